"""Operator 1: near-duplicates by weighted MinHash signatures, bands and exact verification.

Texts become multisets of five-word shingles of lower-cased words. Texts with
equal multisets are one *node* from then on. Nodes get a signature
(``bagminhash``), 32 bands of 4 components: a pair of similarity 0.8 shares no
band with a chance of (1 - 0.8**4)**32, about 5e-8. Buckets are settled in two
steps:

1. *Leaders.* Each bucket's most central node is compared with all others of
   the bucket, a row for each pair of nodes. That joins a group of near copies
   of any size with as many comparisons as it has members.
2. *Blocks.* Pairs within a bucket that step 1 left in different components are
   looked at block against block inside a task. First by signatures alone, half
   a kilobyte a node: a pair stays in play if its sizes allow the similarity, if
   no earlier band has it too, and if at least ``AGREE`` components agree (a pair
   of similarity 0.8 has fewer with a chance of 4e-8). Shingle sets go only to
   the nodes of pairs in play, and these are verified exactly, as matrix
   products over shared shingles. Only links that join two components come out,
   so no task emits the pairs of a group.

Hot buckets are dealt out: leaders' members are salted by the size of the group,
blocks hold a bounded number of nodes, and of shingles where they have any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import arrays, storage
from quillgrid.llm import bagminhash as bag
from quillgrid.llm.components import components

SHINGLE, SIMILARITY, SIZE, ROWS = 5, 0.8, 128, 4
#: Nodes and shingles of a block; members of a salted part of a leader's group.
BLOCK_NODES, BLOCK_SHINGLES, PART = 1024, 2_000_000, 2000
#: Of ``SIZE`` components, so many agree in a pair that is looked at further.
AGREE = 77
FAR_ID = 2**63 - 1


def _elements(data: np.ndarray, offs: np.ndarray):
    """(distinct shingles, owners, counts) of a chunk."""
    _, _, hashes, firsts = arrays.words(data, offs)
    return bag.multisets(*arrays.shingles(hashes, firsts, SHINGLE))


def _scan(batches):
    for batch in batches:
        for part, data, offs in arrays.chunks(batch, "text"):
            n = len(offs) - 1
            v, o, c = _elements(data, offs)
            first = np.searchsorted(o, np.arange(n + 1))
            total = arrays.per_text(c, first)
            node = arrays.mix(arrays.per_text(arrays.mix(v) * c.astype(np.uint64), first) + total.astype(np.uint64)).view(np.int64)
            signature = bag.signatures(v, o, c, n, SIZE)
            keys = bag.bands(signature, ROWS)
            some = total > 0
            at = np.concatenate([[0], np.cumsum(some * keys.shape[1])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node), pa.array(total), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[some].ravel())), pa.array([x.tobytes() for x in signature], pa.binary())], ["id", "text_hash", "node", "n", "bands", "signature"])


def _expanded(v: np.ndarray, o: np.ndarray, c: np.ndarray, texts: int) -> list[bytes]:
    """Each text's multiset as an ascending set of 64-bit numbers: a shingle's k-th occurrence is a number of its own.

    Then the size of a set intersection is the multisets' overlap.
    """
    many = np.flatnonzero(c > 1)
    extra = np.repeat(many, c[many] - 1)
    nth = np.arange(len(extra)) - np.repeat(np.cumsum(c[many] - 1) - (c[many] - 1), c[many] - 1) + 1
    v = np.concatenate([v, arrays.mix(v[extra] + nth.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))])
    o = np.concatenate([o, o[extra]])
    order = np.lexsort((v, o))
    v, first = v[order], np.searchsorted(o[order], np.arange(texts + 1))
    return [v[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _sets(batches):
    for batch in batches:
        for part, data, offs in arrays.chunks(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_expanded(*_elements(data, offs), len(offs) - 1), pa.binary())], ["node", "items"])


def _similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int):
    """shared / (a + b - shared) >= 0.8, in whole numbers."""
    return 9 * shared >= 4 * (a + b)


def _against_leader(batches):
    """Rows sorted by (leader, part), the leader's own row first: links of members that are similar to it."""
    own, items = None, None
    for b in batches:
        leaders, parts, nodes, is_member, sets = (b.column(k) for k in range(5))
        a, z = [], []
        for i, (lead, part, node, member) in enumerate(zip(leaders.to_pylist(), parts.to_pylist(), nodes.to_pylist(), is_member.to_pylist())):
            got = np.frombuffer(sets[i].as_buffer(), np.uint64)
            if not member:
                own, items = (lead, part), got
            elif own == (lead, part) and 5 * min(len(got), len(items)) >= 4 * max(len(got), len(items)):
                at = np.searchsorted(items, got)
                at[at == len(items)] = 0
                if _similar(int((items[at] == got).sum()), len(got), len(items)):
                    a.append(lead), z.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])


def _in_play(rows: pa.Table) -> pa.Table:
    """Of one pair of blocks (columns i, j, block, band, node, root, n, signature): the nodes of pairs that need verification."""
    i, j, band = rows["i"][0].as_py(), rows["j"][0].as_py(), rows["band"][0].as_py()
    block, roots, sizes = rows["block"].to_numpy(), rows["root"].to_numpy(), rows["n"].to_numpy()
    signature = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint32).reshape(len(block), SIZE)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b = sizes[left][:, None], sizes[right][None, :]
    want = (roots[left][:, None] != roots[right][None, :]) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))
    agree = np.zeros(want.shape, np.uint8)
    for k in range(SIZE // ROWS):
        together = np.ones(want.shape, bool)
        for c in range(k * ROWS, (k + 1) * ROWS):
            same = signature[left, c][:, None] == signature[right, c][None, :]
            agree += same
            together &= same
        if k < band:
            want &= ~together
    want &= agree >= AGREE
    some = np.zeros(len(block), bool)
    some[left[want.any(1)]] = some[right[want.any(0)]] = True
    return rows.filter(pa.array(some)).drop_columns(["signature"])


def _block_links(rows: pa.Table) -> pa.Table:
    """Links between components of a pair of (pieces of) blocks, 0 and 1 (columns block, node, root, items), enough to join them all."""
    block, nodes, roots = rows["block"].to_numpy(), rows["node"].to_numpy(), rows["root"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["items"]]
    sizes = np.array([len(s) for s in sets])
    left, right = np.flatnonzero(block == 0), np.flatnonzero(block == 1)
    owner = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    df = np.diff(np.append(np.flatnonzero(new), len(items)))
    column = np.cumsum(new) - 1
    keep = df[column] > 1  # an item of one node adds nothing to any overlap
    column, owner = column[keep], owner[keep]
    kinds, column = np.unique(column, return_inverse=True)
    shared = np.zeros((len(left), len(right)), np.float32)
    row_of = np.full(len(sets), -1)
    step = max(1, min(len(kinds), max(64, 8_000_000 // len(sets))))
    bounds = np.searchsorted(column, np.arange(0, len(kinds) + step, step))
    for a, b in zip(bounds[:-1], bounds[1:]):
        sides = []
        for side in (left, right):
            row_of[:] = -1
            row_of[side] = np.arange(len(side))
            r = row_of[owner[a:b]]
            m = np.zeros((len(side), step), np.float32)
            m[r[r >= 0], (column[a:b] % step)[r >= 0]] = 1
            sides.append(m)
        shared += sides[0] @ sides[1].T
    alike = 9 * shared >= 4 * (sizes[left][:, None] + sizes[right][None, :])
    x, y = np.nonzero(alike & (roots[left][:, None] != roots[right][None, :]))
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while (up := parent.get(r, r)) != r:
            parent[r] = parent.get(up, up)
            r = up
        return r

    a, b = [], []
    for p, q in zip(left[x].tolist(), right[y].tolist()):
        if (u := find(int(roots[p]))) != (w := find(int(roots[q]))):
            parent[u] = w
            a.append(int(nodes[p])), b.append(int(nodes[q]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of near-duplicates that each row belongs to.

    Two texts are linked if their multisets of shingles (five consecutive words;
    a text of one to four words has one shingle of them all) have a weighted
    Jaccard similarity of at least 0.8; classes are the connected components.
    Returns for each input row: ``id_col``, class_id (the smallest id of the
    class; null if it has none), class_size (rows), n_shingles, kept (true for
    the one row of each class that stands for it) and text_hash (xxhash64 of the
    text, which with the id tells rows of repeated ids apart). A text without
    words - null and empty ones too - is a class of its own. Exact repetitions
    of a row are all returned and all carry the same ``kept``.

    Distinct multisets are told apart by a 64-bit number; n of them collide with
    a chance of n**2 / 2**65.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    since = storage.mark(docs.sparkSession)
    src = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"), docs[text_col].alias("text"))
    rows = storage.materialise(src.mapInArrow(_scan, f"id {kind}, text_hash long, node long, n long, bands array<long>, signature binary"), "signatures")
    some = rows.where("n > 0")
    row = F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))
    nodes = some.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.min(row).alias("first"))
    nodes = storage.materialise(nodes, "nodes")
    entries = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    shared = storage.materialise(entries.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1"), "buckets")
    entries = storage.materialise(entries.join(shared, "key"), "entries")

    central = entries.groupBy("node").agg(F.sum(F.log2("cnt")).alias("weight"))
    leaders = entries.join(central, "node").groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    leaders = storage.materialise(leaders, "leaders")
    pairs = storage.materialise(entries.join(leaders, "key").where("node <> leader").select("leader", "node").distinct(), "pairs")
    groups = pairs.groupBy("leader").agg(F.count("*").alias("size"))
    parts = storage.materialise(groups.select("leader", F.ceil(F.col("size") / PART).cast("int").alias("parts")), "parts")
    texts = src.where(F.col("text").isNotNull()).select("id", "text_hash", "text")
    wanted = nodes.join(central.select("node"), "node", "left_semi").select("node", F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"))
    found = texts.alias("t").join(wanted.hint("shuffle_hash").alias("w"), F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.text_hash") == F.col("w.text_hash")))
    sets = storage.materialise(found.select("w.node", "t.text").mapInArrow(_sets, "node long, items binary"), "sets", {"parquet.enable.dictionary": "false"})

    members = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "node", F.lit(True).alias("member"))
    lead = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("node"), F.lit(False).alias("member"))
    both = lead.union(members).join(sets, "node").select("leader", "part", "node", "member", "items")
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(width, "leader", "part").sortWithinPartitions("leader", "part", "member")
    links = storage.materialise(both.mapInArrow(_against_leader, "a long, b long"), "links")
    roots = storage.materialise(components(links), "roots")

    placed = entries.join(roots, "node", "left").select("key", "node", "cnt", "n", "band", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    blocks = F.ceil(F.col("cnt") / BLOCK_NODES).cast("int")
    left = placed.join(storage.materialise(mixed, "mixed"), "key", "left_semi").where("cnt > 2").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "node", "root", "n").join(nodes.select("node", "signature"), "node")
    left = left.select("key", "i", "j", "block", "band", "node", "root", "n", "signature")
    play = left.groupBy("key", "i", "j").applyInArrow(_in_play, "key long, i int, j int, block int, band int, node long, root long, n long")
    play = storage.materialise(play, "in-play")
    load = play.groupBy("key", "i", "j").agg(F.sum("n").alias("load"))
    pieces = F.ceil(F.col("load") / BLOCK_SHINGLES).cast("int")  # of each side, where a pair of blocks has too many shingles for one task
    play = play.join(load, ["key", "i", "j"]).withColumn("pieces", pieces).withColumn("piece", F.pmod(F.xxhash64("node", F.lit(1)), "pieces").cast("int"))
    play = play.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    first = play.where("block = i").select("key", "i", "j", F.col("piece").alias("p"), F.col("other").alias("q"), "node", "root", F.lit(0).alias("block"))
    second = play.where("block = j").select("key", "i", "j", F.col("other").alias("p"), F.col("piece").alias("q"), "node", "root", F.lit(1).alias("block"))
    both = first.union(second).join(sets, "node").select("key", "i", "j", "p", "q", "block", "node", "root", "items")
    more = both.groupBy("key", "i", "j", "p", "q").applyInArrow(_block_links, "a long, b long")
    more = storage.materialise(more, "links")
    if not more.isEmpty():
        stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = storage.materialise(components(more.union(stars)), "roots")

    known = nodes.join(roots, "node", "left").select("node", "least", "copies", "first", F.coalesce("root", "node").alias("root"))
    classes = known.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.min("first").alias("first"))
    named = storage.materialise(known.select("node", "root").join(classes, "root"), "classes")
    storage.free(docs.sparkSession, since, ("signatures", "classes"))
    out = rows.select("id", "text_hash", F.when(F.col("n") > 0, F.col("node")).alias("node"), "n").join(named, "node", "left")
    alone = F.col("root").isNull()
    is_first = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.text_hash") == F.col("text_hash"))
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.col("n").alias("n_shingles"), F.when(alone, True).otherwise(is_first).alias("kept"), "text_hash"
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that stand for their class; of exact repetitions of a row, one stays."""
    key = lambda i, h: F.xxhash64(F.coalesce(i.cast("string"), F.lit("")), h)
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col).where("kept").groupBy(F.col(id_col).alias("id"), "text_hash").agg(F.count("*").alias("times"))
    kept = storage.materialise(kept.withColumn("key", key(F.col("id"), F.col("text_hash"))), "kept")
    names = docs.columns
    src = docs.select(F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(names))).alias("row"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("text_hash"))
    src = src.withColumn("key", key(F.col("id"), F.col("text_hash"))).alias("d")
    same = (F.col("d.key") == F.col("k.key")) & F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.text_hash") == F.col("k.text_hash"))
    out = src.join(kept.where("times = 1").alias("k").hint("shuffle_hash"), same, "left_semi").select("row")
    again = kept.where("times > 1")
    if not again.isEmpty():
        more = src.join(again.alias("k").hint("shuffle_hash"), same, "left_semi").groupBy("id", "text_hash").agg(F.first("row").alias("row"))
        out = out.union(more.select("row"))
    return out.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)))
