"""Operator 2: benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items and documents are normalised alike - A-Z lower-cased, words joined by
single spaces. Every item window is entered in the automaton by an *anchor*, the
run of ``ANCHOR`` of its words with the least hash, which neighbouring windows
mostly share; so the automaton holds a fraction of the items' text instead of
each word ``WINDOW`` times. A document is scanned once for all anchors, windows
around an anchor's matches are verified by 128-bit hashes of all their words,
and what is found is mapped back to words and to code points of the original.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm import arrays, storage

WINDOW, ANCHOR = 13, 4
#: Nodes of one automaton at most (about 50 bytes each in every worker), and windows that it stands for; what is beyond is scanned for in further passes.
NODES, WINDOWS = 8_000_000, 2_000_000

_tables: dict[str, tuple] = {}
_FACTORS = arrays.mix(np.arange(1, 2 * 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, 64) | np.uint64(1)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the ``size`` words from each start on, from the words' hashes."""
    out = []
    for own in _FACTORS:
        total = np.full(len(starts), size, np.uint64)
        for k in range(size):
            total = arrays.mix(total + hashes[starts + k] * own[k % 64])
        out.append(total.view(np.int64))
    return out[0], out[1]


def windows(text: str | None, size: int = WINDOW) -> list[str]:
    """The distinct windows of an item: each run of ``size`` words, or all words if there are fewer, but not none."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _, _ = arrays.words(data, np.array([0, len(data)]))
    low = arrays.LOWER[data].tobytes() if len(data) else b""
    w = [low[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
    k = min(size, len(w))
    return list(dict.fromkeys(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))) if k else []


ENTRIES = "item string, one long, two long, size int, place int, anchor string"


def _entries(size: int):
    """Rows of items to rows of their windows: two hashes, words, where the anchor begins, and the anchor's words."""

    def entries(batches):
        for batch in batches:
            for part, data, offs in arrays.chunks(batch, "text"):
                starts, ends, hashes, firsts = arrays.words(data, offs)
                low = arrays.LOWER[data].tobytes() if len(data) else b""
                cols = [[], [], [], [], [], []]
                for t, item in enumerate(part.column(0).to_pylist()):
                    a, n = int(firsts[t]), int(firsts[t + 1] - firsts[t])
                    k = min(size, n)
                    if not k:
                        continue
                    m = min(ANCHOR, k)
                    grams = window_hashes(hashes, np.arange(a, a + n - m + 1), m)[0].view(np.uint64)
                    place = np.argmin(np.lib.stride_tricks.sliding_window_view(grams, k - m + 1), axis=1)
                    first = np.arange(a, a + n - k + 1)
                    one, two = window_hashes(hashes, first, k)
                    _, keep = np.unique(np.stack([one, two], 1), axis=0, return_index=True)
                    for col, x in zip(cols, ([item] * len(keep), one[keep], two[keep], [k] * len(keep), place[keep])):
                        col.extend(x)
                    cols[5].extend(b" ".join(low[starts[p + j] : ends[p + j]] for j in range(m)).decode() for p in (first + place)[keep].tolist())
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["item", "one", "two", "size", "place", "anchor"])

    return entries


def _table(own) -> tuple:
    """(automaton, words of each anchor, what windows an anchor stands for, window hashes, their items); one for each worker."""
    key, rows = own.value
    if key not in _tables:
        import ahocorasick

        anchors, back = np.unique(np.array(rows["anchor"].to_pylist(), object), return_inverse=True) if len(rows) else (np.zeros(0, object), np.zeros(0, int))
        one, two, size, place = (rows[c].to_numpy() for c in ("one", "two", "size", "place"))
        a = ahocorasick.Automaton()
        for n, x in enumerate(anchors.tolist()):
            a.add_word(f" {x} ", n)
        if len(anchors):
            a.make_automaton()
        stands = np.unique(np.stack([back, size, place], 1), axis=0) if len(rows) else np.zeros((0, 3), int)
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        at = np.flatnonzero(new)
        items = rows["item"].to_pylist()
        _tables.clear()
        _tables[key] = (a if len(anchors) else None, np.array([x.count(" ") + 1 for x in anchors.tolist()], int), (stands, np.searchsorted(stands[:, 0], np.arange(len(anchors) + 1))), (one[order][at], two[order][at]), [items[i] for i in order.tolist()], np.append(at, len(order)))
    return _tables[key]


def _normalised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> str:
    """All words, each followed by a space; each text begins with a line feed and a space."""
    n, docs = len(starts), len(firsts) - 1
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    body = arrays.LOWER[data[np.cumsum(inside[:-1]).astype(bool)]]
    lengths = ends - starts
    text = np.repeat(np.arange(docs), np.diff(firsts))
    at = np.cumsum(lengths) - lengths + np.arange(n) + 2 * (text + 1)  # where each word goes
    out = np.full(len(body) + n + 2 * docs, 32, np.uint8)
    if n:
        out[np.repeat(at - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(body))] = body
    before = np.concatenate([[0], np.cumsum(lengths + 1)])
    out[before[firsts[:-1]] + 2 * np.arange(docs)] = 10
    return out.tobytes().decode()


def _nulls_last(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


def _found(table: tuple, norm: str, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, window) of every occurrence of a window in a chunk's words."""
    automaton, widths, (stands, first_of), (one, two), _, _ = table
    none = np.zeros(0, int)
    hits = list(automaton.iter(norm))
    if not hits:
        return none, none, none
    points = np.frombuffer(norm.encode("utf-32-le"), np.uint32)
    text_of = np.cumsum(points == 10) - 1
    done = np.cumsum(points == 32)  # a text's first space stands before its first word
    at, which = np.array([e for e, _ in hits]), np.array([k for _, k in hits])
    text = text_of[at]
    begin = done[at] - text - 2 - widths[which] + 1  # index in the chunk of the match's first word
    many = first_of[which + 1] - first_of[which]
    pick = np.repeat(first_of[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    begin, text = np.repeat(begin, many) - stands[pick, 2], np.repeat(text, many)
    size = stands[pick, 1]
    inside = (begin >= firsts[text]) & (begin + size <= firsts[text + 1])
    begin, size = begin[inside], size[inside]
    starts, sizes, which = [none], [none], [none]
    for k in np.unique(size).tolist():
        own = np.unique(begin[size == k])
        a, b = window_hashes(hashes, own, k)
        w = np.searchsorted(one, a)
        w[w == len(one)] = 0
        while len(own):  # windows that share their first hash stand together
            same = one[w] == a
            fine = same & (two[w] == b)
            starts.append(own[fine]), sizes.append(np.full(fine.sum(), k)), which.append(w[fine])
            on = same & ~fine & (w + 1 < len(one))
            own, a, b, w = own[on], a[on], b[on], w[on] + 1
    return np.concatenate(starts), np.concatenate(sizes), np.concatenate(which)


def _scan(own):
    def scan(batches):
        table = _table(own)
        for batch in batches:
            for part, data, offs in arrays.chunks(batch, "text"):
                starts, ends, hashes, firsts = arrays.words(data, offs)
                docs = len(offs) - 1
                hit = np.zeros(len(starts) + 1, np.int32)
                found: dict[int, set[str | None]] = {}
                if table[0] is not None and len(starts):
                    begin, size, which = _found(table, _normalised(data, starts, ends, firsts), hashes, firsts)
                    np.add.at(hit, begin, 1)
                    np.add.at(hit, begin + size, -1)
                    items, first_of = table[4], table[5]
                    for t, k in zip((np.searchsorted(firsts, begin, "right") - 1).tolist(), which.tolist()):
                        found.setdefault(t, set()).update(items[first_of[k] : first_of[k + 1]])
                inside = np.cumsum(hit[:-1]) > 0
                total = arrays.per_text(inside.astype(np.int64), firsts)
                spans, names = [], []
                for t in range(docs):
                    mine, where = found.get(t), []
                    if mine is not None:
                        a, b = firsts[t], firsts[t + 1]
                        s, e = arrays.runs(inside[a:b], np.array([0, b - a]))
                        chars = np.concatenate([[0], np.cumsum((data[offs[t] : offs[t + 1]] & 0xC0) != 0x80)])
                        where = [{"start": int(chars[starts[a + i] - offs[t]]), "end": int(chars[ends[a + j - 1] - offs[t]])} for i, j in zip(s.tolist(), e.tolist())]
                    spans.append(where)
                    names.append(sorted(mine or (), key=_nulls_last))
                spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(firsts)), pa.array(total), pa.array(names, pa.list_(pa.string())), spans], ["id", "text", "n_words", "n_hit", "items", "spans"])

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """Where benchmark windows occur in each text.

    Returns for each input row: ``id_col``, n_words, n_hit (words inside any
    occurrence), items (ids, as sorted strings, of items with occurring windows;
    all items without an id are one null, at the end) and spans (start and end
    of each run of hit words, in code points of the
    original text). A null or empty text has no words; items without words have
    no windows; rows and items may repeat; either table may be empty. Documents
    aren't shuffled. The windows' entries are broadcast; anchors of more than
    ``NODES`` characters, or ``WINDOWS`` windows, are dealt out, by their hash, to as many passes over
    the documents as it takes, so no automaton is larger, whatever one item is.
    An anchor that stands for more than its share of a pass's windows - a stem
    that many questions begin with - is dealt out window by window.
    """
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text].alias("text")).where("text is not null")
    entries = storage.materialise(items.mapInArrow(_entries(size), ENTRIES).distinct(), "entries")
    stands = entries.groupBy("anchor").agg(F.count("*").alias("_n"))
    nodes, windows_ = stands.agg(F.coalesce(F.sum(F.length("anchor") + 2), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    passes = max(1, -(-nodes // NODES), -(-2 * windows_ // WINDOWS) if windows_ > WINDOWS else 1)
    if passes > 1:
        share = max(1, WINDOWS // 16)
        # anchors of more than a sixteenth of a pass's windows: at most 16 a pass
        hot = stands.where(F.col("_n") > share).select("anchor", F.ceil(F.col("_n") / share).alias("_slices"))
        slice_ = F.coalesce(F.pmod(F.col("one"), F.col("_slices")), F.lit(0))
        entries = entries.join(F.broadcast(hot), "anchor", "left").withColumn("_pass", F.pmod(F.xxhash64("anchor", slice_), F.lit(passes))).drop("_slices")
        entries = storage.materialise(entries, "dealt-entries")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, text string, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))

    def table(k: int):
        own = entries.where(F.col("_pass") == k).drop("_pass") if passes > 1 else entries
        return spark.sparkContext.broadcast((uuid.uuid4().hex, own.toArrow()))

    if passes == 1:
        out = src.mapInArrow(_scan(table(0)), schema)
    else:
        parts = None
        src = storage.materialise(src.withColumn("row", F.struct(F.col("id"), F.monotonically_increasing_id().alias("n"))), "scanned")
        for k in range(passes):
            found = src.select(F.col("row").alias("id"), "text").mapInArrow(_scan(table(k)), schema.replace(f"id {kind}", f"id struct<id:{kind},n:long>")).drop("text")
            found = storage.materialise(found, "pass")
            parts = found if parts is None else parts.union(found)
        merged = parts.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # a row for each pass
        union = F.aggregate("spans", F.expr("cast(array() as array<struct<start:long,end:long>>)"), lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(s))))
        merged = merged.withColumn("spans", union).join(src.select(F.col("row").alias("id"), "text"), "id")
        counted = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + F.regexp_count(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long"))
        out = merged.select(F.col("id.id").alias("id"), "n_words", counted.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "spans", "text")
    return (out if keep_text else out.drop("text")).withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", share: int = 20, **names) -> DataFrame:
    """``scan`` with digests: contaminated if any word is hit and at least one in ``share`` words is."""
    found = scan(docs, benchmark, id_col=id_col, **names)
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), "items", "spans"
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", share: int = 20, **names) -> DataFrame:
    """The rows of ``docs``, with all columns, that aren't contaminated; one scan, no join."""
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(rest))).alias("row"), docs[text_col].alias("text"))
    found = scan(src, benchmark, id_col="row", text_col="text", keep_text=True, **names)
    clean = found.where((F.col("n_hit") == 0) | (F.col("n_hit") * share < F.col("n_words")))
    return clean.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.c{rest.index(c)}").alias(c) for c in docs.columns))


def oracle(size: int = WINDOW) -> str:
    """DuckDB SQL for the contract's columns."""
    cut = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {cut} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {cut} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item, w, least({size}, len(w)) AS k, unnest(generate_series(1, len(w) - least({size}, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k AS k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
