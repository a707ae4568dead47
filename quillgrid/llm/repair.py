"""Conversation structure repair: the cheapest edits that make roles alternate, by a rank-compressed dynamic program.

A repaired conversation has the role initials ``(s?(ua)+)?``. Four states say how
far such a sequence has come. One row makes one *macro edit*: a run of inserted
turns and then what becomes of the row (keep, rerole, delete). Macro edits are
words over D < I < K < R of which none begins another (each ends in its only
letter that isn't I), so of two audits over the same rows the ASCII-least is the
one whose first differing macro edit is less. A layer therefore needs no audit
strings: for each state it has the least cost, the *rank* of its best audit among
the layer's states, and a parent pointer with the macro edit. The next layer's
ranks come from pairs (parent's rank, macro edit), and the audit is read off the
pointers in the end.

The program composes: the layers of a *piece* of a conversation are a table of
4 x 4 costs and ranks, whatever came before. A conversation that is too long for
one task is cut into pieces by ranges, each gets its table in a task of its own,
the tables are chained, and each piece is then traced between the two states that
the chain gives it. Only the hash of a whole conversation reads its rows in one
sequence, as any hash does, and it holds one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillgrid.llm import storage

#: Rows, and characters, beyond which a conversation is cut into pieces.
LONG_ROWS, LONG_CHARS = 10_000, 1 << 25
WHITE = " \t\n\x0b\x0c\r"
ROLES = ("user", "assistant")

# States: nothing yet, a system turn, a user turn open, a pair closed.
_NONE, _SYSTEM, _OPEN, _CLOSED = range(4)
#: Where an inserted or reroled turn leads, and where a kept initial does.
_NEXT = (_OPEN, _OPEN, _CLOSED, _OPEN)
_KEEP = ({"s": _SYSTEM, "u": _OPEN}, {"u": _OPEN}, {"a": _CLOSED}, {"u": _OPEN})
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
_MACROS = sorted("I" * k + e for k in range(3) for e in "DKR")
_ORDER = {m: k for k, m in enumerate(_MACROS)}
_FAR = 1 << 60
#: What the program sees of a row: its initial, and whether it must go or ends unfinished.
_INITIALS, _FAULTS = "sua-", ("", "truncated", "gone")


def row_class(initial: str, fault: str) -> str:
    """One letter for a row: all that the program knows of it."""
    i = _INITIALS.find(initial) if initial else 3
    return chr(97 + (i if i >= 0 else 3) * 3 + {"": 0, "truncated": 1}.get(fault, 2))


def _moves(letter: str) -> list[list[tuple[int, int, int]]]:
    """For each state the (state before, cost, macro edit) that lead there. A run of inserts never comes back to a state, as that costs more."""
    k = ord(letter) - 97
    initial, fault = _INITIALS[k // 3], k % 3
    out: list[list[tuple[int, int, int]]] = [[], [], [], []]
    for start in range(4):
        state = start
        for n in range(3):
            run = "I" * n
            out[state].append((start, INSERT * n + DELETE, _ORDER[run + "D"]))
            if fault < 2:
                if initial in _KEEP[state]:
                    out[_KEEP[state][initial]].append((start, INSERT * n + KEEP + UNFINISHED * fault, _ORDER[run + "K"]))
                out[_NEXT[state]].append((start, INSERT * n + REROLE + UNFINISHED * fault, _ORDER[run + "R"]))
            state = _NEXT[state]
    return out


_MOVES = {chr(97 + k): _moves(chr(97 + k)) for k in range(12)}


def layers(classes: str, start: int) -> tuple[list[int], list[int], list[list[tuple[int, int] | None]]]:
    """Costs and ranks of the four states after all rows, and each layer's parent pointers (state before, macro edit)."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[start] = 0
    pointers: list[list[tuple[int, int] | None]] = []
    for letter in classes:
        now, came = [_FAR] * 4, [None] * 4
        for state, moves in enumerate(_MOVES[letter]):
            best = None
            for before, price, macro in moves:
                if cost[before] < _FAR:
                    key = (cost[before] + price, rank[before], macro, before)
                    if best is None or key < best:
                        best = key
            if best:
                now[state], came[state] = best[0], (best[3], best[2])
        order = sorted((rank[c[0]], c[1]) for c in came if c)
        rank = [order.index((rank[c[0]], c[1])) if c else 0 for c in came]
        cost = now
        pointers.append(came)
    return cost, rank, pointers


def _tails(cost: list[int], rank: list[int]) -> tuple[int, int, int, int]:
    """(cost, rank, inserts at the end, state before them) of the best end."""
    ends = [(cost[s] + INSERT * n, rank[s], n, s) for s, n in ((_NONE, 0), (_NONE, 2), (_SYSTEM, 2), (_OPEN, 1), (_CLOSED, 0)) if cost[s] < _FAR]
    return min(ends)


def trace(pointers, end: int) -> list[str]:
    """The macro edit of each row, from the pointers that lead to ``end``."""
    out = []
    for came in reversed(pointers):
        end, macro = came[end]
        out.append(_MACROS[macro])
    return out[::-1]


@lru_cache(1 << 15)
def _short(classes: str) -> tuple[int, tuple[str, ...]]:
    return _solve(classes)


def _solve(classes: str) -> tuple[int, tuple[str, ...]]:
    cost, rank, pointers = layers(classes, _NONE)
    total, _, n, end = _tails(cost, rank)
    return total, (*trace(pointers, end), "I" * n)


def solve(classes: str) -> tuple[int, tuple[str, ...]]:
    """The least cost and, for each row, its macro edit; the last item has the turns inserted after all rows."""
    return _short(classes) if len(classes) <= 64 else _solve(classes)


def play(edits: Iterator[tuple[str, str | None, str | None]]) -> Iterator[tuple[str, str, str, bool]]:
    """(edit, role, text, whether it is one of the rows) of every turn, the deleted ones too, from (macro edit, role, text) in order."""
    state = _NONE
    for macro, role, text in edits:
        for e in macro:
            made = ROLES[state == _OPEN]
            if e == "I":
                yield "I", made, "", False
                state = _NEXT[state]
            elif e == "D":
                yield "D", role, text, True
            else:
                state = _KEEP[state][role[:1]] if e == "K" else _NEXT[state]
                yield e, role if e == "K" else made, text, True


def damage(rows: DataFrame) -> DataFrame:
    """The contract's faults, by crc32 of ``conv_id:turn`` modulo 20, in conv_id, turn, role, text and dropped.

    A null is one space in the key, in a role and in a text; ids and turns stay
    null. A row that goes keeps its place as ``dropped``, so that a conversation
    which loses all rows is still known.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), h.alias("_h"))
    text = F.when(F.col("_h") < 2, "").when(F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    r = r.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_h") == 0).alias("dropped"), F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return r.drop("_copy")


def prepare(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as they are, in the columns that ``report`` and ``turns`` read; null roles and texts are empty."""
    return rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))], F.lit(False).alias("dropped"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_LEGAL = ("su", "ua", "au")


def _schema(kind: T.DataType, report: bool) -> T.StructType:
    long_, text = T.LongType(), T.StringType()
    names = [("gaps", long_), *((c, long_) for c in _COUNTS), ("cost", long_), ("audit", text), ("repaired_sha256", text)] if report else [("place", long_), ("turn", long_), ("edit", text), ("role", text), ("text", text)]
    return T.StructType([T.StructField("conv_id", kind), *(T.StructField(n, t) for n, t in names)])


def _conversations(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(conv_id, its rows) of sorted batches; rows are read as they are asked for, and only once."""
    def every():
        for b in batches:
            yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns))

    for key, rows in groupby(every(), key=lambda r: (r[0] is None, r[0])):
        yield key[1], (r[1:] for r in rows)


def _written(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, chars: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= size or n >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)


def fault_of(role: str, text: str, seen: set[tuple[str, str]]) -> str:
    """A row's first fault, given the rows seen before it, to which it is added."""
    end = text.rstrip(WHITE)
    if not end:
        return "blank"
    if (role, text) in seen:
        return "duplicate"
    seen.add((role, text))
    return "" if end[-1] in ".!?" else "truncated"


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _whole(schema: pa.Schema, report: bool):
    """Conversations that one task holds as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for conv, rows in _conversations(batches, ("conv_id", "turn", "role", "text", "dropped")):
                rows = [r[:3] for r in rows if not r[3]]
                seen: set[tuple[str, str]] = set()
                faults = [fault_of(role, text, seen) for _, role, text in rows]
                cost, macros = solve("".join(row_class(r[1][:1], f) for r, f in zip(rows, faults)))
                played = play(iter([(m, r[1], r[2]) for m, r in zip(macros, [*rows, (None, None, None)])]))
                if report:
                    lines = "\n".join(f"{role}:{text}" for e, role, text, _ in played if e != "D")
                    illegal = sum(a[1][:1] + b[1][:1] not in _LEGAL for a, b in zip(rows, rows[1:]))
                    yield (conv, _gaps([r[0] for r in rows]), *(faults.count(f) for f in _COUNTS[:3]), illegal, cost, "".join(macros), hashlib.sha256(lines.encode()).hexdigest())
                else:
                    own = iter(rows)
                    for place, (e, role, text, is_row) in enumerate(played):
                        yield conv, place, next(own)[0] if is_row else None, e, role, text

        yield from _written(every(), schema)

    return run


# --- conversations in pieces ---

_PIECE = "piece int, n long, blank long, duplicate long, truncated long, illegal long, head string, last string, costs array<long>, ranks array<int>"
_SPAN = "piece int, start int, finish int, tail int, cost long, illegal long"


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, piece, counts, initials of its ends, costs and ranks from each state to each) of each piece."""
    for conv, rows in _conversations(batches, ("conv_id", "piece", "initial", "fault")):
        # a piece lies in one task, which may have several of one conversation
        for piece, own in groupby(rows, key=lambda r: r[0]):
            letters, count, illegal, head, last = [], dict.fromkeys(_COUNTS[:3], 0), 0, None, None
            for _, initial, fault in own:
                letters.append(row_class(initial, fault))
                if fault:
                    count[fault] += 1
                illegal += last is not None and last + initial not in _LEGAL
                head, last = initial if head is None else head, initial
            classes = "".join(letters)
            ends = [_ends(classes, s) for s in range(4)]
            yield conv, piece, len(classes), *count.values(), illegal, head, last, [c for e in ends for c in e[0]], [r for e in ends for r in e[1]]


def _ends(classes: str, start: int) -> tuple[list[int], list[int]]:
    """``layers`` without pointers."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[start] = 0
    for at in range(0, len(classes), 4096):
        part = classes[at : at + 4096]
        tables = [layers(part, s)[:2] if cost[s] < _FAR else None for s in range(4)]
        cost, rank, _ = _chain(cost, rank, tables)
    return cost, rank


def _chain(cost, rank, tables):
    """Costs and ranks after a piece whose (costs, ranks) from each state are given, and the state before each."""
    now, came = [_FAR] * 4, [None] * 4
    for state in range(4):
        keys = [(cost[s] + tables[s][0][state], rank[s], tables[s][1][state], s) for s in range(4) if cost[s] < _FAR and tables[s] and tables[s][0][state] < _FAR]
        if keys:
            best = min(keys)
            now[state], came[state] = best[0], best
    order = sorted((c[1], c[2]) for c in came if c)
    return now, [order.index((c[1], c[2])) if c else 0 for c in came], [c[3] if c else None for c in came]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The states between which each piece is traced; the last piece has the turns inserted at the end, the first the total cost and the breaks between pieces."""
    for conv, pieces in _conversations(batches, ("conv_id", "piece", "costs", "ranks", "head", "last")):
        cost, rank = [0, _FAR, _FAR, _FAR], [0] * 4
        before, names, breaks, last = [], [], 0, None
        for piece, costs, ranks, head, end in pieces:
            cost, rank, came = _chain(cost, rank, [(costs[4 * s : 4 * s + 4], ranks[4 * s : 4 * s + 4]) for s in range(4)])
            before.append(came)
            names.append(piece)
            breaks += last is not None and last + head not in _LEGAL
            last = end
        total, _, tail, state = _tails(cost, rank)
        out = []
        for k in range(len(names) - 1, -1, -1):
            start = before[k][state]
            out.append((conv, names[k], start, state, tail if k == len(names) - 1 else 0, total if not k else 0, breaks if not k else 0))
            state = start
        yield from out[::-1]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(at, macro edit, turns inserted behind the conversation) of the rows of each piece."""
    for _, rows in _conversations(batches, ("conv_id", "piece", "at", "initial", "fault", "start", "finish", "tail")):
        for _, own in groupby(rows, key=lambda r: r[0]):
            ats, letters = [], []
            for _, at, initial, fault, start, finish, tail in own:
                ats.append(at)
                letters.append(row_class(initial, fault))
            macros = trace(layers("".join(letters), start)[2], finish)
            for k, at in enumerate(ats):
                yield at, macros[k], "I" * tail if k == len(ats) - 1 else ""


def _apply(df: DataFrame, rows, schema: T.StructType) -> DataFrame:
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: _written(rows(batches), arrow), schema)


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, audit, hash) of conversations of any length: one row is held at a time."""
    for conv, rows in _conversations(batches, ("conv_id", "role", "text", "macro", "tail")):
        audit, digest, first = [], hashlib.sha256(), True

        def steps(rows=rows, audit=audit):
            for role, text, macro, tail in rows:
                audit.append(macro + tail)
                yield macro, role, text
                if tail:
                    yield tail, None, None

        for e, role, text, _ in play(steps()):
            if e != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        yield conv, "".join(audit), digest.hexdigest()


def _in_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their macro edits, pieces, spans) of long conversations."""
    kind = rows.schema["conv_id"].dataType
    made = lambda text: T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(text).fields])
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    at = rows.where("not dropped").drop("dropped").repartitionByRange(*order).sortWithinPartitions(*order)
    at = storage.materialise(at.withColumn("at", F.monotonically_increasing_id()).withColumn("piece", F.spark_partition_id()), "long-rows")
    end = F.regexp_replace("text", "[\\x20\\x09-\\x0D]+\\z", "")
    blank = F.length(end) == 0
    first = at.where(~blank).groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(blank, "blank").when(F.col("first").isNull(), "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    seen = storage.materialise(at.join(first, "at", "left").select("conv_id", "piece", "at", F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "long-faults")
    pieces = storage.materialise(_apply(seen.repartition("piece").sortWithinPartitions("at"), _tables, made(_PIECE)), "pieces")
    spans = storage.materialise(_apply(pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "piece"), _spans, made(_SPAN)), "spans")
    own = spans.select(F.col("conv_id").alias("_c"), F.col("piece").alias("_p"), "start", "finish", "tail")
    traced = seen.join(own, (F.col("piece") == F.col("_p")) & F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c", "_p")
    edits = _apply(traced.repartition("piece").sortWithinPartitions("at"), _edits, T._parse_datatype_string("at long, macro string, tail string"))
    return at.join(edits, "at"), pieces, spans


def _by_length(rows: DataFrame, most_rows: int, most_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of conversations that fit one task, rows of the others or None). The others are so few that their ids can be counted and sent to all tasks, or are joined."""
    size = rows.groupBy("conv_id").agg(F.count("*").alias("_n"), F.sum(F.length("text").cast("long")).alias("_chars"))
    big = storage.materialise(size.where((F.col("_n") > most_rows) | (F.col("_chars") > most_chars)).select(F.col("conv_id").alias("_big")), "long-conversations")
    n = big.count()
    if not n:
        return rows, None
    big = F.broadcast(big) if n <= 10_000 else big
    same = F.col("conv_id").eqNullSafe(F.col("_big"))
    return rows.join(big, same, "left_anti"), rows.join(big, same, "left_semi")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def report(rows: DataFrame, most_rows: int = LONG_ROWS, most_chars: int = LONG_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation.

    ``rows`` comes from ``prepare`` or ``damage``. A null conv_id is a conversation
    like any other. Rows are taken by turn, nulls first, rows of one turn by role
    and text; equal rows are interchangeable. A conversation without rows (all
    dropped) has zeros, an empty audit and the hash of an empty text; an empty
    table gives an empty one.
    """
    schema = _schema(rows.schema["conv_id"].dataType, True)
    few, many = _by_length(rows, most_rows, most_chars)
    out = _grouped(few).mapInArrow(_whole(to_arrow_schema(schema), True), schema)
    if many is None:
        return out
    edited, pieces, spans = _in_pieces(many)
    kept = many.where("not dropped")
    gaps = kept.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0).cast("long")).alias("gaps"))
    counts = pieces.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    total = spans.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("_between"))
    sums = _apply(edited.select("conv_id", "at", "role", "text", "macro", "tail").repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at"), _sum_up, T.StructType([schema["conv_id"], schema["audit"], schema["repaired_sha256"]]))
    all_ids = many.select("conv_id").distinct()
    for part in (gaps, counts, total, sums):
        part = part.withColumnRenamed("conv_id", "_c")
        all_ids = all_ids.join(part, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    long_ = all_ids.select("conv_id", zero(F.col("gaps")).alias("gaps"), *[zero(F.col(c)).alias(c) for c in _COUNTS[:3]], zero(F.col("illegal") + F.col("_between")).alias("illegal"), zero(F.col("cost")).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    return out.unionByName(long_)


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The turns of conversations in pieces, one row held at a time."""
    for conv, rows in _conversations(batches, ("conv_id", "at", "turn", "role", "text", "macro", "tail")):
        held: list[tuple[int, int | None]] = []

        def steps(rows=rows, held=held):
            for at, turn, role, text, macro, tail in rows:
                held[:] = [(at, turn)]
                yield macro, role, text
                if tail:
                    yield tail, None, None

        for place, (e, role, text, is_row) in enumerate(play(steps())):
            yield conv, place, held[0][1] if is_row else None, e, role, text


def turns(rows: DataFrame, most_rows: int = LONG_ROWS, most_chars: int = LONG_CHARS) -> DataFrame:
    """conv_id, place, turn, edit, role and text of every turn after repair, deleted ones (edit D) too; inserted ones have no turn."""
    schema = _schema(rows.schema["conv_id"].dataType, False)
    few, many = _by_length(rows, most_rows, most_chars)
    out = _grouped(few).mapInArrow(_whole(to_arrow_schema(schema), False), schema)
    if many is None:
        return out
    edited, _, _ = _in_pieces(many)
    return out.union(_apply(edited.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at"), _turn_rows, schema))
