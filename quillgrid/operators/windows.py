"""Context windows of long sessions, by pointer doubling.

A window begins where the one before it is full, so windows form a chain that
looks sequential. But where the next window *would* begin, if one began at a
given row, follows from prefix sums alone: a pointer of each row. The windows
that do begin are the rows reached from the session's first row, which
doubling finds in as many rounds as the logarithm of their number.

A session is cut into blocks of rows. A block's task follows the pointers within
it, and what doubling sees is one row for each place where a window may enter a block,
so a session of any length is spread over tasks, and its rows aren't shuffled in each round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.sources import tables as S

#: Rows of a block; at least four times those that a window may have.
BLOCK = 4096
#: A window of more rows than this isn't cut: its session is one group (``walk``).
LONGEST = 1 << 16


def numbered(df: DataFrame, session: str, order: str, size: str) -> DataFrame:
    """(session, _at, _i, _p): each row's number and the sizes before it in its session, from 0, by ranges of (session, order, _tie).

    ``df`` has the columns named, _at (increasing in that order) and _piece (a
    task's range). Sums within a piece are added up; the pieces before it are one
    row each, and only of sessions that lie in several, at most two a piece.
    """
    pieces = df.groupBy(session, "_piece").agg(F.count("*").alias("_rows"), F.sum(size).alias("_sum"))
    before = Window.partitionBy(session).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    earlier = pieces.select(session, "_piece", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before")).where("_rows_before > 0")
    own = Window.partitionBy("_piece", session).orderBy("_at")
    rows = df.withColumns({"_i": F.row_number().over(own).cast("long") - 1, "_p": F.coalesce(F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    e = earlier.select(F.col(session).alias("_s"), F.col("_piece").alias("_q"), "_rows_before", "_sum_before")
    out = rows.join(F.broadcast(e), rows[session].eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_q")), "left")
    return out.select(session, "_at", (F.col("_i") + F.coalesce("_rows_before", F.lit(0))).alias("_i"), (F.col("_p") + F.coalesce("_sum_before", F.lit(0))).alias("_p"), size)


def pointers(before: np.ndarray, rows: int, characters: int) -> np.ndarray:
    """Where the next window begins if one begins at a row: after ``rows`` rows, or behind the first one that makes it more than ``characters`` long. ``before``: sizes before each row."""
    n = np.arange(len(before))
    return np.minimum(n + rows, np.searchsorted(before, before + characters, "right"))


def _entries(session: str, rows: int, characters: int, block: int):
    """For each place where a window may enter a block: where the chain leaves it, and how many windows begin on the way."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        first, own = int(pdf["_i"].iloc[0]), int((~pdf["_guest"]).sum())
        to = pointers(pdf["_p"].to_numpy(), rows, characters)
        leave, count = np.arange(len(to) + rows + 1), np.zeros(len(to) + rows + 1, np.int64)
        for k in range(own - 1, -1, -1):
            leave[k], count[k] = leave[to[k]], count[to[k]] + 1
        places = np.arange(min(own, rows if first else 1))
        return pd.DataFrame({session: [pdf[session].iloc[0]] * len(places), "_e": first + places, "_to": first + leave[places], "_n": count[places]})

    return run


def _contexts(rows: int, characters: int):
    """The window of each row of a block, given where the first one begins in it and its number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        own = int((~pdf["_guest"]).sum())
        to = pointers(pdf["_p"].to_numpy(), rows, characters)
        at, number = int(pdf["_e"].iloc[0] - pdf["_i"].iloc[0]), int(pdf["_number"].iloc[0])
        begins = np.zeros(own, np.int64)
        while at < own:
            begins[at] = 1
            at = int(to[at])
        return pd.DataFrame({"_at": pdf["_at"].to_numpy()[:own], "context": (number - 1 + np.cumsum(begins)).astype("int32")})

    return run


def chain(jumps: DataFrame, session: str) -> DataFrame:
    """(session, _e, _number): the entries reached from 0, and the session's end, and how many windows begin before them.

    ``jumps`` has, for each entry, the next one and the windows in between. In
    each round the reached entries jump as far as all rounds before together, and
    jumps are joined with themselves.
    """
    jumps = S.kept(jumps, "jumps")
    reached = jumps.where("_e = 0").select(session, "_e", F.lit(0).cast("long").alias("_number"))
    fresh = reached = S.kept(reached, "reached")
    while True:
        j = jumps.withColumnsRenamed({session: "_s", "_e": "_from"})
        on = reached[session].eqNullSafe(F.col("_s")) & (F.col("_e") == F.col("_from"))
        fresh = S.kept(reached.join(j, on).select(session, F.col("_to").alias("_e"), (F.col("_number") + F.col("_n")).alias("_number")), "reached")
        if fresh.isEmpty():
            return reached
        reached = reached.union(fresh)
        left, right = jumps, jumps.withColumnsRenamed({session: "_s", "_e": "_from", "_to": "_then", "_n": "_m"})
        twice = left.join(right, left[session].eqNullSafe(F.col("_s")) & (F.col("_to") == F.col("_from")))
        jumps = S.kept(twice.select(session, "_e", F.col("_then").alias("_to"), (F.col("_n") + F.col("_m")).alias("_n")), "jumps")


def context_windows(df: DataFrame, session: str, order: str, text: str, rows: int, characters: int, block: int = BLOCK) -> DataFrame:
    """Adds ``context``: the number of the window that a row lies in, from 0 in each session.

    A new window begins after ``rows`` rows, or behind a row that makes the window more than
    ``characters`` long. Rows of a session are taken by ``order``, nulls first,
    and then by all columns, so equal rows are interchangeable. A null text has
    no characters; a null session is one.
    """
    if rows > LONGEST:
        return walk(df, session, order, text, rows, characters)
    block = max(block, 4 * rows)
    names = df.columns
    tie = F.xxhash64(*(F.col(c) for c in names))
    by = [F.col(session), F.col(order).asc_nulls_first(), F.col("_tie")]
    dealt = df.withColumn("_tie", tie).repartitionByRange(*by).sortWithinPartitions(*by)
    base = S.kept(dealt.withColumns({"_at": F.monotonically_increasing_id(), "_piece": F.spark_partition_id()}).drop("_tie"), "sessions")
    n = numbered(base.select(session, "_at", "_piece", F.length(F.coalesce(text, F.lit(""))).cast("long").alias("_size")), session, order, "_size")
    n = n.select(session, "_at", "_i", "_p", F.floor(F.col("_i") / block).cast("long").alias("_block"))
    ahead = n.where((F.col("_block") > 0) & (F.col("_i") % block <= rows)).withColumns({"_block": F.col("_block") - 1, "_guest": F.lit(True)})
    n = S.kept(n.withColumn("_guest", F.lit(False)).unionByName(ahead), "blocks")
    kind = dict(df.dtypes)[session]
    jumps = n.groupBy(session, "_block").applyInPandas(_entries(session, rows, characters, block), f"`{session}` {kind}, _e long, _to long, _n long")
    long_ = n.where("_block > 0").select(F.col(session).alias("_s")).distinct()
    entered = chain(jumps.join(long_, jumps[session].eqNullSafe(F.col("_s")), "left_semi"), session)
    # sessions of one block begin at 0
    # (or, like a last block in which none begins, have no entry but the session's end)
    starts = entered.groupBy(F.col(session).alias("_s"), F.floor(F.col("_e") / block).cast("long").alias("_b")).agg(F.min(F.struct("_e", "_number")).alias("_f")).select("_s", "_b", "_f.*")
    placed = n.join(starts, n[session].eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")), "left").withColumns({"_e": F.coalesce("_e", F.lit(0)), "_number": F.coalesce("_number", F.lit(0))})
    found = placed.groupBy(session, "_block").applyInPandas(_contexts(rows, characters), "_at long, context int")
    return base.join(found, "_at").select(*names, "context")


def walk(df: DataFrame, session: str, order: str, text: str, rows: int, characters: int) -> DataFrame:
    """``context_windows`` row by row, a session in one task: for windows whose number of rows has no useful bound."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable", na_position="first")
        number = have = chars = 0
        out = []
        for t in pdf[text].fillna(""):
            if have and (have >= rows or chars > characters):
                number, have, chars = number + 1, 0, 0
            have, chars = have + 1, chars + len(t)
            out.append(number)
        return pdf.assign(context=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", context int"
    return df.groupBy(session).applyInPandas(run, schema)
