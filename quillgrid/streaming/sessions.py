"""Sessions as a stream: context windows kept up by a stateful processor, from micro-batch to micro-batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: What is kept of a session: the window it is in, its rows and characters so far, and the time at which it expires (0: never).
STATE = StructType([StructField("number", IntegerType()), StructField("rows", IntegerType()), StructField("characters", LongType()), StructField("expires", LongType())])
ROW, CLOSED = "row", "closed"


class Windows(StatefulProcessor):
    """The window of each row of a session. A session that is idle for ``idle`` milliseconds is closed and forgotten; 0 keeps it."""

    def __init__(self, session: str, order: str, rows: int, characters: int, idle: int = 0):
        self.session, self.order, self.most_rows, self.most_characters, self.idle = session, order, rows, characters, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, have, chars, expires = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        # a micro-batch's rows of one session, in their order; their texts stay behind
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable", na_position="first")
        out = []
        for n in batch["size"]:
            if have and (have >= self.most_rows or chars > self.most_characters):
                number, have, chars = number + 1, 0, 0
            have, chars = have + 1, chars + int(n)
            out.append(number)
        if self.idle:
            if expires:
                self.handle.deleteTimer(expires)
            expires = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(expires)
        self.state.update((number, have, chars, expires))
        yield pd.DataFrame({self.session: [key[0]] * len(out), self.order: batch[self.order].to_numpy(), "context": pd.Series(out, dtype="int32"), "event": ROW})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number = self.state.get()[0]
        self.state.clear()
        yield pd.DataFrame({self.session: [key[0]], self.order: pd.Series([None], dtype="Int64"), "context": pd.Series([number], dtype="int32"), "event": [CLOSED]})

    def close(self) -> None:
        pass


def context_windows(stream: DataFrame, session: str, order: str, text: str, rows: int, characters: int, idle: int = 0) -> DataFrame:
    """(session, order, context, event) of a stream's rows; ``event`` is "closed" for a session that expired, with its last window.

    Rows of a session have to come in order from batch to batch; within a batch
    they are sorted. What is shuffled and kept is sizes, not texts; the state of a
    session is four numbers, however long it is. Needs the RocksDB state store.
    """
    light = stream.select(session, order, F.length(F.coalesce(text, F.lit(""))).alias("size"))
    kinds = {f.name: f.dataType for f in light.schema}
    schema = StructType([StructField(session, kinds[session]), StructField(order, kinds[order]), StructField("context", IntegerType()), StructField("event", StringType())])
    return light.groupBy(session).transformWithStateInPandas(statefulProcessor=Windows(session, order, rows, characters, idle), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if idle else "None")


#: The state store that the processor needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(stream: DataFrame, path: str, checkpoint: str, timers: bool = False) -> None:
    """Process all that is there as Parquet, exactly once, and stop; the checkpoint lets the next call go on.

    With ``timers`` (sessions that expire) it is one batch: processing time never
    stops, so a run until nothing is left to do would not end.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STORE[0], None)
    conf.set(*STORE)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**({"once": True} if timers else {"availableNow": True})).start().awaitTermination()
    finally:
        conf.set(STORE[0], before) if before else conf.unset(STORE[0])
