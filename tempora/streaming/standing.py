"""What stands of each unit, kept as a stream: texts, repeals and withdrawals in any order, each from its own date on.

A unit's changes are its state. As the watermark passes a change's date, or a change comes late for its date, what stands is
worked out again; a row is given out where it differs. Withdrawing a change takes it out, so that what it ended stands again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Changes: of a unit (not null), by an id of its own, from a date; a withdrawal names the id that it withdraws.
CHANGES = "unit string, id string, kind string, valid_from timestamp, target string, ts timestamp"
#: n numbers what a unit gave out; id is the text or repeal that counts.
STANDING = "unit string, n bigint, status string, id string"
#: Such state needs a store that keeps single entries.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Standing(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getMapState("changes", "id string", "kind string, valid_ms bigint")
        self.withdrawn = handle.getMapState("withdrawn", "id string", "valid_ms bigint")
        self.given = handle.getValueState("given", "n bigint, status string, id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples(index=False):
                at = r.valid_from
                if r.kind == "withdraw":
                    if not self.withdrawn.containsKey((r.target,)) or at < self.withdrawn.getValue((r.target,))[0]:
                        self.withdrawn.updateValue((r.target,), (at,))
                else:
                    self.changes.updateValue((r.id,), (r.kind, at))
        yield from self._judge(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judge(key, timerValues.getCurrentWatermarkInMs())

    def _judge(self, key, now: int) -> Iterator[pd.DataFrame]:
        out = {k[0]: v[0] for k, v in self.withdrawn.iterator()}
        rows = [(v[1], k[0], v[0]) for k, v in self.changes.iterator()]
        live = [r for r in rows if r[0] <= now and out.get(r[1], now + 1) > now]
        _, which, kind = max(live, default=(None, None, None))
        status = {"text": "in_force", "repeal": "repealed"}.get(kind, "none")
        last = self.given.get() if self.given.exists() else (0, "none", None)
        if (status, which) != (last[1], last[2]):
            self.given.update((last[0] + 1, status, which))
            yield pd.DataFrame({"unit": [key[0]], "n": [last[0] + 1], "status": [status], "id": [which]})
        coming = [at for at in (*(r[0] for r in rows), *out.values()) if at > now]
        if coming:
            self.handle.registerTimer(min(coming))

    def close(self) -> None:
        pass


def standing(changes: DataFrame, late: str) -> DataFrame:
    """The stream of what stands (STANDING), as of the watermark: `late` behind the newest ts. Later rows are dropped.

    Of a unit's changes that aren't withdrawn as of then, the one of the latest date counts, ties to the greater id: a text is
    in force, a repeal repeals. Dates must not be null. Repeated changes count once; ids must not be used for two changes.
    """
    # Moments travel as milliseconds: in pandas they would be wall time of the session.
    rows = changes.withWatermark("ts", late).withColumn("valid_from", F.unix_millis("valid_from"))
    return rows.groupBy("unit").transformWithStateInPandas(Standing(), STANDING, "Append", "EventTime")


def standing_at(changes: DataFrame, as_of) -> DataFrame:
    """(unit, status, id) of all changes as of a moment (a column), at once: what the stream has given out last by then."""
    gone = changes.where((F.col("kind") == "withdraw") & (F.col("valid_from") <= as_of)).select("unit", F.col("target").alias("id")).distinct()
    live = changes.where((F.col("kind") != "withdraw") & (F.col("valid_from") <= as_of)).join(gone, ["unit", "id"], "left_anti")
    best = live.groupBy("unit").agg(F.max(F.struct("valid_from", "id", "kind")).alias("b"))
    return best.select("unit", F.when(F.col("b.kind") == "text", "in_force").otherwise("repealed").alias("status"), "b.id")


def last_given(rows: DataFrame) -> DataFrame:
    """(unit, status, id): the last row of each unit, without those of which nothing stands."""
    last = rows.groupBy("unit").agg(F.max_by(F.struct("status", "id"), "n").alias("s"))
    return last.select("unit", "s.status", "s.id").where("status <> 'none'")


def replayed(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream of what stands over all there is, into a table below folder."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(STANDING).parquet(f"{folder}/rows")
