"""Structured Streaming forms of the time-series operators, over any stream with the monitors' columns.

Windows are handed on once the watermark has passed their end, and their state is dropped then; rows that come later than that
are not counted. The queries and tests/test_streaming.py feed them from files and hold them against batch forms.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from siteward.catalog import query
from siteward.operators.stand_ins import ARRIVALS, SITES, sites
from siteward.session import scratch_root


#: Milliseconds of a tick.
TICK_MS = 60_000


def stream_of(spark: SparkSession, sf_dir: str, name: str, files_a_trigger: int = 1) -> DataFrame:
    """A table's files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(f"{sf_dir}/{name}*.parquet")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """county, hour_start, n, mean: tumbling hours; rows later than the watermark are dropped."""
    t = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = t.groupBy(F.window("at", "1 hour").alias("w"), F.col("event_type").alias("county")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select("county", F.col("w.start").cast("timestamp_ntz").alias("hour_start"), "n", F.round("mean", 6).alias("mean"))


def sliding(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """county, from_day, n, mean: windows of three days, one beginning each day."""
    t = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = t.groupBy(F.window("at", "3 days", "1 day").alias("w"), F.col("event_type").alias("county")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select("county", F.col("w.start").cast("timestamp_ntz").alias("from_day"), "n", F.round("mean", 6).alias("mean"))


def sessions(events: DataFrame, level: float = 55.5, gap: str = "2 hours") -> DataFrame:
    """county, first_at, n: sessions of measurements at the level, which end after a gap."""
    t = events.where(F.col("value") >= level).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", gap)
    g = t.groupBy(F.session_window("at", gap).alias("w"), F.col("event_type").alias("county")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("county", F.col("w.start").cast("timestamp_ntz").alias("first_at"), "n")


def admit_stream(arrived: DataFrame, capacities: DataFrame) -> DataFrame:
    """site_id, person_id, tick of those let in, as they come: arrived (site_id, person_id, tick) has to come in the order of ticks
    from one trigger to the next; within one, (tick, person_id) decides. Of a site only the beds taken are kept."""

    def door(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([b for b in batches], ignore_index=True)
        taken = state.get[0] if state.exists else 0
        capacity = rows["capacity"].iloc[0]
        rows = rows.sort_values(["tick", "person_id"])
        if capacity == capacity and capacity is not None:
            rows = rows.head(max(0, int(capacity) - taken))
        state.update((taken + len(rows),))
        yield rows[["site_id", "person_id", "tick"]]

    with_beds = arrived.join(capacities.select("site_id", F.col("capacity").cast("double").alias("capacity")), "site_id")
    return with_beds.groupBy("site_id").applyInPandasWithState(door, "site_id long, person_id long, tick long", "taken long", "append", GroupStateTimeout.NoTimeout)


class Doors(StatefulProcessor):
    """A site's arrivals wait in a list until the watermark is past their tick, and are let in by (tick, person_id) then. Of a full site
    only the number of beds taken is kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "n long")
        self.waiting = handle.getListState("waiting", "tick long, person_id long, capacity long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = self.taken.get()[0] if self.taken.exists() else 0
        for batch in rows:
            batch = batch[batch["capacity"].isna() | (batch["capacity"] > taken)]
            if len(batch):
                free = batch["capacity"].isna()
                self.waiting.appendList([(int(t), int(p), -1 if f else int(c)) for t, p, c, f in zip(batch["tick"], batch["person_id"], batch["capacity"], free)])
                for ms in set((batch["tick"] * TICK_MS).tolist()):
                    self.handle.registerTimer(int(ms) + 1)
        yield pd.DataFrame({"site_id": [], "person_id": [], "tick": []}).astype("int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted(tuple(w) for w in waiting if w[0] * TICK_MS < past)
        taken = self.taken.get()[0] if self.taken.exists() else 0
        if due:
            # The first of a trigger's timers takes all that is due; the others find nothing.
            beds = due[0][2]
            let_in = due if beds < 0 else due[: max(0, beds - taken)]
            taken += len(let_in)
            self.taken.update((taken,))
            rest = [tuple(w) for w in waiting if w[0] * TICK_MS >= past] if beds < 0 or taken < beds else []
            self.waiting.put(rest) if rest else self.waiting.clear()
            yield pd.DataFrame([(key[0], p, t) for t, p, _ in let_in], columns=["site_id", "person_id", "tick"]).astype("int64")
        else:
            yield pd.DataFrame({"site_id": [], "person_id": [], "tick": []}).astype("int64")

    def close(self) -> None:
        pass


def admit_ordered(arrived: DataFrame, capacities: DataFrame, late: str = "60 minutes") -> DataFrame:
    """site_id, person_id, tick of those let in, whatever the order in which the stream brings arrivals (site_id, person_id, tick in
    minutes), as long as it brings none later than `late`; later ones, and rows with nulls, count as not come. What waits is as
    much as comes within `late`."""
    arrived.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    a = arrived.where("site_id IS NOT NULL AND person_id IS NOT NULL AND tick IS NOT NULL").withColumn("at", F.timestamp_millis(F.col("tick") * TICK_MS)).withWatermark("at", late)
    a = a.join(capacities.select("site_id", F.col("capacity").cast("long").alias("capacity")), "site_id")
    return a.groupBy("site_id").transformWithStateInPandas(Doors(), "site_id long, person_id long, tick long", "append", "EventTime")


def exposure_stream(events: DataFrame, level: float = 55.5) -> DataFrame:
    """user_id, n, total, over: each person's sums so far, after each trigger that changes them (update mode)."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_if(F.col("value") >= level).alias("over"))


def run_to_end(stream: DataFrame, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """What the stream gives once all that is there is read, written as it comes to the shared folder. append: each row once, when it
    is final. update: a later row of the same keys takes the place of an earlier one."""
    spark = stream.sparkSession
    at = f"{scratch_root(spark)}/siteward-stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("_batch", IntegerType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{at}/out")
    if mode == "append":
        return rows.drop("_batch")
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("r"))
    return last.select("r.*")


def closing(spark: SparkSession, events: DataFrame, days: int = 40) -> DataFrame:
    """The events, and after them one of no county so late that all windows end; a stream that goes on needs none."""
    end = F.max("ts") + F.make_dt_interval(days=F.lit(days))
    last = events.agg(end.alias("ts")).select(*(F.col("ts") if c == "ts" else F.lit(1e9 if c == "value" else None).cast(events.schema[c].dataType).alias(c) for c in events.columns))
    path = f"{scratch_root(spark)}/siteward-events-{uuid.uuid4().hex}"
    events.write.parquet(f"{path}/batch=1")
    last.write.parquet(f"{path}/batch=2")
    # Files in the order of time: the last one closes the windows.
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 10_000).option("recursiveFileLookup", True)
    first = stream.parquet(f"{path}/batch=1")
    return first.union(stream.parquet(f"{path}/batch=2"))


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("stream_hourly", "SELECT event_type AS county, date_trunc('hour', ts) AS hour_start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    return run_to_end(hourly(closing(spark, _events(spark, sf_dir))), "hourly").where("county IS NOT NULL")


@query("stream_sliding", "SELECT event_type AS county, date_trunc('day', ts) - to_days(k::INT) AS from_day, count(*) AS n, round(avg(value), 6) AS mean FROM events, range(3) AS g(k) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    return run_to_end(sliding(closing(spark, _events(spark, sf_dir))), "sliding").where("county IS NOT NULL")


@query("stream_sessions", """WITH e AS (SELECT event_type AS county, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 2 HOUR, true) AS new FROM events WHERE value >= 55.5),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY county ORDER BY ts) AS k FROM e) SELECT county, min(ts) AS first_at, count(*) AS n FROM s GROUP BY county, k""")  # fmt: skip
def stream_sessions(spark, sf_dir):
    return run_to_end(sessions(closing(spark, _events(spark, sf_dir))), "sessions").where("county IS NOT NULL")


@query("stream_admission", f"WITH {ARRIVALS}, {SITES}, r AS (SELECT a.site_id, a.person_id, a.tick, capacity, row_number() OVER (PARTITION BY a.site_id ORDER BY a.tick, a.person_id) AS rank FROM (SELECT DISTINCT site_id, person_id, min(tick) AS tick FROM arrivals GROUP BY site_id, person_id) a JOIN sites USING (site_id)) SELECT site_id, person_id, tick FROM r WHERE capacity IS NULL OR rank <= capacity")
def stream_admission(spark, sf_dir):
    """First come, first served over arrivals as a stream; tests/test_streaming.py has them come in several triggers."""
    a = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("site_id"), F.col("l_orderkey").alias("person_id"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long").alias("tick"))
    a = a.groupBy("site_id", "person_id").agg(F.min("tick").alias("tick"))
    path = f"{scratch_root(spark)}/siteward-arrivals-{uuid.uuid4().hex}"
    a.write.parquet(path)
    # All files in one trigger: files written at once have no order that a stream would keep.
    stream = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 1_000).parquet(path)
    return run_to_end(admit_stream(stream, sites(spark, sf_dir).select("site_id", "capacity")), "admission")


@query("stream_exposure", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, count(*) FILTER (value >= 55.5) AS over FROM events GROUP BY user_id")
def stream_exposure(spark, sf_dir):
    return run_to_end(exposure_stream(stream_of(spark, sf_dir, "events")), "exposure", "update", ["user_id"])
