"""Window panes with revisions: hourly totals of a stream that are sent once, corrected when late rows come, and closed in the end.

A stateful query (transformWithState over rows) keeps, for each shard of a kind and a day, the totals of its hours, the set of
hours with rows since they were last sent, and one timer, set to the earliest deadline of any hour: the grace after which it is sent
or the end after which it is closed. What goes to the state is totals already: tasks of the scan add up their own rows, tasks dealt by
kind, hour and salt add up those, so that a shard gets at most FAN rows an hour and batch, whatever the input. Rows of closed
panes go past the state one by one, dealt by their ids.

Nulls: a row without a time belongs nowhere and is dropped; without an arrival it has arrived when it happened; without a kind
its kind is `none`; without a value, or with one that isn't finite, it adds 0. Rows that share an id count once, the one that arrived, then happened,
first, then by kind and value, nulls first; a row without an id can't repeat another, and counts, undelayed. Batches and tables may be
empty. Further columns, of any name, are not read. Totals are 64-bit; beyond, the job ends.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..runtime import move, scratch, ship

HOUR_MS = 3_600_000
HOUR, DAY = 3_600_000_000, 86_400_000_000
#: Spark's watermark starts at 1970 and never falls below; event times may, so the query's clock runs this many hours ahead.
AHEAD = 24 * 366 * 10_000
#: Partial totals of a pane that reach the state in a batch.
FAN = 8

ROWS = "click_id long, kind string, day long, hour long, cents long, event long, tick boolean"
PARTS = "kind string, day long, part int, hour long, n long, cents long, click_id long, late boolean"
OUT = "hour long, click_id long, n_rows long, cents long, record string, kind string"

#: Settings of the streaming query; the session's own come back afterwards.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # a batch's rows come before its deadlines, so time may not go on between batches
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no room set aside for each
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
}


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    day = F.unix_date(c.cast("date")).cast("long")
    second = F.date_part(F.lit("SECOND"), c)
    return day * DAY + F.hour(c).cast("long") * HOUR + F.minute(c).cast("long") * 60_000_000 + (second * 1_000_000).cast("long")


def cut_batches(clicks: DataFrame, n_batches: int = 8) -> DataFrame:
    """(batch, click_id, kind, day, hour, cents, event, tick): each id once, in the batch of its arrival, a few delayed by up to six batches.

    event is microseconds since 1970, moved back by whole days so that arrival days count from 0 to n_batches - 1.
    """
    c = clicks.where("ts is not null").select("click_id", F.col("ts").alias("ts"), F.coalesce("arrived_at", "ts").alias("arrived_at"), "kind", "value")
    row = F.struct("arrived_at", "ts", "kind", "value")
    once = c.where("click_id is not null").groupBy("click_id").agg(F.min(row).alias("r")).unionByName(c.where("click_id is null").select("click_id", row.alias("r")))
    day = F.unix_date(F.col("r.arrived_at").cast("date")).cast("long")
    q = F.pmod(day, F.lit(n_batches))
    delay = F.greatest(F.lit(0), F.coalesce(F.crc32(F.col("click_id").cast("string").cast("binary")), F.lit(0)) % 30 - 23)
    value = F.col("r.value").cast("double")
    cents = F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0)).otherwise(F.floor(value * 100 + 0.5)).cast("long")
    out = once.select(
        F.least(F.lit(n_batches - 1), q + delay).cast("int").alias("batch"), "click_id", F.coalesce("r.kind", F.lit("none")).alias("kind"), cents.alias("cents"), (micros(F.col("r.ts")) - (day - q) * DAY).alias("event")
    )
    out = out.withColumn("hour", F.expr("(event - pmod(event, 3600000000L)) div 3600000000L"))
    return out.select("batch", "click_id", "kind", F.expr("(hour - pmod(hour, 24L)) div 24L").alias("day"), "hour", "cents", "event", F.lit(False).alias("tick"))


_PART_TYPES = pa.schema([("kind", pa.string()), ("day", pa.int64()), ("part", pa.int32()), ("hour", pa.int64()), ("n", pa.int64()), ("cents", pa.int64()), ("click_id", pa.int64()), ("late", pa.bool_())])


def _totals(t: pa.Table) -> pa.Table:
    """Rows of (kind, day, part, hour) added up."""
    g = t.group_by(["kind", "day", "part", "hour"]).aggregate([("n", "sum"), ("cents", "sum")])
    n = len(g)
    return pa.table([g["kind"], g["day"], g["part"], g["hour"], g["n_sum"], g["cents_sum"], pa.nulls(n, pa.int64()), pa.array([False] * n)], schema=_PART_TYPES)


def _added_up(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Late rows as they come, the others as totals; what is held is one row a pane and part."""
    held = None
    for t in tables:
        yield from t.filter(t["late"]).to_batches()
        new = _totals(t.filter(pc.invert(t["late"])))
        held = new if held is None else _totals(pa.concat_tables([held, new]))
    if held is not None:
        yield from held.to_batches()


def _first(closed_through: int, parts: int):
    """Totals of a task's rows; rows of panes closed by then stay single, dealt by their ids over `parts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % FAN

        def tables() -> Iterator[pa.Table]:
            for b in batches:
                n = b.num_rows
                ids, hour, tick = b["click_id"], b["hour"], b["tick"]
                late = pc.and_(pc.less_equal(hour, closed_through), pc.invert(tick))
                spread = pc.bit_wise_and(pc.fill_null(ids, 0), (1 << 62) - 1)
                part = pc.if_else(late, pc.add(pc.subtract(spread, pc.multiply(pc.divide(spread, parts), parts)), FAN), salt)
                yield pa.table([b["kind"], b["day"], pc.cast(part, pa.int32()), hour, pc.if_else(tick, 0, pa.array([1] * n, pa.int64())), b["cents"], ids, late], schema=_PART_TYPES)

        yield from _added_up(tables())

    return run


def _second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _added_up(pa.table(b.columns, schema=_PART_TYPES) for b in batches)


class Panes(StatefulProcessor):
    """A shard's hours: sent after grace hours, revised until closed, sent as final by the last batch."""

    def __init__(self, grace: int, closing: int, last: bool) -> None:
        self.grace, self.closing, self.last = grace, closing, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getMapState("totals", "hour long", "n long, cents long, sent_n long, sent_cents long, sent boolean")
        self.dirty = handle.getMapState("dirty", "hour long", "yes boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _deadline(self, hour: int, hours: int) -> int:
        """Milliseconds of the clock at which hours after the hour's end have passed."""
        return (hour + 1 + hours + AHEAD) * HOUR_MS

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, new, came = timerValues.getCurrentWatermarkInMs(), {}, False
        for r in rows:
            if r.late != (now >= self._deadline(r.hour, self.closing)) and (r.late or r.n):
                raise RuntimeError(f"hour {r.hour}: the batch and the state disagree on what is closed")
            if r.late:
                yield Row(hour=r.hour, click_id=r.click_id, n_rows=r.n, cents=r.cents, record="late", kind=r.kind)
                continue
            came = True
            if r.n:
                n, cents = new.get(r.hour, (0, 0))
                new[r.hour] = n + r.n, cents + r.cents
        for hour, (n, cents) in new.items():
            old = self.totals.getValue((hour,)) or (0, 0, 0, 0, False)
            self.totals.updateValue((hour,), (old[0] + n, old[1] + cents, *old[2:]))
            self.dirty.updateValue((hour,), (True,))
        if came:
            self._reschedule(now - 1 if self.last else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()  # it has fired
        dirty = {k[0] for k in self.dirty.keys()}
        for (hour,), (n, cents, sent_n, sent_cents, sent) in sorted(self.totals.iterator()):
            row = lambda record, n, cents: Row(hour=hour, click_id=-1, n_rows=n, cents=cents, record=record, kind=key[0])  # noqa: E731, B023
            due, closed = now >= self._deadline(hour, self.grace), now >= self._deadline(hour, self.closing)
            if sent and hour in dirty:
                yield row("retract", sent_n, sent_cents)
                yield row("replace", n, cents)
            elif not sent and due:
                yield row("emit", n, cents)
            elif not sent and self.last:
                yield row("final", n, cents)
            if closed or self.last:
                self.totals.removeKey((hour,))
            elif due:
                self.totals.updateValue((hour,), (n, cents, n, cents, True))
        self.dirty.clear()
        if not self.last:
            self._reschedule(None)

    def _reschedule(self, at: int | None) -> None:
        """One timer, for the earliest deadline of all hours, or for `at`; it fires once the clock has reached it."""
        if at is None:
            dirty = {k[0] for k in self.dirty.keys()}
            ends = [self._deadline(k[0], self.closing if v[4] and k[0] not in dirty else self.grace) - 1 for k, v in self.totals.iterator()]
            at = min(ends, default=None)
        old = self.timer.get()
        if old and old[0] == at:
            return
        if old:
            self.handle.deleteTimer(old[0])
            self.timer.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _settings(spark: SparkSession):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def feed(spark: SparkSession, root: str, batch: int, watermark: int | None, last: bool, grace: int = 6, closing: int = 96) -> None:
    """One start of the query on the checkpoint under root, over the rows that came to root/fed since the last; its rows go to root/out.

    watermark is the largest event time of all earlier batches in microseconds, which the query knows from its checkpoint as its own
    watermark; the tasks that add rows up have to be told.
    """
    schema = T._parse_datatype_string(ROWS)
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/fed")
    clocked = rows.withColumn("clock", F.when(F.col("tick"), F.timestamp_micros(F.lit(0))).otherwise(F.timestamp_micros(F.col("event") + AHEAD * HOUR))).withWatermark("clock", "0 seconds")
    closed_through = -(1 << 62) if watermark is None else watermark // HOUR - closing - 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = clocked.select("click_id", "kind", "day", "hour", "cents", "tick")
    some = narrow.mapInArrow(_first(closed_through, parts), PARTS).repartition("kind", "hour", "part").mapInArrow(_second, PARTS)
    shards = some.withColumn("part", F.when(F.col("late"), F.col("part")).otherwise(-1)).groupBy("kind", "day", "part")
    out = shards.transformWithState(Panes(grace, closing, last), OUT, "Append", "EventTime").withColumn("batch", F.lit(batch).cast("long"))
    q = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def revise_panes(clicks: DataFrame, n_batches: int = 8, grace: int = 6, closing: int = 96) -> DataFrame:
    """(batch, hour, click_id, n_rows, cents, record, kind): every record that the panes of clicks give, batch by batch.

    The batches are written to a new folder of the shared one; the query is started once for each, on one checkpoint.
    """
    spark = clicks.sparkSession
    ship(spark)
    root = scratch(spark, "panes")
    cut_batches(clicks, n_batches).write.partitionBy("batch").parquet(f"{root}/cut")
    cut = spark.read.schema(f"{ROWS}, batch int").parquet(f"{root}/cut")
    latest = dict(cut.groupBy("batch").agg(F.max("event")).collect())  # a row a batch
    shards = cut.select("kind", "day").distinct().select(F.lit(None).cast("long").alias("click_id"), "kind", "day", (F.col("day") * 24).alias("hour"), F.lit(0).cast("long").alias("cents"), F.lit(0).cast("long").alias("event"), F.lit(True).alias("tick"))
    nothing = spark.createDataFrame([], ROWS).coalesce(1)
    for k in range(n_batches):  # a file at least, so that an empty batch is one; the last wakes every shard
        (shards if k == n_batches - 1 else nothing).write.mode("append").parquet(f"{root}/woken/batch={k}")
    watermark = None
    with _settings(spark):
        for k in range(n_batches):
            if k in latest:
                move(spark, f"{root}/cut/batch={k}", f"{root}/fed/rows-{k}")
            move(spark, f"{root}/woken/batch={k}", f"{root}/fed/woken-{k}")
            feed(spark, root, k, watermark, k == n_batches - 1, grace, closing)
            watermark = max((x for x in (watermark, latest.get(k)) if x is not None), default=None)
    return spark.read.schema(f"{OUT}, batch long").parquet(f"{root}/out").select("batch", "hour", "click_id", "n_rows", "cents", "record", "kind")
