"""Streams that keep an order and a bound: results in sequence whatever order they come in, and a source that stays few items ahead."""

from __future__ import annotations

import ast
import contextlib
import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import open_path

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def state_settings(spark: SparkSession, **more: str):
    """Settings that a query with arbitrary state is started under; the session's own come back."""
    return settings(spark, STATE | more)


@contextlib.contextmanager
def settings(spark: SparkSession, new: dict[str, str]):
    """The session with other settings for a while."""
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Sequence numbers of a block of held rows.
BLOCK = 256
#: Rows that a task sorts, or hands on, together.
RUN = 10_000
#: A time after all others.
FOREVER = 2**63 - 1


class InSequence(StatefulProcessor):
    """Rows (group, member, seq, at, payload), handed on as 0, 1, 2, .. of each member of a group.

    A row that comes before its predecessor is held. If the one that is missing hasn't come `patience` milliseconds of event time after
    the stream has reached the oldest row that waits, it is given up: the gap is told, and the held rows go on. A row whose turn is over is handed on
    as `late` if it was given up before, and as `again` if it repeats one that was handed on.

    A call to the state costs more than many rows, so it holds blocks of BLOCK sequence numbers of all members, each read and written once for the rows that come
    together, and one row that says whose turn it is and which blocks there are. `kind` is the members' type.
    """

    def __init__(self, patience: int, kind: str) -> None:
        self.patience, self.kind = patience, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", f"members array<{self.kind}>, turns array<long>, missed long, timer long, blocks array<long>, oldest array<long>")
        self.held = handle.getMapState("held", "block long", f"members array<{self.kind}>, seqs array<long>, ats array<long>, payloads array<string>")
        self.lost = handle.getMapState("lost", "block long", f"members array<{self.kind}>, seqs array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        p, out = Place(self.place.get()), []
        for run in _sorted_runs(rows):
            came = {block: list(group) for block, group in itertools.groupby(run, key=lambda r: r[0] // BLOCK)}
            block, on = 0, set()
            while came or on:
                block = block + 1 if on else next(iter(came))
                on = self._take(p, block, came.pop(block, ()), on, out)
                if len(out) >= RUN:
                    yield _told(key, out)
                    out = []
        if out:
            yield _told(key, out)
        self._reschedule(p)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        p, now, out = Place(self.place.get()), timerValues.getCurrentWatermarkInMs(), []
        p.timer = None
        later = self._later(p, now)
        for block in sorted(p.waits):
            held = self._held(p, block)
            for member, seqs in _by_member(held).items():
                if member not in later:
                    continue
                self._release(p, member, held, out)
                left = [seq for seq in seqs if (member, seq) in held]
                while left and min(later[member][block], min(held[member, seq][0] for seq in left)) + self.patience <= now:
                    for gaps in self._give_up(p, member, left[0]):
                        out += gaps
                        if len(out) >= RUN:
                            yield _told(key, out)
                            out = []
                    self._release(p, member, held, out)
                    left = [seq for seq in left if (member, seq) in held]
                if left:
                    del later[member]
            self._keep(p, block, held)
            self._note_lost(p)
            if len(out) >= RUN:
                yield _told(key, out)
                out = []
        if out:
            yield _told(key, out)
        self._reschedule(p)

    def _take(self, p: Place, block: int, rows: Iterable[tuple], on: set, out: list[tuple]) -> set:
        """Rows of a block of sequence numbers, and what goes on in it; `on` and the result are the members whose turn has come to the beginning of this block and of the next."""
        held = self._held(p, block)
        lost, found, going, changed = None, False, set(), False
        for member in on:
            changed |= self._release(p, member, held, out)
            going.add(member)
        for seq, member, at, payload in rows:
            turn = p.turns.get(member, 0)
            if seq < turn:
                lost = self._lost(p, block) if lost is None else lost
                if (member, seq) in lost:
                    lost.remove((member, seq))
                    p.missed -= 1
                    out.append((member, seq, payload, "late"))
                    found = True
                else:
                    out.append((member, seq, payload, "again"))
            elif seq == turn:
                out.append((member, seq, payload, "on time"))
                p.turns[member] = turn + 1
                changed |= self._release(p, member, held, out)
                going.add(member)
            elif (member, seq) in held:
                out.append((member, seq, payload, "again"))
            else:
                held[member, seq] = at, payload
                changed = True
        if changed:
            self._keep(p, block, held)
        if found:
            self._write_lost(block, lost)
        return {member for member in going if p.turns.get(member, 0) == (block + 1) * BLOCK}

    def _release(self, p: Place, member, held: dict, out: list[tuple]) -> bool:
        """Hand on what is held and has its turn; whether there was any."""
        turn = start = p.turns.get(member, 0)
        while (member, turn) in held:
            out.append((member, turn, held.pop((member, turn))[1], "on time"))
            turn += 1
        if turn > start:
            p.turns[member] = turn
        return turn > start

    def _later(self, p: Place, now: int) -> dict:
        """Of the members with a row that has waited too long, for each block of theirs, the time of the oldest row in blocks behind it."""
        oldest: dict = {}
        for block in sorted(p.waits):
            for (member, _), (at, _) in self._held(p, block).items():
                of = oldest.setdefault(member, {})
                of[block] = min(at, of.get(block, FOREVER))
        due = {member: of for member, of in oldest.items() if min(of.values()) + self.patience <= now}
        return {member: dict(zip(reversed(of), itertools.accumulate([FOREVER, *reversed(of.values())], min), strict=False)) for member, of in due.items()}

    def _give_up(self, p: Place, member, first: int) -> Iterator[list[tuple]]:
        """Nothing of a member before `first` is waited for."""
        for block, group in itertools.groupby(range(p.turns.get(member, 0), first), key=lambda seq: seq // BLOCK):
            seqs = list(group)
            p.gone.setdefault(block, set()).update((member, seq) for seq in seqs)
            if len(p.gone) * BLOCK >= RUN:  # one member has up to BLOCK in a block
                self._note_lost(p)
            yield [(member, seq, None, "gap") for seq in seqs]
        p.turns[member] = first

    def _note_lost(self, p: Place) -> None:
        """Put into the state what was given up."""
        for block, new in p.gone.items():
            self._write_lost(block, self._lost(p, block) | new)
            p.missed += len(new)
        p.gone = {}

    def _held(self, p: Place, block: int) -> dict:
        if block not in p.waits:
            return {}
        members, seqs, ats, payloads = self.held.getValue((block,))
        return dict(zip(zip(members, seqs, strict=True), zip(ats, payloads, strict=True), strict=True))

    def _keep(self, p: Place, block: int, held: dict) -> None:
        if held:
            members, seqs = zip(*held, strict=True)
            ats, payloads = zip(*held.values(), strict=True)
            self.held.updateValue((block,), (list(members), list(seqs), list(ats), list(payloads)))
            p.waits[block] = min(ats)
        elif block in p.waits:
            self.held.removeKey((block,))
            del p.waits[block]

    def _lost(self, p: Place, block: int) -> set:
        found = self.lost.getValue((block,)) if p.missed else None
        return set(zip(*found, strict=True)) if found else set()

    def _write_lost(self, block: int, lost: set) -> None:
        if lost:
            members, seqs = zip(*lost, strict=True)
            self.lost.updateValue((block,), (list(members), list(seqs)))
        else:
            self.lost.removeKey((block,))

    def _reschedule(self, p: Place) -> None:
        """One timer, for the row that has waited longest."""
        at = min(p.waits.values(), default=None)
        at = None if at is None else at + self.patience - 1
        if at != p.timer:
            if p.timer is not None:
                self.handle.deleteTimer(p.timer)
            if at is not None:
                self.handle.registerTimer(at)
            p.timer = at
        self.place.update(p.row())

    def close(self) -> None:
        pass


class Place:
    """Where a group is: each member's turn, how many rows that were given up haven't come, the timer, and the oldest time in each block of held rows."""

    def __init__(self, row: tuple | None) -> None:
        members, turns, self.missed, self.timer, blocks, oldest = row or ([], [], 0, None, [], [])
        self.turns, self.waits = dict(zip(members, turns, strict=True)), dict(zip(blocks, oldest, strict=True))
        self.gone: dict[int, set] = {}  # given up, not in the state yet

    def row(self) -> tuple:
        return list(self.turns), list(self.turns.values()), self.missed, self.timer, list(self.waits), list(self.waits.values())


def _by_member(held: dict) -> dict[object, list[int]]:
    """Sequence numbers of each member, in order."""
    out: dict = {}
    for member, seq in sorted(held):
        out.setdefault(member, []).append(seq)
    return out


def _told(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["member", "seq", "payload", "how"])
    out.insert(0, "group", [key[0]] * len(rows))
    return out


def _sorted_runs(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """(seq, member, at, payload) of the rows in sorted runs of bounded length: what is in order needn't be held, and a task holds one run."""
    rows = itertools.chain.from_iterable(zip(*(f[c].tolist() for c in ("seq", "member", "at", "payload")), strict=True) for f in frames)
    while run := list(itertools.islice(rows, RUN)):
        yield sorted(run, key=lambda r: (r[0], r[3] is not None, r[3] or ""))


def restore_order(stream: DataFrame, key: str, seq: str, at: str, payload: str, patience: int = 3_600_000, groups: int | None = None) -> DataFrame:
    """(key, seq, payload, how) of a stream whose rows carry a sequence number from 0 in each key, in sequence within a key and batch.

    at is the event time; `stream` must not have a watermark yet, since rows behind it would be dropped, and a late row is what this is for. Rows without key, number
    or time are in no sequence and left out; times begin in 1970. State grows with what is held and given up, not with what has passed.
    With `groups`, keys (whole numbers or text) share that many groups of state, each read and written as a whole but for held rows: for many keys of few rows, some
    hundred keys a group. The number stays the same over all starts.
    """
    clocked = stream.where(F.col(key).isNotNull() & F.col(seq).isNotNull() & F.col(at).isNotNull()).withColumn("_clock", F.col(at).cast("timestamp")).withWatermark("_clock", "0 seconds")
    kind = stream.select(key).schema[0].dataType
    if groups is not None and (groups < 1 or not isinstance(kind, (T.IntegralType, T.StringType))):
        raise ValueError("groups must be 1 at least, and their keys whole numbers or text")
    member_kind = "string" if groups is not None and isinstance(kind, T.StringType) else "long"
    group, member = (F.col(key), F.lit(0)) if groups is None else (F.pmod(F.xxhash64(key), F.lit(groups)), F.col(key))
    # the clock itself stays behind: an operator that saw it would drop late rows
    rows = clocked.select(group.alias("group"), member.cast(member_kind).alias("member"), F.col(seq).cast("long").alias("seq"), F.unix_millis("_clock").alias("at"), F.col(payload).cast("string").alias("payload"))
    schema = f"group {rows.schema['group'].dataType.simpleString()}, member {member_kind}, seq long, payload string, how string"
    told = rows.groupBy("group").transformWithStateInPandas(InSequence(patience, member_kind), schema, "Append", "EventTime")
    return told.select(F.col("group" if groups is None else "member").cast(kind).alias("key"), "seq", "payload", "how")


# --- bounded look-ahead -------------------------------------------------------------------------------------


class Frames(InputPartition):
    """Items [start, end) of each of the lanes [first, last)."""

    def __init__(self, first: int, last: int, start: int, end: int) -> None:
        self.first, self.last, self.start, self.end = first, last, start, end


class LookAhead(DataSource):
    """Format `look_ahead`: the rows of a numbered Parquet table, at most `ahead` of them beyond what the query has committed.

    Options: path of a table of (item long, payload string), items from 0, one row each, in files that hold ranges of them; rows, how many; ahead; parts,
    the ranges that a batch is read in; state, a folder where the end of the last batch is noted, so that a query that starts anew goes on from it.
    With `lane`, each so many items are a sequence of their own, as a video's frames are: all go on together, each at most `ahead` beyond what is committed
    of it, and the batches are as many as a lane needs, however many lanes there are. A batch's offsets count within a lane, and `rows` stays the same over all starts.
    """

    @classmethod
    def name(cls) -> str:
        return "look_ahead"

    def schema(self) -> str:
        return "item long, payload string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LookAheadReader(dict(self.options))


class LookAheadReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows, self.ahead = options["path"], int(options["rows"]), int(options.get("ahead", 17))
        self.parts, self.state = int(options.get("parts", 2)), options["state"]
        self.lane = int(options["lane"]) if "lane" in options else None
        if self.ahead < 1 or (self.lane is not None and self.lane < 1):
            raise ValueError("ahead and lane must be 1 at least")
        fs, at = open_path(f"{self.state}/planned")
        self.done = int(fs.open_input_stream(at).read()) if fs.get_file_info(at).type == pafs.FileType.File else 0

    def initialOffset(self) -> dict:
        return {"item": 0}

    def latestOffset(self) -> dict:
        """What may be asked for: `ahead` items beyond the last batch. Spark asks when that batch is done, so all of it is committed."""
        return {"item": min(self.rows, self.lane or self.rows, self.done + self.ahead)}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        self._note(end["item"])
        if self.lane:
            lanes = -(-self.rows // self.lane)
            step = max(-(-lanes // max(self.parts, 1)), 1)
            return [Frames(k, min(k + step, lanes), start["item"], end["item"]) for k in range(0, lanes, step)]
        n = end["item"] - start["item"]
        cuts = [start["item"] + n * i // self.parts for i in range(self.parts + 1)]
        return [Frames(0, 1, a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def _note(self, end: int) -> None:
        """The end of the batch that runs now; a query that starts anew runs that batch to its end before it asks for more."""
        self.done = max(self.done, end)
        fs, at = open_path(self.state)
        fs.create_dir(at)
        with fs.open_output_stream(f"{at}/planned.new") as f:
            f.write(str(self.done).encode())
        fs.move(f"{at}/planned.new", f"{at}/planned")

    def read(self, partition: Frames) -> Iterator[tuple]:
        fs, at = open_path(self.path)
        lane = self.lane or 0
        low, high = partition.first * lane + partition.start, min((partition.last - 1) * lane + partition.end, self.rows)
        table = pq.read_table(at, filesystem=fs, columns=["item", "payload"], filters=[("item", ">=", low), ("item", "<", high)])
        if lane:
            place = table["item"].to_numpy() % lane
            table = table.filter(pa.array((place >= partition.start) & (place < partition.end)))
        for item, payload in sorted(zip(*[c.to_pylist() for c in table.columns], strict=True)):
            yield item, payload


def look_ahead(spark: SparkSession, path: str, rows: int, state: str, ahead: int = 17, parts: int = 2, lane: int | None = None) -> DataFrame:
    """A stream over a numbered table that never reads more than `ahead` items, of each lane if there are lanes, beyond what is committed."""
    spark.dataSource.register(LookAhead)
    options = {"path": path, "rows": str(rows), "state": state, "ahead": str(ahead), "parts": str(parts)} | ({"lane": str(lane)} if lane else {})
    return spark.readStream.format("look_ahead").options(**options).load()


def run_through(stream: DataFrame, out: str, checkpoint: str, batches: int = 1000) -> list[tuple[int, int]]:
    """Run a look-ahead stream to its end into Parquet; the items (start, end) of each batch, from the progress records of up to so many batches."""
    with settings(stream.sparkSession, {"spark.sql.streaming.numRecentProgressUpdates": str(2 * batches + 100)}):
        return _run_through(stream, out, checkpoint)


def lane_spans(spans: list[tuple[int, int]], rows: int, lane: int) -> tuple[int, int]:
    """(how many, the longest) of the ranges of items that batches with these offsets took from all lanes."""
    full, rest = divmod(rows, lane)
    takes = [(min(b, size) - a, k) for size, k in ((lane, full), (rest, 1)) for a, b in spans if k and min(b, size) > a]
    return sum(k for _, k in takes), max((n for n, _ in takes), default=0)


def _run_through(stream: DataFrame, out: str, checkpoint: str) -> list[tuple[int, int]]:
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="0 seconds").start()
    seen: dict[int, tuple[int, int]] = {}
    try:
        q.processAllAvailable()
        for p in q.recentProgress:
            s = p["sources"][0]
            start, end = ((ast.literal_eval(str(x)) or {"item": 0})["item"] for x in (s["startOffset"], s["endOffset"]))
            if end > start:
                seen[p["batchId"]] = start, end
    finally:
        q.stop()
    return [seen[k] for k in sorted(seen)]
