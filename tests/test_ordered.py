"""Streams in sequence with gaps, late and repeated rows over restarts; the bounded source over a restart; PLY files."""

from __future__ import annotations

import datetime as dt
import functools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenforge.runtime import make_folder, scratch
from lumenforge.sources import ply as L
from lumenforge.streaming import ordered as O

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
MINUTE = 60_000


def run(spark, batches, patience):
    """What comes out of each batch (key, seq, minute), the query started anew for each."""
    root = scratch(spark, "sequence")
    schema = "k string, n long, t timestamp, p string"
    with O.state_settings(spark, **{"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
        for i, rows in enumerate(batches):
            spark.createDataFrame([(k, n, None if m is None else T0 + dt.timedelta(minutes=m), p) for k, n, m, p in rows], schema).coalesce(1).write.parquet(f"{root}/came/{i}")
            s = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/came")
            q = O.restore_order(s, "k", "n", "t", "p", patience).withColumn("batch", F.lit(i)).coalesce(1).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
            q.awaitTermination()
    rows = spark.read.schema("key string, seq long, payload string, how string, batch int").parquet(f"{root}/out").collect()
    return [[tuple(r)[:4] for r in rows if r.batch == i] for i in range(len(batches))]


def test_sequences_gaps_and_late_rows(spark):
    out = run(
        spark,
        [
            [("a", 1, 1, "a1"), ("a", 0, 0, "a0"), ("a", 3, 2, "a3"), ("b", 2, 1, "b2"), (None, 0, 0, "x"), ("a", None, 0, "x"), ("a", 9, None, "x")],
            [("a", 3, 2, "a3"), ("b", 0, 3, "b0"), ("b", 0, 3, "b0"), ("c", 0, 30, None)],
            [],  # half an hour has passed: what waits since minutes 1 and 2 is given up
            [("a", 2, 2, "a2"), ("a", 4, 31, "a4"), ("b", 1, 4, "b1"), ("b", 3, 5, "b3"), ("a", 2, 2, "a2")],
        ],
        10 * MINUTE,
    )
    assert sorted(out[0]) == [("a", 0, "a0", "on time"), ("a", 1, "a1", "on time")]
    assert sorted(out[1], key=repr) == [("a", 3, "a3", "again"), ("b", 0, "b0", "again"), ("b", 0, "b0", "on time"), ("c", 0, None, "on time")]
    assert [r for r in out[2] if r[0] == "a"] == [("a", 2, None, "gap"), ("a", 3, "a3", "on time")]
    assert [r for r in out[2] if r[0] == "b"] == [("b", 1, None, "gap"), ("b", 2, "b2", "on time")]
    assert sorted(out[3]) == [("a", 2, "a2", "again"), ("a", 2, "a2", "late"), ("a", 4, "a4", "on time"), ("b", 1, "b1", "late"), ("b", 3, "b3", "on time")]


def test_order_within_a_key_is_kept(spark):
    rows = [("k", n, 0, str(n)) for n in reversed(range(200))]
    out = run(spark, [rows[:50], rows[50:]], MINUTE * 1000)
    assert out[0] == [] and [r[1] for r in out[1]] == list(range(200))


class State:
    """State of one group in this process, with a count of the calls to it."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, {}, set()

    def getValueState(self, name, *schema):
        return Variable(self, name)

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Variable:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def getValue(self, key):
        self.state.calls += 1
        return self.state.values.get((self.name, key))

    def updateValue(self, key, value):
        self.state.calls += 1
        self.state.values[self.name, key] = value

    def removeKey(self, key):
        self.state.calls += 1
        del self.state.values[self.name, key]

    def get(self):
        return self.getValue(None)

    def update(self, value):
        self.updateValue(None, value)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def in_process(batches, patience):
    """What comes out of each batch of (member, seq, at, payload), all of one group, and the state at the end."""
    state, now, out = State(), 0, []
    for rows in batches:
        p = O.InSequence(patience, "long")
        p.init(state)
        frames = [pd.DataFrame(rows[i : i + 7], columns=["member", "seq", "at", "payload"]).assign(group=0) for i in range(0, len(rows), 7)]
        told = list(p.handleInputRows((0,), iter(frames), Clock(now))) if rows else []
        for at in [x for x in state.timers if x < now]:
            state.timers.remove(at)
            told += p.handleExpiredTimer((0,), Clock(now), None)
        out.append([r for f in told for r in f[["member", "seq", "payload", "how"]].itertuples(index=False, name=None)])
        now = max([now, *(r[2] for r in rows)])
    return out, state


def row_by_row(batches, patience):
    """The same by the rule as it is said."""
    turns, held, lost, now, out = {}, {}, set(), 0, []
    for rows in batches:
        told = []
        for m, seq, at, payload in sorted(rows, key=lambda r: (r[1], r[3])):
            turn = turns.setdefault(m, 0)
            if seq < turn or (m, seq) in held:
                told.append((m, seq, payload, "late" if (m, seq) in lost else "again"))
                lost.discard((m, seq))
            else:
                held[m, seq] = at, payload
            while (m, turns[m]) in held:
                told.append((m, turns[m], held.pop((m, turns[m]))[1], "on time"))
                turns[m] += 1
        for m in turns:
            while (mine := [k for k in held if k[0] == m]) and min(held[k][0] for k in mine) + patience <= now:
                first = min(mine)[1]
                told += [(m, seq, None, "gap") for seq in range(turns[m], first)]
                lost |= {(m, seq) for seq in range(turns[m], first)}
                turns[m] = first
                while (m, turns[m]) in held:
                    told.append((m, turns[m], held.pop((m, turns[m]))[1], "on time"))
                    turns[m] += 1
        out.append(told)
        now = max([now, *(r[2] for r in rows)])
    return out, held, lost


@pytest.mark.parametrize("seed", range(40))
def test_blocks_of_state_say_what_single_rows_say(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(O, "BLOCK", rng.choice([1, 4, 16]))
    monkeypatch.setattr(O, "RUN", rng.choice([5, 10_000]))
    rows = [(m, seq, seq * 10 + rng.randrange(60), f"{m}.{seq}") for m in range(rng.choice([1, 5])) for seq in range(60)]
    rows = [r for r in rows if rng.random() < 0.97] + rng.sample(rows, 20)
    batches = [[] for _ in range(8)]
    for r in rows:
        batches[min(7, r[1] // 10 + rng.choice([0, 0, 0, 1, 4]))].append(r)
    for b in batches:
        rng.shuffle(b)
    patience = rng.choice([50, 150, 10**9])
    out, state = in_process(batches, patience)
    expected, held, lost = row_by_row(batches, patience)
    assert [sorted(b, key=repr) for b in out] == [sorted(b, key=repr) for b in expected]
    for b in out:
        for m in {r[0] for r in b}:
            turns = [r[1] for r in b if r[0] == m and r[3] in ("on time", "gap")]
            assert turns == sorted(turns)
    kept = {name: {x for (n, k), v in state.values.items() if n == name for x in zip(v[0], v[1], strict=True)} for name in ("held", "lost")}
    assert kept == {"held": set(held), "lost": lost}


def test_calls_to_the_state_do_not_grow_with_the_rows():
    def calls(n):
        rows = [(m, seq, 0, "x") for m in range(20) for seq in range(n)]
        out, state = in_process([[r for r in rows if r[1] % 3 == k] for k in (1, 2, 0)], 10**9)
        assert sum(len(b) for b in out) == 20 * n and not [x for x in state.values if x[0] != "place"]
        return state.calls

    assert calls(50) == calls(200) < 20


def test_keys_in_groups_come_out_as_keys_by_themselves(spark, monkeypatch):
    rows = [(k, n, n, f"{k}{n}") for k in "abcdefg" for n in range(30) if (ord(k) + n) % 11]
    batches = [[r for r in rows if r[1] * 7 % 3 == i] for i in range(3)] + [[("a", 900, 900, "end")], [], [(k, n, n, "found") for k in "abcdefg" for n in range(30) if not (ord(k) + n) % 11]]
    alone, by_key = run(spark, batches, 60 * MINUTE), O.restore_order
    monkeypatch.setattr(O, "restore_order", functools.partial(by_key, groups=2))
    together = run(spark, batches, 60 * MINUTE)
    assert [sorted(b, key=repr) for b in alone] == [sorted(b, key=repr) for b in together]
    assert {r[3] for b in together for r in b} >= {"on time", "gap", "late"}
    days = spark.createDataFrame([(dt.date(2024, 1, 1), 0, T0, "x")], "k date, n long, t timestamp, p string")
    assert by_key(days, "k", "n", "t", "p").schema["key"].dataType == days.schema["k"].dataType
    with pytest.raises(ValueError):
        O.restore_order(days, "k", "n", "t", "p")


def test_look_ahead_stays_in_its_bound_and_goes_on_after_a_restart(spark):
    root = scratch(spark, "ahead")
    spark.range(45).selectExpr("id AS item", "concat('p', id) AS payload").repartitionByRange(3, "item").write.parquet(f"{root}/items")
    path, state = make_folder(spark, f"{root}/items"), make_folder(spark, f"{root}/state")
    first = O.run_through(O.look_ahead(spark, path, 20, state, ahead=7), f"{root}/out", f"{root}/checkpoint")
    assert first == [(0, 7), (7, 14), (14, 20)]
    second = O.run_through(O.look_ahead(spark, path, 45, state, ahead=7, parts=3), f"{root}/out", f"{root}/checkpoint")
    assert second == [(20, 27), (27, 34), (34, 41), (41, 45)]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").collect())
    assert got == [(i, f"p{i}") for i in range(45)]
    with pytest.raises(ValueError):
        O.LookAheadReader({"path": path, "rows": "1", "ahead": "0", "state": state})


def test_lanes_go_on_together_each_in_its_bound(spark):
    root = scratch(spark, "lanes")
    spark.range(200).selectExpr("id AS item", "concat('p', id) AS payload").repartitionByRange(3, "item").write.parquet(f"{root}/items")
    path, state = make_folder(spark, f"{root}/items"), make_folder(spark, f"{root}/state")
    spans = O.run_through(O.look_ahead(spark, path, 200, state, ahead=7, parts=3, lane=21), f"{root}/out", f"{root}/checkpoint")
    assert spans == [(0, 7), (7, 14), (14, 21)]  # ten lanes, the last of 11 items, in three batches
    assert O.lane_spans(spans, 200, 21) == (29, 7) and O.lane_spans(spans[:1], 5, 21) == (1, 5) and O.lane_spans([], 0, 21) == (0, 0)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").collect()) == [(i, f"p{i}") for i in range(200)]
    reader = O.LookAheadReader({"path": path, "rows": "200", "state": make_folder(spark, f"{root}/new"), "ahead": "7", "parts": "3", "lane": "21"})
    one = [sorted(i for f in reader.partitions({"item": a}, {"item": b}) for i, _ in reader.read(f)) for a, b in spans]
    assert one == [[i for i in range(200) if a <= i % 21 < b] for a, b in spans]


def test_ply_round_trip(spark):
    path = scratch(spark, "ply")
    rows = [("s1", i * 0.5, -float(i), i % 256) for i in range(700)] + [("s2", 1.0, 2.0, 3), (None, 1.0, 1.0, 1), ("s3", None, 1.0, 1)]
    L.save_ply(spark.createDataFrame(rows, "scene string, x double, y double, red int"), path, "scene", {"x": "float", "y": "double", "red": "uchar"})
    back = L.read_ply(spark, path, ["red", "x", "y"], points=64)
    assert sorted((r.scene, r.x, r.y, int(r.red)) for r in back.collect()) == sorted(r for r in rows if None not in r)
    assert sorted((r.scene, r.row) for r in back.collect()) == [("s1", i) for i in range(700)] + [("s2", 0)]
    with pytest.raises(ValueError):
        L.parse_header(b"ply\nformat ascii 1.0\nelement vertex 1\nend_header\n")


def test_ply_of_a_failed_job_leaves_no_scene(spark):
    path = make_folder(spark, scratch(spark, "ply"))
    spark.dataSource.register(L.PlyFiles)
    rows = spark.createDataFrame([("s", float(i)) for i in range(10)], "scene string, x double").repartition(3)
    with pytest.raises(Exception, match="several pieces"):
        rows.write.format("ply").option("types", "float").mode("append").save(path)
    assert spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect() == []
