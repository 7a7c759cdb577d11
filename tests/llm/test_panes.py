"""Panes with revisions against the same rules spelled out row by row."""

from __future__ import annotations

import datetime as dt
import math
import random
import zlib
from collections import defaultdict

import pytest

from lumenforge.llm import panes

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, batch string, hour string"
H = 3_600_000_000


def brute(rows, n_batches=8):
    """Every record, in plain Python."""
    epoch = dt.datetime(1970, 1, 1)
    us = lambda t: (t - epoch) // dt.timedelta(microseconds=1)
    once = {}
    lone = []
    for r in rows:
        if r[1] is None:
            continue
        r = (r[0], r[1], r[2] or r[1], r[3], r[4])
        rank = (r[2], r[1], (r[3] is not None, r[3] or ""), (r[4] is not None, math.inf if r[4] != r[4] else r[4] or 0.0))
        if r[0] is None:
            lone.append(r)
        elif r[0] not in once or rank < once[r[0]][0]:
            once[r[0]] = rank, r
    batches = defaultdict(list)
    for i, t, a, kind, value in [*lone, *(x for _, x in once.values())]:
        d = (a - epoch).days
        q = d % n_batches
        b = min(n_batches - 1, q + max(0, (zlib.crc32(str(i).encode()) if i is not None else 0) % 30 - 23))
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0
        e = us(t) - (d - q) * 24 * H
        batches[b].append((i, kind or "none", e // H, cents, e))
    w, state, out = -math.inf, {}, []
    for b in range(n_batches):
        dirty = set()
        for i, kind, hour, cents, _ in batches[b]:
            if w >= (hour + 97) * H:
                out.append((b, hour, i, 1, cents, "late", kind))
                continue
            s = state.setdefault((kind, hour), [0, 0, None])
            s[0] += 1
            s[1] += cents
            dirty.add((kind, hour))
        for (kind, hour), s in list(state.items()):
            if s[2] is None and w >= (hour + 7) * H:
                out.append((b, hour, -1, s[0], s[1], "emit", kind))
                s[2] = s[0], s[1]
            elif s[2] is not None and (kind, hour) in dirty:
                out += [(b, hour, -1, *s[2], "retract", kind), (b, hour, -1, s[0], s[1], "replace", kind)]
                s[2] = s[0], s[1]
            elif s[2] is None and b == n_batches - 1:
                out.append((b, hour, -1, s[0], s[1], "final", kind))
            if w >= (hour + 97) * H:
                del state[kind, hour]
        w = max([w, *(x[4] for x in batches[b])])
    return out


def made(n, seed, days):
    """Clicks over some days, part of them late by hours or days, some broken or repeated."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = dt.datetime(2024, 1, 3) + dt.timedelta(days=rng.choice(days), seconds=rng.randrange(86_400))
        t = a - dt.timedelta(seconds=rng.choice([1, 60, 7 * 3600, 3 * 86_400, 6 * 86_400]) * rng.random(), microseconds=rng.randrange(1_000_000))
        rows.append((i, t if rng.random() > 0.02 else None, a if rng.random() > 0.02 else None, rng.choice(["view", "view", "click", None]), rng.choice([None, float("nan"), float("inf"), -1.005, 2.345, 10.0])))
    rows += rng.sample(rows, n // 10)
    rows += [(None, *r[1:]) for r in rng.sample(rows, n // 10)]
    rows += [(r[0], r[1], r[2] and r[2] + dt.timedelta(days=1), "click", 1.0) for r in rng.sample(rows, n // 10)]
    rng.shuffle(rows)
    return rows


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("days", [range(12), [1, 2, 7]])
def test_records_are_those_of_the_rules(spark, days):
    rows = made(400, 5, list(days))
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = panes.revise_panes(df).collect()
    want = brute(rows)
    assert {"emit", "retract", "replace", "late", "final"} <= {r.record for r in got}
    assert order(got) == order(want)


def test_without_rows_and_with_one_that_is_last(spark):
    assert panes.revise_panes(spark.createDataFrame([], SCHEMA)).collect() == []
    t = dt.datetime(1950, 1, 1, 5, 30)
    day = (t - dt.datetime(1970, 1, 1)).days
    a = t + dt.timedelta(days=(7 - day) % 8)  # arrives in the last batch, so that no time has passed when it comes
    rows = [(3, t, a, None, 1.5, "x", "y")]
    got = panes.revise_panes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert order(got) == order(brute([r[:5] for r in rows])) and got[0].record == "final"


def test_the_sessions_settings_come_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    panes.revise_panes(spark.createDataFrame([], SCHEMA), n_batches=2)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
