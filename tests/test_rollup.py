"""The kept rollup against one from scratch."""

import datetime
import json
import random
import threading

import pytest

from lectern.operators import observe, rollup
from lectern.operators.tablelog import TableLog

SCHEMA = "request_id string, id long, ts timestamp, mode string, refused boolean, latency_ms double, judge string, gone boolean"


def some(rng, n, ids):
    for i in ids:
        day = datetime.datetime(2024, 1, 1 + rng.randrange(5), rng.randrange(24)) if rng.random() < 0.95 else None
        judge = rng.choice([None, "bad json", json.dumps({"groundedness": rng.randrange(100) / 100}), json.dumps({"groundedness": 0.1, "relevance": rng.randrange(10) / 10})])
        yield (f"r{rng.randrange(n)}", i, day, rng.choice(["ask", "agent", None]), rng.choice([True, False, None]), rng.choice([None, rng.randrange(9999) / 7, float("nan")]), judge, rng.random() < 0.1)


def told(df):
    return sorted((tuple(r[c] for c in ("day", "requests", "refused", *rollup.MEANS)) for r in df.collect()), key=str)


def test_batches_equal_a_rollup_from_scratch(spark, tmp_path):
    rng = random.Random(3)
    batches = [list(some(rng, 40, ids)) for ids in (range(100, 160), range(0, 60), range(130, 220), range(220, 222))]
    log, last = TableLog(spark, str(tmp_path / "t")), {}
    for batch in batches:
        rollup.apply(log, spark.createDataFrame(batch, SCHEMA), delete="gone")
        newest = {}
        for r in batch:
            newest[r[0]] = max(newest.get(r[0], r), r, key=lambda x: x[1])
        for key, r in newest.items():
            if key not in last or r[1] >= last[key][1]:
                last[key] = r
        # A key that was removed is free again for any later batch.
        last = {k: r for k, r in last.items() if not r[7]}
        rows = [(*r[:5], None if r[5] != r[5] else r[5], *r[6:]) for r in last.values()]
        now = spark.createDataFrame(rows, SCHEMA)
        assert told(rollup.daily(log)) == told(observe.daily(now))
        assert told(rollup.daily(log, mode="ask")) == told(observe.daily(now.where("mode = 'ask'")))
        states = {(r.day, r.mode): r for r in log.read(rollup.DAYS, log.version()).collect()}
        assert states == {(r.day, r.mode): r for r in rollup.states(now).collect()}
    before = log.version()
    rollup.apply(log, spark.createDataFrame(batches[1], SCHEMA).where("id < 0"))
    rollup.apply(log, spark.createDataFrame(batches[1], SCHEMA).where("id = -1").drop("gone"))
    assert log.version().parts == before.parts
    every = log.read(rollup.REQUESTS, before).withColumn("gone", rollup.F.lit(True))
    rollup.apply(log, every, delete="gone")
    assert rollup.daily(log).count() == 0 and told(rollup.daily(log, before)) != []


def test_an_untouched_day_keeps_its_file_and_writers_both_count(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"))
    row = lambda k, d: (k, 1, datetime.datetime(2024, 1, d), "ask", False, 1.5, None, False)
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA).drop("gone")
    rollup.apply(log, make(*(row(f"r{d}", d) for d in range(1, 29))))
    kept = {p.path for p in log.version().parts[rollup.DAYS]}
    wait = threading.Barrier(2)

    def write(key):
        wait.wait(timeout=60)
        rollup.apply(log, make(row(key, 3)))

    threads = [threading.Thread(target=write, args=(k,)) for k in ("a", "b")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(kept & {p.path for p in log.version().parts[rollup.DAYS]}) == len(kept) - 1
    found = {r.day: r.requests for r in rollup.daily(log).collect()}
    assert found["2024-01-03"] == 3 and sum(found.values()) == 30
    assert pytest.approx(1.5) == {r.day: r.avg_latency_ms for r in rollup.daily(log).collect()}["2024-01-03"]
