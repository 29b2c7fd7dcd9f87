import random
from collections import defaultdict

import pandas as pd

from trailspan.operators import ledger
from trailspan.streaming import people

ROWS = "email string, at timestamp, seq long, kind string, walk string, token string, new_token string"
START = pd.Timestamp("2026-05-01")


def drawn(seed, n, first=0, since=0):
    """Commands in order of time: mostly sensible, some not, hours apart now and then."""
    rng, rows, token, walk, at = random.Random(seed), [], {}, {}, START + pd.Timedelta(hours=since)
    for k in range(n):
        at += pd.Timedelta(minutes=rng.choice((1, 5, 40, 300)))
        who = rng.randrange(6)
        kind = rng.choice(("register", "preview", "preview", "start", "start", "complete", "discard"))
        new = f"t{first + k}" if kind == "register" else None
        if kind == "preview":
            walk[who] = f"w{first + k}"
        mine = token.get(who) if rng.random() < 0.9 else "old"
        email = rng.choice((f"p{who}@x.org", f" P{who}@X.org "))
        rows.append((email, at.to_pydatetime(), first + k, kind, walk.get(who) if kind != "register" else None, mine, new))
        if new:
            token[who] = new
    return rows


def simple(r):
    return (r.person, str(r.at)[:19], r.seq, r.kind, r.walk, r.outcome)


def test_fold_of_a_person(spark):
    at = lambda h: (START + pd.Timedelta(hours=h)).to_pydatetime()
    c = lambda h, n, kind, walk=None, token=None, new=None: (" Ada@Example.com", at(h), n, kind, walk, token, new)
    rows = [
        c(0, 1, "start", "w1", "a"), c(1, 2, "register", new="a"), c(2, 3, "preview", "w1", "a"), c(3, 4, "register", new="b"), c(4, 5, "start", "w1", "a"), c(4, 6, "start", "w1", "b"),
        c(5, 7, "preview", "w2", "b"), c(6, 8, "complete", "w1", "b"), c(6, 9, "complete", "w1", "b"), c(7, 10, "preview", "w2", "b"), c(8, 11, "preview", "w3", "b"), c(30, 12, "start", "w3", "b"), c(31, 13, "register"),
        ("nobody", at(1), 1, "register", None, None, "x"), ("a@b.org", None, 1, "register", None, None, "x"),
    ]
    frame = spark.createDataFrame(rows, ROWS)
    got = [(r.seq, r.outcome) for r in sorted(people.folded(frame).collect(), key=lambda r: (r.at, r.seq or 0, r.kind != "discard"))]
    assert got == [(1, "REJECTED"), (2, "CREATED"), (3, "PREVIEW"), (4, "RETURNING"), (5, "REJECTED"), (6, "ACTIVE"), (7, "REJECTED"), (8, "COMPLETED"), (9, "REJECTED"), (10, "PREVIEW"), (11, "DISCARDED"), (11, "PREVIEW"), (None, "EXPIRED"), (12, "REJECTED"), (13, "REJECTED")]
    assert {r.reason for r in people.refused(frame).collect()} == {"not an address", "no time or number"}


def test_stream_with_restarts_equals_the_fold(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        parts = [drawn(1, 40), drawn(2, 40, 100, 120), drawn(3, 40, 200, 240)]
        # sent again, and late by less than the watermark allows
        late = [*parts[0][-3:], (*parts[1][5][:2], 1, *parts[1][5][3:])]
        end = [("end@x.org", (START + pd.Timedelta(hours=500)).to_pydatetime(), 999, "register", None, None, "z")]
        given, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
        arrived = [parts[0], parts[1] + late, parts[2], end, [(end[0][0], (START + pd.Timedelta(hours=501)).to_pydatetime(), 1000, "register", None, None, "y")]]
        for k, rows in enumerate(arrived):
            spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(given)
            query = people.walked(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(given), "400 hours").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
            query.awaitTermination()
        got = sorted(simple(r) for r in spark.read.parquet(out).collect() if r.outcome != "EXPIRED")
        state, want = defaultdict(people.Person), []
        for rows in arrived:
            for email, at, seq, kind, walk, token, new in sorted(rows, key=lambda r: (r[1], r[2])):
                who = email.strip().lower()
                want += [(who, str(t)[:19], s, k, w, o) for t, s, k, w, o, _ in state[who].apply(pd.Timestamp(at), seq, kind, walk, token, new) if o != "EXPIRED"]
        assert got == sorted(want) and sum(o == "REJECTED" for *_, o in got) > 10
        assert {simple(r)[:5] for r in people.folded(spark.read.parquet(given)).collect() if r.outcome == "ACTIVE"} >= {g[:5] for g in got if g[5] == "ACTIVE"}
        again = [r for r in spark.read.parquet(out).collect() if r.reason == "late or sent again"]
        assert len(again) >= 3
        assert any(r.outcome == "EXPIRED" for r in spark.read.parquet(out).collect())
    finally:
        spark.conf.set(provider, before)


def test_snapshot(spark):
    segments = spark.createDataFrame([(i,) for i in range(6)], "segment_id long")
    done = spark.createDataFrame([(1,), (1,), (2,)], "segment_id long")
    holds = spark.createDataFrame([(2, "a", 1), (3, "a", 1), (4, "b", 2), (4, "a", 1)], "segment_id long, person string, walk long")
    see = lambda who: {r.segment_id: (r.done, r.reserved, r.worth) for r in ledger.snapshot(segments, done, holds, who, 0.25).collect()}
    a, none = see("a"), see(None)
    assert a[1] == (True, False, 0.0) and a[2] == (True, False, 0.0) and a[3] == (False, False, 1.0) and a[4] == (False, True, 0.25)
    assert none[3] == (False, True, 0.25) and none[2] == (True, True, 0.0) and none[0] == (False, False, 1.0)
