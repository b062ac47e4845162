"""Windows and continuous queries: event by event, all at once, and as a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quadrille.dataset import Dataset
from quadrille.reason.rules import rule
from quadrille.streaming import crosswindow
from quadrille.streaming.continuous import ContinuousQuery, StreamRunner, replay, retrieve
from quadrille.streaming.windows import WindowState, contents, firings
from tests.conftest import rows

TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def text(op="RSTREAM", width=3, step=1, more="", body="?s a <urn:T>"):
    return f"REGISTER {op} <urn:out> AS SELECT * FROM NAMED WINDOW :w ON :s [RANGE {width} STEP {step} {more}] WHERE {{ WINDOW :w {{ {body} }} }}"


def feed(q, names, stream="s"):
    for t, n in enumerate(names, 1):
        q.add_to_stream(stream, (f"urn:{n}", TYPE, "urn:T"), t)


def test_istream_and_dstream(spark):
    q = ContinuousQuery(spark, text("ISTREAM"))
    feed(q, "ABCD")
    assert q.results == [[("urn:A",)], [("urn:B",)], [("urn:C",)]]
    q = ContinuousQuery(spark, text("DSTREAM"))
    feed(q, "ABCDE")
    assert q.results == [[("urn:A",)]]


def test_report_strategies():
    w = WindowState(10, 10, (("PERIODIC", 5), ("NON_EMPTY_CONTENT", None)))
    fired = [w.add(i, i) for i in range(1, 12)]
    assert [f.ts for f in fired if f] == [5, 10]
    w = WindowState(4, 2, tick="TUPLE_DRIVEN")
    assert not any(w.add(i, i) for i in range(10))
    w = WindowState(4, 2)
    w.add("a", 1)
    assert w.flush() == ("a",)


@pytest.mark.parametrize("width,slide,seed", [(10, 2, 1), (5, 5, 2), (10, 4, 3), (3, 2, 4), (4, 6, 5)])
def test_all_at_once_is_event_by_event(spark, width, slide, seed):
    rng = random.Random(seed)
    events, t = [], 0
    for i in range(60):
        t += rng.choice([0, 1, 1, 2, 3, 9])
        events.append((f"s{rng.randint(0, 9)}", "p", "o", t))
    state, want = WindowState(width, slide), {}
    for s, p, o, ts in events:
        f = state.add((s, p, o), ts)
        if f:
            want[f.ts] = (f.open, f.close, sorted(f.items))
    df = spark.createDataFrame(events, "s string, p string, o string, ts long")
    fired = firings(df, width, slide)
    assert rows(fired) == sorted((ts, o, c) for ts, (o, c, _) in want.items())
    got = {}
    for r in contents(df, fired, width, slide).collect():
        got.setdefault(r.fire_ts, []).append((r.s, r.p, r.o))
    assert {k: sorted(v) for k, v in got.items()} == {k: v[2] for k, v in want.items() if v[2]}


def test_replay_is_single_events(spark):
    names = [random.Random(7).choice("ABCDE") for _ in range(15)]
    events = spark.createDataFrame([("s", f"urn:{n}", TYPE, "urn:T", t) for t, n in enumerate(names, 1)], "stream string, s string, p string, o string, ts long")
    for op in ("RSTREAM", "ISTREAM", "DSTREAM"):
        q = ContinuousQuery(spark, text(op, 4, 2))
        feed(q, names)
        assert sorted(x for r in q.results for x in r) == sorted((r.s,) for r in replay(events, text(op, 4, 2)).collect())


def test_static_data_rules_and_filters(spark):
    static = Dataset.of(spark, [("urn:A", "urn:in", "urn:room"), ("urn:B", "urn:in", "urn:hall")])
    body = "REGISTER RSTREAM <urn:o> AS SELECT ?s ?r FROM NAMED WINDOW :w ON :s [RANGE 2 STEP 2] WHERE { WINDOW :w { ?s <urn:hot> ?v } ?s <urn:in> ?r . FILTER(?v > 5) }"
    events = spark.createDataFrame([("s", "urn:A", "urn:temp", "9", 1), ("s", "urn:B", "urn:temp", "3", 1), ("s", "urn:C", "urn:temp", "9", 2)], "stream string, s string, p string, o string, ts long")
    assert rows(replay(events, body, static, [rule([("?x", "urn:temp", "?v")], [("?x", "urn:hot", "?v")])])) == [(2, "urn:A", "urn:room")]


@pytest.mark.parametrize("policy,want", [("wait", 1), ("steal", 2)])
def test_several_windows(spark, policy, want):
    q = ContinuousQuery(spark, f"REGISTER RSTREAM <urn:o> AS SELECT * FROM NAMED WINDOW :a ON :sa [RANGE 2 STEP 2] WITH POLICY {policy} FROM NAMED WINDOW :b ON :sb [RANGE 2 STEP 2] WHERE {{ WINDOW :a {{ ?x <urn:p> ?y }} WINDOW :b {{ ?y <urn:q> ?z }} }}")
    q.add_to_stream("sa", ("urn:1", "urn:p", "urn:m"), 1)
    q.add_to_stream("sb", ("urn:m", "urn:q", "urn:2"), 1)
    q.latest = dict.fromkeys(q.latest)
    q.fresh = set()
    q.add_to_stream("sa", ("urn:0", "urn:p", "urn:0"), 2)
    q.add_to_stream("sb", ("urn:0", "urn:q", "urn:0"), 2)
    q.add_to_stream("sa", ("urn:0", "urn:p", "urn:0"), 4)
    assert len(q.results) >= 1 and q.results[0] == [("urn:1", "urn:m", "urn:2")]
    assert len(q.results) <= want


def test_timeout_policy(spark):
    now = [0.0]
    q = ContinuousQuery(spark, "REGISTER RSTREAM <urn:o> AS SELECT * FROM NAMED WINDOW :a ON :sa [RANGE 2 STEP 2] WITH POLICY (timeout=5, fallback=drop) FROM NAMED WINDOW :b ON :sb [RANGE 2 STEP 2] WHERE { WINDOW :a { ?x <urn:p> ?y } WINDOW :b { ?y <urn:q> ?z } }", clock=lambda: now[0])
    q.add_to_stream("sa", ("urn:1", "urn:p", "urn:m"), 1)
    q.add_to_stream("sa", ("urn:1", "urn:p", "urn:m"), 2)
    now[0] = 10.0
    q.tick()
    assert q.results == [] and not q.fresh


def test_stream_is_replay(spark, tmp_path):
    events = [("s", f"urn:{'ABCDE'[i % 5]}", TYPE, "urn:T", i) for i in range(1, 25)]
    src = tmp_path / "in"
    src.mkdir()
    got = []
    runner = StreamRunner(text("ISTREAM", 6, 2), lambda df, i: got.extend(tuple(r) for r in df.collect()))
    stream = spark.readStream.schema("stream string, s string, p string, o string, ts long").json(str(src))
    query = runner.start(stream, str(tmp_path / "check"))
    for k in range(0, 24, 8):
        (src / f"{k:02}.json").write_text("\n".join(json.dumps(dict(zip(("stream", "s", "p", "o", "ts"), e))) for e in events[k : k + 8]))
        query.processAllAvailable()
    query.stop()
    df = spark.createDataFrame(events, "stream string, s string, p string, o string, ts long")
    assert sorted(got) == rows(replay(df, text("ISTREAM", 6, 2)))


def test_cross_window(spark):
    sensor = spark.createDataFrame([("s1", "temp", "hot", 5)], "s string, p string, o string, ts long")
    maps = spark.createDataFrame([("s1", "in", "room", 3)], "s string, p string, o string, ts long")
    r = [rule([("?x", "urn:w1/temp", "hot"), ("?x", "urn:w2/in", "?r")], [("?r", "alert", "1")])]
    windows = {"urn:w1/": (10, sensor), "urn:w2/": (20, maps)}
    base = crosswindow.base_facts(windows, now=10)
    full = crosswindow.materialise(base, r, 10)
    assert [(x.s, x.tag) for x in full.where("p = 'alert'").collect()] == [("room", 15)]
    later = {"urn:w1/": (10, sensor.withColumn("ts", F.lit(14).cast("long"))), "urn:w2/": (20, maps)}
    for now in (12, 16):
        b = crosswindow.base_facts(later if now == 12 else {"urn:w2/": (20, maps)}, now=now)
        merged = b if now == 12 else b.unionByName(crosswindow.base_facts(later, now=now)).distinct()
        assert rows(crosswindow.update(full, merged, r, now)) == rows(crosswindow.materialise(merged, r, now))


def test_retrieve_and_seeds(spark):
    ds = Dataset.of(spark, [("a", "urn:p", "1"), ("a", "urn:q", "2")])
    assert rows(retrieve(ds, "RETRIEVE SOME ACTIVE STREAM ?s FROM <urn:x> WITH { ?s <urn:p> ?o . }")) == [("a", "urn:p", "1")]
    q = ContinuousQuery(spark, text())
    assert [q.add_probabilistic_to_stream("s", ("a", TYPE, "urn:T"), 0.5, t) for t in (1, 2)] == [1, 2]
