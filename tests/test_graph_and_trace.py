from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skein.operators import evaluate, graph, icc, reports, split, trace


def test_parse_trace_blocks_calls_and_sites(spark):
    text = ["<a: m> -> <b: n>", "[ Intent sent ]", "caller=<a: m>", "callsite=s1", "Action=VIEW", "<a: m> -> <x: startActivity>", "junk", "[ Intent received ]", "short", "<r: q> -> <t: u>"]
    lines = spark.createDataFrame([("app", i, v) for i, v in enumerate(text)], "app string, line_no long, value string")
    calls, intents = trace.parse_trace(lines)
    assert [(r.ts, r.caller, r.callee) for r in calls.orderBy("ts").collect()] == [(0, "a: m", "b: n"), (2, "a: m", "x: startActivity"), (3, "r: q", "t: u")]
    got = intents.collect()
    assert len(got) == 1 and got[0].ts == 1 and got[0].Action == "VIEW" and got[0].Component == "null" and not got[0].incoming
    assert got[0].callsite.callee == "x: startActivity"


def brute_instances(up, down):
    n = 0
    for k in range(min(len(t) for t in up + down)):
        s, t = up[-1][k], down[0][k]
        if t > s and all(up[len(up) - 1 - i][k] == s - i for i in range(len(up))) and all(down[i][k] == t + i for i in range(len(down))):
            n += 1
    return n


def test_flow_rules(spark):
    e = pd.DataFrame([("r", "a", [1, 11]), ("a", "s", [2, 12]), ("r", "b", [4, 14]), ("b", "t", [5, 15])], columns=["src", "dst", "ts"])
    g = graph.LocalGraph(e)
    assert g.ancestor("s", "t") == "r" and [d for _, d in g.shortest("r", "t")] == ["b", "t"]
    assert graph.flows_default(g, "s", "t") == brute_instances([[1, 11], [2, 12]], [[4, 14], [5, 15]]) == 2
    assert graph.flows_default(g, "s", "S") == 0 and graph.flows_default(g, "s", "nowhere") == 0
    assert graph.flows_all(g, "s", "t") == 2 * 2 * 2
    assert graph.flows_by_callers(g, "s", "t") == 0
    df = spark.createDataFrame([("x", *r) for r in e.itertuples(index=False)], "app string, src string, dst string, ts array<int>")
    pairs = spark.createDataFrame([("x", "s", "t"), ("x", "t", "s")], "app string, source string, sink string")
    assert {(r.source, r.n_flows) for r in graph.flow_counts(df, pairs).collect()} == {("s", 2), ("t", 0)}


def test_centralities_match_plain_python(spark):
    rnd = random.Random(6)
    pairs = sorted({(f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}") for _ in range(22)})
    e = spark.createDataFrame(pairs, "src string, dst string")
    n = graph.nodes(e, [])
    names = sorted({x for p in pairs for x in p})
    dist = {}
    for s in names:
        dist[s, s], todo = 0, [s]
        for x in todo:
            for a, b in pairs:
                if a == x and (s, b) not in dist:
                    dist[s, b] = dist[s, x] + 1
                    todo.append(b)
    d = graph.distances(e, n)
    assert {(r.start, r.node): r.d for r in d.collect()} == dist
    for r in graph.harmonic(d, n).collect():
        assert abs(r.harmonic - sum(1 / v for (s, t), v in dist.items() if t == r.node and s != t)) < 1e-9
    for r in graph.closeness(d, n).collect():
        ds = [v for (s, t), v in dist.items() if t == r.node and s != t]
        assert abs(r.closeness - (len(ds) / sum(ds) * len(ds) / (len(names) - 1) if ds else 0)) < 1e-9
    k = {r.node: r.katz for r in graph.katz(e.withColumn("app", F.lit("x"))).collect()}
    a = np.array([[float((u, v) in pairs) for v in names] for u in names])
    want = np.linalg.solve(np.eye(len(names)) - 0.1 * a.T, np.ones(len(names)))
    assert np.allclose([k[x] for x in names], want / np.linalg.norm(want), atol=1e-5)


def test_call_tree_flows_and_sequences(spark):
    tree = spark.createDataFrame([("x", "r", 0, "a", 1), ("x", "a", 1, "s", 2), ("x", "r", 0, "b", 3), ("x", "b", 3, "t", 4)], "app string, src string, src_ts int, dst string, dst_ts int")
    pairs = spark.createDataFrame([("x", "s", "t")], "app string, source string, sink string")
    assert graph.tree_flow_counts(tree, pairs).first().n_flows == 1
    edges = tree.select("app", "src", "dst")
    assert sorted(r.sequence for r in graph.call_sequences(edges).collect()) == [["r", "a", "s"], ["r", "b", "t"]]
    order = {r.node: r.place for r in graph.bottom_up_order(edges).collect()}
    assert order["s"] < order["a"] < order["r"]
    p = graph.tree_paths(tree, spark.createDataFrame([("x", "r", "t")], "app string, src string, dst string")).collect()
    assert [(r.src_ts, r.dst_ts) for r in p] == [(0, 4)]


def test_feature_vectors_have_their_widths(spark):
    edges = spark.createDataFrame([("x", "SDK", "UserCode", 3), ("x", "Unknown", "SDK", 9)], "app string, src_layer string, dst_layer string, freq long")
    nodes = spark.createDataFrame([("x", "SDK", "c", "m", 2), ("x", "UserCode", "d", "n", 3)], "app string, layer string, class string, method string, in_calls long")
    classes = spark.createDataFrame([("x", "Activity", "d", 3), ("x", "Other", "e", 9)], "app string, type string, class string, instances long")
    f = reports.general_features(edges, nodes, classes).first().features
    assert len(f) == 29 and f[2] == 1.0 and f[9] == 0.5 and f[21] == 1.0
    methods = spark.createDataFrame([("x", "source", "LOCATION_INFORMATION", 4, True), ("x", "sink", "LOG", 2, False), ("x", None, None, 4, False)], "app string, role string, category string, calls long, linked boolean")
    s = reports.security_features(methods).first().features
    assert len(s) == 86 and s[0] == round(1 / 3, 4) and s[2] == 0.4 and s[4] == 1.0 and s[5] == 0.0


def test_icc_calibration_and_edges(spark):
    rows = [("x", 0, False, True, "null", "A", "c", "d", "null", "<a: m>"), ("x", 1, True, True, "null", "a", "C", "D", "null", "<b: n>"), ("x", 2, True, True, "null", "z", "c", "d", "e", "<b: n>")]
    i = spark.createDataFrame(rows, "app string, ts int, incoming boolean, external boolean, Component string, Action string, Categories string, DataString string, Extras string, caller string").withColumn("callsite", F.lit(None).cast("struct<caller:string,callee:string>"))
    assert [r.external for r in icc.calibrate(i).orderBy("ts").collect()] == [False, False, True]
    assert [r.external for r in icc.calibrate(i, ["a: m"]).orderBy("ts").collect()] == [True, True, True]
    matched = icc.links(icc.with_key(i))
    assert [(r.caller, r.callee, r.ts) for r in icc.call_edges(i, matched).collect()] == [("a: m", "b: n", 1)]
    c = icc.crosstab(i).first()
    assert (c.ext_im_inc, c.ext_im_out, c.data_only, c.data_both) == (2, 1, 2, 1)


def test_splits_and_curves(spark):
    d = spark.createDataFrame([(i, "a", f"2015-01-{i:02d}") for i in range(1, 11)] + [(20, "b", "2015-01-01")], "id long, label string, day string")
    s = split.date_pivot(d, "label", "day", "id")
    assert sorted(r.id for r in s.where("part = 'test'").collect()) == [9, 10]
    r = split.date_pivot_or_random(d, "label", "day", "id")
    assert r.count() == 11 and sorted(x.id for x in r.where("label = 'a' AND part = 'test'").collect()) == [9, 10]
    f = split.k_folds(d, ["id"], 3).groupBy("fold").count().orderBy("fold").collect()
    assert [x["count"] for x in f] == [4, 4, 3]
    assert split.hold_outs(d, "id", 4).groupBy("run").count().count() == 4
    scored = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, score double")
    assert abs(evaluate.roc_auc(scored).first().auc - 0.75) < 1e-9


def test_streams_agree_with_batch(spark, sf):
    from skein.operators import markov
    from skein.streaming import monitors

    q = monitors.transitions(monitors.event_stream(spark, sf, glob="events.parquet")).writeStream.format("memory").queryName("t_stream").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = markov.successive_pairs(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], "event_type", ["ts", "event_id"])
    count = lambda df: {(r.user_id, r.src, r.dst): r.n for r in df.groupBy("user_id", "src", "dst").agg(F.count("*").alias("n")).collect()}
    assert count(spark.table("t_stream")) == count(batch)


def test_a_trigger_may_bring_a_key_in_several_batches():
    from skein.streaming import monitors

    class State:
        exists, got = False, None

        @property
        def get(self):
            return self.got

        def update(self, value):
            self.exists, self.got = True, value

    frames = lambda rows, cols: [pd.DataFrame(rows[i : i + 2], columns=cols) for i in range(0, len(rows), 2)]
    state, order = State(), [3, 0, 4, 1, 2]
    rows = [(f"t{i}", pd.Timestamp(2020, 1, 1 + i), i) for i in order]
    out = pd.concat(monitors._pairs((7,), iter(frames(rows, ["event_type", "ts", "event_id"])), state))
    assert list(zip(out["src"], out["dst"], strict=True)) == [(f"t{i}", f"t{i + 1}") for i in range(4)] and state.got == ("t4",)
    clocks = State()
    out = pd.concat(monitors._clock(("p",), iter(frames([(i, 10.0 if i == 1 else None) for i in order], ["seq", "remote"])), clocks))
    assert out["clock"].tolist() == [1, 11, 12, 13, 14] and clocks.got == (14,)
    assert list(monitors._pairs((7,), iter([]), State())) == []


def test_ranks_and_sums_over_ranges(spark):
    from skein.operators import order

    df = spark.range(5000).selectExpr("id", "(id * 37) % 501 AS v").repartition(7)
    r = order.global_rank(df, [F.desc("v"), F.asc("id")], "place", "n").orderBy("place").collect()
    assert [x.place for x in r] == list(range(5000)) and [(-x.v, x.id) for x in r] == sorted((-x.v, x.id) for x in r) and r[0].n == 5000
    s = order.running_sums(df, [F.asc("id")], {"v": "run"}).orderBy("id").collect()
    assert [x.run for x in s] == np.cumsum([x.v for x in s]).tolist() and s[0].run_all == s[-1].run
    assert order.global_rank(df.where("id < 0"), [F.asc("id")], "place").count() == 0


def test_svm_penalty_goes_by_the_rows(spark):
    from skein.operators import models, vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] > 0).astype(float)
    df = vectors.to_vector(spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(x, y, strict=True)], "features array<double>, label double"))
    m = models.SummedSVC(c=2.0, max_iter=200).fit(df)
    assert abs(m.getRegParam() - 1 / 120) < 1e-12


def test_l1_svm_meets_its_optimality_conditions():
    from skein.operators.models import l1_svm

    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 8))
    y = np.where(x[:, 0] - 0.5 * x[:, 1] + 0.1 * rng.normal(size=120) > 0, 1.0, -1.0)
    w, b = l1_svm(x, y, c=0.1, rounds=20000, tolerance=1e-12)
    grad = 2 * 0.1 * (x.T @ (y * np.maximum(1 - y * (x @ w + b), 0)))
    assert np.allclose(grad[w != 0], np.sign(w[w != 0]), atol=1e-4) and (np.abs(grad[w == 0]) <= 1 + 1e-4).all()
    assert (np.sign(x @ w + b) == y).mean() > 0.9
