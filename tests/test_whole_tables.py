"""Queries do the whole table: no id is left out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.streaming.query import StreamingQuery

from skein.operators import graph
from skein.plans import evaluation_queries, graph_queries

PAIRS = {("click", "purchase"), ("error", "purchase"), ("click", "error")}


def test_flows_of_every_user(spark, sf):
    e = pd.read_parquet(f"{sf}/events.parquet")
    e["caller"] = e["value"].gt(10).map({True: "view", False: "signup"})
    e = e[e["caller"] != e["event_type"]].sort_values("event_id")
    want = {}
    for user, rows in e.groupby("user_id"):
        ts = rows.groupby(["caller", "event_type"])["event_id"].apply(list).reset_index()
        g = graph.LocalGraph(ts.set_axis(["src", "dst", "ts"], axis=1))
        want |= {(f"u{user}", a, b, rule): f(g, a, b) for a, b in PAIRS for rule, f in graph.RULES.items()}
    got = graph_queries.flow_counts(spark, sf).collect()
    assert len(got) == len(want) and {(r.app, r.source, r.sink, r.rule): r.n_flows for r in got} == want
    assert any(int(k[0][1:]) % 10 and n for k, n in want.items())


def test_tree_flows_of_every_user(spark, sf):
    users = {f"u{u}" for u in pd.read_parquet(f"{sf}/events.parquet", columns=["user_id"])["user_id"]}
    got = graph_queries.tree_flow_counts(spark, sf).collect()
    assert {(r.app, r.source, r.sink, r.rule) for r in got} == {(u, a, b, rule) for u in users for a, b in PAIRS for rule in ("instances", "callers")}
    assert len(got) == len(users) * len(PAIRS) * 2


def test_stream_is_waited_for_to_its_end(spark, sf, monkeypatch):
    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self) if timeout is None else False)  # any limit is too short
    users = pd.read_parquet(f"{sf}/events.parquet", columns=["user_id"])["user_id"]
    counts = evaluation_queries.stream_transitions(spark, sf)
    assert counts.agg({"cnt": "sum"}).first()[0] == len(users) - users.nunique()
