"""Markov transition queries over ``events``."""

from __future__ import annotations

from skein.operators import markov

from ._tables import read

STATES = ["click", "error", "purchase", "signup", "view"]
DROPPED = ["clickToclick", "errorToerror", "purchaseTopurchase", "signupTosignup", "viewToview"]


def _counts(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return markov.transition_counts(markov.successive_pairs(events, ["user_id"], "event_type", ["ts", "event_id"]), ["user_id"])


def markov_transitions(spark, sf_dir):
    return markov.transition_probabilities(_counts(spark, sf_dir), ["user_id"])


def markov_wide(spark, sf_dir):
    wide = markov.transition_matrix(markov_transitions(spark, sf_dir), ["user_id"], STATES)
    return markov.drop_columns(wide, DROPPED)


_BASE = """WITH seq AS (SELECT user_id, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
t AS (SELECT user_id, src, dst, count(*) AS cnt FROM seq WHERE dst IS NOT NULL GROUP BY ALL),
p AS (SELECT user_id, src, dst, cnt, round(CAST(cnt AS DOUBLE) / CAST(sum(cnt) OVER (PARTITION BY user_id, src) AS DOUBLE), 6) AS p FROM t)
"""

QUERIES = {"markov_transitions": markov_transitions, "markov_wide": markov_wide}
ORACLES = {
    "markov_transitions": _BASE + "SELECT user_id, src, dst, cnt, p FROM p",
    "markov_wide": _BASE + "SELECT user_id, " + ", ".join(f"coalesce(max(p) FILTER (WHERE src = '{a}' AND dst = '{b}'), 0.0) AS {a}To{b}" for a in STATES for b in STATES if f"{a}To{b}" not in DROPPED) + " FROM p GROUP BY user_id",
}
