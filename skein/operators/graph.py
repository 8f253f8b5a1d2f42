"""Call graphs: degrees, centralities, reachability, paths and time-ordered flow counts.

Whole-graph questions (degree, reachability, breadth-first distances, closeness, harmonic) are DataFrame
iterations, so one graph may be any size. Questions inside one app's graph that are inherently sequential
(Katz to a tolerance, flows along shortest paths, depth-first sequences) are grouped kernels per app.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.shared import saved


def simple_edges(calls: DataFrame, group: Sequence[str] = ("app",), src: str = "caller", dst: str = "callee") -> DataFrame:
    return calls.select(*group, F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()


def nodes(edges: DataFrame, group: Sequence[str] = ("app",)) -> DataFrame:
    return edges.select(*group, F.col("src").alias("node")).union(edges.select(*group, F.col("dst").alias("node"))).distinct()


def entries(edges: DataFrame, group: Sequence[str] = ("app",)) -> DataFrame:
    """Nodes that nothing calls."""
    return edges.select(*group, F.col("src").alias("node")).distinct().join(edges.select(*group, F.col("dst").alias("node")).distinct(), [*group, "node"], "left_anti")


def degree_centrality(edges: DataFrame, group: Sequence[str] = ("app",), digits: int | None = None) -> DataFrame:
    """(group..., node, centrality): in plus out degree over n - 1; 1 for a graph of one node."""
    ends = edges.select(*group, F.col("src").alias("node")).unionAll(edges.select(*group, F.col("dst").alias("node")))
    deg = ends.groupBy(*group, "node").agg(F.count("*").alias("_d"))
    c = F.when(F.col("_n") > 1, F.col("_d").cast("double") / (F.col("_n") - 1)).otherwise(F.lit(1.0))
    return _with_count(deg, group).select(*group, "node", (F.round(c, digits) if digits is not None else c).alias("centrality"))


def _with_count(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """``rows`` with ``_n``, the number of rows of their graph: counted once per graph, and joined."""
    if not group:
        return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))  # one row
    return rows.join(rows.groupBy(*group).agg(F.count("*").alias("_n")), list(group))


def neighbours(edges: DataFrame, name: str, direction: str = "callees") -> DataFrame:
    """Edges of a node, any case."""
    return edges.where(F.lower("src" if direction == "callees" else "dst") == name.lower())


def distances(edges: DataFrame, starts: DataFrame, group: Sequence[str] = (), save=saved) -> DataFrame:
    """(group..., start, node, d): breadth-first distances from each start, one join a round until no new pairs.

    ``save(df, name)`` cuts the lineage between rounds (by default a table in the shared folder); a round joins the new
    pairs only, and those already known fall to an anti join. A graph of n nodes ends in n rounds.
    """
    keys, k = [*group, "start", "node"], 0
    front = known = save(starts.select(*group, F.col("node").alias("start"), "node").distinct().withColumn("d", F.lit(0)), "d0")
    while not front.isEmpty():
        k += 1
        step = front.join(edges, (front["node"] == edges["src"]) if not group else [*[front[g] == edges[g] for g in group], front["node"] == edges["src"]])
        new = step.select(*[front[g] for g in group], front["start"], edges["dst"].alias("node")).distinct().join(known, keys, "left_anti").withColumn("d", F.lit(k))
        front = save(new, f"d{k}")
        known = known.unionByName(front)
    return known


def closeness(distance_rows: DataFrame, node_rows: DataFrame, group: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """(group..., node, closeness): over incoming distances, scaled by the reached share of the graph."""
    n = _with_count(node_rows.select(*group, "node"), group)
    s = distance_rows.where("start <> node").groupBy(*group, "node").agg(F.sum("d").alias("_s"), F.count("*").alias("_r"))
    c = F.when(F.col("_s") > 0, F.col("_r").cast("double") / F.col("_s") * F.col("_r") / (F.col("_n") - 1)).otherwise(0.0)
    out = n.join(s, [*group, "node"], "left").withColumn("closeness", F.coalesce(c, F.lit(0.0)))
    return out.select(*group, "node", F.round("closeness", digits).alias("closeness") if digits is not None else "closeness")


def harmonic(distance_rows: DataFrame, node_rows: DataFrame, group: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """(group..., node, harmonic): sum of 1 / distance over incoming nodes."""
    s = distance_rows.where("start <> node").groupBy(*group, "node").agg(F.sum(1.0 / F.col("d")).alias("harmonic"))
    out = node_rows.join(s, [*group, "node"], "left").withColumn("harmonic", F.coalesce("harmonic", F.lit(0.0)))
    return out.select(*group, "node", F.round("harmonic", digits).alias("harmonic") if digits is not None else "harmonic")


def closure(edges: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group..., ancestor, node): transitive closure, a node its own ancestor."""
    starts = nodes(edges, group)
    return distances(edges, starts, group).select(*group, F.col("start").alias("ancestor"), "node")


def common_ancestor_pairs(ancestor_rows: DataFrame, pairs: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """pairs (src, dst) with ``reachable``: whether some node is an ancestor of both, or they are one."""
    a = ancestor_rows.select(*group, "ancestor", F.col("node").alias("src"))
    b = ancestor_rows.select(*group, "ancestor", F.col("node").alias("dst"))
    hit = pairs.join(a, [*group, "src"]).join(b, [*group, "dst", "ancestor"]).select(*group, "src", "dst").distinct().withColumn("_r", F.lit(True))
    return pairs.join(hit, [*group, "src", "dst"], "left").withColumn("reachable", F.coalesce("_r", F.lower("src") == F.lower("dst"))).drop("_r")


# kernels over one app's graph


class LocalGraph:
    """Successors and edge times of one graph, neighbours in order of name so that every choice is defined."""

    def __init__(self, edges: pd.DataFrame):
        self.times = {(s, d): [int(x) for x in t] for s, d, t in zip(edges["src"], edges["dst"], edges["ts"], strict=True)} if "ts" in edges else {}
        self.next: dict[str, list[str]] = {}
        for s, d in sorted(set(zip(edges["src"], edges["dst"], strict=True))):
            self.next.setdefault(s, []).append(d)
            self.next.setdefault(d, [])
        self.back: dict[str, list[str]] = {n: [] for n in self.next}
        for s, ds in self.next.items():
            for d in ds:
                self.back[d].append(s)

    def reach(self, start: str, back: bool = False) -> dict[str, int]:
        """Distances from (or to) a node."""
        step, seen, todo = self.back if back else self.next, {start: 0}, deque([start])
        while todo:
            n = todo.popleft()
            for m in step[n]:
                if m not in seen:
                    seen[m] = seen[n] + 1
                    todo.append(m)
        return seen

    def shortest(self, a: str, b: str) -> list[tuple[str, str]] | None:
        """Edges of the first shortest path by names; [] from a node to itself, None when there is none."""
        if a not in self.next or b not in self.next:
            return None
        left = self.reach(b, back=True)
        if a not in left:
            return None
        out = []
        while a != b:
            m = min(x for x in self.next[a] if left.get(x, -1) == left[a] - 1)
            out.append((a, m))
            a = m
        return out

    def paths(self, a: str, b: str, longest: int) -> list[list[tuple[str, str]]]:
        """All simple paths of at most ``longest`` edges."""
        left = self.reach(b, back=True) if b in self.next else {}
        out: list[list[tuple[str, str]]] = []

        def walk(n: str, path: list[tuple[str, str]], on: set[str]) -> None:
            if n == b and path:
                out.append(list(path))
                return
            for m in self.next.get(n, ()):
                if m not in on and left.get(m, longest + 1) + len(path) + 1 <= longest:
                    path.append((n, m))
                    walk(m, path, on | {m})
                    path.pop()

        walk(a, [], {a})
        return out

    def ancestor(self, a: str, b: str) -> str | None:
        """The nearest node that both are reached from: by summed distance, then name."""
        if a not in self.next or b not in self.next:
            return None
        x, y = self.reach(a, back=True), self.reach(b, back=True)
        both = [(x[n] + y[n], n) for n in x if n in y]
        return min(both)[1] if both else None


def _instances(g: LocalGraph, to_src: list, to_sink: list) -> int:
    """k-th instances that run without a break from the ancestor to the source, and later on to the sink."""
    if not to_src or not to_sink:
        return 0
    up, down = [g.times[e] for e in to_src], [g.times[e] for e in to_sink]
    n = 0
    for k in range(min(map(len, [*up, *down]))):
        at, after = up[-1][k], down[0][k]
        behind = all(t[k] == at - i for i, t in enumerate(reversed(up)))
        ahead = all(t[k] == after + i for i, t in enumerate(down))
        n += behind and ahead and after > at
    return n


def _remaining(paths: list[list[int]], floor: int | None) -> tuple[int, list[int]]:
    """(fewest usable instances of a path's edges, those of its last edge): later than the edge before's first and than ``floor``."""
    least, kept = len(paths[0]), []
    for before, now in zip(paths, paths[1:], strict=False):
        first = min(before)
        ok = [t for t in now if t > first and (floor is None or t > floor)]
        least, kept = min(least, len(ok)), ok
    return least, kept


def flows_default(g: LocalGraph, a: str, b: str) -> int:
    top = g.ancestor(a, b)
    return 0 if top is None or a.lower() == b.lower() else _instances(g, g.shortest(top, a), g.shortest(top, b))


def flows_all(g: LocalGraph, a: str, b: str, longest: int = 15) -> int:
    """Over every pair of paths from the ancestor, the shortest ones counted once more beside the list."""
    top = g.ancestor(a, b)
    if top is None or a.lower() == b.lower():
        return 0
    s, t = g.shortest(top, a), g.shortest(top, b)
    if not s or not t:
        return 0
    return sum(_instances(g, x, y) for x in [s, *g.paths(top, a, longest)] for y in [t, *g.paths(top, b, longest)])


def flows_conservative(g: LocalGraph, a: str, b: str) -> int:
    """The thinnest edge of both paths, after instances that come before all of the edge above are left out."""
    top = g.ancestor(a, b)
    if top is None or a.lower() == b.lower():
        return 0
    up, down = ([g.times[e] for e in p] for p in (g.shortest(top, a), g.shortest(top, b)))
    big = 2**31 - 1
    n_up, n_down, floor = big, big, 0
    if up:
        n_up, kept = _remaining(up, None)
        if not kept:
            return 0
        floor = min(kept)
    if down:
        n_down, kept = _remaining(down, floor)
        if len(down[-1]) == len(set(kept)):
            return 0
    return min(n_up, n_down)


def flows_by_callers(g: LocalGraph, a: str, b: str) -> int:
    """What the source's direct callers can carry on to the sink."""
    total = 0
    if a.lower() == b.lower() or a not in g.next or b not in g.next:
        return 0
    for caller in g.back[a]:
        down = g.shortest(caller, b)
        if not down:
            continue
        source = g.times[caller, a]
        n, kept = _remaining([g.times[e] for e in down], min(source))
        if kept:
            total += min(n, len(source))
    return total


RULES = {"default": flows_default, "all": flows_all, "conservative": flows_conservative, "callers": flows_by_callers}


def flow_counts(edges: DataFrame, pairs: DataFrame, rule: str = "default", app: str = "app") -> DataFrame:
    """(app, source, sink, n_flows) of candidate pairs: only pairs of one app meet, in a kernel per app.

    edges: app, src, dst, ts. Pairs without a common ancestor have 0.
    """
    count = RULES[rule]

    def kernel(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        g = LocalGraph(e)
        return pd.DataFrame({app: p[app], "source": p["source"], "sink": p["sink"], "n_flows": [count(g, a, b) for a, b in zip(p["source"], p["sink"], strict=True)]})

    return edges.groupBy(app).cogroup(pairs.toDF(*pairs.columns).groupBy(app)).applyInPandas(kernel, f"{app} string, source string, sink string, n_flows long")


def tree_flow_counts(tree: DataFrame, pairs: DataFrame, by_caller: bool = False, app: str = "app") -> DataFrame:
    """Flow counts on call trees: over instances (method, ts), the source's before the sink's, steps one tick apart.

    tree: app, src, src_ts, dst, dst_ts.
    """

    def kernel(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        up = {(d, int(t)): (s, int(u)) for s, u, d, t in zip(e["src"], e["src_ts"], e["dst"], e["dst_ts"], strict=True)}
        of: dict[str, list[tuple[str, int]]] = {}
        for n in sorted({*up, *up.values()}, key=lambda n: (n[1], n[0])):
            of.setdefault(n[0], []).append(n)

        def chain(n: tuple[str, int]) -> list[tuple[str, int]]:
            out = [n]
            while n in up and up[n] not in out:
                n = up[n]
                out.append(n)
            return out

        def run(path: list[tuple[str, int]], last: int) -> bool:
            return all(n[1] == last - i for i, n in enumerate(path))

        def count(a: str, b: str) -> int:
            total = 0
            if a.lower() == b.lower():
                return 0
            heads = [up[x] for x in of.get(a, []) if x in up] if by_caller else of.get(a, [])
            for x in dict.fromkeys(heads):
                for y in of.get(b, []):
                    cx, cy = chain(x), chain(y)
                    if by_caller:
                        if x not in cy or x == y:
                            continue
                        down = cy[: cy.index(x)]
                        total += down[-1][1] > x[1] and run(down, y[1])
                        continue
                    if x[1] >= y[1]:
                        continue
                    top = next((n for n in cx if n in cy), None)
                    if top is None or top in (x, y):
                        continue
                    left, right = cx[: cx.index(top)], cy[: cy.index(top)]
                    total += right[-1][1] > x[1] and run(left, x[1]) and run(right, y[1])
            return total

        return pd.DataFrame({app: p[app], "source": p["source"], "sink": p["sink"], "n_flows": [count(a, b) for a, b in zip(p["source"], p["sink"], strict=True)]})

    return tree.groupBy(app).cogroup(pairs.toDF(*pairs.columns).groupBy(app)).applyInPandas(kernel, f"{app} string, source string, sink string, n_flows long")


def katz(edges: DataFrame, alpha: float = 0.1, beta: float = 1.0, rounds: int = 1000, tolerance: float = 1e-6, app: str = "app", digits: int | None = None) -> DataFrame:
    """(app, node, katz): power iteration over incoming links, scaled to unit length; no convergence fails the query."""

    def kernel(e: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([e["src"].to_numpy(str), e["dst"].to_numpy(str)]), return_inverse=True)
        src, dst, n = at[: len(e)], at[len(e) :], len(names)
        x = np.zeros(n)
        for _ in range(rounds):
            new = alpha * np.bincount(dst, x[src], n) + beta
            if np.abs(new - x).sum() < n * tolerance:
                new = new / np.linalg.norm(new)
                return pd.DataFrame({app: e[app].iloc[0], "node": names, "katz": new.round(digits) if digits is not None else new})
            x = new
        raise ArithmeticError(f"no convergence in {rounds} rounds for {e[app].iloc[0]}")

    return edges.select(app, "src", "dst").distinct().groupBy(app).applyInPandas(kernel, f"{app} string, node string, katz double")


def shortest_paths(edges: DataFrame, pairs: DataFrame, app: str = "app") -> DataFrame:
    """(app, src, dst, path array<string>) of pairs with a path, by edge count, then names."""

    def kernel(e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        g = LocalGraph(e)
        rows = [(p[app].iloc[i], a, b, path) for i, (a, b) in enumerate(zip(p["src"], p["dst"], strict=True)) if (path := g.shortest(a, b)) is not None]
        return pd.DataFrame([(x, a, b, [a, *[d for _, d in path]]) for x, a, b, path in rows], columns=[app, "src", "dst", "path"])

    return edges.groupBy(app).cogroup(pairs.toDF(*pairs.columns).groupBy(app)).applyInPandas(kernel, f"{app} string, src string, dst string, path array<string>")


def tree_paths(tree: DataFrame, pairs: DataFrame, app: str = "app") -> DataFrame:
    """(app, src, dst, src_ts, dst_ts): instance pairs by name on one branch, the ancestor earlier."""
    pair = lambda c, t: F.struct(F.col(c).alias("m"), F.col(t).alias("t"))
    e = tree.select(app, pair("src", "src_ts").alias("src"), pair("dst", "dst_ts").alias("dst"))
    anc = closure(e, [app]).where("ancestor <> node")
    flat = anc.select(app, F.col("ancestor.m").alias("src"), F.col("node.m").alias("dst"), F.col("ancestor.t").alias("src_ts"), F.col("node.t").alias("dst_ts"))
    return flat.join(pairs, [app, "src", "dst"]).where("src_ts < dst_ts")


def call_sequences(edges: DataFrame, app: str = "app") -> DataFrame:
    """(app, entry, sequence): maximal depth-first sequences from entry nodes, by name; a node is entered once."""

    def kernel(e: pd.DataFrame) -> pd.DataFrame:
        g = LocalGraph(e)
        seen: set[str] = set()
        out = []
        for entry in sorted(n for n in g.next if not g.back[n]):
            todo = [(entry, [entry])]
            while todo:
                n, path = todo.pop()
                if n in seen:
                    continue
                seen.add(n)
                ahead = [m for m in g.next[n] if m not in seen]
                if not ahead:
                    out.append((e[app].iloc[0], entry, path))
                todo += [(m, [*path, m]) for m in reversed(ahead)]
        return pd.DataFrame(out, columns=[app, "entry", "sequence"])

    return edges.groupBy(app).applyInPandas(kernel, f"{app} string, entry string, sequence array<string>")


def reachable_methods(edges: DataFrame, entry_rows: DataFrame, group: Sequence[str] = ("app",)) -> DataFrame:
    return distances(edges, entry_rows, group).groupBy(*group, "node").agg(F.min("d").alias("depth"))


def bottom_up_order(edges: DataFrame, app: str = "app") -> DataFrame:
    """(app, node, place): callees before callers where the graph has no cycle, by depth-first finishing times."""

    def kernel(e: pd.DataFrame) -> pd.DataFrame:
        g, done, order = LocalGraph(e), set(), []
        for root in sorted(g.next):
            todo = [(root, False)]
            while todo:
                n, left = todo.pop()
                if left:
                    order.append(n)
                elif n not in done:
                    done.add(n)
                    todo.append((n, True))
                    todo += [(m, False) for m in reversed(g.next[n]) if m not in done]
        return pd.DataFrame({app: e[app].iloc[0], "node": order, "place": range(len(order))})

    return edges.groupBy(app).applyInPandas(kernel, f"{app} string, node string, place long")


def subtypes(hierarchy: DataFrame) -> DataFrame:
    """(ancestor, node) of (child, parent) rows, any depth."""
    return closure(hierarchy.select(F.col("parent").alias("src"), F.col("child").alias("dst")))


def component_type(classes: DataFrame, subtype_rows: DataFrame, bases: DataFrame) -> DataFrame:
    """classes with ``type``: that of the base class they descend from, by the bases' order."""
    hit = subtype_rows.join(F.broadcast(bases), F.col("ancestor") == F.col("base")).groupBy("node").agg(F.min_by("type", "ord").alias("type"))
    return classes.join(hit.withColumnRenamed("node", "class"), "class", "left")


def backward_facts(flow_edges: DataFrame, uses: DataFrame) -> DataFrame:
    """(use, definition): definitions that may reach a use, facts joined where branches meet (a backward closure)."""
    turned = flow_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return distances(turned, uses.select("node")).select(F.col("start").alias("use"), F.col("node").alias("definition"))


def reflective_targets(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """calls (app, method, local, name) with ``class``: what the local was last defined by in its method.

    definitions: app, method, local, kind (``forName``, ``loadClass``, ``getClass``, ``constant``), value, line.
    """
    known = definitions.where(F.col("kind").isin("forName", "loadClass", "getClass", "constant")).groupBy("app", "method", "local").agg(F.max_by("value", "line").alias("class"))
    return calls.join(known, ["app", "method", "local"], "left")


def reflective_uses(members: DataFrame) -> DataFrame:
    """(app, kind, n) of reflective fields, instance creations and stored methods."""
    return members.where(F.col("kind").isin("field", "newInstance", "method_field")).groupBy("app", "kind").agg(F.count("*").alias("n"))


def affecting_constants(facts: DataFrame, reflective: DataFrame, zero: str = "<<zero>>") -> DataFrame:
    """(constant, call): constants next to the zero fact from which a reflective call's value can be reached."""
    constants = facts.where(F.col("src") == zero).select(F.col("dst").alias("node")).distinct()
    return distances(facts.where(F.col("src") != zero), constants).join(reflective.select("node"), "node", "left_semi").where("start <> node").select(F.col("start").alias("constant"), F.col("node").alias("call"))
