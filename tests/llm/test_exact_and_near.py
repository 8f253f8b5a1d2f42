from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest

from skein.llm import exact, neardup
from skein.llm.common import Scratch
from skein.llm.components import components

SPACE = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, band long, component long, g int, members string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1, 2, 3, "m") for i, t in rows], SCHEMA)


BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, "A b\tc"), (2, "Ab c  "), (3, "Ab\nc \n   "), (4, None), (5, ""), (6, " \t\n"), (7, "ab c"), (7, "ab c"), (8, "é x"), (9, "éx"),
    (20, BASE), (21, BASE + " z"), (22, BASE.replace("w3 ", "q ")), (23, BASE.upper()), (24, "one two"), (25, "one  two"), (26, "two one"),
    (30, "long " * 200_000), (31, "long " * 200_000 + "end"),
]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), i))
    return sorted((i, min(groups[k])[1], len(groups[k]), i == min(groups[k])[1], hashlib.sha256(k.encode()).hexdigest()) for i, t in rows for k in [SPACE.sub("", t or "")])


def test_exact_matches_brute_force_on_awkward_rows(spark):
    got = sorted(tuple(r) for r in exact.exact_dedup(docs(spark, ROWS)).collect())
    assert got == brute_exact(ROWS)


def test_exact_empty_and_null_ids(spark):
    assert exact.exact_dedup(docs(spark, [])).count() == 0
    assert exact.keep_first_copies(docs(spark, [])).count() == 0
    out = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(docs(spark, [(None, "x "), (1, "x"), (None, "y"), (2, "z"), (0, "z")])).collect()}
    assert out == {(None, None, 2, True), (1, None, 2, False), (None, None, 1, True), (2, 0, 2, False), (0, 0, 2, True)}


def texts(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in df.collect())


def test_exact_stage_goes_by_rows(spark):
    """Another text of the same id stays, identical rows are one, rows without an id take part."""
    rows = [(0, "a"), (1, "a"), (1, "unique other text"), (2, "b c"), (2, "b c"), (2, "b  c"), (None, "a"), (None, "d"), (None, "d")]
    out = exact.keep_first_copies(docs(spark, rows))
    assert out.columns == docs(spark, rows).columns
    assert texts(out) == [(False, 0, "a"), (False, 1, "unique other text"), (False, 2, "b  c"), (True, 0, "d")]


def test_append_returns_the_rows_it_wrote(spark):
    index = exact.DigestIndex(spark)
    row = lambda d, i: spark.createDataFrame([(bytes([d]), i, 1)], "digest binary, keep_id long, group_size long")
    assert [r.keep_id for r in index.append(row(1, 5)).collect()] == [5]
    second = index.append(row(1, 6).union(row(2, 7)))
    assert second.count() == 1 and second.first().keep_id == 7
    assert {r.keep_id for r in index.read().collect()} == {5, 7}
    tables = {t.name for t in spark.catalog.listTables()}
    exact.exact_dedup(docs(spark, [(1, "x")])).collect()
    assert {t.name for t in spark.catalog.listTables()} == tables  # an index of one's own leaves no table
    spark.sql(f"DROP TABLE {index.name}")


def test_operators_leave_the_session_as_it_was(spark):
    now = dict(spark.conf.getAll)
    neardup.near_dup_groups(docs(spark, ROWS)).collect()
    exact.exact_dedup(docs(spark, ROWS)).collect()
    assert dict(spark.conf.getAll) == now


def test_near_clashing_ids_and_missing_ids(spark):
    far = " ".join(f"k{i}" for i in range(60))
    rows = [(1, BASE), (1, far), (2, BASE + " z"), (3, far + " z"), (None, far + " y"), (None, "only here of all rows"), (0, "nothing like the others in here")]
    out = neardup.near_dup_groups(docs(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [
        ("0", "0", True), ("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "1", False), ("None", "1", False), ("None", "None", True),
    ]
    left = neardup.keep_one_of_each_group(docs(spark, [*rows, (4, BASE), (4, "a text of its own, with the id of a copy")]))
    assert texts(left) == sorted([(False, 1, BASE), (False, 1, far), (False, 0, rows[-1][1]), (False, 4, "a text of its own, with the id of a copy"), (True, 0, "only here of all rows")])


def test_large_bands_are_dealt(spark, monkeypatch):
    """Many classes in one band, of several components: the pairs between them are met in salted parts."""
    import random

    monkeypatch.setattr(neardup, "BAND_ROWS", 7)
    rnd = random.Random(9)
    rows = []
    for i in range(150):
        words = [f"v{k}" for k in range(60)]
        at = rnd.choice([0, 15, 30])
        words[at : at + rnd.randint(3, 14)] = [f"x{i}{k}" for k in range(rnd.randint(3, 14))]
        rows.append((i, " ".join(words)))
    got = sorted(tuple(r) for r in neardup.near_dup_groups(docs(spark, rows)).collect())
    assert got == brute_near(rows)


def test_index_keeps_what_came_first(spark):
    index = exact.DigestIndex(spark)
    exact.exact_dedup(docs(spark, [(5, "same"), (6, "other")]), index).collect()
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact.exact_dedup(docs(spark, [(1, "sa me"), (2, "new")]), index).collect()}
    assert got == {1: (5, False), 2: (2, True)}
    assert exact.DigestIndex(spark, index.name).read().count() == 3
    spark.sql(f"DROP TABLE {index.name}")
    again = exact.DigestIndex(spark, index.name, index.buckets, index.path)
    assert again.exists() and again.read().count() == 3
    assert [r.kept for r in exact.exact_dedup(docs(spark, [(9, "other")]), again).collect()] == [False]
    assert sorted(r.doc_id for r in exact.keep_first_copies(docs(spark, ROWS)).collect()) == sorted({i for i, k, _, kept, _ in brute_exact(ROWS) if kept})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i, _ in rows)


def test_near_matches_brute_force_on_awkward_rows(spark):
    got = sorted(tuple(r) for r in neardup.near_dup_groups(docs(spark, ROWS)).collect())
    assert got == brute_near(ROWS)
    assert neardup.near_dup_groups(docs(spark, [])).count() == 0


def test_near_chains_between_borderline_copies(spark):
    import random

    rnd = random.Random(4)
    rows = []
    for i in range(240):
        words = [f"v{k}" for k in range(45)]
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(45)] = f"r{rnd.random()}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rnd.random()}" for _ in range(20))) for i in range(40)]
    got = sorted(tuple(r) for r in neardup.near_dup_groups(docs(spark, rows)).collect())
    assert got == brute_near(rows)


@pytest.mark.parametrize("n", [1, 30])
def test_components_of_a_path_and_a_star(spark, n):
    links = [(i, i + 1) for i in range(n)] + [(500, 600 + i) for i in range(n)] + [(7000, 7000)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {500: 500} | {600 + i: 500 for i in range(n)}


def test_hot_groups_are_joined_apart(spark, monkeypatch):
    """A group of a third of all rows and many small ones: the same rows as by a plain join, whichever way is taken."""
    from skein.llm import common

    rows = spark.range(900).selectExpr("id", "IF(id % 3 = 0, -1, id div 4) AS k").repartition(5)
    groups = rows.groupBy("k").agg({"id": "min", "k": "count"}).toDF("k", "least", "n").where("k <> 7")
    want = sorted((r.id, r.least, r.n) for r in rows.join(groups, "k").collect())
    for least in (0, 10_000):
        monkeypatch.setattr(common, "HOT_LEAST", least)
        monkeypatch.setattr(common, "HOT_SHARE", 0.1)
        out = common.join_groups(rows, groups, ["k"], "n", 900)
        assert sorted((r.id, r.least, r.n) for r in out.collect()) == want
