from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import mixing, sentpiece, topk, warc


# mixing


def test_schedule_windows_and_deviation():
    for seed in range(20):
        rnd = random.Random(seed)
        parts = mixing.shares({f"s{i}": rnd.random() ** 3 for i in range(rnd.randint(1, 40))}, 256)
        assert sum(parts.values()) == 256
        done = dict.fromkeys(parts, 0)
        for s, j, t, release, deadline in mixing.schedule(parts, 256):
            assert release <= t < deadline and j == done[s]
            done[s] += 1
            assert all(abs(done[x] - parts[x] * (t + 1) / 256) < 1 for x in parts)
        assert done == parts


def test_mix_places_every_document(spark):
    rnd = random.Random(3)
    rows = [(i, f"s{min(3, i % 9)}" if i % 50 else None, "x" * rnd.randint(0, 30)) for i in range(9000)] + [(5, "s0", "dup"), (9001, "s1", None), (None, "s1", "no id")]
    d = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, source string, text string, slot int, chunk string")
    out = mixing.mix(d, block=100, period=64).toPandas()
    assert sorted(out["doc_id"]) == [*range(9000), 9001]
    for _, g in out.groupby("source"):
        g = g.sort_values("start")
        assert (g["start"].to_numpy() == np.concatenate([[0], np.cumsum(g["size"])[:-1]])).all()
        assert (g["block"] == g["start"] // 100).all() and (g.groupby("block")["slot"].nunique() == 1).all()
    assert out.groupby("slot")["source"].nunique().max() == 1
    sizes = out.groupby("source")["size"].sum()
    parts = mixing.shares(mixing.default_weights(sizes.to_dict()), 64)
    until = int(out.groupby("source")["slot"].max().min())
    for t in range(1, until):
        seen = out[out["slot"] < t].groupby("source")["block"].nunique()
        assert all(abs(seen.get(s, 0) - parts[s] * t / 64) < 1.0001 for s in parts)
    again = mixing.mixed_documents(d)
    assert again.columns == d.columns and again.count() == len(rows)
    assert mixing.mix(d.where("doc_id < 0")).count() == 0
    assert set(mixing.mix(d, {"s0": 3.0, "s1": 1.0}, block=100).select("source").distinct().toPandas()["source"]) == {"s0", "s1", "s2", "s3", "(none)"}


# revisits


def captures(spark, rows):
    full = [(r["id"], r.get("url"), r.get("ts"), r["kind"], r.get("etag"), r.get("lm"), r.get("digest"), r.get("h")) for r in rows]
    return spark.createDataFrame(full, "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers map<string,string>").withColumn("page", F.lit("clash")).withColumn("state", F.lit(1))


def test_revisit_states_and_headers(spark):
    url = "http://www.Example.org:80/a/?b=2&utm_source=x&a=1#f"
    rows = [
        {"id": 1, "url": "https://example.org/a?a=1&b=2", "ts": 10, "kind": "response", "etag": "e1", "digest": "d1", "h": {"content-type": "t", "age": "1"}},
        {"id": 2, "url": url, "ts": 10, "kind": "revisit", "etag": "e1"},
        {"id": 3, "url": url, "ts": 11, "kind": "revisit", "etag": "W/e1", "h": {"age": "9", "content-type": "no", "date": "d"}},
        {"id": 4, "url": url, "ts": 12, "kind": "revisit", "etag": "zz"},
        {"id": 5, "url": url, "ts": 12, "kind": "revisit", "digest": "d1"},
        {"id": 6, "url": url, "ts": 12, "kind": "revisit"},
        {"id": 7, "url": None, "ts": 12, "kind": "revisit", "etag": "e1"},
        {"id": 8, "url": url, "ts": None, "kind": "revisit", "etag": "e1"},
        {"id": 9, "url": url, "ts": 20, "kind": "response", "etag": "e2"},
        {"id": 10, "url": url, "ts": 21, "kind": "revisit", "etag": "e1"},
        {"id": 11, "url": url, "ts": 21, "kind": "revisit", "lm": "x"},
        {"id": 12, "url": url, "ts": 30, "kind": "request"},
        {"id": 10, "url": url, "ts": 21, "kind": "revisit", "etag": "e1"},
    ]
    out = warc.resolve_revisits(captures(spark, rows)).collect()
    states = {r.record_id: (r.state, r.refers_to) for r in out}
    assert states == {2: ("orphan", None), 3: ("resolved", 1), 4: ("mismatch", None), 5: ("resolved", 1), 6: ("unverified", None), 7: ("orphan", None), 8: ("orphan", None), 10: ("mismatch", None), 11: ("mismatch", None)}
    assert len(out) == 10
    three = next(r for r in out if r.record_id == 3)
    assert three.headers == {"content-type": "t", "age": "9", "date": "d"} and three.digest == "d1"
    assert warc.resolve_revisits(captures(spark, rows[:1])).count() == 0


def test_a_hot_page_is_cut_into_time_buckets(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUCKET_ROWS", 50)
    rnd = random.Random(5)
    rows = [{"id": i, "url": "h.org/x" if rnd.random() < 0.6 else f"h.org/{rnd.randrange(20)}", "ts": rnd.randrange(400), "kind": rnd.choice(["response", "revisit", "revisit"]), "etag": rnd.choice("ab")} for i in range(2000)]
    got = {r.record_id: (r.state, r.refers_to) for r in warc.resolve_revisits(captures(spark, rows)).collect()}
    for r in rows:
        if r["kind"] == "revisit":
            before = [(x["ts"], x["id"]) for x in rows if x["kind"] == "response" and x["url"] == r["url"] and x["ts"] < r["ts"]]
            last = max(before)[1] if before else None
            want = ("orphan", None) if last is None else ("resolved", last) if rows[last]["etag"] == r["etag"] else ("mismatch", None)
            assert got[r["id"]] == want


# top-k


def brute_top(rows, k):
    good = {i: np.floor(64 * np.array(v, np.float64)).astype(np.int64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in good:
        if q % 20 == 0:
            best = sorted((-int(good[q] @ good[i]), i) for i in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("n", [0, 1, 30, 700])
def test_dual_tree_matches_brute_force(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(5, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.normal(size=8) * 0.1]) for i in range(n)]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]  # ties: a third of all vectors is one
    if n > 20:
        rows += [(10_000, None), (10_020, [None] * 8), (10_040, [float("nan")] * 8), (10_060, [float("inf")] + [0.0] * 7), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, score string")
    assert sorted(tuple(r) for r in topk.nearest_of_every_20th(df).collect()) == brute_top(dict(rows).items(), 20)


@pytest.mark.parametrize("scale", [1e6, 1e8, 1e14])
def test_scores_are_exact_on_large_components(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * scale]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    want = []
    for q in range(0, 300, 20):
        score = lambda i: max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(good[q], good[i], strict=True))))  # noqa: B023, E731
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted((-score(i), i) for i in good if i != q)[:20], 1)]
    assert sorted(tuple(r) for r in topk.nearest_of_every_20th(df).collect()) == want


def test_blocks_are_pruned_and_never_crossed(spark):
    """Far clusters in small blocks: several blocks and cells, no cross join, ragged widths."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6)) * 20
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=6)][: 5 if i % 50 == 3 else 6]) for i in range(3000)]
    df = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = topk.top_k(df.where("vec_id % 20 = 0"), df, 5, data_block=100, query_block=64)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == brute_top([(i, v + [0.0] * (6 - len(v))) for i, v in rows], 5)


@pytest.mark.parametrize("kind", ["normal", "copies", "line"])
def test_cover_tree_invariants(kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=(900, 8)) * 50, "copies": np.repeat(rng.normal(size=(30, 8)) * 50, 30, 0), "line": np.outer(2.0 ** (np.arange(600) % 14), np.ones(3))}[kind].astype(np.int16)
    numbers = topk.Numbers(float(np.abs(x).max()), x.shape[1])
    t = topk.CoverTree(np.arange(len(x)), x, numbers, leaf=8)
    assert sorted(t.ids.tolist()) == list(range(len(x))) and (x[t.ids] == t.x).all()
    f = x.astype(float)
    c = f[t.centres]
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))
    top = t.level_of[0]
    for level in sorted(set(t.level_of)):
        net = np.flatnonzero(t.level_of >= level)
        assert (net == np.arange(len(net))).all()  # nested
        assert (d[np.ix_(net, net)][~np.eye(len(net), dtype=bool)] > 2.0**level).all()  # separated
        if level > t.level_of.min():
            assert np.sqrt(((f[:, None] - c[None, net]) ** 2).sum(2)).min(1).max() <= 2.0**level * (1 + 1e-12)  # covering
    for j in range(1, len(c)):
        assert t.level_of[t.parent[j]] > t.level_of[j] and d[j, t.parent[j]] <= 2.0 ** (t.level_of[j] + 1) * (1 + 1e-12)
    for k, children in enumerate(t.children):
        members = t.x[t.lo[k] : t.hi[k]].astype(float)
        assert np.sqrt(((members - t.centre[k].astype(float)) ** 2).sum(1)).max() <= t.radius[k] * (1 + 1e-9)
        if children:
            assert (t.centre[children[0]] == t.centre[k]).all() and t.lo[children[0]] == t.lo[k] and t.hi[children[-1]] == t.hi[k]
            assert all(t.hi[a] == t.lo[b] for a, b in zip(children, children[1:], strict=False)) and len(children) > 1
    assert top >= max(t.level_of)


def test_vectors_of_unequal_length(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0, 5.0]), (2, []), (3, [2.0])], "vec_id long, embedding array<float>")
    assert sorted((r.rank, r.vec_id, r.score) for r in topk.nearest_of_every_20th(df).collect()) == [(1, 1, 64 * 64 * 3), (2, 3, 64 * 64 * 2)]


def test_tree_covers_and_cuts_off():
    rng = np.random.default_rng(1)
    x = np.floor(64 * np.concatenate([rng.normal(size=(2000, 8)) * 0.05 + c for c in rng.normal(size=(4, 8)) * 3]))
    numbers = topk.Numbers(float(np.abs(x).max()), 8)
    t = topk.CoverTree(np.arange(len(x)), x, numbers)
    s = topk.Search(topk.CoverTree(np.arange(100), x[:100], numbers), 5)
    s.add(t)
    assert s.tested < 100 * len(x) * 0.6


# pieces

@pytest.fixture(scope="module")
def library():
    sp = pytest.importorskip("sentencepiece")
    return sp.SentencePieceProcessor(model_file=sentpiece.MODEL_PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return sentpiece.Vocabulary.load()


def texts():
    rnd = random.Random(1)
    out = ["", " ", "   a  b ", "x" * 3000, "日本✈ the " * 300, "a\x00b\n\tc", "’,”). «»."] + [" " * k + "w" for k in range(40)]
    return out + ["".join(rnd.choice(' \n\tabctheing é日✈.,)"»’…1') for _ in range(rnd.randint(0, 80))) for _ in range(800)]


def test_encoding_is_the_library_s(vocabulary, library):
    table = sentpiece.UnitTable(vocabulary, True)
    for t in texts():
        want = library.encode(t)
        assert vocabulary.encode(t) == want
        n, _, h, _, at = next(table.encode([t]))
        assert table.ids_of(at).tolist() == want and n == len(want) and h == sentpiece.ids_hash(np.array(want, np.int64))
        assert vocabulary.decode(want) == t


def test_chunks_give_the_same_pieces(vocabulary, library):
    import itertools

    for t in texts():
        e = sentpiece.escape(t)
        for size in (70, 97):
            cuts = [*range(0, len(e), size), len(e)]
            chunks = [vocabulary.chunk(e, a, b) for a, b in itertools.pairwise(cuts)]
            if len(chunks) > 1:
                at = sentpiece.boundary_states([c.matrix() for c in chunks])
                got = [p for c, i, j in zip(chunks, at, at[1:], strict=False) for p in c.path(i, j)]
                assert vocabulary.to_ids(got) == library.encode(t)


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(0)
    a, b, c = (np.where(rng.random((4, 4)) < 0.4, -np.inf, rng.integers(-9, 9, (4, 4)).astype(float)) for _ in range(3))
    assert (sentpiece.maxplus(sentpiece.maxplus(a, b), c) == sentpiece.maxplus(a, sentpiece.maxplus(b, c))).all()


def test_encode_and_decode_tables(spark, library):
    rows = [(i, t) for i, t in enumerate(texts()[:60])] + [(100, None), (101, "a▁b " * 60), (3, texts()[3])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, row int, ids string")
    out = sentpiece.encode(d, chunk=96)
    got = sorted((r.doc_id, list(r.ids), r.n_tokens, r.round_trip) for r in out.collect())
    assert got == sorted((i, library.encode(t or ""), len(library.encode(t or "")), i != 101) for i, t in rows)
    back = {r.doc_id: r.text for r in sentpiece.decode(out).collect()}
    assert all(back[i] == (t or "") for i, t in rows if i != 101)
    assert sentpiece.encode(d.where("doc_id < 0")).count() == 0


def test_a_unit_that_is_a_piece_takes_one_test(vocabulary):
    piece = max((p for p in vocabulary.ids if p.isascii() and p.isalpha()), key=len)
    vocabulary.fits.clear()
    assert vocabulary.solve_ids(piece) == [vocabulary.ids[piece]]
    assert len(vocabulary.fits) == 1


def test_chunks_are_sent_on_a_few_at_once(vocabulary, library):
    from types import SimpleNamespace

    import pandas as pd
    import pyarrow as pa

    text = "a thing, é日 and thethingthe " * 300
    held = SimpleNamespace(value=vocabulary)
    parts = pd.concat(sentpiece._cut(vocabulary.longest, 96)([pd.DataFrame({"row": [7], "doc_id": [5], "text": [text]})]))
    parts = parts.merge(sentpiece._scan(pd.concat(sentpiece._matrices(held)([parts]))), on=["row", "k"])
    out = list(sentpiece._backtrace(held, True)([pa.RecordBatch.from_pandas(parts)]))
    assert len(parts) > 50 and max(map(len, out)) <= 16
    whole = sentpiece._join(True)(pd.concat([x.to_pandas() for x in out]))
    assert list(whole["ids"][0]) == library.encode(text) and whole["doc_id"][0] == 5 and whole["round_trip"][0]


def test_pipeline_stages_keep_columns(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "source_mixing", "piece_encoding"]
    start = spark.read.parquet(f"{sf}/documents.parquet")
    from skein.llm import exact, neardup
    from skein.llm.common import Scratch

    scratch, docs = Scratch(spark, "t"), start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = scratch.save(stage(spark, docs, sf), name)
        assert docs.columns == start.columns
        if name == "exact_dedup":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in exact.exact_dedup(before).where("kept").collect()}
        if name == "minhash_near_dedup":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in neardup.near_dup_groups(before).where("kept").collect()}
        if name in ("language_id", "source_mixing"):
            assert docs.count() == before.count()
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    assert out.where("NOT round_trip").count() == 0


def test_pipeline_equals_plain_stages(spark, tmp_path, library):
    """All five stages on awkward rows, against plain Python: letters, one of equal texts, one of linked texts, every source, the library's ids."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_exact_and_near import brute_exact, brute_near

    rnd = random.Random(12)
    words = ["kalo", "mitu", "lomi", "kami", "tulo", "mika", "nasa", "pelo"]
    text = lambda n: " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(n))
    base = [text(rnd.randint(8, 60)) for _ in range(25)]
    texts = base + [b + " more" for b in base[:10]] + [b.replace(" ", "  ") for b in base[5:12]] + [None, "", "12 34", "?!", base[0], "kalo " * 9000]
    rows = [(3 * i + 1, t, "xx" if i % 4 else None, f"s{min(3, i % 7)}" if i % 9 else None, 1, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    left = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    kept = {i for i, _, _, stays, _ in brute_exact(left) if stays}
    kept = {i for i, _, _, stays in brute_near([(i, t) for i, t in left if i in kept]) if stays}
    known = dict(left)
    assert sorted(r.doc_id for r in out) == sorted(kept)
    assert all(r.ids == library.encode(known[r.doc_id]) and r.n_tokens == len(r.ids) and r.round_trip for r in out)
