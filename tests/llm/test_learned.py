from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from skein.llm import langid, quality, sequence, toxicity


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def corpus(spark, n=240):
    rnd = random.Random(2)
    syl = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["szr", "ent", "üch", "vor"]}
    rows, labels = [], []
    for i in range(n):
        lang = "xx" if i % 2 else "yy"
        words = ["".join(rnd.choice(syl[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(40)]
        toxic, low = int(rnd.random() < 0.3), int(rnd.random() < 0.3)
        if toxic:
            for _ in range(3):
                words[rnd.randrange(40)] = rnd.choice(["nasty", "vilelo", "vilemi"])
        if low:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), lang if i % 11 else None, "s", None, "clash", 1.5))
        labels.append((i, 1 - low, toxic))
    awkward = [(9000, None), (9001, ""), (9002, " \n"), (9003, "12 34 !!"), (9004, "ка ломи"), (9005, "ka " * 100_000), (1, rows[1][1])]
    rows += [(i, t, None, None, None, "clash", None) for i, t in awkward]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, spans double").repartition(3)
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (l, 1 - q, q, t) for (i, _, l, *_), (_, q, t) in zip(rows, labels, strict=False)}


def test_language_ids_held_out_and_awkward_rows(spark):
    d, _, _ = corpus(spark)
    out = langid.identify_documents(d).collect()
    assert len(out) == 247
    got = {r.doc_id: r for r in out}
    assert all(got[i].lang_pred == ("xx" if i % 2 else "yy") and 0 <= got[i].score <= 1 for i in range(240))
    assert all(got[i].held_out == held(i, 4, 2) for i in got)
    assert [got[i].lang_pred for i in (9000, 9001, 9002, 9003)] == ["und"] * 4
    assert got[9004].lang_pred in ("xx", "yy")
    assert langid.identify_documents(d.where("doc_id < 0")).count() == 0
    kept = langid.keep_known_languages(d, langid.learn_model(d))
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {*range(240), 9005}
    assert kept.where("lang IS NULL").count() == 0


def test_language_spans_of_a_mixed_text(spark):
    d, _, _ = corpus(spark)
    text = "kalo mitu lomi kami tulo mika " * 4 + "szrent üchvor entvor vorszr üchent szrvor " * 4
    out = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), langid.learn_model(d), spans=True).first()
    assert [s.lang for s in out.spans] == ["xx", "yy"] and out.n_langs == 2
    assert abs(out.spans[0].end - len("kalo mitu lomi kami tulo mika " * 4)) <= 8


def test_toxic_scores_and_offsets(spark):
    d, labels, truth = corpus(spark)
    out = {r.doc_id: r for r in toxicity.score_documents(d, labels).collect()}
    tests = [i for i in truth if held(i, 4, 2)]
    assert tests and all(out[i].predicted == truth[i][3] for i in tests)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert all(out[i].predicted == 0 for i in (9000, 9001, 9002))
    field = toxicity.learn_field(d, labels)
    one = toxicity.tag(spark.createDataFrame([(1, "ka nasty lo"), (2, None)], "doc_id long, text string"), field, spans=True).orderBy("doc_id").collect()
    assert [(s.start, s.end) for s in one[0].spans] == [(3, 8)] and one[1].spans == []
    assert toxicity.score_documents(d.where("doc_id < 0"), labels).count() == 0
    assert toxicity.score_documents(d, labels.where("doc_id < 0")).count() == 247


def test_quality_scores(spark):
    d, labels, truth = corpus(spark)
    out = {r.doc_id: r for r in quality.score_documents(d, labels).collect()}
    tests = [i for i in truth if held(i, 5, 0)]
    assert tests and all(out[i].held_out for i in tests)
    assert all(out[i].predicted == truth[i][2] for i in tests)
    ranked = quality.rank(d, quality.learn_ranking(d, labels))
    kept = quality.keep_above_quantile(ranked, 0.25)
    assert kept.columns[-1] == "kept" and 0.7 <= kept.where("kept").count() / 247 <= 0.8
    assert quality.score_documents(d.where("doc_id < 0"), labels).count() == 0
    assert quality.score_documents(d, labels.where("quality = 1")).where("score < 0.9").count() == 0


def brute_viterbi(s, penalty):
    import itertools

    best = max(itertools.product(range(s.shape[1]), repeat=len(s)), key=lambda p: (sum(s[i, k] for i, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))))
    return sum(s[i, k] for i, k in enumerate(best)) - penalty * sum(a != b for a, b in zip(best, best[1:], strict=False))


def test_viterbi_and_forward_backward_match_enumeration():
    rng = np.random.default_rng(0)
    sizes = [0, 5, 1, 0, 4, 6]
    first = np.concatenate([[0], np.cumsum(sizes)])
    s = rng.normal(size=(first[-1], 3)) * 2
    got = sequence.viterbi(s, first, 1.0)
    for a, b in zip(first, first[1:], strict=False):
        p = got[a:b]
        if b > a:
            value = sum(s[a + i, k] for i, k in enumerate(p)) - sum(x != y for x, y in zip(p, p[1:], strict=False))
            assert abs(value - brute_viterbi(s[a:b], 1.0)) < 1e-9
    odds, trans = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    p = sequence.marginals(odds, first, trans)
    import itertools

    for a, b in zip(first, first[1:], strict=False):
        total, hit = 0.0, np.zeros(b - a)
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(odds[a + i] * k for i, k in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:], strict=False)))
            total += w
            hit += w * np.array(y)
        assert b == a or np.allclose(p[a:b], hit / total)


def test_field_gradient_is_that_of_the_enumerated_likelihood():
    """Log likelihood by all paths, differentiated by finite differences, for every kind of weight."""
    import itertools

    rng = np.random.default_rng(4)
    text = "ab cd ab ef|cd ab|ef ef cd ab cd".encode()
    parts = text.split(b"|")
    buf, offs = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    seen, _, _, first = toxicity.tokens(buf, offs)
    f = toxicity.Field()
    used = np.unique(seen)
    for k in ("word", "left", "right"):
        getattr(f, k)[used] = rng.normal(size=len(used)).astype(np.float32)
    f.bias, f.trans = 0.3, rng.normal(size=(2, 2))
    want = rng.integers(0, 2, seen.shape[1]).astype(float)

    def likelihood():
        odds, total = f.odds(seen, first), 0.0
        for a, b in zip(first, first[1:], strict=False):
            energy = lambda y: sum(odds[a + i] * v for i, v in enumerate(y)) + sum(f.trans[int(u), int(v)] for u, v in zip(y, y[1:], strict=False))  # noqa: B023, E731
            total += energy(want[a:b]) - np.log(sum(np.exp(energy(y)) for y in itertools.product((0, 1), repeat=b - a)))
        return total

    g, step = f.gradient(seen, first, want), 1e-2
    for name, at in [*[(k, i) for k in ("word", "left", "right") for i in used[:4]], *[("trans", (i, j)) for i in (0, 1) for j in (0, 1)]]:
        w = getattr(f, name)
        keep = w[at]
        w[at] = keep + step
        up = likelihood()
        w[at] = keep - step
        down = likelihood()
        w[at] = keep
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3
    f.bias += step
    up = likelihood()
    f.bias -= 2 * step
    assert abs((up - likelihood()) / (2 * step) - g["bias"]) < 2e-3


def test_preference_weights_are_where_the_pair_loss_is_least():
    from skein.llm import learn

    rng = np.random.default_rng(8)
    d = rng.normal(size=(300, 4)) + [0.5, 0, -0.2, 0]  # features of the preferred less those of the other
    w = learn.logistic(d, np.ones(300), ridge=3.0)
    loss = lambda v: np.log1p(np.exp(-d @ v)).sum() + 1.5 * v @ v
    for i in range(4):
        e = np.eye(4)[i] * 1e-4
        assert abs(loss(w + e) - loss(w - e)) < 1e-6 and loss(w + 100 * e) > loss(w) < loss(w - 100 * e)
    x = np.concatenate([rng.normal(size=(60, len(quality.NAMES))) + 1, rng.normal(size=(60, len(quality.NAMES)))])
    r = quality.Ranking.fit(x, np.repeat([1, 0], 60))
    s = r.strength(x)
    assert (s[:60, None] > s[None, 60:]).mean() > 0.95 and (np.argsort(s) == np.argsort(r.scores(x))).all()


def test_missing_ids_and_repeated_rows_are_scored(spark):
    """Rows without a doc_id, and rows that share one, get a result each; other columns do not matter."""
    d, labels, _ = corpus(spark)
    extra = spark.createDataFrame([(None, "ka nasty lo vilelo"), (None, None), (3, "KA!! LO!!"), (3, "ka lo mi tu ka lo")], "doc_id long, text string")
    both = d.unionByName(extra, allowMissingColumns=True)
    for out in (toxicity.score_documents(both, labels), quality.score_documents(both, labels), langid.identify_documents(both)):
        rows = out.collect()
        assert len(rows) == 251 and sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 3 for r in rows) == 3
        assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)


def test_scripts_narrow_for_good(spark):
    """One word of another script is never given to a language without that script, however long it is; unknown scripts say nothing."""
    rows = [(i, "kalo mitu lomi kami tulo mika " * 5, "xx") for i in range(40)] + [(100 + i, "καλημέρα κόσμε και πάλι " * 5, "el") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn_model(d)
    texts = [(1, "kalo mitu " * 20 + "κ" * 4000), (2, "ω" * 3000 + " kalo"), (3, "שלום " * 50 + "kalo mitu lomi " * 3), (4, "שלום " * 50), (5, "kaλo")]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model, spans=True).collect()}
    assert [s.lang for s in out[1].spans] == ["xx", "el"] and out[2].lang_pred == "el" and out[3].lang_pred == "xx"
    assert out[4].lang_pred in ("xx", "el") and out[5].lang_pred in ("xx", "el")
    wrong = d.where("lang = 'xx'").limit(5).withColumn("lang", F.lit("el"))
    assert {r.lang for r in langid.keep_known_languages(wrong, model).collect()} == {"xx"}
