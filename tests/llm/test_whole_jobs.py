"""The text operators do the whole job: no row, share or group is given up for a bound."""

from __future__ import annotations

import zlib

import numpy as np

from skein.llm import langid, mixing

SCHEMA = "doc_id long, text string, lang string"


def test_rare_scripts_and_unlabelled_tables_stay(spark):
    held = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "kalo mitu lomi kami tulo mika " * 5, "xx") for i in range(400)]
    rows += [(900 + i, "καλημέρα κόσμε και πάλι " * 5, "el" if i else None) for i in range(4)]
    rows += [(i, "안녕하세요 여러분 반갑습니다 " * 5, "ko") for i in held[:3]] + [(held[3], "여러분 안녕하세요 " * 5, None)]
    rows += [(950, "שלום עולם " * 5, None), (951, "12 34", "xx"), (952, "ไทย ภาษา " * 5, "th")]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {r.doc_id: r.lang for r in langid.keep_known_languages(d, langid.learn_model(d, rows=20, held_out=False)).collect()}
    assert set(out) == {r[0] for r in rows} - {950, 951}
    assert out[900] == "el" and out[held[3]] == "ko" and out[952] == "th"
    # scripts of a language that the model was not learnt on
    out = langid.keep_known_languages(d, langid.learn_model(d.where("lang = 'xx'"))).collect()
    assert {r.doc_id for r in out} == {r[0] for r in rows} - {950, 951}
    bare = spark.createDataFrame([(i, t, None) for i, t, _ in rows], SCHEMA)
    assert langid.keep_known_languages(bare, langid.learn_model(bare)).count() == len(rows) - 1


def test_shares_follow_the_true_weights(spark):
    for weights in ([1 / 3] + [2 / 57] * 19, [1 / k for k in range(1, 1501)], [0.7, 0.1, 0.2]):
        exact = mixing.whole_numbers(weights)
        w = np.array(weights) / sum(weights)
        done = np.zeros(len(w))
        for t, (i, j, slot) in enumerate(mixing.slots(exact, [10**9] * len(w))):
            assert slot == t and j == done[i]
            done[i] += 1
            assert np.abs(done - w * (t + 1)).max() < 1 + 1e-6
            if t == 12_000:
                break
    ended = list(mixing.slots([2, 1, 1, 0], [9, 1, 2, 2]))
    assert len(ended) == 14 and all(t >= 2 * j and t < 2 * j + 2 for i, j, t in ended if i == 0) and ended[-2][0] == ended[-1][0] == 3
    # a whole table, over many times 64 slots: one hot source of a third, 19 others
    d = spark.range(6000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "IF(id % 3 = 0, 'hot', concat('s', id % 19)) AS source")
    out = mixing.mix(d, {"hot": 1 / 3, **{f"s{i}": 2 / 57 for i in range(19)}}, block=10).toPandas()
    assert len(out) == 6000 and out["slot"].is_unique and out["slot"].notna().all()
    hot = out[out["source"] == "hot"].sort_values("slot")
    assert (np.abs(hot["slot"].to_numpy() - 3 * np.arange(len(hot))) <= 3).all()


def test_any_number_of_sources(spark):
    d = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', 10 + cast(id % 7 AS int)) AS text", "concat('domain', id % 2500) AS source")
    out = mixing.mix(d, block=10).toPandas()
    assert sorted(out["doc_id"]) == list(range(5000)) and out["source"].nunique() == 2500
    assert out["slot"].notna().all() and out.groupby("slot")["source"].nunique().max() == 1


def earliest_deadline_first(weights, n):
    """Slot by slot over all sources, in fractions: of the released blocks the one of the earliest deadline, ties by source."""
    from fractions import Fraction

    w = [Fraction(x) for x in weights]
    total = sum(w)
    w = [x / total for x in w]
    done, out = [0] * len(w), []
    for t in range(n):
        ready = [(-(-(done[i] + 1) // x), i) for i, x in enumerate(w) if x and done[i] // x <= t]
        _, i = min(ready)
        out.append((i, done[i], t))
        done[i] += 1
    return out


def test_schedule_equals_a_plain_scheduler_and_keeps_the_given_weights():
    from itertools import islice

    hot = [0.5, *[0.5 / 500] * 500]
    tiny = [0.7, 0.29999, 0.00001]
    for weights, n in ((hot, 1200), (tiny, 3000), ([0.5, 0.0, 0.25, 0.25], 400), ([3.0, 1e-9, 2.0], 500)):
        plan = list(islice(mixing.slots(mixing.whole_numbers(weights), [10**9] * len(weights)), n))
        assert plan == earliest_deadline_first(weights, n)
    for weights in (hot, tiny):
        w = np.array(weights) / sum(weights)
        done, far = np.zeros(len(w)), 0.0
        for t, (i, _, slot) in enumerate(islice(mixing.slots(mixing.whole_numbers(weights), [10**9] * len(w)), 60_000)):
            assert slot == t
            done[i] += 1
            if t % 97 == 0:
                far = max(far, np.abs(done - w * (t + 1)).max())
        assert far < 1 + 1e-6
    # a weight of 0 has no slot while others have blocks, and comes after them
    plan = list(mixing.slots(mixing.whole_numbers([1.0, 0.0, 1.0]), [3, 2, 5]))
    assert [i for i, _, _ in plan[-2:]] == [1, 1] and len(plan) == 10


def test_mixing_query_equals_a_plain_computation(spark, sf):
    """op3 over a whole table: running sizes in hash order per source, blocks, and the plain scheduler's slots."""
    from skein.llm import queries

    out = queries.queries()["op3_pfair_mixing"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "coalesce(source, '(none)') AS source", "length(coalesce(text, '')) AS size", "xxhash64('mix', doc_id) AS turn").toPandas()
    assert sorted(out["doc_id"]) == sorted(docs["doc_id"])
    docs = docs.sort_values(["source", "turn", "doc_id"])
    docs["start"] = docs.groupby("source")["size"].cumsum() - docs["size"]
    both = out.merge(docs, on="doc_id", suffixes=("", "_plain"))
    assert (both["source"] == both["source_plain"]).all() and (both["start"] == both["start_plain"]).all() and (both["block"] == both["start"] // mixing.BLOCK).all()
    sizes = docs.groupby("source")["size"].sum()
    names = sorted(sizes.index)
    slots = {(names[i], j): t for i, j, t in mixing.slots(mixing.whole_numbers([float(sizes[n]) ** 0.5 for n in names]), [int(sizes[n]) // mixing.BLOCK + 1 for n in names])}
    assert [slots[s, b] for s, b in zip(both["source"], both["block"], strict=True)] == both["slot"].tolist()
