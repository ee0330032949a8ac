"""A round against brute force, accuracy on labelled rows that were set aside, and corner cases."""

from __future__ import annotations

from collections import Counter

import numpy as np

from gridwise.llm import cotrain, queries

DATA = "/root/testdata/sf0.01"


def test_accuracy(spark):
    docs, labels = queries.table(spark, DATA, "documents"), queries.table(spark, DATA, "labels")
    learned, aside = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    model = cotrain.fit(docs, learned, labelled=400)
    got = cotrain.score(docs, model).select("doc_id", "quality_score").join(aside, "doc_id").toPandas()
    keep = got.quality_score >= cotrain.THRESHOLD
    assert ((keep == (got.quality == 1)).mean()) >= 0.95
    assert keep[got.quality == 1].mean() >= 0.97
    assert len(model.rounds) == cotrain.ROUNDS and sum(map(sum, model.rounds)) > 0


ROWS = [(i, f"{'fine words here' if i % 2 else 'BUY NOW $$$'} w{i % 5}\nw{i % 7}", "good.example" if i % 2 else "bad.example", "en", 20) for i in range(60)] + [(60, None, None, None, None), (61, "", "good.example", "de", 0), (62, "BUY NOW $$$", "other.example", "en", 11)]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


def test_features_of_many_texts_are_those_of_each():
    texts = ["", None, "One two  two\n\nline é!", " ", "x", "\n", "a b c d " * 30, "ab", "Two two"]
    found = cotrain.text_features(texts)
    for i, t in enumerate(texts):
        single = cotrain.text_features([t])
        for p, (f, row) in found.items():
            assert sorted(f[row == i].tolist()) == sorted(single[p][0].tolist()), (t, p)
    words = {w: sorted(cotrain.text_features([w])["words"][0].tolist()) for w in ("two", "Two", "one")}
    assert words["two"] == words["Two"] != words["one"]
    f, row = found["words"]
    assert [int((row == i).sum()) for i in range(len(texts))] == [0, 0, 9, 0, 1, 0, 239, 1, 3]
    assert [int((found["grams"][1] == i).sum()) for i in (0, 4, 6, 7)] == [0, 0, 237, 0]
    shape = found["shape"][0].reshape(len(texts), -1) - cotrain.BINS * np.arange(len(cotrain.SHAPE))
    at = {n: k for k, n in enumerate(cotrain.SHAPE)}
    top = cotrain.BINS - 1
    assert shape[4, at["single"]] == top and shape[2, at["types"]] == int(np.sqrt(4 / 5) * top) and shape[2, at["titles"]] == int(np.sqrt(1 / 5) * top)
    assert shape[2, at["lines"]] == top and shape[2, at["tails"]] == int(np.sqrt(1 / 5) * top) and (shape[0] == shape[1]).all()


def brute_sums(rows):
    """Counts by part, feature and class, one row after the other."""
    n = Counter()
    for good, text, page in rows:
        for part, f in [*(text or {}).items(), *(page or {}).items()]:
            for x in f.tolist():
                n[part, x, good] += 1
    return n


def nonzero(sums):
    return {(p, int(f), int(g)): int(sums[p][g, f]) for p in cotrain.PARTS for g, f in zip(*np.nonzero(sums[p]), strict=True)}


def test_a_round_against_brute_force(spark):
    one = lambda found: {p: f for p, (f, _) in found.items()}
    own = [(i % 2, one(cotrain.text_features([t])), one(cotrain.page_features([tuple(about)]))) for i, t, *about in ROWS[:20]]
    known = spark.createDataFrame(ROWS[:20], SCHEMA).selectExpr("*", "CAST(doc_id % 2 AS INT) AS good")
    sums = cotrain.label_sums(known)
    assert nonzero(sums) == brute_sums(own)
    # Naive Bayes by its definition.
    text, page = (cotrain.View.of(cotrain.VIEWS[v], sums) for v in ("text", "page"))
    n = brute_sums(own)
    for part, x in [("words", int(own[1][1]["words"][0])), ("page", int(own[1][2]["page"][0]))]:
        share = [(n[part, x, g] + cotrain.SMOOTH) / (sum(v for (p, _, k), v in n.items() if p == part and k == g) + cotrain.SMOOTH * cotrain.PARTS[part]) for g in (0, 1)]
        assert np.isclose((text if part == "words" else page).odds[part][x], np.log(share[1] / share[0]))
    text.a, text.base, page.a, page.base = np.array([2.0, 1.0, 1.0]), 0.1, np.array([3.0]), 0.0
    pool = spark.createDataFrame(ROWS[20:], SCHEMA).repartition(3)
    got = cotrain.exchanged(pool, text, page, sure=0.8)
    want, told = [], Counter()
    for _, t, *about in ROWS[20:]:
        f, g = cotrain.text_features([t]), cotrain.page_features([tuple(about)])
        p_text, p_page = (1 / (1 + np.exp(-view.logit(x, 1)[0])) for view, x in ((text, f), (page, g)))
        f, g = one(f), one(g)
        if max(p_text, 1 - p_text) >= 0.8:
            want.append((int(p_text > 0.5), None, g))
            told[int(p_text > 0.5), 0] += 1
        if max(p_page, 1 - p_page) >= 0.8:
            want.append((int(p_page > 0.5), f, None))
            told[int(p_page > 0.5), 1] += 1
    assert nonzero(got) == brute_sums(want) and len(want) > 40
    assert {k: got["told"][k] for k in told} == told and got["told"].sum() == sum(told.values())


def test_calibration_gives_no_weight_to_what_points_the_wrong_way():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400).astype(float)
    a, _ = cotrain.calibrate(np.stack([y * 2 + rng.normal(0, 1, 400), -y + rng.normal(0, 1, 400)], axis=1), y)
    assert a[0] > 0.5 and a[1] == 0


def test_corners(spark):
    df = spark.createDataFrame([(1, None, None, None, None), (2, "", "s", "en", 0), (3, "w " * 50_000, "s", "en", 100_000)], SCHEMA).selectExpr("*", "'old' AS quality_score", "1 AS known_id", "2 AS good", "3 AS h")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = cotrain.fit(df, labels)
    assert model is None
    assert [r.quality_score for r in cotrain.score(df, model).collect()] == [1.0, 1.0, 1.0]
    # Repeated ids: one row of each is learned from. Conflicting labels: the good one.
    many = spark.createDataFrame(ROWS * 10, SCHEMA).selectExpr("*", "1 AS known_id", "2 AS good", "3 AS h")
    real = cotrain.fit(many, spark.createDataFrame([(i, q) for i in range(60) for q in {0, i % 2}] + [(None, 1), (5, 7)], "doc_id long, quality int"), labelled=40)
    assert all(0 <= r.quality_score <= 1 for r in cotrain.score(df, real).collect())
    assert all(n <= 10 * (len(ROWS) - 40) for told in real.rounds for n in told)
    got = {r.doc_id: r.quality_score for r in cotrain.score(many, real).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > 0.5 > max(got[i] for i in range(0, 60, 2))
    assert cotrain.score(df.limit(0), real).count() == 0 and cotrain.fit(df.limit(0), labels.limit(0)) is None
