"""The pipeline's stages one by one and as a whole against brute force on a small fixture."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F
from test_decontaminate import slide
from test_simhash import classes

import corpus_pipeline
from gridwise.llm import cotrain, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, item string"
STAGE = dict(corpus_pipeline.STAGES)


def fixture():
    rnd = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("stone", "river", "light", "garden", "winter", "paper") for b in ("", "s", "ly", "en", "ing")]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(f"question{i} {w}{j}" for j, w in enumerate(prose(12)))) for i in range(4)]
    rows, labels = [], []
    add = lambda i, text, source="good.example": rows.append((i, text, "en", source, None if text is None else len(text), f"k{i}", None))
    for i in range(80):
        good = i % 4 != 0
        add(i, " ".join([*prose(60), f"end{i}"]) if good else "CLICK $$$ NOW >>> " * 12 + f"{i}", "good.example" if good else "spam.example")
        if i < 60:
            labels.append((i, int(good), 0))
    base = prose(80)
    add(100, " ".join(base))
    add(101, " ".join(base))
    add(102, " ".join([*base[:40], "changed", *base[41:]]))
    for i, item in items:
        add(110 + i, " ".join([*prose(20), item, *prose(20)]))
    add(120, " ".join([*prose(30), "write to jane.roe@mail.example.org or +1 (743) 555-3824", *prose(10)]))
    add(121, " ".join([*prose(30), "at ten dot" , "8[.]8[.]8[.]8", *prose(10)]))
    add(122, None)
    add(123, "")
    add(124, "é漢 " * 3000)
    rows.append((None, rows[83][1], "en", "good.example", None, "null id", None))
    rows.append(rows[1])
    return rows, labels, items


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rows, labels, items = fixture()
    d = f"{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    return f"file://{d}"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_by_quality(spark, rows, d):
    model = cotrain.fit(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{d}/labels.parquet"))
    return [r for r in rows if round(model.probability(cotrain.text_features([r[1]]), cotrain.page_features([(r[3], r[2], r[4])]), 1)[0], 6) >= cotrain.THRESHOLD]


def without_copies(rows):
    """By row: of each class of similar texts the row with the smallest id, null last; repetitions are one."""
    sets = [shingles(r[1]) for r in rows]
    near = lambda a, b: sets[a] == sets[b] or bool(sets[a] | sets[b]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    of = classes(range(len(rows)), near)
    first = {}
    for n, r in enumerate(rows):
        k = (r[0] is None, r[0] or 0)
        if of[n] not in first or k < first[of[n]][0]:
            first[of[n]] = (k, n)
    return [rows[n] for n in sorted(n for _, n in first.values())]


def without_benchmark(rows, items):
    bad = {i for i, _ in slide([(n, r[1]) for n, r in enumerate(rows)], items)}
    return [r for n, r in enumerate(rows) if n not in bad]


def without_data(rows):
    out = []
    for i, text, lang, source, n, *more in rows:
        if text is not None:
            base, added = pii.find(text)
            for k, a, b in sorted({*base, *added}, key=lambda s: -s[1]):
                text = f"{text[:a]}[{k.upper()}]{text[b:]}"
            n = len(text)
        out.append((i, text, lang, source, n, *more))
    return out


def encoded(rows):
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, text, lang, source, *_ in rows:
        ids = None if text is None else tokenizer.encode(text, add_special_tokens=False).ids
        back = None if text is None else tokenizer.decode(ids, skip_special_tokens=False)
        out.append((i, lang, source, -1 if ids is None else len(ids), ids, None if back is None else hashlib.sha256(back.encode()).hexdigest(), None if back is None else back == text))
    return out


def plain(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_stages_and_run(spark, world):
    rows, _, items = fixture()
    docs = spark.read.parquet(f"{world}/documents.parquet")
    assert list(STAGE) == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "BPE encoding and decoding"]
    for name, want in (
        ("quality classifier", kept_by_quality(spark, rows, world)),
        ("SimHash near-dedup", without_copies(rows)),
        ("benchmark decontamination", without_benchmark(rows, items)),
        ("PII", without_data(rows)),
    ):
        got = STAGE[name](spark, docs, world)
        assert got.columns == docs.columns, name
        assert plain(got) == sorted(map(repr, want)), name
    # Each does something here, and none does all.
    kept = kept_by_quality(spark, rows, world)
    assert {r[0] for r in kept} >= {i for i in range(60) if i % 4} and not {r[0] for r in kept} & {i for i in range(0, 60, 4)}
    assert {r[0] for r in rows} - {r[0] for r in without_copies(rows)} == {101, 102, 123, None} and sum(r[0] == 1 for r in without_copies(rows)) == 1
    assert len(rows) - len(without_benchmark(rows, items)) >= 4 and "[EMAIL]" in str(without_data(rows)) and "[IP]" in str(without_data(rows))
    whole = encoded(without_data(without_benchmark(without_copies(kept), items)))
    got = corpus_pipeline.run(spark, world)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256", "exact"]
    null = F.col("ids").isNull()
    assert plain(got.withColumn("n_tokens", F.when(null, F.lit(-1)).otherwise(F.col("n_tokens")))) == sorted(map(repr, whole))


def test_empty_table(spark, world):
    docs = spark.read.parquet(f"{world}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, world).count() == 0, name


def test_clashing_names(spark, world):
    names = ["id", "item_id", "own_key", "text_key", "gone_id", "known_id", "good", "h", "ids", "decoded", "quality_score", "component_id", "digest", "row"]
    docs = spark.read.parquet(f"{world}/documents.parquet").selectExpr("*", *(f"doc_id AS {n}" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, world)
        assert made.count() > 0, name
