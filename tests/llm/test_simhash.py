"""Fingerprints, the trie join and the classes against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from gridwise.llm import simhash as sh


def brute_fingerprint(text, n=3):
    words, word = [], b""
    for byte in (text or "").encode():
        c = byte + 32 if 65 <= byte <= 90 else byte
        if c == 32 or 9 <= c <= 13:
            if word:
                words.append(word)
            word = b""
        else:
            word += bytes([c])
    if word:
        words.append(word)
    if not words:
        return 0
    parts = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, near):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in nodes}


def test_fingerprint():
    rnd = random.Random(4)
    for _ in range(200):
        t = "".join(rnd.choice(["A", "b ", "C\t", " ", "\n", "\x1c", "\xa0", "é", "x y ", "\x0b"]) for _ in range(rnd.randint(0, 40)))
        assert sh.fingerprint(t) == brute_fingerprint(t)
    long = " ".join(f"w{i % 977}" for i in range(80_000))
    assert sh.fingerprint(long) == brute_fingerprint(long)


@pytest.mark.parametrize("at_once", [8, 1 << 18])
def test_traversal(monkeypatch, at_once):
    monkeypatch.setattr(sh, "AT_ONCE", at_once)
    rng = np.random.default_rng(at_once)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = [base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(4)]
    fp = np.unique(np.concatenate([base, *flips]))
    of = sh.traverse(fp, len(fp), 0, 0, 2, 64, lambda i, j: sh.distance(fp[i], fp[j]) <= 2)
    want = classes(range(len(fp)), lambda i, j: int(fp[i] ^ fp[j]).bit_count() <= 2)
    assert of.tolist() == [want[i] for i in range(len(fp))]
    # A few bits that differ, so that the last level holds many leaves, all of them near.
    key = np.sort(rng.integers(0, 4, 300, dtype=np.uint64) << np.uint64(62))
    assert set(sh.traverse(key, 300, 0, 0, 2, 20, lambda i, j: np.ones(len(i), bool)).tolist()) == {0}


def test_near_duplicates(spark, monkeypatch):
    rnd = random.Random(8)
    texts = []
    for i in range(40):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.choice([5, 60, 400]))]
        texts += [" ".join(words), " ".join(words).upper(), " ".join([*words[:-1], "other"])]
    texts += [None, "", " \t", "one", "ONE", "two words"]
    rows = [(i, t, -1) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0], (None, "one", 0)], "doc_id long, text string, fp long")
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = classes(range(len(texts)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for leaves in (sh.LEAVES, 64):
        monkeypatch.setattr(sh.links, "__defaults__", (2, leaves))
        got = sh.near_duplicates(df).collect()
        assert len(got) == len(rows) + 2
        for r in got:
            if r.doc_id is not None:
                assert (r.fp % 2**64, r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert sh.near_duplicates(df.limit(0)).count() == 0


def similarity(a, b):
    s = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


@pytest.mark.parametrize("leaves", [sh.WIDE_LEAVES, 40])
def test_similar_classes(spark, monkeypatch, leaves):
    monkeypatch.setattr(sh.wide_links, "__defaults__", (leaves,))
    rnd = random.Random(9)
    texts = {}
    for i in range(80):
        words = [f"w{rnd.randrange(3000)}" for _ in range(300)]
        texts[10 * i] = " ".join(words)
        if i < 40:
            words[rnd.randrange(300)] = "new"
            texts[10 * i + 1] = " ".join([*words, "tail"])
            texts[10 * i + 2] = texts[10 * i]
    df = spark.createDataFrame([*texts.items(), (None, "x"), (5000, None), (5001, "")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sh.similar_classes(df).collect()}
    assert all(similarity(texts[10 * i], texts[10 * i + 1]) >= 0.8 for i in range(40))
    assert got == {k: k - k % 10 if k < 5000 else 5000 for k in [*texts, 5000, 5001]}
    kept = sh.deduplicate(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted([*(str(10 * i) for i in range(80)), "None", "5000"])
    assert sh.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [sh.SET_BLOCK, 300])
def test_similar_classes_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(sh, "SET_BLOCK", block)
    rnd = random.Random(10)
    pick = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    texts = []
    for i in range(240):
        # Sets of 150 shingles with a similarity of 0.74 to 0.91.
        shared = round(300 * (j := 0.74 + 0.17 * i / 240) / (1 + j))
        common = pick(shared + 4)
        texts += [" ".join([*common, *pick(150 - shared)]) for _ in range(2)]
    for _ in range(20):
        # A line repeated, in documents that differ otherwise.
        line = pick(12) * 20
        texts += [" ".join([*line, *pick(200)]) for _ in range(2)]
    words = pick(60)
    # A family in which only neighbours are similar.
    texts += [" ".join([*words[k:], *pick(k)]) if k else " ".join(words) for k in (0, 2, 4, 6)] + [" ".join(words[k : k + 50]) for k in range(11)]
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    near = lambda a, b: 5 * (n := len(sets[a] & sets[b])) >= 4 * (len(sets[a]) + len(sets[b]) - n)
    want = classes(range(len(texts)), near)
    assert 100 < sum(want[2 * i] == want[2 * i + 1] for i in range(240)) < 200
    got = {r.doc_id: r.component_id for r in sh.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_crowded_nodes_and_frequent_keys(spark, monkeypatch):
    """A third of the texts are near copies of one, another third are copies; few fingerprints fit below a node."""
    monkeypatch.setattr(sh.wide_links, "__defaults__", (8,))
    monkeypatch.setattr(sh, "HOT", 20)
    monkeypatch.setattr(sh, "HOT_SHARE", 10)
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
    near = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 400, 4)]
    texts = [*near, *(["the very same words in all of these"] * 100), *(" ".join(f"y{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(100))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in sh.similar_classes(df).collect()}
    assert got == {i: 0 if i < 100 else 100 if i < 200 else i for i in range(300)}
    copies = {r.doc_id: r.component_id for r in sh.near_duplicates(df).collect()}
    assert {copies[i] for i in range(100, 200)} == {100} and len(copies) == 300
    # Fingerprints that agree in all bits are linked as they are.
    same = spark.createDataFrame([(bytes(32), i) for i in range(50)], "fp binary, rep long")
    assert {(r.a, r.b) for r in sh.wide_links(same).collect()} == {(i, 0) for i in range(1, 50)}


def test_clashing_names(spark):
    names = ["k", "n", "fp", "rep", "node", "root", "digest", "gone_id", "component_id", "hot_key", "own_key"]
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words in here")], "doc_id long, text string").selectExpr("*", *(f"doc_id * 10 AS {n}" for n in names))
    kept = sh.deduplicate(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.k, r.gone_id) for r in kept.collect()) == [(1, 10, 10), (3, 30, 30)]
    assert sorted((r.doc_id, r.component_id) for r in sh.near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_recall_on_documents(spark):
    """Every document whose id is divisible by 50 against all others: links at a similarity of 0.8 or more that are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    cut = lambda t: set(zip(*((t or "").lower().split()[k:] for k in range(5)), strict=False))
    sets = {d: cut(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    of = {r.doc_id: r.component_id for r in sh.similar_classes(spark.createDataFrame(docs)).collect()}
    linked = [(q, d) for q in sets if q % 50 == 0 and len(sets[q]) for d in sets if d != q and len(sets[q] & sets[d]) >= 0.8 * len(sets[q] | sets[d])]
    assert linked and sum(of[q] == of[d] for q, d in linked) >= 0.9 * len(linked)


def test_rows_are_judged_by_their_texts(spark, monkeypatch):
    """No text without a copy goes, whatever its id, and repeated rows are one."""
    rnd = random.Random(12)
    a, b, c = ([f"w{rnd.randrange(10**6)}" for _ in range(60)] for _ in range(3))
    text = " ".join
    rows = [("3", text(a)), ("5", text(a)), ("5", text(b)), ("7", text([*b, "word"])), ("4", text(a)), (None, text(a)), (None, text(a)), (None, text(c)), (None, text(c)), ("9", None), ("8", " "), ("6", text(b).upper()), ("3", text(a))]
    want = sorted([("3", text(a)), ("5", text(b)), ("None", text(c)), ("8", " ")])
    for hot in (sh.HOT, 1):
        monkeypatch.setattr(sh, "HOT", hot)
        kept = sh.deduplicate(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id string, text string, at int, th int"))
        assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == want
    numbers = spark.createDataFrame([(int(i) if i else None, t) for i, t in rows], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in sh.deduplicate(numbers).collect()) == want
    assert sorted((r.doc_id, r.component_id) for r in sh.similar_classes(numbers).collect()) == [(3, 3), (4, 3), (5, 3), (6, 5), (7, 5), (8, 8), (9, 8)]


def test_first_set_of_a_class_and_the_rest(spark, monkeypatch):
    """Chains in which the first set is similar to few: the rest is compared with all, in blocks."""
    monkeypatch.setattr(sh, "SET_BLOCK", 120)
    monkeypatch.setattr(sh, "HOT", 3)
    rnd = random.Random(13)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(90)]
    texts = [words[k : k + 50] for k in range(0, 40, 2)]
    rnd.shuffle(texts)
    sets = [sh.shingle_set(" ".join(t)) for t in texts]
    held = spark.createDataFrame([(i, 0, 9, s.tobytes()) for i, s in enumerate(sets)] + [(100, 1, 2, sets[0].tobytes()), (101, 1, 2, sets[0].tobytes())], "rep long, class long, blocks long, hashes binary")
    sizes = spark.createDataFrame([(0, len(sets), 9), (1, 2, 2)], "class long, n long, blocks long")
    roots = {r.node: r.root for r in sh.components(sh._links_in_classes(held, sizes)).collect()}
    want = classes(range(len(sets)), lambda a, b: sh._linked(sets[a], sets[b]))
    assert {i: roots.get(i, i) for i in range(len(sets))} == {i: want[i] for i in range(len(sets))} and roots[101] == 100
    assert len(set(want.values())) == 1 and sum(not sh._linked(s, sets[0]) for s in sets) > 10


def test_bits_of_ids(spark):
    ids = spark.range(0, 3_000_000, 10).withColumnRenamed("id", "k")
    bits = sh.id_bits(ids, "k")
    slots = [r[0] for r in ids.select(sh.id_slot("k")).limit(5000).collect()]
    assert all(bits[x >> 3] >> (x & 7) & 1 for x in slots)
    assert np.unpackbits(bits).sum() == ids.select(sh.id_slot("k")).distinct().count() and not sh.id_bits(ids.limit(0), "k").any()
