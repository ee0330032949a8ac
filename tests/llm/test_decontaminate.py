"""Benchmark passages, exact and with substitutions, against a search that slides every item over every text."""

from __future__ import annotations

import random
from itertools import combinations

from gridwise.llm import decontaminate as de


def slide(docs, items):
    hashes, out = de.Hashes(), set()
    for d, text in docs:
        doc = hashes.of(text)
        for k, t in items:
            item = hashes.of(t)
            for shift in range(-len(item) + 1, len(doc)):
                n, a, b = de.aligned(item, doc, shift)
                if len(item) and n >= de.needed(len(item)):
                    out.add((d, k))
    return out


def world():
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    pick = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, " ".join(pick(rnd.randint(15, 45)))) for i in range(12)] + [(20, None), (21, ""), (22, "three short words")]
    docs = [(i, " ".join(pick(120))) for i in range(30)]
    for i in range(30, 90):
        body, item = pick(100), items[i % 12][1].split()
        for p in rnd.sample(range(len(item)), k=(i // 12) % 4):
            item[p] = "other"
        if i % 7 == 0:
            item = item[len(item) // 2 :]
        docs.append((i, " ".join([*body[:40], *item, *body[40:]]).upper()))
    return [*docs, (90, None), (91, ""), (92, "x three, short WORDS y")], items


def test_against_sliding(spark):
    docs, items = world()
    d = spark.createDataFrame([*docs, docs[40], (None, docs[40][1])], "doc_id long, text string").selectExpr("*", "1 AS item_id")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = slide(docs, items)
    for chars in (de.BLOCK_CHARS, 900):
        got = {(r.doc_id, r.item_id) for r in de.matches(d, b, block_chars=chars).collect() if r.doc_id is not None}
        # What the masks bring together is verified; exact and lightly changed passages are all brought together.
        assert got <= want and len(got) >= 0.97 * len(want)
        assert {(i, i % 12) for i in range(30, 90) if i % 7 and (i // 12) % 4 <= 2} <= got
        assert not any(i < 30 for i, _ in got) and (92, 22) in got
    r = {x.doc_id: x for x in de.contamination(d, b).collect()}
    assert r[92].items == "22" and r[90].contaminated is False and r[31].max_words >= 11
    kept = de.drop_contaminated(d, b)
    assert kept.columns == d.columns and {x.doc_id for x in kept.collect()} == {i for i, _ in docs} - {i for i, _ in got}
    assert [r.contaminated for r in de.contamination(d, b).collect() if r.doc_id is None] == [True]
    clash = d.selectExpr("*", *(f"1 AS {c}" for c in ("k", "text_key", "own_key", "items", "words", "held_id", "own_id")))
    assert de.drop_contaminated(clash, b).columns == clash.columns and de.drop_contaminated(clash, b).count() == kept.count()
    assert de.contamination(clash, b).where("contaminated").count() == sum(1 for _ in {i for i, _ in got}) + 2
    assert de.contamination(d.limit(0), b).count() == 0 and de.contamination(d, b.limit(0)).where("contaminated").count() == 0


def test_masks_find_two_substitutions_in_a_short_item():
    rnd = random.Random(1)
    item = de.Hashes().of(" ".join(f"a{i}" for i in range(15)))
    index = de.Index([(1, " ".join(f"a{i}" for i in range(15)))])
    missed = 0
    for i in range(15):
        for j in range(i):
            doc = item.copy()
            doc[[i, j]] = rnd.getrandbits(60)
            missed += not index.search(doc) and (i - j > 1)
    assert missed <= 10


def test_masks_miss_nothing_that_counts():
    rnd = random.Random(3)
    fresh = lambda n: [f"x{rnd.getrandbits(50)}" for _ in range(n)]
    for n in range(1, 26):
        items = [(1, " ".join(fresh(n)))]
        index, words = de.Index(items), items[0][1].split()
        docs = []
        # Every placement of the substitutions allowed in a whole short item, and any others in longer ones.
        off = n - de.needed(n)
        placed = list(combinations(range(n), off)) if n <= 16 else []
        placed += [rnd.sample(range(n), rnd.randint(0, min(n, off + 2))) for _ in range(200)]
        for places in placed:
            own = [f"y{k}" if k in places else w for k, w in enumerate(words)]
            docs.append((len(docs), " ".join(rnd.choice([own, [*fresh(5), *own, *fresh(9)], [*own, *fresh(3)]]))))
        hashes = de.Hashes()
        got = {(d, m[0]) for d, t in docs for m in index.search(hashes.of(t))}
        assert got == slide(docs, items), n
        assert {(m[0], m[1]) for m in index.search_all([hashes.of(t) for _, t in docs])} == got


def test_masks_miss_nothing_in_part_of_a_long_item():
    rnd = random.Random(4)
    item = [f"a{i}" for i in range(45)]
    items, docs = [(1, " ".join(item))], []
    for share in (0.45, 0.5, 0.55, 0.6):
        docs += [(len(docs) + k, " ".join(w if rnd.random() < share else "other" for w in item)) for k in range(150)]
    # Every second word agrees, and pairs of words.
    docs += [(1000, " ".join(w if k % 2 == 0 else "other" for k, w in enumerate(item[:25]))), (1001, " ".join(w if k % 4 < 2 else "other" for k, w in enumerate(item[:30])))]
    index, hashes = de.Index(items), de.Hashes()
    want = slide(docs, items)
    assert {(1000, 1), (1001, 1)} <= want and 100 < len(want) < len(docs)
    assert {(d, m[0]) for d, t in docs for m in index.search(hashes.of(t))} == want
