"""Removal of repeated passages against all windows compared with each other."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridwise.llm import substrings


def brute(texts, least):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - least + 1) if seen[tuple(w[i : i + least])] > 1 for j in range(i, i + least)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=4, max_size=30), min_size=1, max_size=5), st.integers(1, 60))
def test_automaton(pieces, words):
    got = substrings.within_shard(pieces, 4, words)
    seen = Counter(tuple(p[i : i + 4]) for p in pieces for i in range(len(p) - 3))
    assert [[i for s, e in runs for i in range(s, e + 1)] for runs in got] == [[i for i in range(len(p) - 3) if seen[tuple(p[i : i + 4])] > 1] for p in pieces]


def test_equal_windows_have_equal_keys(monkeypatch):
    rng = random.Random(1)
    passage = [str(rng.random()) for _ in range(9)]
    texts = [" \t".join([*("x" * 3), *passage, "y"]), "", "few words", "\n ".join(["q", "r", *passage, *("z" * 30)]) + "\n"]
    w = substrings.Windows([t.encode() for t in texts], 7)
    assert w.first.tolist() == [0, 13, 13, 15, 56]
    for hashes in (w.anchor, w.own()):
        assert hashes[3:6].tolist() == hashes[17:20].tolist()
    assert w.whole.tolist() == [i + 7 <= 13 or i >= 15 for i in range(50)]
    for block in (1, 7, 64):
        monkeypatch.setattr(substrings, "BLOCK", block)
        again = substrings.Windows([t.encode() for t in texts], 7)
        assert again.hash.tolist() == w.hash.tolist() and again.start.tolist() == w.start.tolist() and again.end.tolist() == w.end.tolist()
    keys, text = w.keys(None)
    brute = [(int(g), t) for t, (a, b) in enumerate(zip(w.first, w.first[1:], strict=False)) for p, g in enumerate(w.group) if a <= p and p + 2 <= b and any(w.anchor[i] == g for i in range(max(p - 5, a), min(p, b - 7) + 1))]
    assert list(zip(keys.tolist(), text.tolist(), strict=True)) == brute


def corpus():
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "béta", "c", "漢", "d\xa0d", "e\x1ce"]) + str(rng.randrange(40))
    text = lambda n: [word() for _ in range(n)]
    common, passage = text(14), text(9)
    docs = [text(rng.randrange(1, 60)) for _ in range(25)]
    docs += [d[:10] + [word()] + d[12:] for d in docs[:6]] + [docs[3]] * 3 + [docs[-1]]
    docs += [text(5) + common + text(5) for _ in range(30)] + [text(3) + passage[: rng.randrange(5, 10)] + text(4) for _ in range(6)]
    docs += [["x", "y"] * 40, ["z"] * 50, ["x", "y", "z"], ["once"] * 6, ["once"] * 7]
    return [None, "", " \n\t", *("  ".join(d) + rng.choice(["", "\n", " "]) for d in docs)]


@pytest.mark.parametrize(("crowd", "sent"), [(4096, 10**6), (3, 10**6), (3, 0), (8, 0)])
def test_documents(spark, crowd, sent, monkeypatch):
    monkeypatch.setattr(substrings, "MOST_FREQUENT", 200)
    rows = [(i, t, "n") for i, t in enumerate(corpus())] + [(None, "once " * 9, "n"), (5, corpus()[5], "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(5)
    texts = substrings.distinct_texts(docs)
    for sent_bytes in (0, 1 << 30):
        made = substrings.without_repeats(texts, 7, crowd, sent, sent_bytes)
        got = sorted((tuple(r) for r in substrings.by_document(docs, texts, made).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)
        assert got == sorted(((r[0], *b) for r, b in zip(rows, brute([t for _, t, _ in rows], 7), strict=True)), key=str)


def test_ids_of_any_type_hot_texts_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CROWDED", 4)
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(f"d{i}", passage) for i in range(20)] + [("e", "start " + passage), ("f", "short"), ("g", "short"), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("doc_id", "text", "1 AS tid", "2 AS part", "3 AS n")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs).collect()}
    assert got == {**{f"d{i}": (60, 60, "") for i in range(20)}, None: (60, 60, ""), "e": (61, 60, "start"), "f": (1, 0, "short"), "g": (1, 0, "short")}
    assert substrings.remove_repeats(docs).count() == len(rows)
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
