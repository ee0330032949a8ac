"""Benchmark decontamination by spaced seeds.

A mask fixes which positions of a window of words count; the others may hold any word. The hash of the counting words
joins windows of benchmark items with windows of documents. Around each hit the two texts are laid side by side at that
shift and compared word by word, which tolerates substitutions.

The masks miss no passage that counts. In one, more words agree than differ (PENALTY), and at least needed() agree. If
no window of seven words held four that agree, then of L words at most 3 * (L // 7) + min(3, L % 7) would; for items
of 17 words and more this is below max(LEAST, L / 2 + 1 / 2) at every L, for items of 5 to 16 words below needed(). So all
ways to choose four of seven words are masks. Items of 3 and 4 words have to agree in three, shorter ones in all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Words that count in the masks of an item, by its length, and words that they are spread over at most.
WEIGHT = {1: 1, 2: 2, 3: 3, 4: 3}
HEAVY, SPREAD = 4, 7
#: By the words that count, the masks: positions of these, the first 0.
MASKS = {1: [(0,)], 2: [(0, 1)], 3: [(0, *m) for m in combinations(range(1, 4), 2)], HEAVY: [(0, *m) for m in combinations(range(1, SPREAD), HEAVY - 1)]}
#: Words that have to agree in an aligned passage: this share of the item's, or LEAST words if that is less.
SHARE, LEAST = 0.75, 13
#: A word that differs costs as much as this many that agree when the aligned passage is chosen, so over half of a passage agrees.
PENALTY = 1
#: Characters of benchmark texts that are broadcast at once; larger sets go in blocks of this size.
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\w+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
WORDS = 500_000
#: Words of documents that are searched at once, about.
AT_ONCE = 200_000


class Hashes(dict):
    """64-bit hash of each word, worked out once; forgets all when it gets large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def seeds(words: np.ndarray, weight: int) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """Each mask of this weight with the hash of the words that count from each position on; past the end, words are 0."""
    n, padded = len(words), np.append(words, np.zeros(SPREAD, np.uint64))
    scaled = [padded * _ODD[k] for k in range(weight)]
    part: dict[tuple[int, ...], np.ndarray] = {(0,): scaled[0][:n]}
    for mask in MASKS[weight]:
        # Masks are in order, so what two of them begin with is added up once.
        for k in range(1, weight + 1):
            if mask[:k] not in part:
                part = {m: x for m, x in part.items() if len(m) < k}
                part[mask[:k]] = part[mask[: k - 1]] + scaled[k - 1][mask[k - 1] : mask[k - 1] + n]
        yield mask, part[mask]


def aligned(item: np.ndarray, doc: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(agreeing words, start, end in doc) of the best passage of doc[shift + i] against item[i].

    Best: agreeing words less PENALTY for each that differs; of equals the last end, and then the first start.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[lo:hi] == doc[lo + shift : hi + shift]
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -PENALTY))])
    low = np.minimum.accumulate(sums)
    gain = sums - low
    end = len(gain) - 1 - int(np.argmax(gain[::-1]))
    start = int(np.argmin(sums[: end + 1]))
    return int(same[start:end].sum()), start + lo + shift, end + lo + shift


def needed(n: int) -> int:
    """Words that have to agree with an item of n words."""
    return min(LEAST, math.ceil(SHARE * n))


class Index:
    """Seed hashes of some benchmark items, sorted, with their place in the items laid end to end; a bit table in front of them."""

    def __init__(self, items: list[tuple[int, str | None]]):
        hashes = Hashes()
        self.items = [(k, hashes.of(t)) for k, t in items]
        size = np.fromiter((len(w) for _, w in self.items), np.int64, len(self.items))
        self.size, self.start = size, np.cumsum(size) - size
        self.words = np.concatenate([*(w for _, w in self.items), np.empty(0, np.uint64)])
        self.needed = np.fromiter(map(needed, size.tolist()), np.int64, len(size))
        owner = np.repeat(np.arange(len(size)), size)
        room = size[owner] - (np.arange(len(owner)) - self.start[owner])
        weight = np.array([WEIGHT.get(n, HEAVY) for n in size.tolist()], np.int64)[owner]
        self.masks: dict[int, dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k in np.unique(weight).tolist():
            self.masks[k] = {}
            for mask, h in seeds(self.words, k):
                at = np.flatnonzero((weight == k) & (room > mask[-1]))
                at = at[np.argsort(h[at], kind="stable")].astype(np.int32)
                bits = np.zeros(1 << min(24, max(16, (32 * len(at)).bit_length())), bool)
                bits[(h[at] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
                self.masks[k][mask] = h[at], at, bits

    def search(self, doc: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, agreeing words, start, end in words) of the best passage for each item that doc holds."""
        return [m[1:] for m in self.search_all([doc])]

    def search_all(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """The same for several documents, with the number of the document first."""
        size = np.fromiter(map(len, docs), np.int64, len(docs))
        start, words = np.cumsum(size) - size, np.concatenate([*docs, np.empty(0, np.uint64)])
        end = np.cumsum(size)
        tried = [np.empty((3, 0), np.int64)]
        for weight, masks in self.masks.items():
            for mask, own in seeds(words, weight):
                h, at, bits = masks[mask]
                pos = np.flatnonzero(bits[(own & np.uint64(len(bits) - 1)).astype(np.int64)])
                lo, hi = np.searchsorted(h, own[pos], "left"), np.searchsorted(h, own[pos], "right")
                of = np.searchsorted(end, pos, "right")
                hit = np.flatnonzero((lo < hi) & (pos + mask[-1] < end[np.minimum(of, len(end) - 1)]))
                if len(hit):
                    n = (hi - lo)[hit]
                    place = at[np.arange(n.sum()) + np.repeat(lo[hit] - (np.cumsum(n) - n), n)].astype(np.int64)
                    item = np.searchsorted(self.start + self.size, place, "right")
                    k = np.repeat(of[hit], n)
                    tried.append(np.unique(np.stack([k, item, np.repeat(pos[hit], n) - start[k] - (place - self.start[item])]), axis=1))
        doc, item, shift = np.unique(np.concatenate(tried, axis=1), axis=1)
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for c in range(0, len(doc), 4096):
            # Where not enough words agree at this shift in all, no passage can.
            d, i, s = doc[c : c + 4096], item[c : c + 4096], shift[c : c + 4096]
            lo, hi = np.maximum(0, -s), np.minimum(self.size[i], size[d] - s)
            n = hi - lo
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            same = self.words[within + np.repeat(self.start[i] + lo, n)] == words[within + np.repeat(start[d] + s + lo, n)]
            enough = np.add.reduceat(same, np.cumsum(n) - n, dtype=np.int64) >= self.needed[i]
            for k, j, at in zip(d[enough].tolist(), i[enough].tolist(), s[enough].tolist(), strict=True):
                found, first, last = aligned(self.items[j][1], docs[k], at)
                if found >= self.needed[j] and found > out.get((k, j), (0,))[0]:
                    out[k, j] = (found, first, last)
        return [(k, self.items[j][0], *out[k, j]) for k, j in sorted(out)]


def portions(texts: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts in turn in groups of about AT_ONCE words, with the number of the first of each."""
    first, n = 0, 0
    for k, t in enumerate(texts):
        if n and n + len(t) > AT_ONCE:
            yield first, texts[first:k]
            first, n = k, 0
        n += len(t)
    if first < len(texts):
        yield first, texts[first:]


def text_key(text: Column) -> Column:
    """128 bits of a text's digest; null for a null text."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, words, start, end, text_key) for each item of which a document holds a passage, start and end in the document's words.

    text_key is that of the text, the same for equal texts.

    Words are runs of word characters, lower-cased. Benchmark items are broadcast in blocks of at most about block_chars
    characters, whose number is worked out from their total size, so a large benchmark costs more passes and no more
    memory. Null and empty texts and items match nothing; repeated rows of docs give repeated results.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("t")).where("item IS NOT NULL AND t IS NOT NULL").distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    out = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text_key", pa.string())])
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("text_key"))
    found = None
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(sorted((r["item"], r["t"]) for r in items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == k).toLocalIterator()))

        def batches(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, hashes = Index(shared.value), Hashes()
            for b in it:
                ids, texts, keys = b.column(0).to_pylist(), [hashes.of(t) for t in b.column(1).to_pylist()], b.column(2)
                hits = [(ids[first + m[0]], *m[1:], keys[first + m[0]].as_py()) for first, part in portions(texts) for m in index.search_all(part)]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], f.type) for i, f in enumerate(out)], schema=out)

        part = rows.mapInArrow(batches, "id long, item long, words int, start int, end int, text_key string")
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, contaminated, n_items, items, max_words) for every row of docs; items in order, comma-joined.

    The verdict is on a row's text, whatever its id: rows with a null id have theirs, and rows that share an id have each
    their own. Null and empty texts are clean. Other columns are dropped, whatever their names. Empty tables give no rows,
    and an empty benchmark no contaminated ones.
    """
    held = materialize(matches(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("held_id"), "text_key", "item_id", "words"), "matches")
    # By id and text: copies have ids of their own, so they meet their verdicts in many tasks.
    per = held.groupBy("held_id", "text_key").agg(F.count_distinct("item_id").alias("n_items"), F.array_join(F.sort_array(F.collect_set("item_id")), ",").alias("items"), F.max("words").cast("long").alias("max_words"))
    rows = docs.select(F.col(id_col).alias("own_id"), text_key(F.col(text_col)).alias("own_key"))
    return rows.join(per, F.col("own_id").cast("long").eqNullSafe(F.col("held_id")) & (F.col("own_key") == F.col("text_key")), "left").select(
        F.col("own_id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), F.coalesce("max_words", F.lit(0).cast("long")).alias("max_words")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark passage, whatever their id. All columns are kept as they are, whatever their names."""
    held = materialize(matches(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("held_id"), "text_key").distinct(), "matches")
    return docs.join(held, docs[id_col].cast("long").eqNullSafe(held["held_id"]) & (text_key(docs[text_col]) == held["text_key"]), "left_anti")
