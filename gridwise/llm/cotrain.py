"""Quality classification by co-training two views of a document.

One view is the text: hashed words and pairs of words, hashed character n-grams, and the shape of the text in bins. The
other is what is known about the page it came from: source, language, length and what is missing. Each view is a naive
Bayes classifier, whose model is sums of features by class. In each round either view labels all rows that it is sure
of, and the other view's sums are taken over the labelled rows and over these, in one pass. After each round both views are
calibrated on labelled rows that were set aside; at the end the calibrated views are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Labelled rows that are learned from at most; every fifth of them only calibrates. Other labelled rows count as unlabelled.
LABELLED, SET_ASIDE = 12_000, 5
ROUNDS = 2
#: How sure of a row a view has to be to label it for the other.
SURE = 0.95
#: A document is rejected if its probability of being good is below this.
THRESHOLD = 0.5
#: Buckets of hashed words and pairs, and of hashed character n-grams; characters (bytes) of such a one; bins of a shape feature or a length.
WORDS, GRAMS, GRAM, BINS = 1 << 16, 1 << 16, 4, 32
#: Buckets of hashed sources and languages.
SLOTS = 256
#: Added to each sum.
SMOOTH = 0.5

# Classes of bytes: other, lower, upper, digits, blanks, breaks, stops, shouts, symbols, beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"-()", b"!?", b"|#$%&*+<=>@[\\]^_`{}~/")):
    _CLASS[list(_chars)] = _i + 1
_CLASS[128:] = 9
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd weights of the bytes of a word by their place; longer words go round.
_WEIGHTS = np.random.default_rng(7).integers(0, 1 << 31, 64, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

SHAPE = ["other", "lower", "upper", "digits", "blanks", "breaks", "stops", "shouts", "symbols", "beyond", "length", "types", "words", "richness", "lines", "titles", "tails", "single"]
#: The parts of the views and their numbers of features: a part's features of one row are compared with its own sums.
PARTS = {"words": WORDS, "grams": GRAMS, "shape": len(SHAPE) * BINS, "page": 2 * SLOTS + BINS + 8}
VIEWS = {"text": ("words", "grams", "shape"), "page": ("page",)}
#: Bytes of texts that are worked on at once, about.
AT_ONCE = 1 << 20

#: Of each part the features of rows, and the number of the row of each.
Found = dict[str, tuple[np.ndarray, np.ndarray]]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
    return (h ^ h >> np.uint32(12)) * np.uint32(0x297A2D39)


def _runs(data: np.ndarray, inside: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash, row) of the runs of bytes marked inside; edges are where rows begin and end."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = edges[:-1][edges[:-1] < len(data)]
    first[begin] = inside[begin]
    start = np.flatnonzero(first)
    if not len(start):
        return start, start, np.empty(0, np.uint32), start
    number = np.cumsum(first, dtype=np.int32) - 1
    place = np.arange(len(data), dtype=np.int32) - start[np.maximum(number, 0)].astype(np.int32)
    h = np.add.reduceat(np.where(inside, (data.astype(np.uint32) + np.uint32(1)) * _WEIGHTS[place & 63], np.uint32(0)), start, dtype=np.uint32)
    size = np.add.reduceat(inside, start, dtype=np.int64)
    return start, size, _mixed(h + size.astype(np.uint32)), np.searchsorted(edges, start, "right") - 1


def _different(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """How many different hashes each row has."""
    x = np.sort(row.astype(np.uint64) << np.uint64(32) | h)
    return np.bincount((x[np.diff(x, prepend=x[:1] + np.uint64(1)) != 0] >> np.uint64(32)).astype(np.int64), minlength=rows)


def _share(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return n / np.maximum(of, 1)


def text_features(texts: list[str | None]) -> Found:
    """Words, pairs of words and n-grams of bytes as buckets, and the text's shape in bins; A-Z lower-cased for words, which end at ASCII white space."""
    rows, raw = len(texts), [(t or "").encode() for t in texts]
    edges = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    per = lambda row, weights=None: np.bincount(row, weights, minlength=rows)
    start, size, h, row = _runs(_LOWER[data], ~_SPACE[data], edges)
    pairs = _mixed(h[:-1] * np.uint32(0x9E3779B1) + h[1:])[row[:-1] == row[1:]]
    grams = np.zeros(max(0, len(data) - GRAM + 1), np.uint32)
    for k in range(GRAM):
        grams = (grams ^ data[k : k + len(grams)]) * np.uint32(0x01000193)
    owner = np.repeat(np.arange(rows, dtype=np.int32), np.diff(edges))
    whole = owner[: len(grams)] == owner[len(data) - len(grams) :]
    n, bytes_ = per(row), np.diff(edges)
    kinds = np.bincount(owner * 10 + _CLASS[data], minlength=10 * rows).reshape(rows, 10)
    different = _different(row, h, rows)
    _, _, line, line_row = _runs(data, data != 10, edges)
    last = _CLASS[data[start + size - 1]] if len(start) else start
    shape = np.stack(
        [
            *_share(kinds.T, bytes_),
            _share(bytes_, n) / 100,
            _share(different, n),
            np.log(np.maximum(n, 1)) / 20,
            np.log(np.maximum(different, 1)) / np.maximum(np.log(np.maximum(n, 1)), 1.0),
            _share(_different(line_row, line, rows), per(line_row)),
            _share(per(row, _CLASS[data[start]] == 2) if len(start) else n, n),
            _share(per(row, (last != 1) & (last != 2) & (last != 3) & (last != 9)) if len(start) else n, n),
            _share(per(row, size == 1), n),
        ],
        axis=1,
    )
    bins = (np.sqrt(np.clip(shape, 0, 1)) * (BINS - 1)).astype(np.int64) + BINS * np.arange(len(SHAPE))
    return {
        "words": (np.concatenate([h, pairs]).astype(np.int64) % WORDS, np.concatenate([row, row[:-1][row[:-1] == row[1:]]])),
        "grams": ((_mixed(grams[whole]) % np.uint32(GRAMS)).astype(np.int64), owner[: len(grams)][whole]),
        "shape": (bins.ravel(), np.repeat(np.arange(rows), len(SHAPE))),
    }


@cache
def slot(name: str, value: str | None) -> int:
    return xxhash.xxh64_intdigest(f"{name}={value}") % SLOTS


def page_features(rows: list[tuple[str | None, str | None, int | None]]) -> Found:
    """Of (source, lang, n_chars): source, language, logarithm of the length, and what is missing."""
    out = []
    for source, lang, n_chars in rows:
        length = min(BINS - 1, int(2 * np.log2(max(n_chars or 0, 0) + 1)))
        missing = [2 * SLOTS + BINS + 2 * i + (x is None) for i, x in enumerate((source, lang, n_chars))]
        out.append([slot("source", source), SLOTS + slot("lang", lang), 2 * SLOTS + length, *missing])
    return {"page": (np.array(out, np.int64).ravel(), np.repeat(np.arange(len(rows)), 6))}


def portions(columns: list[list]) -> Iterator[tuple[list, ...]]:
    """Rows in turn, about AT_ONCE characters of texts (the first column) at once."""
    first, n = 0, 0
    for k, t in enumerate(columns[0]):
        if n and n + len(t or "") > AT_ONCE:
            yield tuple(c[first:k] for c in columns)
            first, n = k, 0
        n += len(t or "")
    if first < len(columns[0]):
        yield tuple(c[first:] for c in columns)


Sums = dict[str, np.ndarray]


def no_sums() -> Sums:
    """For each part the sums of its features in bad and in good rows."""
    return {p: np.zeros((2, n)) for p, n in PARTS.items()}


@dataclass
class View:
    """A naive Bayes classifier over some parts: log odds of each feature, and how the parts' odds are calibrated."""

    odds: dict[str, np.ndarray]
    a: np.ndarray = field(default_factory=lambda: np.empty(0))
    base: float = 0.0

    @classmethod
    def of(cls, parts: tuple[str, ...], sums: Sums) -> View:
        log = {p: np.log((sums[p] + SMOOTH) / (sums[p] + SMOOTH).sum(axis=1, keepdims=True)) for p in parts}
        return cls({p: x[1] - x[0] for p, x in log.items()})

    def parts(self, found: Found, rows: int) -> np.ndarray:
        """The mean log odds of each row's features in each part; 0 where it has none."""
        out = np.zeros((rows, len(self.odds)))
        for i, (p, odds) in enumerate(self.odds.items()):
            features, row = found[p]
            out[:, i] = np.bincount(row, odds[features], minlength=rows) / np.maximum(np.bincount(row, minlength=rows), 1)
        return out

    def logit(self, found: Found, rows: int) -> np.ndarray:
        return np.clip(self.parts(found, rows) @ self.a + self.base, -20, 20)


@dataclass
class CoTrained:
    text: View
    page: View
    #: Calibrated log odds: base + a . (text logit, page logit), a >= 0.
    a: np.ndarray
    base: float
    #: Of each round the rows that the text view labelled for the page view, and the other way round.
    rounds: list[tuple[int, int]]

    def probability(self, text: Found, page: Found, rows: int) -> np.ndarray:
        z = np.stack([self.text.logit(text, rows), self.page.logit(page, rows)], axis=1) @ self.a + self.base
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression of y on the columns of z, on rows that z's model has not seen. A column that points the wrong way gets no weight."""
    used = list(range(z.shape[1]))
    while True:
        w = np.zeros(len(used) + 1)
        x = np.hstack([z[:, used], np.ones((len(z), 1))])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), x.T @ (p - y) + 1e-2 * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        if not used or (w[:-1] >= 0).all():
            a = np.zeros(z.shape[1])
            a[used] = w[:-1]
            return a, float(w[-1])
        used = [u for u, v in zip(used, w, strict=False) if v >= 0]


_COLUMNS = ("text", "source", "lang", "n_chars")
_SUMS = pa.schema([("part", pa.string()), ("feature", pa.int32()), ("good", pa.int32()), ("n", pa.float64())])


def _inputs(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*more, F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"))


def _collected(made: DataFrame) -> Sums:
    """Sums of (part, feature, good, n) rows, added up over Spark; their number is bounded by PARTS."""
    sums = no_sums() | {"told": np.zeros((2, 2))}
    got = made.groupBy("part", "feature", "good").agg(F.sum("n").alias("n")).toPandas()
    for part, rows in got.groupby("part"):
        sums[part][rows.good, rows.feature] = rows.n
    return sums


def _emitted(sums: Sums) -> pa.RecordBatch:
    rows = [(p, *np.nonzero(x), x) for p, x in sums.items()]
    columns = [np.concatenate([np.full(len(g), p, object) for p, g, _, _ in rows]), np.concatenate([f for _, _, f, _ in rows]), np.concatenate([g for _, g, _, _ in rows]), np.concatenate([x[g, f] for _, g, f, x in rows])]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMS, strict=True)], schema=_SUMS)


def _add(sums: Sums, found: Found, good: np.ndarray) -> None:
    """Add the features of rows by their class; rows of another number than 0 and 1 have none."""
    for part, (features, row) in found.items():
        for g in (0, 1):
            sums[part][g] += np.bincount(features[good[row] == g], minlength=PARTS[part])


def label_sums(rows: DataFrame) -> Sums:
    """Sums over labelled rows (good, text, source, lang, n_chars)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = no_sums()
        for b in it:
            for texts, good, *page in portions([b.column(k).to_pylist() for k in (1, 0, 2, 3, 4)]):
                _add(sums, text_features(texts) | page_features(list(zip(*page, strict=True))), np.array(good))
        yield _emitted(sums)

    return _collected(_inputs(rows, "good").mapInArrow(batches, "part string, feature int, good int, n double"))


def exchanged(rows: DataFrame, text: View, page: View, sure: float = SURE) -> Sums:
    """Sums over rows of what each view labels: of text features by the page view's labels, of page features by the text view's.

    told[good, 0] counts the rows that the text view labelled, told[good, 1] those that the page view did.
    """
    shared = rows.sparkSession.sparkContext.broadcast((text, page))
    edge = float(np.log(sure / (1 - sure)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, (text, page) = no_sums() | {"told": np.zeros((2, 2))}, shared.value
        for b in it:
            for texts, *about in portions([c.to_pylist() for c in b.columns]):
                found = (text_features(texts), page_features(list(zip(*about, strict=True))))
                for v, view in enumerate((text, page)):
                    z = view.logit(found[v], len(texts))
                    good = np.where(np.abs(z) >= edge, (z > 0).astype(int), -1)
                    sums["told"][:, v] += [(good == 0).sum(), (good == 1).sum()]
                    _add(sums, found[1 - v], good)
        yield _emitted(sums)

    return _collected(_inputs(rows).mapInArrow(batches, "part string, feature int, good int, n double"))


def _odds(rows: DataFrame, text: View, page: View) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of labelled rows the parts' mean log odds in both views, and the labels."""
    shared = rows.sparkSession.sparkContext.broadcast((text, page))
    out = pa.schema([("good", pa.int32()), ("text", pa.list_(pa.float64())), ("page", pa.list_(pa.float64()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, page = shared.value
        for b in it:
            for texts, good, *about in portions([b.column(k).to_pylist() for k in (1, 0, 2, 3, 4)]):
                made = [good, list(text.parts(text_features(texts), len(texts))), list(page.parts(page_features(list(zip(*about, strict=True))), len(texts)))]
                yield pa.RecordBatch.from_arrays([pa.array(m, f.type) for m, f in zip(made, out, strict=True)], schema=out)

    got = _inputs(rows, "good").mapInArrow(batches, "good int, text array<double>, page array<double>").toPandas()
    stack = lambda c: np.stack(got[c].to_numpy())
    return stack("text"), stack("page"), got.good.to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """Learn from the first ``labelled`` labelled ids by a hash, and in each round from all other rows of docs.

    Labels other than 0 and 1 and null ids don't count; of conflicting labels of an id the good one counts. Of rows that
    share a labelled id the least by text, source, language and length is learned from. What reaches the driver are sums
    by feature, and of the rows set aside (a fifth of ``labelled`` at most) a few numbers each. None if a class is missing
    among the rows learned from or those set aside, as with empty tables.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").alias("known_id")).agg(F.max("quality").cast("int").alias("good"))
    known = known.withColumn("h", F.xxhash64("known_id", F.lit(9))).orderBy("h", "known_id").limit(labelled)
    # Bounded by a parameter, so it can go to every task.
    known = materialize(known, "known")
    least = F.min(F.struct(*_COLUMNS)).alias("row")
    rows = docs.select(F.col("doc_id"), *(c for c in _COLUMNS)).join(F.broadcast(known), F.col("doc_id") == F.col("known_id")).groupBy("doc_id", "good", "h").agg(least)
    rows = materialize(rows.select("good", "row.*", (F.pmod(F.xxhash64("h"), F.lit(SET_ASIDE)) == 0).alias("aside")), "labelled")
    counts = {(r["aside"], r["good"]): r["n"] for r in rows.groupBy("aside", "good").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 4:
        return None
    ids = known.select("known_id")
    pool = docs.select("doc_id", *_COLUMNS).join(F.broadcast(ids), F.col("doc_id") == F.col("known_id"), "left_anti")
    learned, aside = rows.where("NOT aside"), rows.where("aside")
    own = label_sums(learned)
    sums, done = own, []
    for r in range(rounds + 1):
        text, page = (View.of(VIEWS[v], sums) for v in ("text", "page"))
        z_text, z_page, y = _odds(aside, text, page)
        for view, z in ((text, z_text), (page, z_page)):
            view.a, view.base = calibrate(z, y)
        if r == rounds:
            break
        more = exchanged(pool, text, page)
        done.append((int(more["told"][:, 0].sum()), int(more["told"][:, 1].sum())))
        sums = {p: own[p] + more[p] for p in PARTS}
    z = np.stack([np.clip(z_text @ text.a + text.base, -20, 20), np.clip(z_page @ page.a + page.base, -20, 20)], axis=1)
    a, base = calibrate(z, y)
    return CoTrained(text, page, a, base, done)


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """docs with ``quality_score`` (probability of being good, 6 places); other columns stay, a column of that name is replaced.

    Null columns are features of their own. Without a model every score is 1, so nothing is rejected.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array, sources: pa.Array, langs: pa.Array, sizes: pa.Array) -> pa.Array:
        if shared.value is None:
            return pa.array(np.ones(len(texts)))
        made = [np.empty(0)]
        for part, *about in portions([c.to_pylist() for c in (texts, sources, langs, sizes)]):
            made.append(shared.value.probability(text_features(part), page_features(list(zip(*about, strict=True))), len(part)))
        return pa.array(np.round(np.concatenate(made), 6))

    return docs.withColumn("quality_score", scored("text", "source", "lang", F.col("n_chars").cast("long")))
