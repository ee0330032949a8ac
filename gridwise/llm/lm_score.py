"""Cross-entropy difference: how much more a target corpus's language model likes a document than a background's.

Both are bigram models with the same order, smoothing and vocabulary (the words of the background, which is the whole
table; the target is a part of it), counted over all rows. A text is the words between a start and an end mark.

    P_b(w) = c_b(w) / N_b                      P_t(w) = (c_t(w) + MU * P_b(w)) / (N_t + MU)
    P_m(w|v) = (c_m(v, w) + BETA * P_m(w)) / (c_m(v) + BETA)

How it runs: documents are dealt into blocks by a hash of their id. A block sorts the hashes of its distinct n-grams and
sends their counts, cut into ranges of the hash; each range adds up the counts of all blocks and sends every block
those of its own n-grams, in the same order. The block then scores its documents. Hashes and counts travel packed,
and no task holds more than a block or a range; both grow in number, not in size, with the corpus. A block sends to FANOUT
ranges at most: beyond, groups of blocks first add up what they hold of a coarse range, and the sums go on to the ranges.

Rows without words need no block. Ids with so much text that they would fill a block (null is one) are dealt by their
texts and the partitions that they are read in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Pseudo-counts of the unigram and bigram models.
MU, BETA = 1000.0, 2.0
#: Characters in a block, about.
BLOCK_CHARS = 8_000_000
#: Ranges that a block sends packets to without a step between.
FANOUT = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes that no word has: marks of the start and the end of a text.
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000001)
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def words(text: str | None) -> list[bytes]:
    """A-Z are lower-cased, and words end at ASCII white space."""
    return (text or "").encode().translate(_LOWER).split()


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a bigram from those of its words."""
    with np.errstate(over="ignore"):
        h = (v * _ODD) ^ (v >> _STEP)
        h = (h + w) * _ODD
        return h ^ (h >> _STEP)


class Block:
    """The documents of a block: sorted hashes of their distinct n-grams, and where in these each predicted word is.

    A text's predicted words are its own and its end mark; a text without words has none.
    """

    def __init__(self, texts: list[str | None]):
        split = [words(t) for t in texts]
        self.sizes = np.array([len(d) + 1 if d else 0 for d in split], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        full = self.sizes > 0
        # Numbers of the words as they come, after those of the two marks.
        seen: dict[bytes, int] = {}
        number = seen.setdefault
        word = np.ones(int(self.sizes.sum()), np.int64)
        inner = np.ones(len(word), bool)
        inner[(self.starts + self.sizes)[full] - 1] = False
        word[inner] = np.fromiter((number(w, len(seen) + 2) for d in split for w in d), np.int64, int(inner.sum()))
        before = np.empty_like(word)
        before[1:] = word[:-1]
        before[self.starts[full]] = 0
        hashes = np.concatenate([np.array([START, END]), np.fromiter(map(xxhash.xxh64_intdigest, seen), np.uint64, len(seen))])
        pairs, at = np.unique(before * len(hashes) + word, return_inverse=True)
        bigrams = pair(hashes[pairs // len(hashes)], hashes[pairs % len(hashes)])
        self.hashes, place = np.unique(np.concatenate([hashes, bigrams]), return_inverse=True)
        self.word, self.before, self.bigram = place[word], place[before], place[len(hashes) + at]
        self.start = place[0]

    def counts(self, own: np.ndarray) -> np.ndarray:
        """How often each n-gram is in the texts that own marks; a context counts as often as a text or a word begins with it."""
        marks = np.repeat(own, self.sizes)
        n = np.bincount(self.word[marks], minlength=len(self.hashes)) + np.bincount(self.bigram[marks], minlength=len(self.hashes))
        n[self.start] += int((own & (self.sizes > 0)).sum())
        return n

    def sums(self, each: np.ndarray) -> np.ndarray:
        """Sum over the predicted words of each text."""
        out, full = np.zeros(len(self.sizes)), self.sizes > 0
        if full.any():
            out[full] = np.add.reduceat(each, self.starts[full])
        return out


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as planes: all lowest bytes, then all second ones, and so on. Empty planes cost next to nothing once compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def steps(rising: np.ndarray) -> np.ndarray:
    """The first number and the differences of each to the one before."""
    return np.diff(rising, prepend=np.zeros(1, rising.dtype))


def span(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Which of so many equal ranges of the hash each is in; rises with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def packets(hashes: np.ndarray, counts: dict[str, np.ndarray], ranges: int) -> dict[str, object]:
    """Columns range, hashes and counts of the packets that sorted hashes are cut into, one for each range that has any."""
    which = span(hashes, ranges)
    cuts = np.flatnonzero(np.diff(which, prepend=-1))
    bounds = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(hashes)], strict=True)) if len(cuts) else []
    return {"range": which[cuts], "hashes": [pack(steps(hashes[a:b])) for a, b in bounds]} | {c: [pack(n[a:b]) for a, b in bounds] for c, n in counts.items()}


def opened(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Of all packets: distinct hashes, where in these each packet's hashes are, where packets end, and the summed counts."""
    each = [np.cumsum(unpack(h), dtype=np.uint64) for h in pdf.hashes]
    hashes, at = np.unique(np.concatenate(each), return_inverse=True)
    sums = {c: np.bincount(at, weights=np.concatenate([unpack(x) for x in pdf[c]])) for c in COUNTS}
    return hashes, at, np.cumsum([len(h) for h in each]), sums


def answers(pdf: pd.DataFrame, at: np.ndarray, ends: np.ndarray, sums: dict[str, np.ndarray]) -> pd.DataFrame:
    """(block, range, counts) that go back for each packet."""
    return pd.DataFrame({"block": pdf.block, "range": pdf.range} | {c: [pack(p) for p in np.split(n[at], ends[:-1])] for c, n in sums.items()})


COUNTS = ("all", "own")
_BACK = "block long, range long, all binary, own binary"


def exchange(sent: DataFrame, step: int, ranges: int) -> DataFrame:
    """(block, range, all, own): for each packet (block, range, hashes, all, own) the counts of its hashes over all blocks.

    The packets are cut into ranges / step coarse ranges. With step > 1, as many blocks as there are coarse ranges are a
    group, which adds up a coarse range's packets and sends the sums to its step ranges.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        _, at, ends, sums = opened(pdf)
        return answers(pdf, at, ends, sums)

    if step == 1:
        return sent.groupBy("range").applyInPandas(add, _BACK)
    coarse = ranges // step
    grouped = sent.withColumn("group", F.floor(F.col("block") / coarse)).groupBy("group", "range")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, _, _, sums = opened(pdf)
        return pd.DataFrame({"block": pdf.group.iloc[0]} | packets(hashes, sums, ranges))

    def spread(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        _, at, ends, _ = opened(pdf)
        back = back.sort_values("fine")
        return answers(pdf, at, ends, {c: np.concatenate([unpack(x) for x in back[c]]) for c in COUNTS})

    summed = grouped.applyInPandas(merge, "block long, range long, hashes binary, all binary, own binary")
    back = summed.groupBy("range").applyInPandas(add, _BACK)
    back = back.select(F.col("block").alias("group"), F.floor(F.col("range") / step).alias("range"), F.col("range").alias("fine"), *COUNTS)
    return grouped.cogroup(back.groupBy("group", "range")).applyInPandas(spread, _BACK)


def target_ids(labels: DataFrame) -> DataFrame:
    """Ids of the target corpus: documents labelled as good."""
    return labels.where("quality = 1").select("doc_id").distinct()


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, fanout: int = FANOUT) -> DataFrame:
    """(id, n_tokens, ce_target, ce_background, score) per row.

    target has the ids of the target corpus, a part of docs; repeated ids in it count once. The cross-entropies are
    natural logarithms per predicted word (the end mark is one), 6 places; score is the target's less the background's,
    so low is like the target. Null, empty and blank texts have no tokens and null scores. Repeated rows count and come
    out repeatedly. Rows with a null id are background. Other columns are dropped, whatever their names. Without a target
    corpus the target model is the background's unigram. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ids = target.select(F.col(target.columns[0]).cast("long").alias("k")).where("k IS NOT NULL").distinct()

    out = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("chars", pa.int64())])

    def sizes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(1).to_pylist()
            n = [len(t.encode().split()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x + 1 if x else 0 for x in n], pa.int64()), pa.array([len(t or "") for t in texts], pa.int64())], schema=out)

    per = rows.mapInArrow(sizes, "id long, n long, chars long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    per = materialize(per.join(ids, per.id == ids.k, "left").select("id", "n", "chars", F.col("k").isNotNull().alias("own")), "sizes")
    n_b, n_t, chars = (int(x or 0) for x in per.agg(F.sum("n"), F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)), F.sum("chars")).first())
    blocks = max(1, math.ceil(chars / block_chars))
    step = 1 if blocks <= fanout else math.ceil(math.sqrt(blocks))
    ranges = math.ceil(blocks / step) * step
    # At most four for each block, so these may be sent to every task.
    heavy = per.where(F.col("id").isNull() | (F.col("chars") * 4 > block_chars)).select(F.col("id").alias("h"), F.col("own").alias("own_"), F.lit(True).alias("heavy"))
    deal = lambda *c: F.pmod(F.xxhash64(*c), F.lit(blocks)).alias("block")
    worded = rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(F.broadcast(heavy), F.col("id").eqNullSafe(F.col("h")), "left")
    spread = F.when(F.col("heavy"), deal("id", "text", F.spark_partition_id())).otherwise(deal("id")).alias("block")
    dealt = worded.select(spread, "id", "text", F.coalesce("own_", F.lit(False)).alias("own")).groupBy("block")
    marked = ids.select(deal("k"), "k").groupBy("block")

    def send(docs: pd.DataFrame, target: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"block": [], "range": [], "hashes": [], "all": [], "own": []})
        made = Block(docs.text.tolist())
        own = docs.own.to_numpy(bool) | (np.isin(docs.id.fillna(-1).to_numpy(np.int64), target.k.to_numpy(np.int64)) & docs.id.notna().to_numpy())
        counts = {"all": made.counts(np.ones(len(own), bool)), "own": made.counts(own)}
        return pd.DataFrame({"block": docs.block.iloc[0]} | packets(made.hashes, counts, ranges // step))

    sent = dealt.cogroup(marked).applyInPandas(send, "block long, range long, hashes binary, all binary, own binary")
    counts = exchange(sent, step, ranges).groupBy("block")

    def judge(docs: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        made = Block(docs.text.tolist())
        counts = counts.sort_values("range")
        n = {c: np.concatenate([unpack(x) for x in counts[c]]).astype(float) for c in COUNTS}
        p_b = n["all"] / max(n_b, 1)
        p_t = (n["own"] + MU * p_b) / (n_t + MU)
        ce = {}
        for c, p in (("all", p_b), ("own", p_t)):
            each = -np.log((n[c][made.bigram] + (BETA * p)[made.word]) / (n[c] + BETA)[made.before])
            ce[c] = made.sums(each) / made.sizes
        return pd.DataFrame({"id": docs.id, "n_tokens": made.sizes, "ce_target": ce["own"].round(6), "ce_background": ce["all"].round(6), "score": (ce["own"] - ce["all"]).round(6)})

    none = {c: [] for c in ("id", "n_tokens", "ce_target", "ce_background", "score")}
    scored = dealt.cogroup(counts).applyInPandas(lambda d, c: judge(d, c) if len(d) else pd.DataFrame(none), "id long, n_tokens long, ce_target double, ce_background double, score double")
    blank = rows.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).selectExpr("id", "0L AS n_tokens", *(f"CAST(NULL AS DOUBLE) AS {c}" for c in ("ce_target", "ce_background", "score")))
    return scored.unionByName(blank).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


#: The same scores in SQL, for the tables documents and labels.
SQL = f"""
WITH docs AS (
    SELECT d.doc_id, l.doc_id IS NOT NULL AS own,
        list_filter(string_split_regex(translate(coalesce(d.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id
), seqs AS (
    SELECT doc_id, own, list_concat(['<s>'], ws, ['</s>']) AS s FROM docs WHERE len(ws) > 0
), steps AS (
    SELECT doc_id, own, s[i] AS v, s[i + 1] AS w FROM (SELECT doc_id, own, s, unnest(range(1, len(s))) AS i FROM seqs)
), uni AS (
    SELECT w, count(*) AS n, count(*) FILTER (WHERE own) AS m FROM steps GROUP BY w
), ctx AS (
    SELECT v, count(*) AS n, count(*) FILTER (WHERE own) AS m FROM steps GROUP BY v
), bi AS (
    SELECT v, w, count(*) AS n, count(*) FILTER (WHERE own) AS m FROM steps GROUP BY v, w
), total AS (
    SELECT count(*) AS n, count(*) FILTER (WHERE own) AS m FROM steps
), probs AS (
    SELECT bi.v, bi.w, bi.n AS bn, bi.m AS bm, ctx.n AS cn, ctx.m AS cm,
        uni.n / total.n::DOUBLE AS pb, (uni.m + {MU}::DOUBLE * (uni.n / total.n::DOUBLE)) / (total.m + {MU}::DOUBLE) AS pt
    FROM bi JOIN ctx ON bi.v = ctx.v JOIN uni ON bi.w = uni.w, total
), each AS (
    SELECT s.doc_id, -ln((p.bm + {BETA}::DOUBLE * p.pt) / (p.cm + {BETA}::DOUBLE)) AS lt, -ln((p.bn + {BETA}::DOUBLE * p.pb) / (p.cn + {BETA}::DOUBLE)) AS lb
    FROM steps s JOIN probs p ON s.v = p.v AND s.w = p.w
), sums AS (
    SELECT doc_id, count(*) AS n, sum(lt) / count(*) AS t, sum(lb) / count(*) AS b FROM each GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_tokens, round(s.t, 6) AS ce_target, round(s.b, 6) AS ce_background, round(s.t - s.b, 6) AS score
FROM docs d LEFT JOIN sums s ON d.doc_id = s.doc_id
"""
