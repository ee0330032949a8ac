"""SimHash near-duplicates: fingerprints, and links between them by a self-join over their binary trie.

Where a similarity is asked for, the trie join only proposes classes, and the sets of shingles are compared exactly in each.

Equal fingerprints are one leaf. The trie is traversed for pairs of nodes at once: differing bits add up on the way
down, and a pair goes no further once they exceed the budget. The first levels are laid out over Spark: a fingerprint
joins every pair of prefixes within the budget that has its own; each such pair of subtrees is then traversed by itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwise.operators.graph import components

from .common import bounded_batches, map_columns, materialize

BITS = 64
#: Fingerprints below a node of the last level that Spark lays out, about, and the deepest such level.
LEAVES, DEEPEST = 4096, 32
#: A key is frequent if it has more than HOT rows and more than one row in HOT_SHARE, so HOT_SHARE keys are frequent at most.
HOT, HOT_SHARE = 256, 100_000
#: Pairs of nodes looked at together in a traversal.
AT_ONCE = 1 << 16
#: Below this many pairs of fingerprints, a pair of nodes is compared fingerprint by fingerprint.
FEW = 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is in over half of the XXH64 hashes of the word shingles, repeats included.

    A-Z are lower-cased and words end at ASCII white space. Fewer words than a shingle: the whole sequence. None: 0.
    """
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=">u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) per row, fp as a signed long. Null counts as empty. Repeated rows stay; other columns are dropped."""

    def rows(ids: list, texts: list) -> dict[str, list]:
        return {"id": ids, "fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

    out = pa.schema([("id", pa.int64()), ("fp", pa.int64())])
    return map_columns(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), rows, "id long, fp long", out)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Labels:
    """Components of what has been linked so far, as the smallest member of each."""

    def __init__(self, n: int):
        self.of, self.linked = np.arange(n), False

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            more = x != y
            if not more.any():
                return
            a, b, x, y = a[more], b[more], x[more], y[more]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(self.of, up := self.of[self.of]):
                self.of = up
            self.linked = True

    def joined(self, nodes: np.ndarray) -> np.ndarray:
        """Whether all leaves of both ranges have one label; the time does not depend on the ranges' lengths."""
        alo, ahi, blo, bhi, _ = nodes
        changes = np.cumsum(self.of != np.append(self.of[:1], self.of[:-1]))
        return (self.of[alo] == self.of[blo]) & (changes[alo] == changes[ahi - 1]) & (changes[blo] == changes[bhi - 1])


def traverse(key: np.ndarray, half: int, depth: int, errors: int, budget: int, deepest: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Label of each fingerprint after linking all pairs whose keys differ in at most budget of the first deepest bits and that are near.

    key[:half] and key[half:] are the leaves below two nodes at depth whose prefixes differ in errors bits, each part
    sorted; with half = len(key) the node is paired with itself. near says of pairs of leaves (two arrays of positions)
    which are to be linked. A pair of nodes whose leaves are in one component already is left out: its links would
    change nothing.
    """
    n, labels = len(key), Labels(len(key))
    one = np.zeros(1, np.int64)
    first = (one, one + half, one, one + half) if half == n else (one, one + half, one + half, one + n)
    stack = [(depth, np.stack([*first, one + errors]))]
    while stack:
        d, nodes = stack.pop()
        if nodes.shape[1] > AT_ONCE:
            cut = nodes.shape[1] // 2
            stack += [(d, nodes[:, cut:]), (d, nodes[:, :cut])]
            continue
        if labels.linked and (nodes.shape[1] > FEW or d >= deepest):
            nodes = nodes[:, ~labels.joined(nodes)]
        sizes = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
        if d >= deepest:
            # Nothing is left to tell leaves apart by: compare them all, many at a time.
            large = sizes > AT_ONCE
            if large.any():
                stack += [(d, part) for x in nodes[:, large].T for part in halves(x)]
            # The first part is never empty, as no size left is above AT_ONCE.
            cuts = np.flatnonzero(np.diff((np.cumsum(sizes[~large]) - 1) // AT_ONCE, prepend=0)).tolist()
            parts = np.split(nodes[:, ~large], cuts, axis=1)
            if len(parts) > 1:
                stack += [(d, part) for part in parts[1:] if part.shape[1]]
            nodes = parts[0]
            sizes = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
        small = sizes <= FEW if d < deepest else np.ones(nodes.shape[1], bool)
        if small.any():
            alo, _, blo, bhi, _ = nodes[:, small]
            k = np.repeat(np.arange(len(alo)), sizes[small])
            within = np.arange(len(k)) - np.repeat(np.cumsum(sizes[small]) - sizes[small], sizes[small])
            width = (bhi - blo)[k]
            i, j = alo[k] + within // width, blo[k] + within % width
            i, j = i[i < j], j[i < j]
            linked = near(i, j)
            labels.link(i[linked], j[linked])
            nodes = nodes[:, ~small]
        if not nodes.shape[1]:
            continue
        ones = np.append(0, np.cumsum((key >> np.uint64(BITS - 1 - d)) & np.uint64(1), dtype=np.int64))
        alo, ahi, blo, bhi, err = nodes
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        itself = alo == blo
        down = np.concatenate(
            [
                np.stack([alo, amid, blo, bmid, err]),
                np.stack([amid, ahi, bmid, bhi, err]),
                np.stack([alo, amid, bmid, bhi, err + 1]),
                np.stack([amid, ahi, blo, bmid, err + 1])[:, ~itself],
            ],
            axis=1,
        )
        keep = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget)
        stack.append((d + 1, down[:, keep]))
    return labels.of


def halves(node: np.ndarray) -> list[np.ndarray]:
    """A pair of ranges as pairs of parts that hold the same pairs of leaves, each pair of leaves in order once."""
    alo, ahi, blo, bhi, err = node.tolist()
    column = lambda *x: np.array([*x, err], np.int64)[:, None]
    if alo == blo:
        mid = (alo + ahi) // 2
        return [column(alo, mid, mid, ahi), column(mid, ahi, mid, ahi), column(alo, mid, alo, mid)]
    if ahi - alo >= bhi - blo:
        mid = (alo + ahi) // 2
        return [column(mid, ahi, blo, bhi), column(alo, mid, blo, bhi)]
    mid = (blo + bhi) // 2
    return [column(alo, ahi, mid, bhi), column(alo, ahi, blo, mid)]


def level(distinct: DataFrame, leaves: int = LEAVES) -> int:
    """Trie level at which a node has about ``leaves`` fingerprints, and none has many times that, down to DEEPEST."""
    deep = materialize(distinct.groupBy(F.shiftrightunsigned("fp", BITS - DEEPEST).alias("p")).agg(F.count("*").alias("n")), "prefixes")
    n = deep.agg(F.sum("n")).first()[0] or 0
    at = min(DEEPEST, max(0, math.ceil(math.log2(max(n, 1) / leaves))))
    while n and at < DEEPEST and deep.groupBy(F.shiftrightunsigned("p", DEEPEST - at)).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > 8 * leaves:
        at += 1
    return at


def links(distinct: DataFrame, budget: int = 2, leaves: int = LEAVES) -> DataFrame:
    """(a, b) with the same components as all pairs of (fp, rep) within budget differing bits, as stars within each pair of subtrees.

    distinct has each fp once. A row is copied to every pair of prefixes within the budget, of its level's length; what a
    task holds is one pair of nodes.
    """
    depth = level(distinct, leaves)
    masks = [sum(1 << b for b in bits) for k in range(budget + 1) for bits in combinations(range(depth), min(k, depth)) if k <= depth]
    own = F.shiftrightunsigned("fp", BITS - depth) if depth else F.lit(0).cast("long")
    rows = distinct.select("fp", "rep", own.alias("own"), F.explode(F.array(*(F.lit(m).cast("long") for m in sorted(set(masks))))).alias("mask"))
    other = F.col("own").bitwiseXOR(F.col("mask"))
    rows = rows.select("fp", "rep", F.least("own", other).alias("p"), F.greatest("own", other).alias("q"), (F.col("own") > other).alias("second"))

    def subtrees(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = int(pdf.p.iloc[0]), int(pdf.q.iloc[0])
        fp, second = pdf.fp.to_numpy(np.int64).view(np.uint64), pdf.second.to_numpy(bool)
        order = np.lexsort((fp, second))
        rep, half = pdf.rep.to_numpy(np.int64)[order], int(len(fp) - second.sum())
        if p != q and half in (0, len(fp)):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        fp = fp[order]
        of = traverse(fp, half, depth, (p ^ q).bit_count(), budget, BITS, lambda i, j: distance(fp[i], fp[j]) <= budget)
        moved = of != np.arange(len(of))
        return pd.DataFrame({"a": rep[moved], "b": rep[of[moved]]})

    return rows.groupBy("p", "q").applyInPandas(subtrees, "a long, b long")


def look_up(rows: DataFrame, table: DataFrame, key: str, sizes: DataFrame, share: int = HOT_SHARE) -> DataFrame:
    """rows with the columns of table that has the same key, which is unique there; sizes has each key's number of rows in n.

    Frequent keys, at most ``share`` of them, are sent to every task, so their rows are not shuffled into one.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = materialize(sizes.where(F.col("n") > max(HOT, total / share)).select(F.col(key).alias("hot_key")), "hot")
    own = table.withColumnRenamed(key, "own_key")
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    few = own.join(F.broadcast(hot), F.col("own_key") == F.col("hot_key"), "left_semi")
    often = marked.where("hot_key IS NOT NULL").join(F.broadcast(few), F.col(key) == F.col("own_key"), "left")
    seldom = marked.where("hot_key IS NULL").join(own, F.col(key) == F.col("own_key"), "left")
    return often.unionByName(seldom).drop("hot_key", "own_key")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(id, fp, component_id) per row: component_id is the smallest id that links of at most budget differing bits reach.

    Ids should be unique; rows that share one share its smallest component of all (each row is still returned). Rows with
    a null id keep their fingerprint and have a null component unless others share it. Texts without words have fingerprint 0 and are
    linked like any other. An empty table gives none.
    """
    found = materialize(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    sizes = materialize(found.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "distinct")
    distinct = sizes.where("rep IS NOT NULL").select("fp", "rep")
    roots = components(links(distinct, budget))
    classes = materialize(distinct.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "classes")
    return look_up(found, classes, "fp", sizes).select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "fp", "component_id")


# For similarity rather than a fixed few bits, wide fingerprints are looked up in several tries, each over bits of its own.
# That only proposes classes; the sets of shingles decide within each.
#: Bytes of a wide fingerprint; bits of it that two proposed documents may differ in. At a Jaccard similarity of 0.8 of their
#: sets of shingles, texts differ in 38.8 bits on average with a deviation of 5.7, so this is four deviations more.
WIDE, WIDE_BUDGET = 32, 62
MEAN_BITS, DEVIATION = 38.8, 5.7
#: Bits of a trie below its first levels that are traversed, and how many of these may differ.
PREFIX, PREFIX_BUDGET = 20, 3
#: Share of the pairs at a similarity of exactly 0.8 that the tries have to propose in expectation.
RECALL = 0.998
#: Fingerprints below a node of the last of the first levels; above CROWDED times that, a node's are laid out by more levels.
WIDE_LEAVES, CROWDED, MORE = 1 << 16, 4, 6
#: Two texts are near copies from this Jaccard similarity of their sets of shingles on, as a fraction.
SIMILAR = (4, 5)
#: Shingle hashes in a block of a proposed class, about (32 MB); a task compares two blocks.
SET_BLOCK = 1 << 22
#: Sets in it, at most about, and places of sets or rows that are sent to every task at most (some 60 bytes each).
SETS, SENT_PLACES = 1024, 500_000


#: A table of bits says which texts are to be looked at: BITS_A_TEXT for each, ID_BITS at least and MOST_BITS at most (512 MB). Texts that share a bit with one are looked at in vain.
ID_BITS, BITS_A_TEXT, MOST_BITS = 1 << 26, 16, 1 << 32
#: Bits in a piece of it, as Spark's bitmap functions have them.
PIECE_BITS = 8 * 4096
#: Classes whose first set of shingles is sent to every task, at most.
SENT_SETS = 1000


def bits_needed(n: int) -> int:
    """Bits of a table for n texts, a power of two."""
    return min(max(ID_BITS, 1 << (BITS_A_TEXT * n).bit_length()), MOST_BITS)


def id_slot(*columns: str, bits: int | None = None) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits or ID_BITS))


def id_bits(ids: DataFrame, *columns: str, bits: int | None = None) -> np.ndarray:
    """A table with the bits of all ids set, least bit first."""
    slot = id_slot(*columns, bits=bits) + 1
    pieces = ids.select(F.bitmap_bucket_number(slot).alias("piece"), F.bitmap_bit_position(slot).alias("at")).groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros((bits or ID_BITS) // 8, np.uint8)
    # At most as many rows as there are pieces.
    for r in pieces.toLocalIterator():
        at = (r["piece"] - 1) * PIECE_BITS // 8
        out[at : at + PIECE_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted different XXH64 hashes of the word shingles, with words as in fingerprint. Empty without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """Bit i is set if it is in over half of the hashes of a set, each drawn out to WIDE bytes."""
    counts = np.zeros(8 * WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        x = hashes[at : at + (1 << 14), None] + np.arange(1, WIDE // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        counts += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def trie_bits(t: int) -> np.ndarray:
    """The bits of a wide fingerprint that trie t is over, in order."""
    return np.random.default_rng(t).permutation(8 * WIDE)[:BITS]


def tries_needed(depth: int) -> int:
    """Tries that propose RECALL of the pairs at a similarity of 0.8, if the first depth bits of each have to be equal."""
    z = np.linspace(-4, 4, 161)
    weight = np.exp(-z * z / 2)
    off = np.clip((MEAN_BITS + DEVIATION * z) / (8 * WIDE), 0, 1)
    one = (1 - off) ** depth * sum(math.comb(PREFIX, k) * off**k * (1 - off) ** (PREFIX - k) for k in range(PREFIX_BUDGET + 1))
    n = 1
    while (weight * (1 - (1 - one) ** n)).sum() < RECALL * weight.sum():
        n += 1
    return n


def wide_links(distinct: DataFrame, leaves: int = WIDE_LEAVES) -> DataFrame:
    """(a, b) with the components of all pairs of (fp, rep) that one of the tries brings together and that differ in at most WIDE_BUDGET bits.

    The first levels of a trie are as many as give nodes of about leaves fingerprints; each node is a task's work, its
    leaves the pairs' both sides. More levels bring fewer pairs together, so there are more tries: as often as the number
    of fingerprints doubles, by about 1.2 to 1.3 times, and the work grows with both. The fingerprints of crowded nodes
    (of many near copies) go to nodes of further levels; those that agree in all bits of a trie are linked as they are.
    """
    depth = max(0, math.ceil(math.log2(max(distinct.count(), 1) / leaves)))
    tries = tries_needed(depth)
    out = pa.schema([("t", pa.int32()), ("key", pa.int64()), ("fp", pa.binary()), ("rep", pa.int64())])

    def keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, WIDE), axis=1)
            for t in range(tries):
                key = np.ascontiguousarray(np.packbits(bits[:, trie_bits(t)], axis=1)).view(">u8").ravel().astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), t, np.int32)), pa.array(key), b.column(0), b.column(1)], schema=out)

    todo, ready, links = distinct.select("fp", "rep").mapInArrow(keys, "t int, key long, fp binary, rep long"), [], []
    node = lambda d: F.shiftrightunsigned("key", BITS - d) if d else F.lit(0).cast("long")
    while True:
        here = todo.withColumn("depth", F.lit(depth)).withColumn("node", node(depth))
        full = here.groupBy("t", "node").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where(F.col("n") > CROWDED * leaves)
        # At most one for each CROWDED * leaves rows.
        full = materialize(full.select(F.col("t").alias("t_"), F.col("node").alias("node_"), "least"), "crowded")
        if full.isEmpty():
            ready.append(here)
            break
        same = (F.col("t") == F.col("t_")) & (F.col("node") == F.col("node_"))
        ready.append(here.join(F.broadcast(full), same, "left_anti"))
        todo = here.join(F.broadcast(full), same)
        if depth == BITS:
            links.append(todo.where("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
            break
        todo, depth = todo.select("t", "key", "fp", "rep"), min(BITS, depth + MORE)
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)

    def subtree(pdf: pd.DataFrame) -> pd.DataFrame:
        depth = int(pdf.depth.iloc[0])
        key = pdf.key.to_numpy(np.int64).view(np.uint64)
        order = np.argsort(key)
        key, rep = key[order], pdf.rep.to_numpy(np.int64)[order]
        full = np.frombuffer(b"".join(pdf.fp), np.uint64).reshape(-1, WIDE // 8)[order]
        near = lambda i, j: distance(full[i], full[j]).sum(axis=1) <= WIDE_BUDGET
        of = traverse(key, len(key), depth, 0, PREFIX_BUDGET, min(BITS, depth + PREFIX), near)
        moved = of != np.arange(len(of))
        return pd.DataFrame({"a": rep[moved], "b": rep[of[moved]]})

    found = rows.groupBy("t", "depth", "node").applyInPandas(subtree, "a long, b long")
    for more in links:
        found = found.unionByName(more)
    return found


def same_classes(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the position of the first of its class: what links of SIMILAR or more reach. Every pair that could join two classes is compared."""
    up, down = SIMILAR
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    vocabulary, word = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    start, held = np.cumsum(size) - size, np.zeros(len(vocabulary), bool)
    of, free = np.full(len(sets), -1), np.arange(len(sets))
    while len(free):
        first, todo, free = int(free[0]), [int(free[0])], free[1:]
        of[first] = first
        while todo and len(free):
            x = todo.pop()
            # Sets of too different sizes can't be similar.
            near = (down * np.minimum(size[free], size[x]) >= up * np.maximum(size[free], size[x])).nonzero()[0]
            other = free[near]
            n, own = size[other], word[start[x] : start[x] + size[x]]
            held[own] = True
            at = np.arange(n.sum()) + np.repeat(start[other] - (np.cumsum(n) - n), n)
            sums = np.append(0, np.cumsum(held[word[at]]))
            held[own] = False
            shared = sums[np.cumsum(n)] - sums[np.cumsum(n) - n]
            linked = (up + down) * shared >= up * (n + size[x])
            of[other[linked]] = first
            todo += other[linked].tolist()
            free = np.delete(free, near[linked])
    return of


def _beside(df: DataFrame, fn: Callable[..., dict[str, list]], kinds: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """df's columns but text beside what fn makes of the texts; fn returns the rows that stay under "row"."""
    keep = [c for c in df.columns if c != "text"]
    bounded_batches(df.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            made = fn(b)
            own = [b.column(c).take(pa.array(made["row"], pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(made[k], t) for k, (_, t) in kinds.items())], names=[*keep, *kinds])

    schema = ", ".join([*(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{k} {t}" for k, (t, _) in kinds.items())])
    return df.mapInArrow(batches, schema)


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of SIMILAR or more; empty ones have with each other."""
    up, down = SIMILAR
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return down * shared >= up * (len(a) + len(b) - shared)


def _links_in_classes(held: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b): links that join what is similar in each class of sets (rep, class, blocks, hashes); sizes: (class, n, blocks).

    In a large class, one of SENT_SETS at most, each set is compared with the class's first one where it lies. Those that
    aren't similar to it are compared with all of the class, block by block; those that are need no comparison with each
    other. So a family of near copies takes work in proportion to its size. Of other classes, all pairs of blocks meet.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = materialize(sizes.where(F.col("n") > max(HOT, total / SENT_SETS)).select(F.col("class").alias("hot_class")), "hot")
    large = held.join(F.broadcast(hot), F.col("class") == F.col("hot_class"), "left_semi")
    other = held.join(F.broadcast(hot), F.col("class") == F.col("hot_class"), "left_anti")
    firsts = large.groupBy(F.col("class").alias("c")).agg(F.min_by("hashes", "rep").alias("first_hashes"), F.min("rep").alias("first"))

    def judge(b: pa.RecordBatch) -> dict[str, list]:
        pairs = zip(b.column("hashes").to_pylist(), b.column("first_hashes").to_pylist(), strict=True)
        return {"row": list(range(b.num_rows)), "linked": [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in pairs]}

    both = large.join(F.broadcast(materialize(firsts, "firsts")), F.col("class") == F.col("c")).drop("c")
    judged = materialize(_beside(both, judge, {"linked": ("boolean", pa.bool_())}).drop("first_hashes"), "judged")
    free = judged.where("NOT linked").groupBy(F.col("class").alias("c")).agg(_blocks(F.sum(F.octet_length("hashes") / 8), F.count("*")).alias("free_blocks"))
    rest = judged.join(F.broadcast(free), F.col("class") == F.col("c"))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    at = lambda p, q: F.struct(p.cast("long").alias("p"), q.cast("long").alias("q"))
    # A block of what is left meets each block of all; a block of a class without a first set, each one from its own on.
    everywhere = F.transform(upto("free_blocks"), lambda k: at(k, block("blocks")))
    places = F.when(F.col("linked"), everywhere).otherwise(F.array_union(everywhere, F.transform(upto("blocks"), lambda k: at(block("free_blocks"), k))))
    pairs = F.transform(upto("blocks"), lambda k: at(F.least(block("blocks"), k), F.greatest(block("blocks"), k)))

    def exact(pdf: pd.DataFrame) -> pd.DataFrame:
        rep, of = pdf.rep.to_numpy(np.int64), same_classes([np.frombuffer(x, np.uint64) for x in pdf.hashes])
        moved = of != np.arange(len(of))
        return pd.DataFrame({"a": rep[moved], "b": rep[of[moved]]})

    rows = rest.select("rep", "class", "hashes", F.explode(places).alias("at")).unionByName(other.select("rep", "class", "hashes", F.explode(pairs).alias("at")))
    more = rows.groupBy("class", "at.p", "at.q").applyInPandas(exact, "a long, b long")
    return judged.where("linked AND rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b")).unionByName(more)


def _blocks(hashes: Column, sets: Column) -> Column:
    """Blocks of about SET_BLOCK hashes and SETS sets at most."""
    return F.greatest(F.ceil(hashes / SET_BLOCK), F.ceil(sets / SETS), F.lit(1)).cast("long")


def classes_of_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, th, root, first_id, first_th) per row: th is the text's hash, root stands for a class of similar texts, and (first_id, first_th) is its first row.

    The first row is that with the smallest id, null ones last, and of those that with the smallest th. Links of wide
    fingerprints propose classes; within each, sets of shingles are compared exactly, so nothing is linked below SIMILAR.
    Null counts as empty; texts without words are one class. Ids can be of any type, repeated and null.
    """

    def cut(b: pa.RecordBatch) -> dict[str, list]:
        sets = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
        return {"row": list(range(len(sets))), "fp": [wide_fingerprint(x) for x in sets], "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "n": [len(x) for x in sets]}

    def members(b: pa.RecordBatch) -> dict[str, list]:
        bits = shared.value
        rows = [k for k, slot in enumerate(b.column("slot").to_pylist()) if bits[slot >> 3] >> (slot & 7) & 1]
        # Of rows that are repeated in a task, one will do.
        rows = [k for k in rows if (key := (b.column("id")[k].as_py(), b.column("th")[k].as_py())) not in seen and not seen.add(key)]
        sets = [shingle_set(b.column("text")[k].as_py(), shingle) for k in rows]
        return {"row": rows, "own": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "hashes": [x.tobytes() for x in sets]}

    # Each task has its own.
    seen: set[tuple] = set()
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    made = _beside(texts, cut, {"fp": ("binary", pa.binary()), "digest": ("binary", pa.binary()), "n": ("long", pa.int64())})
    # Rows are numbered once, as they are written.
    found = materialize(made.withColumn("at", F.monotonically_increasing_id()), "wide")
    # Equal sets are one, for which one row stands.
    one = F.min(F.struct("at", "id", "th")).alias("one")
    sets = materialize(found.groupBy("digest").agg(one, F.first("fp").alias("fp"), F.first("n").alias("n"), F.count("*").alias("rows")).withColumn("rep", F.col("one.at")), "sets")
    distinct = materialize(sets.groupBy(F.col("fp").alias("fp_")).agg(F.min("rep").alias("rep_")), "distinct")
    proposed = components(wide_links(distinct.select(F.col("fp_").alias("fp"), F.col("rep_").alias("rep"))))
    proposed = distinct.join(proposed, F.col("rep_") == F.col("node"), "left").select("fp_", F.coalesce("root", "rep_").alias("class"))
    proposed = materialize(sets.join(proposed, F.col("fp") == F.col("fp_")).select("digest", "rep", F.col("one.id").alias("rep_id"), F.col("one.th").alias("rep_th"), "n", "class"), "proposed")
    sizes = materialize(proposed.groupBy("class").agg(_blocks(F.sum("n"), F.count("*")).alias("blocks"), F.count("*").alias("n")).where("n > 1"), "sizes")
    several = look_up(proposed.select("digest", "rep", "rep_id", "rep_th", "class"), sizes.select("class", "blocks"), "class", sizes.select("class", "n")).where("blocks IS NOT NULL")
    several = materialize(several, "several")
    # Only texts that may be in such a class are cut into shingles once more, and no text is shuffled.
    places = several.count()
    bits = bits_needed(places)
    shared = df.sparkSession.sparkContext.broadcast(id_bits(several, "rep_id", "rep_th", bits=bits))
    held = _beside(texts.withColumn("slot", id_slot("id", "th", bits=bits)), members, {"own": ("binary", pa.binary()), "hashes": ("binary", pa.binary())})
    held = held.join(F.broadcast(several) if places <= SENT_PLACES else several, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th")) & (F.col("own") == F.col("digest")))
    held = materialize(held.select("rep", "class", "blocks", "hashes"), "members")
    roots = components(_links_in_classes(held, sizes))
    classes = materialize(proposed.join(roots, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("root")), "classes")
    rows = sets.select("digest", F.col("rows").alias("n"))
    each = materialize(look_up(found.select("id", "th", "digest"), classes, "digest", rows).select("id", "th", "root"), "each")
    firsts = materialize(each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("f"), F.count("*").alias("n")), "firsts")
    return look_up(each, firsts.select("root", F.col("f.id").alias("first_id"), F.col("f.th").alias("first_th")), "root", firsts.select("root", "n"))


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, component_id) per distinct id, null left out: component_id is the smallest id of the classes that its texts are in."""
    each = classes_of_rows(df, id_col, text_col, shingle).where("id IS NOT NULL")
    return each.groupBy(F.col("id").alias(id_col)).agg(F.min("first_id").alias("component_id"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """df with one row of each class of similar texts: that with the smallest id, null ones last; if it has several texts of the class, one of them, and if it is repeated, one of the repetitions.

    What counts is the row's text: an id with texts in several classes can stay with some of them. All columns are kept as
    they are, whatever their names. An empty table gives an empty one.
    """
    each = materialize(classes_of_rows(df, id_col, text_col, shingle), "rows")
    first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("th") == F.col("first_th"))
    named = lambda rows: rows.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th"))
    gone = materialize(named(each.where(~first).select("id", "th").distinct()), "gone")
    # Few are sent to every task, so no text is shuffled; more of them meet the texts by their hashes.
    gone = F.broadcast(gone) if gone.count() <= SENT_PLACES else gone
    again = materialize(named(each.where(first).groupBy("id", "th").count().where("count > 1")), "again")
    same = lambda left, right: left[id_col].eqNullSafe(right["gone_id"]) & (F.xxhash64(left[text_col]) == right["gone_th"])
    kept = df.join(gone, same(df, gone), "left_anti")
    if again.isEmpty():
        return kept
    # Repetitions are merged before they are shuffled.
    return kept.join(again, same(kept, again), "left_anti").union(kept.join(again, same(kept, again), "left_semi").dropDuplicates([id_col, text_col]))


def iter_pairs(fp: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """All pairs within the budget one by one, for tests."""
    for i in range(len(fp)):
        for j in np.flatnonzero(distance(fp[i + 1 :], fp[i]) <= budget) + i + 1:
            yield i, int(j)
