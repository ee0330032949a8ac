"""Substring removal: words in a passage of so many words that also starts elsewhere go.

Suffix automata of reference shards give matching statistics: a text is streamed through an automaton, which says after
each word how long a passage ending there the shard holds, and how often. Sending the automata of a whole corpus to all
of its texts would take work in proportion to its square, so a shard goes only to texts that can match it:

- The least hash among the short word groups of a window is its anchor; equal windows have equal anchors. Windows whose
  anchor occurs once in the corpus match nothing and go no further.
- A stretch of windows with one anchor, a piece, is sent to the shard of its anchor. Each task builds the automata of its
  shards, of bounded size, and streams their pieces through them.
- Windows of anchors that very many texts hold are told apart by their own hashes. Those of them that are frequent,
  bounded in number, make the one automaton that is broadcast, and whole texts are streamed through it where they lie.

Hashes decide what meets; words decide what matches. Equal texts are one to all of this: each but the shortest is removed.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bounded_batches, materialize

LEAST = 35
#: Occurrences of an anchor from which its windows are told apart, and words of an automaton, but for what one window adds.
CROWDED, SHARD_WORDS = 4096, 60_000
#: Anchors that are sent to every task at most (8 bytes each); more of them meet the texts by a join. Crowded anchors and
#: frequent windows at most: what is above its share of all occurrences can't be more than that.
SENT, MOST_CROWDED, MOST_FREQUENT = 4_000_000, 4_000_000, 10_000
#: Bytes of removals, about, that are sent to every task; more of them are joined.
SENT_BYTES = 64 << 20
_BASE = 0x9E3779B97F4A7C15
#: Bytes whose words are hashed at once, and bytes of texts that are looked at together.
BLOCK, TOGETHER = 1 << 19, 1 << 20
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class _Powers:
    """Powers of an odd base modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int) -> None:
        self.base, self.held = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            p = np.full(2 * n, self.base, np.uint64)
            p[:1] = 1
            self.held = np.cumprod(p, dtype=np.uint64)
        return self.held[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(pow(_BASE, -1, 1 << 64))


def group_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, by running sums of a polynomial modulo 2**64."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _UP.upto(len(h)), out=total[1:])
    return _mixed((total[size:] - total[:-size]) * _DOWN.upto(len(h) - size + 1))


def sliding(take: np.ufunc, g: np.ndarray, width: int) -> np.ndarray:
    """Least or largest of each width values in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        g = take(g[: len(g) - step], g[step:])
        done += step
    return g


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of all words, worked out over BLOCK bytes at once; a word goes to the block in which it starts."""
    raw = np.frombuffer(text, np.uint8)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(raw):
        stop = min(at + BLOCK, len(raw))
        while stop < len(raw) and not (more := _BLANK[raw[stop : stop + BLOCK]]).any():
            stop = min(stop + BLOCK, len(raw))
        if stop < len(raw):
            stop += int(more.argmax())
        part = raw[at:stop]
        edge = np.diff(_BLANK[part].view(np.int8), prepend=1, append=1)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * _UP.upto(len(part)), out=total[1:])
        parts.append((start + at, end + at, _mixed((total[end] - total[start]) * _DOWN.upto(len(part) + 1)[start])))
        at = stop
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(map(np.concatenate, zip(*parts, strict=True)))  # type: ignore[return-value]


class Windows:
    """All windows of least words of several texts at once.

    bytes: the texts with a blank after each; start, end: of the words in them; first: the first word of each text, and
    one more; text: the text of each window; group: hashes of short word groups; anchor: the least of them in each window;
    whole: whether a window lies within one text.
    """

    def __init__(self, texts: list[bytes], least: int) -> None:
        self.least, size = least, max(1, least // 3)
        self.bytes = b" ".join([*texts, b""])
        self.start, self.end, self.hash = _words(self.bytes)
        ends = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, ends)
        self.group = group_hashes(self.hash, size)
        self.width = least - size + 1
        self.anchor = sliding(np.minimum, self.group, self.width) if len(self.hash) >= least else self.group[:0]
        self.text = np.searchsorted(self.first, np.arange(len(self.anchor)), "right") - 1
        self.whole = np.arange(len(self.anchor)) + least <= self.first[self.text + 1]

    def own(self) -> np.ndarray:
        """A hash of all words of each window."""
        return group_hashes(self.hash, self.least)

    def keys(self, crowded: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(key, text): anchors, or, given the crowded anchors, the hashes of their windows; each as often as it occurs."""
        if not len(self.anchor):
            return self.group[:0], self.text
        if crowded is not None:
            pick = self.whole & held_in(self.anchor, crowded)
            return self.own()[pick], self.text[pick]
        # No window that covers a group has a larger anchor than the group's hash; where one has as large a one, the group is an anchor.
        around = np.zeros(self.width - 1, np.uint64)
        largest = sliding(np.maximum, np.concatenate([around, np.where(self.whole, self.anchor, np.uint64(0)), around]), self.width)
        at = np.flatnonzero(self.group == largest)
        return self.group[at], np.searchsorted(self.first, at, "right") - 1

    def pieces(self, good: np.ndarray, single: bool) -> Iterator[tuple[int, int, int, bytes]]:
        """(window, text, place in it, bytes) of the stretches of good windows with one anchor, or of single good windows."""
        if single:
            first = last = np.flatnonzero(good)
        else:
            turn = np.flatnonzero((self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1]) | (good[1:] != good[:-1])) + 1
            first, last = np.append(0, turn), np.append(turn, len(good)) - 1
            first, last = first[good[first]], last[good[first]]
        text = self.text[first]
        for w, t, at, a, b in zip(first.tolist(), text.tolist(), (first - self.first[text]).tolist(), self.start[first].tolist(), self.end[last + self.least - 1].tolist(), strict=True):
            yield w, t, at, self.bytes[a:b]


def several(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts (first one's number, texts) of about TOGETHER bytes, in order."""
    held, size = [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= TOGETHER or i + 1 == len(texts):
            yield i + 1 - len(held), held
            held, size = [], 0


def held_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is among ordered ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Automaton:
    """Suffix automaton of several word sequences, with the number of places where each state's passages end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = array("q", [-1]), array("q", [0]), array("q", [0])

    def _state(self, length: int, onward: dict[int, int], link: int) -> int:
        self.next.append(onward)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A state of its own for the shorter passages of target that come from state."""
        if self.length[target] == self.length[state] + 1:
            return target
        short = self._state(self.length[state] + 1, self.next[target].copy(), self.link[target])
        self.link[target] = short
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = short
            state = self.link[state]
        return short

    def add(self, words: list[int], times: int) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            known = nexts[last].get(w)
            if known is not None:
                last = self._split(last, w, known)
            else:
                new = self._state(length[last] + 1, {}, 0)
                at = last
                while at >= 0 and w not in nexts[at]:
                    nexts[at][w] = new
                    at = link[at]
                if at >= 0:
                    link[new] = self._split(at, w, nexts[at][w])
                last = new
            count[last] += times

    def close(self) -> Automaton:
        """Sum the counts up the links, longest first."""
        for s in np.argsort(-np.array(self.length), kind="stable").tolist():
            if self.link[s] >= 0:
                self.count[self.link[s]] += self.count[s]
        return self

    def repeats(self, words: list[int], least: int, times: int) -> list[int]:
        """Starts of the windows of least words that the automaton holds so many times or more."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        state, matched, out = 0, 0, []
        for i, w in enumerate(words):
            to = nexts[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nexts[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= least:
                # The state of the last least words, not of a longer match.
                while length[link[state]] >= least:
                    state = link[state]
                matched = least
                if count[state] >= times:
                    out.append(i - least + 1)
        return out


def joined(starts: list[int]) -> list[tuple[int, int]]:
    """Runs (first, last) of consecutive starts."""
    runs: list[tuple[int, int]] = []
    for s in starts:
        if runs and runs[-1][1] == s - 1:
            runs[-1] = (runs[-1][0], s)
        else:
            runs.append((s, s))
    return runs


def matched(pieces: list[list[bytes]], least: int) -> list[list[tuple[int, int]]]:
    """For each piece, the runs of its windows that occur twice or more among all; one automaton."""
    ids: dict[bytes, int] = {}
    numbered = [tuple(ids.setdefault(w, len(ids)) for w in p) for p in pieces]
    times: dict[tuple[int, ...], int] = {}
    for p in numbered:
        times[p] = times.get(p, 0) + 1
    automaton = Automaton()
    for p, n in times.items():
        automaton.add(list(p), n)
    automaton.close()
    runs = {p: joined(automaton.repeats(list(p), least, 2)) for p in times}
    return [runs[p] for p in numbered]


def within_shard(groups: list[list[bytes]], least: int, words: int = 4 * SHARD_WORDS) -> list[list[tuple[int, int]]]:
    """matched for the pieces of some keys; if one key has more words than an automaton takes, its windows are dealt by their hashes."""
    total = sum(map(len, groups))
    if total <= words:
        return matched(groups, least)
    windows = [(hash(tuple(p[s : s + least])), i, s) for i, p in enumerate(groups) for s in range(len(p) - least + 1)]
    shards: list[list[tuple[int, int]]] = [[] for _ in range(len(windows) * least // words + 1)]
    for h, i, s in windows:
        shards[h % len(shards)].append((i, s))
    found: list[list[int]] = [[] for _ in groups]
    for shard in shards:
        for (i, s), runs in zip(shard, matched([groups[i][s : s + least] for i, s in shard], least), strict=True):
            if runs:
                found[i].append(s)
    return [joined(sorted(f)) for f in found]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(tid, text, n) of the different texts, n rows each; nulls are empty. Copies are counted before they are shuffled."""
    own = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))
    return materialize(own.select(F.md5(F.col("text").cast("binary")).alias("tid"), F.col("text").cast("binary").alias("text"), "n"), "texts")


def _keys(texts: DataFrame, least: int, crowded: Broadcast | None, named: bool = False) -> DataFrame:
    """(key, n): anchors, or window hashes of crowded anchors, and how often they occur; with names (key, tid), the texts that hold them."""
    out = pa.schema([("key", pa.int64()), ("tid", pa.string()) if named else ("n", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            tids = b.column("tid").to_numpy(zero_copy_only=False)
            for at, held in several(b.column("text").to_pylist()):
                keys, text = Windows(held, least).keys(crowded and crowded.value)
                if named:
                    rows = np.unique(np.stack([keys, text.astype(np.uint64)], axis=1), axis=0)
                    keys, last = np.ascontiguousarray(rows[:, 0]), pa.array(tids[at + rows[:, 1].astype(np.int64)], pa.string())
                else:
                    keys, times = np.unique(keys, return_counts=True)
                    last = pa.array(times.astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), last], schema=out)

    return texts.select("tid", "text").mapInArrow(batches, "key long, tid string" if named else "key long, n long")


def _array(keys: DataFrame) -> np.ndarray:
    """Keys of a bounded table, ordered as unsigned numbers."""
    return np.sort(keys.select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def _with_keys(texts: DataFrame, repeated: DataFrame, least: int, crowded: Broadcast | None, top: int) -> DataFrame:
    """(tid, text, own): the texts that hold repeated keys, with those, by a join; keys above top go to every task."""
    rows = _keys(texts, least, crowded, named=True)
    hot = repeated.where(F.col("n") > top).select("key")
    rest = rows.join(F.broadcast(hot), "key", "left_anti").join(repeated.where(F.col("n") <= top).select("key"), "key", "left_semi")
    hits = rows.join(F.broadcast(hot), "key", "left_semi").unionByName(rest)
    own = hits.groupBy(F.col("tid").alias("t")).agg(F.collect_list("key").alias("own"))
    return texts.join(own, F.col("tid") == F.col("t")).select("tid", "text", "own")


def _pieces(texts: DataFrame, least: int, repeated: Broadcast | None, left: Broadcast | None, crowded: Broadcast | None) -> DataFrame:
    """(key, tid, at, words) of the windows with repeated keys: stretches of one anchor, or single windows of crowded anchors.

    repeated: the keys, or None where each text has its own; left: keys that stay out.
    """
    out = pa.schema([("key", pa.int64()), ("tid", pa.string()), ("at", pa.int32()), ("words", pa.binary())])
    bounded_batches(texts.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        for b in it:
            tids = b.column("tid").to_pylist()
            for at, part in several(b.column("text").to_pylist()):
                w = Windows(part, least)
                if not len(w.anchor):
                    continue
                keys, good = (w.own(), w.whole & held_in(w.anchor, crowded.value)) if crowded else (w.anchor, w.whole)
                if repeated:
                    good = good & held_in(keys, repeated.value)
                else:
                    # Each text with its own keys.
                    known = [np.sort(b.column("own")[at + k].values.to_numpy().view(np.uint64)) for k in range(len(part))]
                    edges = np.searchsorted(w.text, np.arange(len(part) + 1))
                    good = good & np.concatenate([held_in(keys[a:e], known[k]) for k, (a, e) in enumerate(pairwise(edges.tolist()))])
                if left:
                    good = good & ~held_in(keys, left.value)
                signed = keys.view(np.int64)
                for window, text, place, words in w.pieces(good, bool(crowded)):
                    rows.append((int(signed[window]), tids[at + text], place, words))
                    held += len(words) + 60
                    if held >= BATCH_BYTES:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return texts.mapInArrow(batches, "key long, tid string, at int, words binary")


def _in_shards(pieces: DataFrame, least: int) -> DataFrame:
    """(tid, first, last): runs of windows that occur twice or more among the pieces; those of one key meet in one task."""
    out = pa.schema([("tid", pa.string()), ("first", pa.int32()), ("last", pa.int32())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latest, places, held, size = None, [], [], 0

        def flush() -> pa.RecordBatch:
            rows = [(tid, at + first, at + last) for (tid, at), runs in zip(places, within_shard(held, least), strict=True) for first, last in runs]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(out)], schema=out)

        for b in it:
            for key, tid, at, words in zip(*(b.column(n).to_pylist() for n in ("key", "tid", "at", "words")), strict=True):
                if size >= SHARD_WORDS and key != latest:
                    yield flush()
                    places, held, size = [], [], 0
                latest = key
                places.append((tid, at))
                held.append(words.split())
                size += len(held[-1])
        if held:
            yield flush()

    return pieces.repartition("key").sortWithinPartitions("key").mapInArrow(batches, "tid string, first int, last int")


def _searched(texts: DataFrame, repeated: DataFrame, n: int, least: int, left: np.ndarray, crowded: Broadcast | None, top: int, sent: int) -> DataFrame:
    """Runs of repeated windows of the keys (key, n), but for those left out."""
    context = texts.sparkSession.sparkContext
    out = context.broadcast(left) if len(left) else None
    if n <= sent:
        return _in_shards(_pieces(texts.select("tid", "text"), least, context.broadcast(_array(repeated)), out, crowded), least)
    return _in_shards(_pieces(_with_keys(texts, repeated, least, crowded, top), least, None, out, crowded), least)


def _counted(keys: DataFrame, name: str, floor: int, most: int) -> tuple[DataFrame, int, int]:
    """Keys that occur twice or more, written; how many they are; and the number of occurrences above which there are at most ``most`` keys."""
    repeated = materialize(keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), name)
    n, total = repeated.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return repeated, n, max(floor, total // most)


def repeats(texts: DataFrame, least: int = LEAST, crowd: int = CROWDED, sent: int = SENT) -> tuple[DataFrame, list[bytes]]:
    """((tid, first, last) of the windows of the texts that occur twice or more, frequent windows' words that are not in it)."""
    bounded_batches(texts.sparkSession)
    context = texts.sparkSession.sparkContext
    repeated, n, cut = _counted(_keys(texts, least, None), "anchors", crowd, MOST_CROWDED)
    many = _array(repeated.where(F.col("n") > cut))
    runs = _searched(texts, repeated, n, least, many, None, cut, sent)
    if not len(many):
        return runs, []
    crowded = context.broadcast(many)
    repeated, n, cut = _counted(_keys(texts, least, crowded), "windows", crowd, MOST_FREQUENT)
    frequent = _array(repeated.where(F.col("n") > cut))
    runs = runs.unionByName(_searched(texts, repeated, n, least, frequent, crowded, cut, sent))
    if not len(frequent):
        return runs, []
    # One text of words for each frequent hash, or several if such a hash stands for several.
    held = _pieces(texts.select("tid", "text"), least, context.broadcast(frequent), None, crowded)
    blanks = F.regexp_replace(F.col("words").cast("string"), r"[\x20\x09-\x0D]+", " ")
    return runs, [r["words"].encode() for r in held.groupBy(blanks.alias("words")).count().where(F.col("count") > 1).collect()]


def without_repeats(texts: DataFrame, least: int = LEAST, crowd: int = CROWDED, sent: int = SENT, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """(tid, n_words, n_removed, kept) of different texts (tid, text, n)."""
    runs, frequent = repeats(texts, least, crowd, sent)
    spark = texts.sparkSession
    gone = materialize(runs.groupBy(F.col("tid").alias("t")).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("gone")), "gone")
    rows, spans = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    gone = F.broadcast(gone) if rows * 120 + spans * 16 <= sent_bytes else gone
    both = texts.join(gone, F.col("tid") == F.col("t"), "left").select("tid", "text", "n", F.col("gone.first").alias("first"), F.col("gone.last").alias("last"))
    out = pa.schema([("tid", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
    held = spark.sparkContext.broadcast(frequent)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        automaton = Automaton()
        for w in held.value:
            automaton.add([ids.setdefault(x, len(ids)) for x in w.split()], 1)
        for b in it:
            made = []
            for tid, text, n, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = text.split()
                drop = np.zeros(len(words) + 1, np.int64)
                if n > 1 and len(words) >= least:
                    drop[0] += 1
                else:
                    again = joined(automaton.repeats([ids.get(w, -1) for w in words], least, 0)) if ids else []
                    for s, e in [*zip(first or [], last or [], strict=True), *again]:
                        drop[s] += 1
                        drop[e + least] -= 1
                keep = np.cumsum(drop[:-1]) == 0
                kept = [words[k] for k in np.flatnonzero(keep).tolist()] if not keep.all() else words
                made.append((tid, len(words), len(words) - len(kept), b" ".join(kept)))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return both.mapInArrow(batches, "tid string, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def by_document(docs: DataFrame, texts: DataFrame, made: DataFrame) -> DataFrame:
    """(doc_id and made's columns but tid) of every document: made by its text; a text of very many rows is dealt over parts."""
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(CROWDED, total // MOST_FREQUENT)
    # At most MOST_FREQUENT rows.
    hot = materialize(texts.where(F.col("n") > share).select(F.col("tid").alias("t"), F.ceil(F.col("n") / share).cast("int").alias("parts")), "hot")
    dealt = lambda df: df.join(F.broadcast(hot), F.col("tid") == F.col("t"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("t")
    rows = docs.select("doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")).alias("tid"))
    rows = dealt(rows).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")
    spread = dealt(made).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return rows.join(spread, ["tid", "part"]).drop("tid", "part")


def remove_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of documents (doc_id, text).

    Words are runs of anything but blanks. A word goes if a window of ``least`` words that covers it has the same words as
    a window that starts anywhere else, in the same document or another one; all are judged on the input. What is left is
    joined by one blank. Null texts are empty. Repeated rows are copies of each other, whatever their ids, which can be of
    any type and null; one id and text on very many rows meet in one task. Other columns are dropped, whatever their
    names. An empty table gives no rows.
    """
    texts = distinct_texts(docs)
    return by_document(docs, texts, without_repeats(texts, least))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, w, unnest(range(1, len(w) - {LEAST} + 2)) AS i FROM d WHERE len(w) >= {LEAST}),
c AS (SELECT r, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + {LEAST} - 1], ' ')) AS n FROM s),
g AS (SELECT DISTINCT r, unnest(range(i, i + {LEAST})) AS j FROM c WHERE n > 1),
o AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT o.r, string_agg(w[o.j], ' ' ORDER BY o.j) AS kept, count(*) AS n FROM o LEFT JOIN g ON g.r = o.r AND g.j = o.j WHERE g.r IS NULL GROUP BY o.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.r = d.r
"""
