"""Language identification by unigrams over pieces, with all segmentations summed.

Each language has a probability for each piece of a fixed public vocabulary. The forward algorithm adds up the
probabilities of all ways to cut a word into pieces; a text's likelihood is the product over its words. The piece
probabilities are learned by expectation maximisation: each round counts how often a piece is expected in the words of
a language, over all segmentations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Labelled documents that the model is fitted on at most, rounds of fitting.
TRAIN_DOCS, ROUNDS = 20_000, 3
#: No piece has a smaller probability than this.
FLOOR = 1e-8
#: Longer words go through slower passes that rescale, as plain products would get too small.
LONG = 30
#: Positions of a long word whose probabilities are held at once in learning; the others are worked out again.
WINDOW = 4096
#: Words whose likelihoods a worker remembers, and bytes of these.
MEMO, MEMO_BYTES = 400_000, 128 << 20
#: Words times languages that are worked on at once, about.
AT_ONCE = 1 << 14
WORD_START = "▁"


def load_pieces(path: str) -> list[str]:
    """The vocabulary's text pieces in order, without control and byte pieces; path as in bpe, or a full one."""
    import sentencepiece

    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Lattice:
    """All pieces in each of a list of words. A character that is no piece is the unknown one, the last of the vocabulary."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(self.ids)
        # What pieces begin with, by length: sorted hashes, and the number of the piece or -1 where it is only a beginning.
        begun = dict.fromkeys((p[:n] for p in pieces for n in range(1, len(p) + 1)), -1) | self.ids
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for n in range(1, max(map(len, pieces), default=0) + 1):
            own = [x for x in begun if len(x) == n]
            codes = self.codes("".join(own)).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = self.longer(h, codes[:, k])
            order = np.argsort(h)
            self.levels.append((h[order], np.array([begun[x] for x in own], np.int64)[order]))

    @staticmethod
    def codes(text: str) -> np.ndarray:
        """A 64-bit number for each character."""
        c = (np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return c ^ (c >> np.uint64(29))

    @staticmethod
    def longer(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Hash of strings with hash h and one more character."""
        h = (h ^ code) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))

    def edges(self, words: list[str]) -> np.ndarray:
        """Rows: word, start, end, piece; ordered by end, then word.

        All characters of all words at once: what starts at each grows by a character as long as a piece begins that way.
        """
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        codes = self.codes(WORD_START + WORD_START.join(words))
        word = np.repeat(np.arange(len(words)), size)
        start = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        room = size[word] - start
        at, h, out = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for n, (hashes, pieces) in enumerate(self.levels, 1):
            inside = room[at] >= n
            at = at[inside]
            h = self.longer(h[inside], codes[at + n - 1])
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            begun = hashes[k] == h
            piece = np.where(begun, pieces[k], -1)
            if n == 1:
                piece_or = np.where(piece < 0, self.unknown, piece)
                out.append(np.stack([word, start, start + 1, piece_or]))
            else:
                is_piece = piece >= 0
                p = at[is_piece]
                out.append(np.stack([word[p], start[p], start[p] + n, piece[is_piece]]))
            at, h = at[begun], h[begun]
            if not len(at):
                break
        e = np.concatenate(out, axis=1)
        return e[:, np.argsort(e[2] << 32 | e[0], kind="stable")]

    def forward(self, words: list[str], theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edges, alpha, lengths): alpha[w, i, l] is the probability of the first i characters of word w in language l."""
        e = self.edges(words)
        size = np.array([len(w) + 1 for w in words], np.int64)
        alpha = np.zeros((len(words), int(size.max()) + 1, theta.shape[1]))
        alpha[:, 0] = 1.0
        cuts = np.searchsorted(e[2], np.arange(1, alpha.shape[1] + 1))
        for end, (lo, hi) in enumerate(zip(cuts, [*cuts[1:], e.shape[1]], strict=True), 1):
            if lo < hi:
                w, a, _, piece = e[:, lo:hi]
                first = np.flatnonzero(np.diff(w, prepend=-1))
                alpha[w[first], end] = np.add.reduceat(alpha[w, a] * theta[piece], first, axis=0)
        return e, alpha, size

    def likelihood(self, words: list[str], theta: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability in each language (words x languages)."""
        out = np.empty((len(words), theta.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for at in range(0, len(short), some := portion(theta)):
            part = short[at : at + some]
            _, alpha, size = self.forward([words[i] for i in part], theta)
            out[part] = np.log(alpha[np.arange(len(part)), size])
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.long(w, theta)
        return out

    def long(self, word: str, theta: np.ndarray) -> np.ndarray:
        """The same for one long word, rescaled at each character."""
        text, scale = WORD_START + word, np.zeros(theta.shape[1])
        width = max(map(len, self.ids), default=1)
        rows = [np.ones(theta.shape[1])]  # of the last positions, all divided by the same scale
        for end in range(1, len(text) + 1):
            now, single = np.zeros(theta.shape[1]), False
            for n in range(1, min(width, end, len(rows)) + 1):
                if (piece := self.ids.get(text[end - n : end])) is not None:
                    now = now + rows[-n] * theta[piece]
                    single = single or n == 1
            if not single:
                now = now + rows[-1] * theta[self.unknown]
            scale += np.log(now)
            rows = [r / now for r in rows[-width:]] + [np.ones_like(now)]
        return scale

    def expected(self, words: list[str], counts: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces (pieces x languages) in words with these counts (words x languages)."""
        out = np.zeros_like(theta)
        for i, w in enumerate(words):
            if len(w) > LONG:
                self.expected_long(w, counts[i], theta, out)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        if not short:
            return out
        words, counts = [words[i] for i in short], counts[short]
        e, alpha, size = self.forward(words, theta)
        w, a, b, piece = e
        beta = np.zeros_like(alpha)
        rows = np.arange(len(words))
        beta[rows, size] = 1.0
        order = np.lexsort((w, a))
        we, ae, be, pe = e[:, order]
        cuts = np.searchsorted(ae, np.arange(alpha.shape[1] + 1))
        for start in range(alpha.shape[1] - 1, -1, -1):
            lo, hi = cuts[start], cuts[start + 1]
            if lo < hi:
                first = np.flatnonzero(np.diff(we[lo:hi], prepend=-1))
                beta[we[lo:hi][first], start] = np.add.reduceat(beta[we[lo:hi], be[lo:hi]] * theta[pe[lo:hi]], first, axis=0)
        whole = alpha[rows, size]
        share = alpha[w, a] * theta[piece] * beta[w, b] / whole[w] * counts[w]
        np.add.at(out, piece, share)
        return out

    def expected_long(self, word: str, count: np.ndarray, theta: np.ndarray, out: np.ndarray) -> None:
        """Add one long word's expected counts to out. Probabilities are logarithms, held for a WINDOW of positions at a time."""
        text, width = WORD_START + word, max(map(len, self.ids), default=1)
        size = len(text)

        def pieces(places: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
            """The other ends and the pieces of (start, end, other end)."""
            found = [(o, p) for a, b, o in places if (p := self.ids.get(text[a:b], self.unknown if b == a + 1 else None)) is not None]
            return np.array([o for o, _ in found]), np.array([p for _, p in found])

        def forward(lo: int, hi: int, before: np.ndarray) -> np.ndarray:
            """Positions lo - width to hi from those up to lo."""
            rows = np.concatenate([before, np.empty((hi - lo, theta.shape[1]))])
            for end in range(lo + 1, hi + 1):
                at, piece = pieces([(end - n, end, end - n) for n in range(1, min(width, end) + 1)])
                k, last = at - lo + width, end - 1 - lo + width
                rows[last + 1] = rows[last] + np.log((np.exp(rows[k] - rows[last]) * theta[piece]).sum(axis=0))
            return rows

        cuts = list(range(0, size, WINDOW))
        held = [np.zeros((width + 1, theta.shape[1]))]  # before each window
        for lo in cuts:
            rows = forward(lo, min(size, lo + WINDOW), held[-1])
            held.append(rows[-width - 1 :])
        whole, after = held.pop()[-1], np.zeros((width + 1, theta.shape[1]))
        for lo in reversed(cuts):
            hi = min(size, lo + WINDOW)
            alpha = forward(lo, hi, held.pop())[width:]
            beta = np.concatenate([np.empty((hi - lo, theta.shape[1])), after])
            for start in range(hi - 1, lo - 1, -1):
                at, piece = pieces([(start, start + n, start + n) for n in range(1, min(width, size - start) + 1)])
                k, last = at - lo, start + 1 - lo
                beta[start - lo] = beta[last] + np.log((np.exp(beta[k] - beta[last]) * theta[piece]).sum(axis=0))
                np.add.at(out, piece, np.exp(alpha[start - lo] + beta[k] - whole) * theta[piece] * count)
            after = beta[: width + 1]


def portion(theta: np.ndarray) -> int:
    """Words that are worked on at once."""
    return max(16, AT_ONCE // theta.shape[1])


def words_of(text: str) -> list[str]:
    return text.lower().split()


def word_counts(train: DataFrame, langs: list[str]) -> DataFrame:
    """(word, counts): how often each word occurs in texts of each language that has it, as an array of (lang, n)."""
    bounded_batches(train.sparkSession)
    at = {x: i for i, x in enumerate(langs)}
    out = pa.schema([("word", pa.string()), ("lang", pa.int32()), ("n", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for b in it:
            n: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = at[lang]
                n.update((w, k) for w in words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in n], pa.string()), pa.array([k for _, k in n], pa.int32()), pa.array(list(n.values()), pa.int64())], schema=out)

    rows = train.select("lang", "text").mapInArrow(batches, "word string, lang int, n long")
    return rows.groupBy("word", "lang").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))


class Model:
    """langs, piece probabilities (pieces + unknown) x langs, and log priors."""

    def __init__(self, langs: list[str], theta: np.ndarray, prior: np.ndarray, path: str):
        self.langs, self.theta, self.prior, self.path = langs, theta, prior, path


def fit(labelled: DataFrame, path: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Model | None:
    """Learn from rows with text and language; None if there are none.

    Fitted on at most train_docs rows, the first by a hash of their id; of rows that share an id the least by text and
    language, and none without an id. What reaches the driver is expected counts of the vocabulary's pieces in the
    languages of these rows, whatever the number of rows. Other columns don't matter, whatever their names.
    """
    spark = labelled.sparkSession
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    # Bounded by a parameter, so it can go to every task.
    chosen = rows.where("id IS NOT NULL").select("id", F.xxhash64("id").alias("h")).distinct().orderBy("h", "id").limit(train_docs)
    train = rows.join(F.broadcast(chosen.select("id")), "id", "left_semi").groupBy("id").agg(F.min(F.struct("text", "lang")).alias("row"))
    train = materialize(train.select("row.*"), "langid")
    per = train.groupBy("lang").count().orderBy("lang").collect()
    if not per:
        return None
    langs = [r["lang"] for r in per]
    prior = np.log(np.array([r["count"] for r in per], float) / sum(r["count"] for r in per))
    counts = materialize(word_counts(train, langs), "words")
    pieces = load_pieces(path)
    theta = np.full((len(pieces) + 1, len(langs)), 1.0 / (len(pieces) + 1))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, theta))

        def partial(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            pieces, theta = shared.value
            lattice, total = Lattice(pieces), np.zeros_like(theta)
            for pdf in it:
                for at in range(0, len(pdf), some := portion(theta)):
                    part = pdf.iloc[at : at + some]
                    counts = np.zeros((len(part), theta.shape[1]))
                    for i, c in enumerate(part.counts):
                        for x in c:
                            counts[i, x["lang"]] = x["n"]
                    total += lattice.expected(part.word.tolist(), counts, theta)
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece.astype(np.int32), "lang": lang.astype(np.int32), "n": total[piece, lang]})

        sums = counts.mapInPandas(partial, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        n = np.full_like(theta, 1e-3)
        n[sums.piece, sums.lang] += sums.n
        theta = np.maximum(n / n.sum(axis=0), FLOOR)
        shared.unpersist()
    return Model(langs, theta, prior, path)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) per row, from the text alone.

    score is the share of the predicted language in the likelihoods of all, weighted by the priors; ties go to the
    first language in order. A text that is null or has no letter is ``und`` with score 0, and so is every text if there is
    no model. Repeated rows stay; other columns are dropped. Long words count whole.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(None if model is None else (load_pieces(model.path), model.theta, model.prior, model.langs))
    out = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not None:
            pieces, theta, prior, langs = shared.value
            lattice, row, seen, most = Lattice(pieces), {}, np.empty((1 << 10, len(langs))), min(MEMO, MEMO_BYTES // (8 * len(langs)))
        for b in it:
            pred: list[str] = []
            score: list[float] = []
            texts = [words_of(t) if t is not None and any(map(str.isalpha, t)) else None for t in b.column(1).to_pylist()]
            if shared.value is not None:
                if len(row) > most:
                    row, seen = {}, np.empty((1 << 10, len(langs)))
                new = list({w for t in texts if t for w in t if w not in row})
                if new:
                    while len(seen) < len(row) + len(new):
                        seen = np.concatenate([seen, np.empty_like(seen)])
                    seen[len(row) : len(row) + len(new)] = lattice.likelihood(new, theta)
                    row |= dict(zip(new, range(len(row), len(row) + len(new)), strict=True))
            for t in texts:
                if t is None or shared.value is None:
                    pred.append("und")
                    score.append(0.0)
                    continue
                ll = prior + seen[np.fromiter(map(row.__getitem__, t), np.int64, len(t))].sum(axis=0)
                best = int(ll.argmax())
                pred.append(langs[best])
                score.append(round(float(1.0 / np.exp(ll - ll[best]).sum()), 6))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], schema=out)

    made = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, "id long, lang_pred string, score double")
    return made.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "lang_pred", "score")
