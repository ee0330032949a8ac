"""Byte-pair encoding as a streaming transducer, and an incremental decoder.

A merge list fixes, for each prefix of a piece of text, the last token of the prefix's encoding: the vocabulary token
that ends there and may follow the last token of the prefix before it. Two tokens may stand side by side if no merge
crosses their boundary before the merges inside them are done. The transducer keeps these last tokens for the most
recent positions only. A boundary that all paths from those positions run through can't move any more, so the tokens
up to it are emitted. How far the input can move a boundary is bounded by the merge list; ``Merges.lookahead`` is such
a bound, and memory is constant.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

#: Pieces whose tokens a worker remembers, and the longest such piece in characters.
MEMO, MEMO_CHARS = 300_000, 48
#: Token pairs whose compatibility a worker remembers.
PAIRS = 1_000_000
#: Characters that go through the splitter at a time.
WINDOW = 1 << 16

# The byte-level alphabet writes a byte as itself if it is printable Latin-1 and else as the next free
# character from 256 on; its splitter.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same classes within Latin-1, where the standard library's engine can run; words come first, as most pieces are.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
_SPLIT_LATIN = re.compile(rf" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_SPLIT_ANY = regex.compile(_SPLIT)


def split(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _SPLIT_ANY.findall(text)
    return _SPLIT_LATIN.findall(text)


def alphabet() -> dict[str, int]:
    spare = (b for b in range(256) if b not in set(_PRINTABLE))
    return {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(spare)}


class Merges:
    """A byte-level vocabulary with its merge list, from a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = alphabet()
        raw = lambda s: bytes(byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: raw(s) for s, i in vocab.items() if s not in self.special}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.ids: dict[bytes, int] = {raw(s): i for s, i in vocab.items() if s not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        #: When a token comes into being; single bytes are there from the start.
        self.born: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), r)
            if z not in self.parts:
                self.parts[z], self.born[z] = (x, y), r
        self.longest = max(len(b) for b in self.ids)
        self.little = {i: i.to_bytes(4, "little") for i in self.bytes}
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._pairs: dict[int, dict[int, bool]] = {}
        self._known = 0
        self.lookahead = self._lookahead()

    def _edge(self, t: int, side: int, memo: dict) -> list[tuple[int, float]]:
        """The tokens at one edge of t while it is put together, each with the rank of the merge that ends it."""
        if (out := memo.get(t)) is None:
            out, at, end = [], t, float("inf")
            while True:
                out.append((at, end))
                if at not in self.parts:
                    break
                end, at = self.born[at], self.parts[at][side]
            memo[t] = out
        return out

    def together(self, a: int, b: int) -> bool:
        """Whether a and b stay side by side: no merge of an edge of a with one of b comes while both are there.

        Of equal ranks the leftmost merge goes first, so one inside a comes before, and one inside b after.
        """
        left, rank, ok = self._edge(b, 0, self._left), self.rank, True
        for x, end in self._edge(a, 1, self._right):
            for y, until in left:
                if (r := rank.get((x, y))) is not None and r < end and r <= until:
                    ok = False
        if self._known >= PAIRS:
            self._known = 0
            for row in self._pairs.values():
                row.clear()
        self._known += 1
        self._pairs.setdefault(a, {})[b] = ok
        return ok

    def _lookahead(self) -> int:
        """Bytes after a boundary beyond which the input can't move it.

        A boundary moves only if a merge crosses it. Its right operand lies in the bytes after the boundary; whether that
        comes to be hangs on earlier merges that take up its right edge, whose right operands lie further on, and so
        forth with ever lower ranks. In rank order, reach[t] is the most bytes that such chains starting with left
        operand t take; the bound is the largest over all merges.
        """
        reach: dict[int, int] = {}
        most = 0
        for (a, b), _ in sorted(self.rank.items(), key=lambda x: x[1]):
            after = max((reach.get(x, 0) for x, _ in self._edge(b, 1, self._right)), default=0)
            takes = len(self.bytes[b]) + after
            reach[a] = max(reach.get(a, 0), takes)
            most = max(most, takes)
        return most

    def transducer(self) -> Transducer:
        return Transducer(self)


class Transducer:
    """Encodes one piece fed in parts; push and finish return the tokens that have become stable."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.enough = merges.lookahead + merges.longest
        self.reset()

    def reset(self) -> None:
        self.tail = b""  # the bytes after the last emitted token
        self.last: list[int] = [-1]  # of each position in tail, the token that ends there; before the first byte: the last emitted one
        self.step: list[int] = [0]
        self.lag = 0  # most bytes ever held back

    def push(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), 1024):
            self.tail += data[at : at + 1024]
            self._extend()
            if len(self.tail) > self.enough:
                out += self._stable()
        return out

    def _extend(self) -> None:
        """Work out the last token for each new position.

        Just one token that ends there may follow the last token of the text before it: a sequence whose neighbours all
        stay side by side is the encoding. Short ones are tried first.
        """
        get, pairs, together = self.m.ids.get, self.m._pairs, self.m.together
        tail, last, step = self.tail, self.last, self.step
        for end in range(len(last), len(tail) + 1):
            for at in range(end - 1, -1, -1):
                if (t := get(tail[at:end])) is not None:
                    before = last[at]
                    if before < 0:
                        break
                    row = pairs.get(before)
                    ok = None if row is None else row.get(t)
                    if ok or (ok is None and together(before, t)):
                        break
            last.append(t)
            step.append(end - at)

    def _stable(self) -> list[int]:
        """Emit up to the last boundary that the paths from all positions a later token can start at run through."""
        n = len(self.tail)
        live = set(range(max(0, n - self.m.longest + 1), n + 1))
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(far - self.step[far])
        cut = live.pop()
        self.lag = max(self.lag, n - cut)
        return self._emit(cut)

    def _emit(self, cut: int) -> list[int]:
        if cut == 0:
            return []
        out, at = [], cut
        while at > 0:
            out.append(self.last[at])
            at -= self.step[at]
        self.tail, self.last, self.step = self.tail[cut:], self.last[cut:], [0, *self.step[cut + 1 :]]
        return out[::-1]

    def finish(self) -> list[int]:
        out = self._emit(len(self.tail))
        self.reset()
        return out


class Encoder:
    """Encodes a text fed in parts of any size, with constant memory.

    The splitter runs over what is held; a piece counts once the text behind it can't change it. A run that outgrows a
    window goes to the transducer as it comes.
    """

    def __init__(self, merges: Merges, memo: dict[str, bytes] | None = None):
        self.m = merges
        self.memo = {} if memo is None else memo
        self.marks = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.mark_chars = max(map(len, merges.special), default=1)
        self.transducer = merges.transducer()
        self.runs = [regex.compile(c) for c in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")]
        self.held, self.run = "", None

    def _ids(self, tokens: list[int]) -> bytes:
        little = self.m.little
        return b"".join([little[t] for t in tokens])

    def _piece(self, piece: str) -> bytes:
        out = self._ids(self.transducer.push(piece.encode()) + self.transducer.finish())
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = out
        return out

    def _pieces(self, pieces: list[str]) -> bytes:
        memo = self.memo
        try:
            return b"".join([memo[p] for p in pieces])
        except KeyError:
            return b"".join([memo.get(p) or self._piece(p) for p in pieces])

    def _plain(self, text: str, end: bool) -> tuple[bytes, str]:
        """Tokens (as little-endian unsigned 32-bit integers) of what is settled in text, and the rest."""
        out = b""
        if self.run is not None:  # inside a run that has outgrown a window
            m = self.run.match(text)
            n = m.end() if m else 0
            space = self.run is self.runs[2]
            if n == len(text) and not end:
                keep = min(n, 1)
                out += self._ids(self.transducer.push(text[: n - keep].encode()))
                return out, text[n - keep :]
            take = n - 1 if space and n < len(text) else n  # the last blank before a word isn't the run's
            out += self._ids(self.transducer.push(text[:take].encode()) + self.transducer.finish())
            self.run, text = None, text[take:]
        pieces = split(text)
        if end:
            return out + self._pieces(pieces), ""
        # What follows can still change the last piece, and an apostrophe before it.
        rest = "".join(pieces[-2:])
        out += self._pieces(pieces[:-2])
        if len(rest) > WINDOW:
            if len(pieces) > 1 and len(pieces[-2]) > 2:
                out += self._pieces(pieces[-2:-1])
                rest = pieces[-1]
            if len(rest) > WINDOW and (run := next((r for r in self.runs if r.fullmatch(rest, 1)), None)):
                self.run = run
                out += self._ids(self.transducer.push(rest[:-1].encode()))
                rest = rest[-1]
        return out, rest

    def feed(self, text: str) -> Iterator[bytes]:
        for at in range(0, len(text), WINDOW):
            self.held += text[at : at + WINDOW]
            if self.marks:
                while m := self.marks.search(self.held):
                    before, _ = self._plain(self.held[: m.start()], True)
                    yield before + self.m.special[m[0]].to_bytes(4, "little")
                    self.held = self.held[m.end() :]
            # A mark may have begun at the end.
            keep = 0
            if self.marks:
                keep = next((n for n in range(min(self.mark_chars - 1, len(self.held)), 0, -1) if any(s.startswith(self.held[-n:]) for s in self.m.special)), 0)
            ready, tail = self.held[: len(self.held) - keep], self.held[len(self.held) - keep :]
            done, rest = self._plain(ready, False)
            self.held = rest + tail
            yield done

    def finish(self) -> bytes:
        done, _ = self._plain(self.held, True)
        self.held = ""
        return done


class Decoder:
    """Tokens to text, incrementally: a state machine holds the bytes of a character that isn't complete yet."""

    def __init__(self, merges: Merges):
        self.bytes = merges.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        table = self.bytes
        return self.state.decode(b"".join([table[t] for t in memoryview(ids).cast("I")]))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[str, tuple[Merges, dict[str, bytes]]] = {}


def load(path: str) -> tuple[Merges, dict[str, bytes]]:
    """The merges and the memo of this worker."""
    if path not in _LOADED:
        _LOADED[path] = (Merges(path), {})
    return _LOADED[path]


def _named(path: str) -> str:
    """path itself, or the place of a file of the installed public vocabularies."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def digests(df: DataFrame, path: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, n_chars, decoded_sha256): each whole text encoded and decoded again as a stream.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded text in UTF-8.
    A null text is empty and has no tokens. Repeated rows stay; other columns are dropped.
    """

    def rows(ids: list, texts: list) -> dict[str, list]:
        merges, memo = load(_named(path))
        made: dict[str, list] = {"id": ids, "n_tokens": [], "ids_sha256": [], "n_chars": [], "decoded_sha256": []}
        for t in texts:
            encoder, decoder = Encoder(merges, memo), Decoder(merges)
            n, chars, of_ids, of_text = 0, 0, hashlib.sha256(), hashlib.sha256()
            for part in encoder.feed(t or ""):
                n += len(part) // 4
                of_ids.update(part)
                text = decoder.feed(part)
                chars += len(text)
                of_text.update(text.encode())
            part = encoder.finish()
            of_ids.update(part)
            text = decoder.feed(part) + decoder.finish()
            of_text.update(text.encode())
            made["n_tokens"].append(n + len(part) // 4)
            made["ids_sha256"].append(of_ids.hexdigest())
            made["n_chars"].append(chars + len(text))
            made["decoded_sha256"].append(of_text.hexdigest())
        return made

    out = map_columns(
        df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
        rows,
        "id long, n_tokens long, ids_sha256 string, n_chars long, decoded_sha256 string",
        pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("n_chars", pa.int64()), ("decoded_sha256", pa.string())]),
    )
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_tokens", "ids_sha256", "n_chars", "decoded_sha256")


def encode(df: DataFrame, path: str = "byte_bpe_50k.json", text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """df with the token ids of text_col as an array; null for a null text. A column of that name is replaced."""
    from .common import bounded_batches

    bounded_batches(df.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        merges, memo = load(_named(path))

        def one(t: str | None) -> bytes:
            if t is None:
                return b""
            e = Encoder(merges, memo)
            return b"".join([*e.feed(t), e.finish()])

        made = [one(t.as_py()) for t in texts]
        ends = np.cumsum([0, *(len(x) // 4 for x in made)]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(made), "<u4").view("<i4"))
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=texts.is_null())

    return df.withColumn(out_col, ids(F.col(text_col)))


def decode(df: DataFrame, path: str = "byte_bpe_50k.json", ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of the ids in ids_col; null for null. Bytes that aren't UTF-8 become U+FFFD. A column of that name is replaced."""
    from .common import bounded_batches

    bounded_batches(df.sparkSession)

    @F.arrow_udf("string")
    def text(arrays: pa.Array) -> pa.Array:
        merges, _ = load(_named(path))

        def one(ids: pa.ListScalar) -> str | None:
            if not ids.is_valid:
                return None
            d = Decoder(merges)
            return d.feed(ids.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()) + d.finish()

        return pa.array(map(one, arrays), pa.string())

    return df.withColumn(out_col, text(F.col(ids_col)))
