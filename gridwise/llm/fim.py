"""Fill-in-middle transformation: whole texts are cut in three at token ends, which a sparse index of checkpoints finds.

A token is a run of blanks with the run of other characters after it; blanks at the end are a token of their own. While
tokens are counted, block by block, every so many of them leave a checkpoint: how many tokens, bytes and code points came
before. A cut after k tokens starts at the last checkpoint before it and scans a few tokens further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
#: Tokens from a checkpoint to the next, and bytes that are scanned at once.
EVERY, BLOCK = 256, 1 << 18
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def token_ends(text: memoryview, start: int = 0, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ends, points) by block from a byte on: where tokens end, and how many code points begin from start up to each end."""
    size, points = len(text), 0
    for at in range(start, size, block):
        part = np.frombuffer(text[at : at + block], np.uint8)
        blank = _BLANK[part]
        after = np.append(blank[1:], at + block >= size or _BLANK[text[at + block]])
        ends = np.flatnonzero(~blank & after) + 1
        if at + block >= size and blank[-1]:
            ends = np.append(ends, len(part))
        begun = np.cumsum((part & 0xC0) != 0x80)
        yield ends + at, begun[ends - 1] + points
        points += int(begun[-1])


class Checkpoints:
    """tokens in all, and for every so many of them how many tokens, bytes and code points came before."""

    def __init__(self, text: memoryview, every: int = EVERY, block: int = BLOCK) -> None:
        self.text, self.block, self.tokens = text, block, 0
        units, places, points = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        for ends, begun in token_ends(text, 0, block):
            pick = np.arange(every - 1 - self.tokens % every, len(ends), every)
            units.append(self.tokens + pick + 1)
            places.append(ends[pick])
            points.append(begun[pick])
            self.tokens += len(ends)
        self.units, self.places, self.points = map(np.concatenate, (units, places, points))

    def cut(self, k: int) -> tuple[int, int]:
        """(byte, code point) after k tokens."""
        c = int(np.searchsorted(self.units, k, "right")) - 1
        place, point, left = int(self.places[c]), int(self.points[c]), k - int(self.units[c])
        if not left:
            return place, point
        for ends, begun in token_ends(self.text, place, min(self.block, 1 << 12)):
            if left <= len(ends):
                return int(ends[left - 1]), point + int(begun[left - 1])
            left -= len(ends)
        raise ValueError(f"{k} tokens of {self.tokens}")


def transformed(key: str, text: memoryview, rate: int, spm: int, seed: int, every: int = EVERY, block: int = BLOCK) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix and of the middle, output) of one text."""
    index = Checkpoints(text, every, block)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    h1, h2, h3, h4 = (int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))
    whole = bytes(text)
    if not whole or h3 % 100 >= rate or any(m in whole for m in _MARKS):
        return index.tokens, "plain", None, None, whole
    first, second = sorted((h1 % (index.tokens + 1), h2 % (index.tokens + 1)))
    (a, chars), (b, more) = index.cut(first), index.cut(second)
    p, s, m = _MARKS
    if h4 % 100 < spm:
        form, out = "spm", b"".join((s, whole[b:], p, whole[:a], m, whole[a:b]))
    else:
        form, out = "psm", b"".join((p, whole[:a], s, whole[b:], m, whole[a:b]))
    return index.tokens, form, chars, more - chars, out


_OUT = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.binary())])


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of documents (doc_id, text).

    Of a hundred documents, about ``rate`` are cut, and of a hundred of those about ``spm`` have their suffix first; both
    hang on the seed and doc_id only (of any type, as text; a null one is empty). Texts that are empty or null, or hold a
    mark, stay plain, with null prefix_chars and middle_chars. Repeated rows come out alike. Other columns are dropped,
    whatever their names. An empty table gives no rows. A text is held whole by its task, and the index is small beside it.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, keys, texts = b.columns
            made, held, at = [], 0, 0
            for i in range(b.num_rows):
                made.append(transformed(keys[i].as_py(), memoryview(texts[i].as_buffer()), rate, spm, seed))
                held += len(made[-1][-1])
                if held >= BATCH_BYTES or i + 1 == b.num_rows:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _OUT, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(made)), *columns], names=["doc_id", *_OUT.names])
                    made, held, at = [], 0, i + 1

    made = rows.mapInArrow(batches, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. Cut texts hold no mark, so the first one found is the right one."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def split(second: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + len(MIDDLE) + 1)

    (p, s, m), (s2, p2, m2) = split(SUFFIX), split(PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"
_H = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"
SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_TOKENS} AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, {_H.format(1)} % (len(u) + 1) AS a, {_H.format(9)} % (len(u) + 1) AS b, {_H.format(17)} % 100 AS c, {_H.format(25)} % 100 AS d FROM t),
p AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:n], '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
