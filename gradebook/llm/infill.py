"""Fill-in-middle: texts are cut in three and written as prefix, suffix and middle behind markers.

A cut falls between two units (code points, words or lines, by ``unit``), each drawn as a unit number.  Finding the byte
where unit number c starts would be a walk over the text; instead a text is divided into blocks of ``BLOCK`` bytes and two
Fenwick trees over the blocks hold how many units and how many code points start in each.  A cut descends the tree by binary
lifting: from the largest power of two down, it steps over a run of blocks as long as no more units start there than are
left to skip.  That gives the block of the cut and, from the second tree on the same way, the code points before it; the
boundary is then looked for in that block alone.  The trees of all texts of a piece are one flat array, so that the descent
is a handful of numpy steps for all texts together.

Units.  ``char``: code points.  ``word``: a run of ``[^\\x20\\x09-\\x0D]`` with the white space after it; white space before the first
word belongs to it.  ``line``: up to and including ``\\n``.

Defined results: a null text is an empty one.  An empty text, one that holds a marker, and the share of texts drawn so is
``plain``: the output is the text, and the counts of its parts are null.  A text is handled whole whatever its length.  Draws depend on the
seed and doc_id alone, so that equal ids are cut alike; a null doc_id is drawn as an empty one.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, documents_schema, pieces, text_bytes

BLOCK = 1024       # bytes of a text block
PLAIN_FROM = 90    # of 100: texts drawn from here on stay plain
SPM_BELOW = 20     # of 100: texts drawn below are written suffix first
P, S, M = "<P>", "<S>", "<M>"
UNITS = ("char", "word", "line")


# ------------------------------------------------------------------------------------------ units and trees

def char_starts(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80


def unit_starts(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """True at the first byte of each unit of texts that lie end to end."""
    if unit == "char":
        return char_starts(data)
    starts = np.zeros(len(data), bool)
    if unit == "line":
        starts[1:] = data[:-1] == 10
    else:
        gap = SPACE[data]
        starts[1:] = gap[:-1] & ~gap[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    if unit == "word" and len(first):
        # the unit of a text's first word starts with the text: a later start counts only behind a word of the same text
        words = np.concatenate([[0], np.cumsum(~SPACE[data])])
        text = np.searchsorted(offsets, np.arange(len(data)), side="right") - 1
        starts &= words[:-1] > words[offsets[text]]
    starts[first] = True
    return starts


class Blocks:
    """Fenwick trees over the blocks of many texts: ``units[base + i]`` and ``chars[base + i]``, i = 1 .. blocks of the text, hold
    what starts in the blocks (i - lowbit(i), i]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, block: int = BLOCK):
        self.offsets, self.block = offsets, block
        self.at_unit, self.at_char = unit_starts(data, offsets, unit), char_starts(data)
        self.n_blocks = -(-np.diff(offsets) // block)
        self.base = np.cumsum(self.n_blocks) - self.n_blocks - 1
        text = np.repeat(np.arange(len(offsets) - 1), self.n_blocks)
        self.i = np.arange(len(text)) - self.base[text]
        first = offsets[text] + (self.i - 1) * block
        self.units, self.n = self._tree(self.at_unit, first, text)
        self.chars, _ = self._tree(self.at_char, first, text)

    def _tree(self, flags: np.ndarray, first: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tree, total of each text) of the flags in each block."""
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(len(self.n_blocks), np.int64)
        run = np.concatenate([[0], np.cumsum(np.add.reduceat(flags.astype(np.int64), first))])
        place = np.arange(1, len(first) + 1)
        low = self.i & -self.i
        start = self.base + 1
        return run[place] - run[place - low], run[start + self.n_blocks] - run[start]

    def cut(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code points before it) at which unit number ``unit`` of each text starts; the text's end for its unit count."""
        left, chars, at = unit.astype(np.int64).copy(), np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64)
        step = 1 << int(self.n_blocks.max(initial=1)).bit_length()
        while step := step >> 1:
            inside = np.flatnonzero(at + step <= self.n_blocks)
            there = self.base[inside] + at[inside] + step
            go = self.units[there] <= left[inside]
            inside, there = inside[go], there[go]
            left[inside] -= self.units[there]
            chars[inside] += self.chars[there]
            at[inside] += step
        byte = np.minimum(self.offsets[:-1] + at * self.block, self.offsets[1:])
        for t in np.flatnonzero(at < self.n_blocks):
            a = byte[t]
            k = int(np.flatnonzero(self.at_unit[a:min(a + self.block, self.offsets[t + 1])])[left[t]])
            chars[t] += np.count_nonzero(self.at_char[a:a + k])
            byte[t] = a + k
        return byte, chars


# ------------------------------------------------------------------------------------------ operator

def draws(seed: int) -> list[Column]:
    """h1 to h4 of a document: the first four 8-digit groups of the hex sha256 of ``seed:doc_id``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform_texts(batches: Iterator[pa.RecordBatch], unit: str, block: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    p, s, m = P.encode(), S.encode(), M.encode()
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        h = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
        for i, j in pieces(offsets):
            part, ends = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            blocks = Blocks(part, ends, unit, block)
            h1, h2 = h[0][i:j] % (blocks.n + 1), h[1][i:j] % (blocks.n + 1)
            one, one_chars = blocks.cut(np.minimum(h1, h2))
            two, two_chars = blocks.cut(np.maximum(h1, h2))
            raw = part.tobytes()
            forms, outputs = [], []
            for t in range(j - i):
                text = raw[ends[t]:ends[t + 1]]
                if not text or h[2][i + t] % 100 >= PLAIN_FROM or p in text or s in text or m in text:
                    forms.append("plain")
                    outputs.append(text)
                    continue
                prefix, middle, suffix = raw[ends[t]:one[t]], raw[one[t]:two[t]], raw[two[t]:ends[t + 1]]
                spm = h[3][i + t] % 100 < SPM_BELOW
                forms.append("spm" if spm else "psm")
                outputs.append(b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle]))
            plain = np.array([f == "plain" for f in forms], bool)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(i, j - i), pa.array(blocks.n, pa.int64()), pa.array(forms, pa.string()),
                pa.array(one_chars, pa.int64(), mask=plain), pa.array(two_chars - one_chars, pa.int64(), mask=plain),
                pa.array(outputs, pa.binary()).cast(pa.string())], schema=schema)


def fill_in_middle(docs: DataFrame, seed: int = 1, unit: str = "char", block: int = BLOCK) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points), output (text) of every document."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    schema = documents_schema(docs, [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()),
                                     ("output", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return docs.select("doc_id", "text", *draws(seed)).mapInArrow(lambda batches: transform_texts(batches, unit, block, arrow), schema)


def restore(output: Column, form: Column) -> Column:
    """The text from its output and form.  The parts hold no marker, and no marker begins inside another, so each is found as
    the first of its kind."""
    def parts(text: Column, marker: str) -> tuple[Column, Column]:
        two = F.split(text, marker, 2)
        return two[0], two[1]

    body = F.substring(output, 4, 2**31 - 1)
    prefix, rest = parts(body, S)
    suffix, middle = parts(rest, M)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = parts(body, P)
    prefix, middle = parts(rest, M)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def digest(made: DataFrame) -> DataFrame:
    """Hashes in place of the outputs: of the output, and of the text rebuilt from it."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
