"""Shared pieces of the operators: staged tables in the cluster's shared folder, and word arrays over Arrow text.

Word arrays.  A text column arrives as one Arrow buffer of UTF-8 bytes.  Words are found and hashed with
numpy over that buffer, a bounded piece of documents at a time, so no Python object is made per word.
Hashes are 64 bits and depend on the word's bytes alone, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

PIECE_BYTES = 1 << 20  # text handled at once; one longer document is a piece of its own

_MASK = (1 << 64) - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); on a cluster an error where the session names none."""
    return checkpoint_dir(spark)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(staged: DataFrame, rows: int) -> DataFrame:
    """A staged table, marked for broadcast if it has at most ``rows`` rows; beyond, joins with it stay shuffles."""
    return F.broadcast(staged) if staged.limit(rows + 1).count() <= rows else staged


def send(spark: SparkSession, value) -> Broadcast:
    """Broadcast an object together with its class, as bytes: executors need no copy of this folder to read it (``received``)."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent: Broadcast):
    """The object that ``send`` sent; once a task."""
    return cloudpickle.loads(sent.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_schema(df: DataFrame, extra: list[tuple[str, T.DataType]]) -> T.StructType:
    """``df``'s doc_id field followed by ``extra``."""
    return T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType, True)]
                        + [T.StructField(n, t, True) for n, t in extra])


# ---------------------------------------------------------------------------------------------- hashing

def _odd_constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers from a splitmix stream."""
    out, x = [], seed
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append((z ^ (z >> 31)) | 1)
    return np.array(out, dtype=np.uint64)


MULTIPLIERS = _odd_constants(64, 7)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of a fixed odd base (mod 2^64)."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 256)
        steps = np.full(size, MULTIPLIERS[63], dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


# ---------------------------------------------------------------------------------------------- text

def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, true inside the inclusive byte ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))  # after lower-casing A-Z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


# letters and marks among the code points of the first two planes, by general category
_LETTER = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x20000)])
APOSTROPHES = (0x2018, 0x2019, 0x02BC)


def wide_characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, code point, bytes) of every character beyond ASCII in UTF-8 ``data``."""
    at = np.flatnonzero(data >= 0xC2)
    lead = data[at].astype(np.int32)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    for k in range(1, 4):
        code = np.where(size > k, code << 6 | data[np.minimum(at + k, len(data) - 1)].astype(np.int32) & 0x3F, code)
    return at, code, size


def only_letters(data: np.ndarray) -> np.ndarray:
    """``data`` with each character beyond ASCII that is no letter and no mark turned into blanks, a curved apostrophe into straight
    ones, as many as it has bytes: places in the text stay as they are."""
    at, code, size = wide_characters(data)
    letter = np.where(code < len(_LETTER), _LETTER[np.minimum(code, len(_LETTER) - 1)], code < 0x40000)
    quote = np.isin(code, APOSTROPHES)
    if (letter & ~quote).all():
        return data
    out = data.copy()
    fill = np.where(quote, ord("'"), ord(" ")).astype(np.uint8)
    for k in range(4):
        gone = (~letter | quote) & (size > k)
        out[at[gone] + k] = fill[gone]
    return out


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [i, j) holding at most ``limit`` bytes, or one longer document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of a run of documents, in order: document number, byte span and 64-bit hash."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    per_doc: np.ndarray  # words of each document
    first: np.ndarray    # index of each document's first word


def find_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no ``breaks``; ``data`` is as it shall be hashed (lower-cased or not)."""
    n, docs = len(data), len(offsets) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(docs, np.int64), np.zeros(docs, np.int64))
    gap = breaks[data]
    edge = offsets[:-1][offsets[:-1] < n]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[edge] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after[edge[edge > 0] - 1] = True
    start = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(after & ~gap) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    length = end - start
    firsts = np.cumsum(length) - length
    if len(start):
        place = np.arange(int(length.sum())) - np.repeat(firsts, length)
        power = powers(int(length.max()))
        h = np.add.reduceat((data[~gap].astype(np.uint64) + np.uint64(1)) * power[place], firsts)
        h = mix(h + length.astype(np.uint64) * MULTIPLIERS[62])
    else:
        h = np.zeros(0, np.uint64)
    per_doc = np.bincount(doc, minlength=docs).astype(np.int64)
    return Words(doc, start, end, h, per_doc, np.cumsum(per_doc) - per_doc)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``size`` words inside one document, in order of its first word."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += words.hash[k:k + n] * MULTIPLIERS[k]
    inside = words.doc[:n] == words.doc[size - 1:]
    return words.doc[:n][inside], mix(h[inside])


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Lists of the given lengths over flat values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
