"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is a row of term counts in three groups of places:

* shapes: the shape of each word (class of its first, last and last but one byte, all capitals, length), pairs of neighbouring
  shapes, whether the word stands up to ``BACK`` words earlier, and the shapes of lines, hashed into ``SHAPES`` places;
* words (lower-cased A-Z, parted at anything but letters and digits): one place for each of the ``WORDS`` words that stand in most labelled
  rows (ties by hash; at least two rows), told apart by 64-bit hashes, and one place for all other words together;
* pairs of neighbouring words that both have a place, hashed into ``PAIRS`` places.

Counts enter as log(1 + n), weighted by inverse document frequency (other words: 1); shapes, and words with their pairs, are brought to unit
length apart.  Latent vectors are the projections on the first ``RANK`` right singular vectors of the
labelled rows' matrix, of unit length.

At most ``FIT_ROWS`` labelled rows, the first by hash of doc_id, make the space and the voters; the voters' vectors (``FIT_ROWS`` x
``RANK`` numbers), the projection and the words are broadcast.  Every document is compared with every voter by exact cosine products, a block of documents at a
time, and its score is the vote of the ``K`` nearest, weighted by similarity to the power ``SHARP``.  The share of label 1 votes along with a
fixed small weight (``DOUBT`` of the ``K`` votes at the similarity that all but a share ``UNLIKE`` of the voters have to their own ``K`` nearest), so a
text that is unlike all voters gets a score near that share and not a sure one.

Defined results: null, empty and blank texts have no terms and get the share of label 1 among the voters, as does
everything when no voter is near.  Without usable labels all scores are 0.5.  A doc_id labelled twice counts by its
largest label.  Rows are independent; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, MULTIPLIERS, NOT_ALNUM, SPACE, documents_schema, find_words, mix, pieces, received, send, stage, text_bytes
from .toxicity import fit_rows

FIT_ROWS = 6000
SHAPES, WORDS, PAIRS = 1024, 2047, 1024
DIM, RANK = SHAPES + WORDS + 1 + PAIRS, 96
BACK = 8
K, SHARP = 25, 8.0
DOUBT, UNLIKE = 0.1, 0.1
BLOCK = 256
_NO_WORDS = np.zeros(0, np.uint64)

# classes of a byte: letters and digits by kind, any other byte is its own class
_CLASS = np.arange(256, dtype=np.int64)
for _lo, _hi, _c in ((ord("a"), ord("z"), 256), (ord("A"), ord("Z"), 257), (ord("0"), ord("9"), 258), (0x80, 0xFF, 256)):
    _CLASS[_lo:_hi + 1] = _c


def shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, SHAPES) counts of the hashed shapes."""
    docs = len(offsets) - 1
    words = find_words(data, offsets, SPACE)
    if not len(words.hash):
        return np.zeros((docs, SHAPES), np.float32)
    length = words.end - words.start
    kind = _CLASS[data]
    upper = np.add.reduceat((kind == 257).astype(np.int64), words.start)
    lower = np.add.reduceat((kind == 256).astype(np.int64), words.start)
    shape = kind[words.start] + 512 * kind[words.end - 1] + 512 ** 2 * np.where(length > 1, kind[np.maximum(words.end - 2, 0)], 511) \
        + 512 ** 3 * (np.minimum(length, 15) // 4) + 512 ** 3 * 8 * ((upper > 1) & (lower == 0))
    found = [(words.doc, shape, 1)]
    n = len(shape)
    for back in range(1, min(BACK, n - 1) + 1):
        again = (words.hash[back:] == words.hash[:-back]) & (words.doc[back:] == words.doc[:-back])
        found.append((words.doc[back:][again], np.full(int(again.sum()), min(back, 2)), 2))
    same = words.doc[1:] == words.doc[:-1]
    found.append((words.doc[1:][same], (shape[:-1] * 1000003 + shape[1:])[same], 3))
    newline = np.concatenate([[0], np.cumsum(data == 10)])
    breaks = newline[words.start[1:]] > newline[words.end[:-1]]
    found.append((words.doc[1:][same & breaks], shape[1:][same & breaks], 4))
    place = np.concatenate([d * SHAPES + (mix(v.astype(np.uint64) + MULTIPLIERS[30 + k]) % np.uint64(SHAPES)).astype(np.int64) for d, v, k in found])
    return np.bincount(place, minlength=docs * SHAPES).reshape(docs, SHAPES).astype(np.float32)


def word_terms(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> np.ndarray:
    """(documents, WORDS + 1 + PAIRS) counts of the ``known`` words (sorted hashes), of all others, and of pairs of known ones."""
    docs, width = len(offsets) - 1, WORDS + 1 + PAIRS
    words = find_words(LOWER[data], offsets, NOT_ALNUM)
    if not len(words.hash):
        return np.zeros((docs, width), np.float32)
    at = np.searchsorted(known, words.hash)
    is_known = known[np.minimum(at, len(known) - 1)] == words.hash if len(known) else np.zeros(len(at), bool)
    place = np.where(is_known, at, WORDS)
    pair = (words.doc[1:] == words.doc[:-1]) & is_known[1:] & is_known[:-1]
    both = mix(words.hash[:-1][pair] * MULTIPLIERS[0] + words.hash[1:][pair] * MULTIPLIERS[1]) % np.uint64(PAIRS)
    found = np.concatenate([words.doc * width + place, words.doc[1:][pair] * width + WORDS + 1 + both.astype(np.int64)])
    return np.bincount(found, minlength=docs * width).reshape(docs, width).astype(np.float32)


def blocks(column: pa.Array):
    """(first row, last row + 1, bytes, offsets) of at most ``BLOCK`` rows of a text column at a time."""
    data, offsets = text_bytes(column)
    for i, j in pieces(offsets):
        for k in range(i, j, BLOCK):
            end = min(k + BLOCK, j)
            yield k, end, data[offsets[k]:offsets[end]], offsets[k:end + 1] - offsets[k]


def terms(data: np.ndarray, offsets: np.ndarray, known: np.ndarray = _NO_WORDS) -> np.ndarray:
    """(documents, DIM) logarithmic counts of all terms."""
    return np.log1p(np.hstack([shapes(data, offsets), word_terms(data, offsets, known)]))


def _distinct_words(batches):
    for batch in batches:
        for _, _, data, offsets in blocks(batch.column("text")):
            words = find_words(LOWER[data], offsets, NOT_ALNUM)
            for d in range(len(offsets) - 1):
                own = np.unique(words.hash[words.first[d]:words.first[d] + words.per_doc[d]])
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["word"])


def common_words(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of the ``WORDS`` words that stand in most rows, of those in two or more."""
    words = rows.mapInArrow(_distinct_words, "word bigint").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    top = words.orderBy(F.desc("n"), "word").limit(WORDS).collect()  # at most WORDS numbers
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def _rows(known: np.ndarray):
    def fn(batches):
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("text")):
                x = terms(data, offsets, known).astype(np.float16)
                sparse = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("y").slice(i, j - i), pa.array([p.astype(np.uint16).tobytes() for p in sparse], pa.binary()),
                     pa.array([r[p].tobytes() for r, p in zip(x, sparse)], pa.binary())], names=["y", "place", "x"])

    return fn




class Model:
    """Projection (DIM x RANK), the voters' unit vectors and their labels, idf, known words, and the weight with which the prior votes."""

    def __init__(self, project: np.ndarray, voters: np.ndarray, labels: np.ndarray, idf: np.ndarray | None = None, known: np.ndarray = _NO_WORDS, doubt: float = 0.0):
        self.project, self.voters, self.labels, self.idf, self.known, self.doubt = project, voters, labels, idf, known, doubt
        self.prior = float(labels.mean()) if len(labels) else 0.5


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log counts by idf, shapes and words of unit length each."""
    x = x * idf
    return np.hstack([unit(x[:, :SHAPES]), unit(x[:, SHAPES:])])


def leading(x: np.ndarray, rank: int) -> np.ndarray:
    """The first ``rank`` right singular vectors, by subspace iteration from a fixed start."""
    start = np.random.default_rng(0).normal(size=(x.shape[1], min(rank + 32, x.shape[1]))).astype(np.float32)
    for _ in range(6):
        start, _ = np.linalg.qr(x.T @ (x @ start))
    _, _, inner = np.linalg.svd(x @ start, full_matrices=False)
    return (start @ inner.T[:, :rank]).astype(np.float32)


def nearest(own: np.ndarray, voters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(voter numbers, similarities) of the k nearest of each row."""
    near = own @ voters.T
    top = np.argpartition(near, len(voters) - k, axis=1)[:, len(voters) - k:]
    return top, np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, usable, limit: int = FIT_ROWS, label: str = "quality") -> Model:
    rows = stage(fit_rows(docs, labels, label, usable, limit), "fit")
    known = common_words(rows)
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("place", T.BinaryType()), T.StructField("x", T.BinaryType())])
    got = rows.mapInArrow(_rows(known), schema).collect()  # at most `limit` rows of 4 * DIM bytes
    got.sort(key=lambda r: (r["y"], bytes(r["place"]), bytes(r["x"])))
    if not got:
        return Model(np.zeros((DIM, RANK), np.float32), np.zeros((0, RANK), np.float32), np.zeros(0))
    x = np.zeros((len(got), DIM), np.float32)
    for own, r in zip(x, got):
        own[np.frombuffer(r["place"], np.uint16)] = np.frombuffer(r["x"], np.float16)
    y = np.array([float(r["y"] > 0) for r in got])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    idf[SHAPES + WORDS] = 1  # other words stand in nearly every row; their share is what tells
    x = weighted(x, idf)
    project = leading(x, RANK)
    voters = unit(x @ project).astype(np.float32)
    k = min(K + 1, len(voters))  # a voter is its own nearest
    least = np.concatenate([nearest(voters[i:i + BLOCK], voters, k)[1].min(axis=1) for i in range(0, len(voters), BLOCK)])
    return Model(project, voters, y, idf, known, DOUBT * K * float(np.quantile(least, UNLIKE)) ** SHARP)


def vote(x: np.ndarray, model: Model) -> np.ndarray:
    """Scores of weighted rows."""
    out = np.full(len(x), model.prior)
    if not len(model.voters):
        return out
    k = min(K, len(model.voters))
    for i in range(0, len(x), BLOCK):
        own = x[i:i + BLOCK] @ model.project
        top, weight = nearest(unit(own), model.voters, k)
        weight = weight ** SHARP
        total = weight.sum(axis=1) + model.doubt
        some = (total > 0) & (np.abs(own).sum(axis=1) > 0)
        out[i:i + BLOCK][some] = ((weight * model.labels[top]).sum(axis=1) + model.doubt * model.prior)[some] / total[some]
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (chance of label 1) of every row."""
    sent = send(docs.sparkSession, model)

    def fn(batches):
        own = received(sent)
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column("text")):
                x = terms(data, offsets, own.known)
                x = weighted(x, own.idf) if own.idf is not None else x
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(vote(x, own))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(fn, documents_schema(docs, [("score", T.DoubleType())]))
