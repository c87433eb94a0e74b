"""Benchmark decontamination as a prefix-filtered set join.

A window is ten consecutive words of a benchmark item (words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing
A-Z); an item of fewer words, but not none, is one window.  A document is hit where all words of a window stand in
it, in order.

A window is the set of its positioned five-word shingles (all its words where it has fewer).  Containment in full
makes one prefix token necessary, so each window is looked up by its rarest shingle only:

1. One pass counts, over all documents, how often each shingle of the benchmark occurs (sums by task, then one aggregate).
2. Each window is filed under its rarest shingle; a window whose rarest shingle never occurs is left out.
3. A second pass joins document shingles with that index.  A match fixes where the window would start; it goes on
   only if the window then lies inside the document (positional and length bounds), and its words are all equal.

The benchmark side is cut into blocks of at most ``WINDOWS_PER_BLOCK`` windows by hash; a block is what is sent to
the tasks at once, so its size is bounded whatever the benchmark's.  More blocks mean more passes, with equal results.

Defined results: null or empty text: no words, not contaminated.  Null or empty item: no window.  Null item_id: the
item counts under the name ``null``.  Several items with the same words are all named.  Equal rows give equal results,
one each.  Other columns are not read.  Empty documents: empty result; empty benchmark: nothing is hit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NOT_ALNUM, documents_schema, find_words, list_array, mix, pieces, received, send, shingles, stage, text_bytes

WINDOW = 10
SHINGLE = 5
WINDOWS_PER_BLOCK = 200_000
_SIEVE = 1 << 21


def _windows(size: int) -> Callable:
    def fn(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            words = find_words(LOWER[data], offsets, NOT_ALNUM)
            names, out = batch.column("item").to_pylist(), []
            for d, n in enumerate(words.per_doc):
                own = words.hash[words.first[d]:words.first[d] + n]
                out += [(names[d], own[i:i + size].tobytes()) for i in range(max(n - size + 1, min(n, 1)))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())],
                                             names=["item", "words"])
    return fn


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows (8 bytes a word) with the items they come from."""
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("words", T.BinaryType())])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return items.mapInArrow(_windows(size), schema).groupBy("words").agg(F.collect_set("item").alias("items"))


class Lookup:
    """Sorted shingle hashes of one shingle length, behind a small bit table that turns most probes away."""

    def __init__(self, tokens: np.ndarray):
        self.tokens = np.unique(tokens)
        self.sieve = np.zeros(_SIEVE, bool)
        self.sieve[(self.tokens & np.uint64(_SIEVE - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, numbers of the tokens found there)."""
        at = np.flatnonzero(self.sieve[(h & np.uint64(_SIEVE - 1)).astype(np.int64)])
        if not len(at) or not len(self.tokens):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.tokens, h[at]), len(self.tokens) - 1)
        good = self.tokens[k] == h[at]
        return at[good], k[good]


class Block:
    """A bounded block of windows, by length, with the hashes of their shingles."""

    def __init__(self, rows: list, size: int):
        self.size = size
        self.items = [r["items"] for r in rows]
        by: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by.setdefault(len(r["words"]) // 8, []).append(i)
        self.length = {n: (np.array(ids), np.stack([np.frombuffer(rows[i]["words"], np.uint64) for i in ids])) for n, ids in by.items()}
        self.tokens = {}
        for n, (_, words) in self.length.items():
            self.tokens.setdefault(min(n, SHINGLE), []).append(self.shingles(words).ravel())
        self.tokens = {s: Lookup(np.concatenate(x)) for s, x in self.tokens.items()}

    @staticmethod
    def shingles(words: np.ndarray) -> np.ndarray:
        """(windows, offsets) shingle hashes, as ``common.shingles`` makes them."""
        from .common import MULTIPLIERS

        n, s = words.shape[1], min(words.shape[1], SHINGLE)
        h = np.zeros((len(words), n - s + 1), np.uint64)
        for k in range(s):
            h += words[:, k:k + n - s + 1] * MULTIPLIERS[k]
        return mix(h)

    def file(self, counts: dict[int, np.ndarray]) -> None:
        """File every window under its rarest shingle."""
        self.prefix = {}
        for n, (ids, words) in self.length.items():
            s = min(n, SHINGLE)
            h = self.shingles(words)
            k = np.searchsorted(self.tokens[s].tokens, h)
            often = counts[s][k]
            place = np.argmin(often, axis=1)
            row = np.arange(len(ids))
            live = often[row, place] > 0
            token, place, ids_, words_ = h[row, place][live], place[live], ids[live], words[live]
            order = np.argsort(token, kind="stable")
            token = token[order]
            look = Lookup(token)
            first = np.searchsorted(token, look.tokens)
            self.prefix[n] = (look, first, np.append(first[1:], len(token)), place[order], ids_[order], words_[order])

    def hits(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, window) of every occurrence, in word numbers of ``words``."""
        out = []
        ends = words.first + words.per_doc
        by_size = {}
        for n, (look, first, last, place, ids, win) in self.prefix.items():
            s = min(n, SHINGLE)
            if s not in by_size:
                by_size[s] = _positions(words, s)
            at, h = by_size[s]
            i, k = look.find(h)
            times = (last - first)[k]
            i = np.repeat(at[i], times)
            entry = np.repeat(first[k], times) + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
            start = i - place[entry]
            doc = words.doc[i] if len(i) else i
            good = (start >= words.first[doc]) & (start + n <= ends[doc]) if len(i) else np.zeros(0, bool)
            start, entry = start[good], entry[good]
            for w in range(n):
                same = words.hash[start + w] == win[entry, w]
                start, entry = start[same], entry[same]
            out.append((start, np.full(len(start), n), ids[entry]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out))


def _positions(words, s: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of each run of s words inside a document."""
    n = len(words.hash) - s + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    _, h = shingles(words, s)
    return np.flatnonzero(words.doc[:n] == words.doc[s - 1:]), h


def _count(block) -> Callable:
    def fn(batches):
        own = received(block)
        counts = {s: np.zeros(len(look.tokens), np.int64) for s, look in own.tokens.items()}
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in pieces(offsets):
                words = find_words(LOWER[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i], NOT_ALNUM)
                for s, look in own.tokens.items():
                    _, k = look.find(shingles(words, s)[1])
                    counts[s] += np.bincount(k, minlength=len(look.tokens))
        for s, c in counts.items():
            k = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), s)), pa.array(k), pa.array(c[k])], names=["s", "k", "n"])
    return fn


def _search(block, all_rows: bool) -> Callable:
    def fn(batches):
        own = received(block)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in pieces(offsets):
                words = find_words(LOWER[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i], NOT_ALNUM)
                start, length, window = own.hits(words)
                doc = words.doc[start] if len(start) else start
                order = np.lexsort((start, doc))
                start, length, window, doc = start[order], length[order], window[order], doc[order]
                inside = start - words.first[doc] if len(start) else start
                bounds = np.searchsorted(doc, np.arange(j - i + 1))
                names = []
                for d in range(j - i):
                    lo, hi = bounds[d], bounds[d + 1]
                    names.append(sorted({x for w in set(window[lo:hi].tolist()) for x in own.items[w]}) if hi > lo else [])
                n = np.diff(bounds)
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("ta").slice(i, j - i), batch.column("tb").slice(i, j - i),
                     pa.array(words.per_doc), list_array(pa.array(inside.astype(np.int64)), n),
                     list_array(pa.array((inside + length).astype(np.int64)), n), pa.array(names, pa.list_(pa.string()))],
                    names=["doc_id", "ta", "tb", "n_words", "starts", "stops", "items"])
                yield out if all_rows else out.filter(pa.array(n > 0))
    return fn


def _filed_blocks(docs: DataFrame, benchmark: DataFrame, size: int, windows_per_block: int):
    """(broadcast block with its index filed by counts over ``docs``, whether it is the last), one after the other."""
    known = stage(windows(benchmark, size), "windows")
    blocks = max(1, -(-known.count() // windows_per_block))
    counted = T.StructType([T.StructField(c, T.LongType()) for c in ("s", "k", "n")])
    spark = docs.sparkSession
    for b in range(blocks):
        own = Block(known.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect(), size)
        sent = send(spark, own)
        counts = {s: np.zeros(len(look.tokens), np.int64) for s, look in own.tokens.items()}
        for r in docs.select("text").mapInArrow(_count(sent), counted).groupBy("s", "k").agg(F.sum("n").alias("n")).collect():
            counts[r["s"]][r["k"]] = r["n"]
        sent.unpersist()
        own.file(counts)
        yield send(spark, own), b == blocks - 1


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, windows_per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """doc_id, n_words, starts and stops (word spans of the hits, by start), items (sorted names) for every row."""
    # the text's own hashes keep apart rows that share a doc_id
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("ta"), F.xxhash64(F.lit(1), "text").alias("tb"))
    spans = T.ArrayType(T.LongType())
    found = documents_schema(docs, [("ta", T.LongType()), ("tb", T.LongType()), ("n_words", T.LongType()), ("starts", spans),
                                    ("stops", spans), ("items", T.ArrayType(T.StringType()))])
    base, more = None, None
    for block, last in _filed_blocks(docs, benchmark, size, windows_per_block):
        if base is None:
            base = texts.mapInArrow(_search(block, True), found)
            base = base if last else stage(base, "hits")
        else:
            part = stage(texts.mapInArrow(_search(block, False), found), "hits").drop("n_words").dropDuplicates(["doc_id", "ta", "tb"])
            more = part if more is None else more.union(part)
    if more is not None:
        rest = more.groupBy("doc_id", "ta", "tb").agg(*(F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("starts", "stops", "items")))
        same = F.expr("b.doc_id <=> r.doc_id AND b.ta = r.ta AND b.tb = r.tb")
        joined = base.alias("b").join(rest.alias("r"), same, "left")
        none = F.array()
        base = joined.select("b.doc_id", "b.n_words", *(
            F.concat(f"b.{c}", F.coalesce(f"r.more_{c}", none.cast("array<string>" if c == "items" else "array<bigint>"))).alias(c)
            for c in ("starts", "stops", "items")))
    return base.select("doc_id", "n_words", "starts", "stops", F.array_sort(F.array_distinct("items")).alias("items"))


def words_hit(starts: str = "starts", stops: str = "stops"):
    """Words inside any of the spans: spans sorted by start, summed past the furthest stop so far."""
    return F.expr(f"""aggregate(array_sort(arrays_zip({starts}, {stops})), named_struct('n', 0L, 'to', 0L),
        (s, x) -> named_struct('n', s.n + greatest(0L, x.{stops} - greatest(x.{starts}, s.to)), 'to', greatest(s.to, x.{stops})), s -> s.n)""")


def digest(hits: DataFrame) -> DataFrame:
    """The counts of ``contamination``'s spans and items."""
    return hits.select("doc_id", "n_words", words_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def _clean(block) -> Callable:
    def fn(batches):
        own = received(block)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            hit = np.zeros(len(offsets) - 1, bool)
            for i, j in pieces(offsets):
                words = find_words(LOWER[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i], NOT_ALNUM)
                start = own.hits(words)[0]
                hit[i + words.doc[start]] = True
            yield batch.filter(pa.array(~hit))
    return fn


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, windows_per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no window of the benchmark."""
    rest = docs
    for block, last in _filed_blocks(docs, benchmark, size, windows_per_block):
        rest = rest.mapInArrow(_clean(block), docs.schema)
        rest = rest if last else stage(rest, "clean")
    return rest
