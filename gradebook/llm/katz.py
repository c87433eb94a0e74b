"""Katz backoff language model (bigrams) over the whole corpus, with the scores of every document.

Tokens of a text: its words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end.  A token's history is the token before it,
or a start.  With r the training count of (h, w):

    P(w | h) = d_r r / c(h)            if r > 0
             = alpha(h) P(w)           otherwise, alpha(h) = (1 - sum d_r r / c(h)) / (1 - sum P(w')) over the w' seen after h
    P(w)     = e_r r / N               if w was seen r times, else the mass that the discounts e leave, for one unknown token

d and e are Good-Turing discounts up to ``K`` counts; beyond, a hundredth of a count is set aside, so that a history
whose successors are all frequent keeps some mass too.  Weights are normalised exactly, by these sums.

The tables are too large to send to tasks, so they are partitioned by hash, and texts ask them by message:

1. texts are packed into chunks of about ``CHUNK_BYTES``, one row each (staged, so that a chunk never changes);
2. each chunk sends its distinct words and bigrams, with their training counts, to the partitions of the count tables;
   these add them up and answer each chunk with the totals; one chunk is named owner of each bigram;
3. each chunk scores its tokens up to the backoff weights, and sends the discounted mass and the unigram mass of the bigrams
   it owns, by history, and the histories whose weight it needs, to the partitions of the backoff table;
4. these normalise, and answer with log alpha, which the chunk adds.

A word or bigram, however frequent, is one entry of a chunk's message; tables are dealt by the hash of the whole bigram, so
a frequent history is spread too.  Messages are packed arrays (sorted, difference coded, byte planes).

Words and bigrams are known by 64-bit hashes.  Defined results: null or empty text: the end token alone.  Null doc_id: scored,
never learned from.  No training document: all tokens unknown, each with model probability 1 and base score
log10(0.5 / 0.5).  Equal rows score equally and count each.  Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, MULTIPLIERS, find_words, mix, pieces, stage, text_bytes

K = 5
BEYOND = 0.01
CHUNK_BYTES = 6 << 20
PART_BYTES = 8 << 20      # text for each partition of the bigram table
START, END = np.uint64(MULTIPLIERS[55]), np.uint64(MULTIPLIERS[56])
WORDS, PAIRS = 0, 1


ROWS_AT_ONCE = 4          # chunk rows (some MB each) that are sent to Python at once


@contextmanager
def few_rows_at_once(spark: SparkSession):
    """Within it, stages hand Python ``ROWS_AT_ONCE`` rows a batch: a batch of the usual size would hold dozens of chunks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(ROWS_AT_ONCE))
    try:
        yield
    finally:
        spark.conf.set(key, before)


# ------------------------------------------------------------------------------------------ packed arrays

def pack(values: np.ndarray, differences: bool = False) -> bytes:
    """Count, then the byte planes of the 64-bit values (of their differences, for sorted ones), compressed."""
    raw = np.ascontiguousarray(values).view(np.uint64)
    if differences and len(raw):
        raw = np.concatenate([raw[:1], np.diff(raw)])
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpack(data: bytes, dtype=np.int64, differences: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    raw = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()
    return (np.cumsum(raw, dtype=np.uint64) if differences else raw).view(dtype)


def split_sorted(keys: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the runs of sorted keys that go to each part (parts hold ranges of the key's upper half)."""
    own = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(own, np.arange(parts + 1, dtype=np.uint64))


# ------------------------------------------------------------------------------------------ chunks

_CHUNK = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("doc_id", T.BinaryType()), T.StructField("has_id", T.BinaryType()),
                       T.StructField("learn", T.BinaryType()), T.StructField("held", T.BinaryType()),
                       T.StructField("lengths", T.BinaryType()), T.StructField("text", T.BinaryType()), T.StructField("size", T.LongType())])


def _chunks(batches):
    base, held, size, number = TaskContext.get().partitionId() << 32, [], 0, 0

    def flush():
        ids = np.concatenate([h[0] for h in held])
        text = b"".join(h[5] for h in held)
        row = [base + number, pack(ids), *(np.concatenate([h[k] for h in held]).astype(np.uint8).tobytes() for k in (1, 2, 3)),
               pack(np.concatenate([h[4] for h in held])), pa.compress(text, codec="zstd", asbytes=True) if text else b"", len(text)]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), *[pa.binary()] * 6, pa.int64()))], names=_CHUNK.names)

    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        ids = batch.column("doc_id")
        known = np.array(ids.is_valid())
        numbers = np.array(ids.fill_null(0)).astype(np.int64)
        learn, out = np.array(batch.column("learn")), np.array(batch.column("held"))
        for i, j in pieces(offsets):
            held.append((numbers[i:j], known[i:j], learn[i:j], out[i:j], np.diff(offsets[i:j + 1]), data[offsets[i]:offsets[j]].tobytes()))
            size += int(offsets[j] - offsets[i])
            if size >= CHUNK_BYTES:
                yield flush()
                held, size, number = [], 0, number + 1
    if held:
        yield flush()


class Chunk:
    """Tokens of a chunk: hash, history's hash, document number, and which documents are learned from."""

    def __init__(self, row: dict):
        self.ids, self.has_id = unpack(row["doc_id"]), np.frombuffer(row["has_id"], np.uint8).astype(bool)
        self.learn, self.held = (np.frombuffer(row[c], np.uint8).astype(bool) for c in ("learn", "held"))
        lengths = unpack(row["lengths"])
        text = np.frombuffer(pa.decompress(row["text"], decompressed_size=row["size"], codec="zstd", asbytes=True) if row["size"] else b"", np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        hashes, counts = [], []
        for i, j in pieces(offsets):
            words = find_words(LOWER[text[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i])
            hashes.append(words.hash)
            counts.append(words.per_doc)
        self.count = np.concatenate(counts) + 1
        last = np.cumsum(self.count) - 1
        self.token = np.empty(int(self.count.sum()), np.uint64)
        inner = np.ones(len(self.token), bool)
        inner[last] = False
        self.token[inner], self.token[last] = np.concatenate(hashes), END
        self.history = np.empty_like(self.token)
        self.history[1:] = self.token[:-1]
        self.history[last - self.count + 1] = START
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.pair = mix(self.history * MULTIPLIERS[57] + self.token * MULTIPLIERS[58])


_ASK = T.StructType([T.StructField("part", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()),
                     T.StructField("keys", T.BinaryType()), T.StructField("n", T.BinaryType())])


def _ask(word_parts: int, pair_parts: int):
    """Messages of each chunk to the count tables; part numbers of the bigram table follow those of the word table."""
    def fn(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                weight = own.learn[own.doc]
                out = []
                for kind, values, parts, shift in ((WORDS, own.token, word_parts, 0), (PAIRS, own.pair, pair_parts, word_parts)):
                    keys, where = np.unique(values, return_inverse=True)
                    n = np.bincount(where, weights=weight, minlength=len(keys)).astype(np.int64)
                    cut = split_sorted(keys, parts)
                    out += [(shift + p, row["chunk"], kind, pack(keys[a:b], True), pack(n[a:b])) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
                del own, weight, values, keys, where, n
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=_ASK.names)
    return fn


_ANSWER = T.StructType([T.StructField("part", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("kind", T.IntegerType()),
                        T.StructField("n", T.BinaryType()), T.StructField("stats", T.ArrayType(T.LongType()))])


def _count_table(group: pa.Table) -> pa.Table:
    """One part of a count table: totals of its keys, answered to every chunk (twice the total, plus one for the owner)."""
    rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
    keys = [unpack(r["keys"], np.uint64, True) for r in rows]
    length = np.array([len(k) for k in keys])
    all_keys = np.concatenate(keys)
    distinct, first, where = np.unique(all_keys, return_index=True, return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([unpack(r["n"]) for r in rows]), minlength=len(distinct)).astype(np.int64)
    owner = np.zeros(len(all_keys), np.int64)
    owner[first] = 1
    answer = total[where] * 2 + owner
    cut = np.concatenate([[0], np.cumsum(length)])
    stats = [int(total.sum()), int((total > 0).sum()), *np.bincount(total[(total > 0) & (total <= K + 1)], minlength=K + 2)[1:K + 2].tolist()]
    n = len(rows)
    return pa.table({"part": pa.array([r["part"] for r in rows], pa.int64()), "chunk": pa.array([r["chunk"] for r in rows], pa.int64()),
                     "kind": pa.array([r["kind"] for r in rows], pa.int32()), "n": pa.array([pack(answer[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                     "stats": pa.array([stats] + [[]] * (n - 1), pa.list_(pa.int64()))})


# ------------------------------------------------------------------------------------------ the model

def discounts(count_of: list[int]) -> np.ndarray:
    """Good-Turing discounts d_1 .. d_K from the numbers of types seen 1 .. K + 1 times; fewer where the counts don't
    allow it, and half a count where they allow none."""
    n = [0, *count_of]
    for k in range(K, 0, -1):
        if any(n[r] <= 0 for r in range(1, k + 2)):
            continue
        tail = (k + 1) * n[k + 1] / n[1]
        if tail >= 1:
            continue
        d = [(((r + 1) * n[r + 1] / n[r]) / r - tail) / (1 - tail) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array(d + [1 - BEYOND / r for r in range(k + 1, K + 1)])
    return np.array([1 - 0.5 / r for r in range(1, K + 1)])


class Model:
    """The few numbers all tasks need: totals and discounts of words (e) and bigrams (d)."""

    def __init__(self, words: list[int], pairs: list[int]):
        self.total, self.types = words[0], words[1]
        self.e, self.d = discounts(words[2:]), discounts(pairs[2:])
        n = np.array(words[2:2 + K], dtype=float)
        r = np.arange(1, K + 1)
        left = float((n * r * (1 - self.e)).sum()) + BEYOND * (self.types - n.sum())
        self.unknown = left / self.total if self.total else 1.0

    @staticmethod
    def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
        low = d[np.clip(count, 1, K) - 1] * count
        return np.where(count > K, count - BEYOND, low)

    def word(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounted(count, self.e) / max(1, self.total), self.unknown)


_SCORED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("part", T.LongType()), T.StructField("chunk", T.LongType()),
                        *(T.StructField(c, T.BinaryType()) for c in ("a", "b", "c", "d", "e", "f"))])


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.table({f.name: pa.array([r[k] for r in rows], kinds[f.dataType.simpleString()]) for k, f in enumerate(schema.fields)})


def _score(model: Model, parts: int):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            own = Chunk(row)
            answers = sorted(right.to_pylist(), key=lambda r: r["part"])
            got = {k: np.concatenate([unpack(r["n"]) for r in answers if r["kind"] == k]) for k in (WORDS, PAIRS)}
            words, word_of = np.unique(own.token, return_inverse=True)
            count = got[WORDS] // 2
            _, first, pair_of = np.unique(own.pair, return_index=True, return_inverse=True)
            both, owner = got[PAIRS] // 2, got[PAIRS] % 2 == 1
            chance = model.word(count)
            # a history's count is its word's: every word is followed by a token; starts are as many as ends
            at = np.searchsorted(words, np.where(own.history == START, END, own.history))
            before = count[at]
            seen = both[pair_of] > 0
            logs = np.where(seen, np.log10(np.maximum(model.discounted(both, model.d), 1e-300))[pair_of] - np.log10(np.maximum(before, 1)), np.log10(chance)[word_of])
            base = np.log10((count + 0.5) / (model.total + 0.5 * (model.types + 1)))[word_of]
            n = len(own.count)
            sums = [np.bincount(own.doc, weights=w, minlength=n) for w in (logs, base, (count > 0)[word_of])]
            flags = (own.has_id.astype(np.int64) * 2 + own.held)
            out.append(("D", None, row["chunk"], pack(own.ids), pack(flags), pack(own.count), *(pack(x) for x in sums)))
            # what this chunk owns, by history
            mine = first[owner & (both > 0)]
            keys, where = np.unique(own.history[mine], return_inverse=True)
            mass = np.bincount(where, weights=model.discounted(both[pair_of[mine]], model.d), minlength=len(keys))
            uni = np.bincount(where, weights=chance[word_of[mine]], minlength=len(keys))
            cut = split_sorted(keys, parts)
            out += [("S", p, row["chunk"], pack(keys[a:b], True), pack(mass[a:b]), pack(uni[a:b]), None, None, None) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            # whose weight it needs
            need = np.flatnonzero(~seen & (before > 0))
            keys, h_first, where = np.unique(own.history[need], return_index=True, return_inverse=True)
            entry, times = np.unique(where * np.int64(n) + own.doc[need], return_counts=True)
            out.append(("L", None, row["chunk"], pack(entry), pack(times), None, None, None, None))
            cut, held = split_sorted(keys, parts), before[need][h_first]
            out += [("N", p, row["chunk"], pack(keys[a:b], True), pack(held[a:b]), None, None, None, None) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
        return _table(out, _SCORED)
    return fn


_ALPHA = T.StructType([T.StructField("part", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("alpha", T.BinaryType())])


def _backoff_table(group: pa.Table) -> pa.Table:
    """One part of the backoff table: exact sums by history, answered as log10 alpha."""
    rows = sorted(group.to_pylist(), key=lambda r: r["chunk"])
    sums, needs = [r for r in rows if r["kind"] == "S"], [r for r in rows if r["kind"] == "N"]
    if not needs:
        return _table([], _ALPHA)
    keys = np.concatenate([unpack(r["a"], np.uint64, True) for r in sums])
    distinct, where = np.unique(keys, return_inverse=True)
    mass = np.bincount(where, weights=np.concatenate([unpack(r["b"], np.float64) for r in sums]), minlength=len(distinct))
    uni = np.bincount(where, weights=np.concatenate([unpack(r["c"], np.float64) for r in sums]), minlength=len(distinct))
    out = []
    for r in needs:
        own, count = unpack(r["a"], np.uint64, True), unpack(r["b"])
        k = np.searchsorted(distinct, own)
        alpha = (1 - mass[k] / count) / (1 - uni[k])
        out.append((r["part"], r["chunk"], pack(np.log10(np.maximum(alpha, 1e-300)))))
    return _table(out, _ALPHA)


def _finish(schema: T.StructType):
    def fn(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {r["kind"]: r for r in left.to_pylist()}
        own = rows["D"]
        ids, flags, n_tokens = unpack(own["a"]), unpack(own["b"]), unpack(own["c"])
        logs, base, known = (unpack(own[c], np.float64) for c in "def")
        answers = sorted(right.to_pylist(), key=lambda r: r["part"])
        if answers:
            alpha = np.concatenate([unpack(r["alpha"], np.float64) for r in answers])
            entry, times = unpack(rows["L"]["a"]), unpack(rows["L"]["b"])
            n = len(ids)
            logs = logs + np.bincount(entry % n, weights=alpha[entry // n] * times, minlength=n)
        return pa.table([pa.array(ids, pa.int64(), mask=flags < 2), pa.array(flags % 2 == 1), pa.array(n_tokens), pa.array(known.astype(np.int64)),
                         pa.array(base), pa.array(logs)], names=schema.names)
    return fn


def katz_scores(docs: DataFrame, learn, held) -> tuple[DataFrame, Model]:
    """doc_id, held_out, n_tokens, n_known, base_score, score for every row; ``learn`` tells the rows that are learned from,
    ``held`` is passed through (both Boolean columns; null is false)."""
    false = F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(learn, false).alias("learn"), F.coalesce(held, false).alias("held"))
    chunks = stage(rows.mapInArrow(_chunks, _CHUNK), "chunks")
    size = chunks.agg(F.sum("size").alias("s")).first()["s"] or 0
    pair_parts = max(4, -(-size // PART_BYTES))
    word_parts = max(2, -(-pair_parts // 6))
    spark = docs.sparkSession
    with few_rows_at_once(spark):
        asked = chunks.mapInArrow(_ask(word_parts, pair_parts), _ASK)
        answers = stage(asked.groupBy("part").applyInArrow(_count_table, _ANSWER), "counts")
    stats = {WORDS: [0] * (K + 3), PAIRS: [0] * (K + 3)}
    for r in answers.select("kind", F.posexplode("stats")).groupBy("kind", "pos").agg(F.sum("col").alias("n")).collect():
        stats[r["kind"]][r["pos"]] = r["n"]
    model = Model(stats[WORDS], stats[PAIRS])
    backoff_parts = word_parts * 2
    with few_rows_at_once(spark):
        scored = chunks.groupBy("chunk").cogroup(answers.drop("stats").groupBy("chunk")).applyInArrow(_score(model, backoff_parts), _SCORED)
        scored = stage(scored, "scored")
    alphas = scored.where("kind IN ('S', 'N')").groupBy("part").applyInArrow(_backoff_table, _ALPHA)
    done = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()),
                         T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    local = scored.where("kind IN ('D', 'L')")
    return local.groupBy("chunk").cogroup(alphas.groupBy("chunk")).applyInArrow(_finish(done), done), model
