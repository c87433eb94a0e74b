"""Near-duplicates by MinHash bands with sequential Bayesian verification.

A document's set holds its distinct five-word shingles over words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased;
fewer words make one shingle of all of them, no word an empty set, which links with nothing.  Two documents
link when ``100 * |intersection| >= percent * |union|``; a class is a connected component of links.

1. Every text becomes a signature of ``BANDS * ROWS`` 16-bit minima and a 128-bit key of its whole set.
   Texts with equal sets fall into one class at once (one aggregate), so a group of copies, however large,
   goes on as one representative.
2. Representatives meet in band buckets; of buckets with the same members one is kept.  Buckets over ``BLOCK`` members
   are cut into pairs of blocks, so a task holds at most two blocks, whatever the bucket's size.  Inside a block pair
   numpy compares signatures batch by batch; after each batch a pair is dropped when the posterior chance that its
   similarity reaches the threshold is under ``MISS``.  A pair belongs to the first band it shares.  Surviving pairs
   leave the task as one packed row for each block pair, most similar first.
3. The survivors' full shingle sets are sent to their block pairs and verified there, pair by pair, except pairs that
   links verified there already connect.  So at most one link a member leaves the task, and none between
   classes is lost.
4. Links are connected (``components``).

Chances: at similarity 0.85 a pair shares no band with chance 7e-9, and is dropped wrongly with at most
``MISS`` per batch; at 0.8 no band is shared with chance 3e-6.

Defined results: null, empty or blank text: n_shingles 0, its own class, kept.  Null doc_id: component null,
kept.  Equal rows given twice: both rows come back with the same class.  A doc_id given to different texts: each text is compared
on its own, under the number of its class of equal sets, and may be in a component of its own.  Columns other than doc_id and text
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, MULTIPLIERS, _odd_constants, documents_schema, find_words, mix, pieces, shingles, small, stage, text_bytes
from .components import components

SHINGLE = 5
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32          # hashes compared before each posterior check
MISS = 1e-7         # chance at which the posterior check gives a pair up
BLOCK = 256         # members of a bucket compared in one task at once, with as many others
BROADCAST_IDS = 2_000_000  # up to so many survivors (8 bytes each) their ids are broadcast to pick their texts

_A = (_odd_constants(HASHES, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (_odd_constants(HASHES, 13) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words = find_words(LOWER[data], offsets)
    doc, h = shingles(words, SHINGLE)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    out = []
    for d, n in enumerate(words.per_doc):
        if n >= SHINGLE:
            out.append(np.unique(h[bounds[d]:bounds[d + 1]]))
        elif n:
            own = words.hash[words.first[d]:words.first[d] + n]
            out.append(mix(np.array([(own * MULTIPLIERS[40:40 + n]).sum() + np.uint64(n)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    """Minima of HASHES permutations of the 32-bit halves, a bounded block of shingles at a time."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low = (values >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(out, (low[i:i + 2048, None] * _A + _B).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys of (n, HASHES) signatures; the band's number is part of the key."""
    rows = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    return mix((rows * MULTIPLIERS[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * MULTIPLIERS[50])


def set_key(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole shingle set; the order of its members doesn't matter."""
    return (int(mix(values).sum(dtype=np.uint64)), int((mix(values ^ MULTIPLIERS[9]) * MULTIPLIERS[5]).sum(dtype=np.uint64)))


def _described(column: str, describe):
    """mapInArrow function: doc_id, hash of the text, n_shingles, set key, and the bytes that ``describe`` makes of each set."""
    def fn(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in pieces(offsets):
                sets = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                key = np.array([set_key(s) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("tx").slice(i, j - i), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(key[:, 0]),
                     pa.array(key[:, 1]), pa.array([describe(s) for s in sets], pa.binary())], names=["doc_id", "tx", "n_shingles", "set_a", "set_b", column])
    return fn


def described(docs: DataFrame, column: str, describe) -> DataFrame:
    schema = documents_schema(docs, [("tx", T.LongType()), ("n_shingles", T.LongType()), ("set_a", T.LongType()), ("set_b", T.LongType()), (column, T.BinaryType())])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tx")).mapInArrow(_described(column, describe), schema)


def signatures(docs: DataFrame) -> DataFrame:
    return described(docs, "sig", lambda s: (signature(s) >> np.uint32(16)).astype(np.uint16).tobytes())


def _bands(batches):
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        keys = band_keys(sig).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(batch.column("doc_id")), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig))),
                                          pa.array(keys.ravel())], names=["doc_id", "band", "bucket"])


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For each count of compared hashes, the fewest matches whose posterior P(similarity >= threshold) is at least
    ``miss``; the prior is uniform, so the posterior after m of n is Beta(m + 1, n - m + 1)."""
    out = {}
    for n in [*range(BATCH, HASHES, BATCH), HASHES]:
        tail, m = 0.0, -1
        while m < n:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
        out[n] = m
    return out


def surviving_pairs(sig: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, least: dict[int, int],
                    percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of members ``left`` x ``right``, the pairs that pass the length bound and every posterior check, with their matches."""
    small, large = np.minimum(size[left][:, None], size[right]), np.maximum(size[left][:, None], size[right])
    mask = 100 * small >= percent * large
    if left is right:
        mask &= np.triu(np.ones_like(mask), 1)
    a, b = np.nonzero(mask)
    a, b = left[a], right[b]
    found, done = np.zeros(len(a), np.int64), 0
    for n, m in least.items():
        for k in range(done, n):
            found += sig[a, k] == sig[b, k]
        keep = found >= m
        a, b, found, done = a[keep], b[keep], found[keep], n
        if not len(a):
            break
    return a, b, found


def compare_buckets(percent: int):
    """Rows sorted by block pair (gid) in; for each with surviving pairs one row out: gid, members, packed pairs."""
    least = least_matches(percent / 100)

    def run(bucket, own, ids, size, sig, side, same):
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        a, b, found = surviving_pairs(sig, size, left, right, least, percent)
        if len(a):  # a pair belongs to the first band it shares
            mine = own[a, np.argmax(own[a] == own[b], axis=1)] == bucket
            a, b, found = a[mine], b[mine], found[mine]
        if not len(a):
            return None
        order = np.argsort(-found, kind="stable")
        members, places = np.unique(np.stack([a, b])[:, order], return_inverse=True)
        return ids[members], places.reshape(2, -1).astype(np.int32)

    def flush(held):
        gid, bucket = (np.array([r[c] for r in held], np.int64) for c in ("gid", "bucket"))
        sig = np.frombuffer(b"".join(r["sig"] for r in held), np.uint16).reshape(len(held), HASHES)
        own = band_keys(sig).view(np.int64)
        ids, size, side = (np.array([r[c] for r in held], np.int64) for c in ("doc_id", "n_shingles", "side"))
        same = np.array([r["bi"] == r["bj"] for r in held])
        cuts = np.flatnonzero(gid[1:] != gid[:-1]) + 1
        out = []
        for i, j in zip([0, *cuts], [*cuts, len(held)]):
            got = run(bucket[i], own[i:j], ids[i:j], size[i:j], sig[i:j], side[i:j], same[i]) if j - i > 1 else None
            if got is not None:
                out.append((gid[i], got[0], got[1].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())),
                                          pa.array([x[2] for x in out], pa.binary())], names=["gid", "members", "pairs"])

    def fn(batches):
        held, last = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["gid"] != last and len(held) >= 4 * BLOCK:
                    yield from flush(held)
                    held = []
                held.append(row)
                last = row["gid"]
        if held:
            yield from flush(held)

    return fn


def candidate_groups(reps: DataFrame, percent: int) -> DataFrame:
    """Block pairs of buckets with the representatives of their surviving pairs and those pairs, packed.  ``doc_id`` here is
    the number of the class that a representative stands for."""
    rows = reps.mapInArrow(_bands, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("bucket", T.LongType())]))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.bit_xor(F.xxhash64("doc_id")).alias("who"),
                                         F.min("band").alias("band")).where("n > 1")
    # buckets of equal members meet the same pairs: the one of the first band stays
    buckets = buckets.groupBy("n", "low", "who").agg(F.min(F.struct("band", "bucket")).alias("one")).select("one.bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = rows.select("doc_id", "bucket").join(buckets, "bucket").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = placed.select("doc_id", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("doc_id", "bucket", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"),
                           F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")).withColumn("gid", F.xxhash64("bucket", "bi", "bj"))
    spread = spread.join(reps.select("doc_id", "n_shingles", "sig"), "doc_id")
    schema = T.StructType([T.StructField("gid", T.LongType()), T.StructField("members", T.ArrayType(T.LongType())), T.StructField("pairs", T.BinaryType())])
    return spread.repartition("gid").sortWithinPartitions("gid").mapInArrow(compare_buckets(percent), schema)


def verify_groups(percent: int):
    """Rows sorted by (gid, place) in, the packed pairs first; out: links that connect all pairs verified on full sets."""
    def check(pairs, ids, sets):
        parent = {}

        def root(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for a, b in np.frombuffer(pairs, np.int32).reshape(2, -1).T.tolist():
            x, y = root(a), root(b)
            if x != y:
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    parent[max(x, y)] = min(x, y)
                    yield min(ids[a], ids[b]), max(ids[a], ids[b])

    def fn(batches):
        gid, pairs, ids, sets = None, None, {}, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["gid"] != gid:
                    if pairs is not None:
                        out += check(pairs, ids, sets)
                    gid, pairs, ids, sets = row["gid"], None, {}, {}
                if row["place"] < 0:
                    pairs = row["bytes"]
                else:
                    ids[row["place"]], sets[row["place"]] = row["doc_id"], np.frombuffer(row["bytes"], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])
        out = list(check(pairs, ids, sets)) if pairs is not None else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return fn


def verified_links(groups: DataFrame, docs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of classes whose full shingle sets reach the threshold; they connect all that do."""
    members = groups.select("gid", F.posexplode("members").alias("place", "cid"))
    chosen = stage(members.select("cid").distinct().join(reps.select("cid", "doc_id", "set_a", "set_b"), "cid"), "members")
    some = docs.join(small(chosen.select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi")
    sets = described(some, "bytes", lambda s: s.tobytes()).drop("n_shingles", "tx")
    named = members.join(chosen, "cid").join(sets, ["doc_id", "set_a", "set_b"])
    rows = named.select("gid", "place", F.col("cid").alias("doc_id"), "bytes").union(
        groups.select("gid", F.lit(-1).alias("place"), F.lit(None).cast("long").alias("doc_id"), F.col("pairs").alias("bytes")))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return rows.repartition("gid").sortWithinPartitions("gid", "place").mapInArrow(verify_groups(percent), schema)


def classified(docs: DataFrame, percent: int) -> DataFrame:
    """Every row of ``docs`` with doc_id, tx (hash of the text), n_shingles, n_copies, component (number of its smallest class) and
    component_id (smallest doc_id there); the last two are null without a set or a doc_id.

    Classes of equal sets are numbered in the order of their smallest doc_id, so the smallest class reached holds the smallest doc_id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(signatures(texts), "signatures")
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stage(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies")), "sets")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes = stage(classes.repartitionByRange(parts, "rep").sortWithinPartitions("rep", "set_a", "set_b").withColumn("cid", F.monotonically_increasing_id()), "classes")
    heads = classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b", "cid")
    reps = stage(named.join(heads, ["doc_id", "set_a", "set_b"]).dropDuplicates(["cid"]), "reps")
    groups = stage(candidate_groups(reps.select(F.col("cid").alias("doc_id"), "n_shingles", "sig"), percent), "groups")
    comp = stage(components(verified_links(groups, texts, reps, percent)), "components")
    # few classes have links, and fewer head a component: the doc_id of each head
    low = stage(comp.select("component").distinct().join(classes.select(F.col("cid").alias("component"), F.col("rep").alias("low")), "component"), "heads")
    comp = comp.join(small(low, BROADCAST_IDS), "component").withColumnRenamed("node", "cid")
    reached = classes.join(comp, "cid", "left").select("set_a", "set_b", "n_copies", F.coalesce("component", "cid").alias("component"), F.coalesce("low", "rep").alias("component_id"))
    out = signed.drop("sig").join(reached, ["set_a", "set_b"], "left")
    whole = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", "tx", "n_shingles", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("n_copies")), F.lit(1)).alias("n_copies"),
                      F.when(whole, F.col("component")).alias("component"), F.when(whole, F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, n_copies (rows with an equal set) for every row of ``docs``."""
    out = classified(docs, percent)
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"), "n_copies")


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: the one of the smallest doc_id, and if that has several texts there,
    of the smallest text hash; of rows equal in doc_id and text one stays.  Rows without a set or without a doc_id stay.

    Rows are told apart by (doc_id, text hash), so a text that is like no other stays whatever else its doc_id holds."""
    found = stage(classified(docs, percent).select("doc_id", "tx", "component", "component_id"), "found")
    others = found.where("component IS NOT NULL AND doc_id <> component_id").select("doc_id", "tx")
    heads = found.where("doc_id = component_id")
    several = stage(heads.groupBy("component").agg(F.min("tx").alias("low"), F.max("tx").alias("high")).where("low < high").select("component", "low"), "several")
    rest = heads.join(small(several, BROADCAST_IDS), "component").where("tx > low").select("doc_id", "tx")
    gone = stage(others.union(rest).distinct().select(F.col("doc_id").alias("__llm_id"), F.col("tx").alias("__llm_tx")), "gone")

    def is_in(t: DataFrame):
        return (docs["doc_id"] == t["__llm_id"]) & (F.xxhash64(docs["text"]) == t["__llm_tx"])

    left = docs.join(small(gone, BROADCAST_IDS), is_in(gone), "left_anti")
    twice = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__llm_id"), F.col("tx").alias("__llm_tx")).agg(F.count(F.lit(1)).alias("__llm_n"))
    twice = stage(twice.where("__llm_n > 1").select("__llm_id", "__llm_tx"), "twice")
    if not twice.take(1):
        return left
    single = left.join(twice, is_in(twice), "left_anti")
    return single.union(left.join(twice, is_in(twice), "left_semi").dropDuplicates(["doc_id", "text"]))
