"""Large JSON files read by many tasks: the entries of one object, or objects one behind the other.

A file is read as pieces parted at a byte that may part items (a comma between entries, an opening brace before objects), which lets Spark
split it anywhere.  Whether such a byte parts items depends on all bytes before it: on whether they leave a string open and on the depth of braces.
So the files are scanned twice:

1. each split is summed up for both cases, string closed or open at its start: quotes modulo two, the change of depth and its lowest
   value.  Splits are strung together by running sums over the splits of a file (one short row a split), which gives each its true start.
2. each split cuts its pieces into items.  Items inside one split go on as they are; only what stands before the first and behind the
   last cut of a split is shuffled, and put together by file.

The starts are broadcast: a row for each split beyond the first of a file, so one row for ``spark.sql.files.maxPartitionBytes`` of input (some
80 MB for 100 TB); files of one split need none.  One item must fit into a row; a file and an object may have any size.

Rows: file_path, place (from 0, in order within the file), item (text) and shut (whether the outermost brace is closed at its end).
Empty files have no items.  Closing braces too many are passed over.  In text that is no JSON the cuts fall somewhere, and the items
fail to parse where they are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_QUOTE, _BACKSLASH = 34, 92
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1


def _pieces(spark: SparkSession, root: str, parted: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", parted).text(root)
    return raw.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))


def _runs(batch: pa.RecordBatch):
    """(first row, last row + 1, file_path, block) of the rows of one split at a time; a split's rows follow each other."""
    n = batch.num_rows
    files, starts = batch.column("file_path").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
    edges = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
    edges = [0, *edges.tolist(), n] if n else [0]
    for i, j in zip(edges, edges[1:]):
        yield i, j, files[i], int(starts[i])


def _structure(values: list[bytes], parted: bytes, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places where the pieces begin, running quotes, change of depth at each byte) of the pieces with the parting byte before each, other than
    before the file's first."""
    sizes = np.array([len(v) + 1 for v in values], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(parted + parted.join(values), np.uint8)
    if first:  # the file's first piece has no parting byte before it: a blank stands there
        data = data.copy()
        data[0] = 32
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != _BACKSLASH, at, -1))
    before = np.concatenate([[-1], plain[:-1]])
    quote = (data == _QUOTE) & ((at - 1 - before) % 2 == 0)  # an even number of backslashes before it
    return begin, np.cumsum(quote), _DEPTH[data]


def _sum_up(parted: bytes):
    """Each split's quotes, and change and lowest value of depth for a closed (0) and an open (1) string at its start."""
    names = ["file_path", "block", "quotes", "d0", "low0", "d1", "low1"]

    def fn(batches):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_pydict(dict(zip(names, [[v] for v in (*key, *state)])))

        for batch in batches:
            values = batch.column("value").cast(pa.binary())
            for i, j, file, block in _runs(batch):
                fresh = key != (file, block)
                if fresh:
                    if key is not None:
                        yield row()
                    key, state = (file, block), [0, 0, 0, 0, 0]
                _, quotes, depth = _structure(values.slice(i, j - i).to_pylist(), parted, fresh and block == 0)
                odd = (state[0] + quotes) % 2 == 1
                for open_at_start in (0, 1):
                    run = np.cumsum(np.where(odd == bool(open_at_start), depth, 0))
                    state[2 + 2 * open_at_start] = min(state[2 + 2 * open_at_start], state[1 + 2 * open_at_start] + int(run.min()))
                    state[1 + 2 * open_at_start] += int(run[-1])
                state[0] = (state[0] + int(quotes[-1])) % 2
        if key is not None:
            yield row()

    return fn


def _starts(pieces: DataFrame, parted: bytes) -> DataFrame:
    """file_path, block, open, depth_sum and depth_low (lowest sum so far) at the start of every split beyond a file's first."""
    sums = pieces.mapInArrow(_sum_up(parted), "file_path string, block bigint, quotes bigint, d0 bigint, low0 bigint, d1 bigint, low1 bigint")
    earlier = W.partitionBy("file_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    true = sums.withColumn("open", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2) \
        .withColumn("d", F.when(F.col("open") == 1, F.col("d1")).otherwise(F.col("d0"))).withColumn("low", F.when(F.col("open") == 1, F.col("low1")).otherwise(F.col("low0")))
    true = true.withColumn("depth_sum", F.coalesce(F.sum("d").over(earlier), F.lit(0)))
    true = true.withColumn("depth_low", F.coalesce(F.min(F.col("depth_sum") + F.col("low")).over(earlier), F.lit(0)))
    return true.where("block > 0").select("file_path", "block", "open", "depth_sum", "depth_low")


def _cut(parted: bytes, level: int):
    """Items of each split: file_path, block, number (0: what stands before the first cut), item, shut, and whether it may go on (``last``)."""
    names = ["file_path", "block", "number", "item", "shut", "last"]

    def fn(batches):
        key, state, held, number, shut = None, None, [], 0, False

        def rows(file, block, found, last):
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * len(found), pa.string()), pa.array([block] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.binary()).view(pa.string()), pa.array([f[2] for f in found], pa.bool_()), pa.array([last] * len(found), pa.bool_())], names=names)

        for batch in batches:
            values = batch.column("value").cast(pa.binary())
            for i, j, file, block in _runs(batch):
                fresh = key != (file, block)
                if fresh:
                    if key is not None:
                        yield rows(*key, [(number, b"".join(held), shut)], True)
                    key, held, number = (file, block), [], 0
                    state = [int(batch.column(c)[i].as_py()) for c in ("open", "depth_sum", "depth_low")]
                own = values.slice(i, j - i).to_pylist()
                first = fresh and block == 0
                begin, quotes, depth = _structure(own, parted, first)
                change = np.where((state[0] + quotes) % 2 == 1, 0, depth)
                run = state[1] + np.cumsum(change)
                low = np.minimum(state[2], np.minimum.accumulate(run))  # a closing brace too many doesn't count
                deep = run - np.minimum(low, 0)
                odd = (state[0] + quotes) % 2
                before = np.concatenate([[state[1] - min(state[2], 0)], deep[begin[1:] - 1]])
                closed = np.concatenate([[state[0] % 2 == 0], odd[begin[1:] - 1] == 0])
                cuts = np.flatnonzero(closed & (before == level))
                cuts = cuts[cuts > 0] if first else cuts
                if first:
                    held.append(own[0])
                found, at = [], int(first)
                for c in cuts.tolist():
                    held += [parted + v for v in own[at:c]]
                    found.append((number, b"".join(held), bool(before[c] == 0)))
                    held, number, at = [], number + 1, c
                held += [parted + v for v in own[at:]]
                state = [(state[0] + int(quotes[-1])) % 2, int(run[-1]), int(low[-1])]
                shut = bool(state[0] == 0 and deep[-1] == 0)
                if found:
                    yield rows(file, block, found, False)
        if key is not None:
            yield rows(*key, [(number, b"".join(held), shut)], True)

    return fn


def read_items(spark: SparkSession, root: str, parted: str, level: int) -> DataFrame:
    """Items that begin at a byte ``parted`` outside strings at depth ``level`` of braces and brackets; a file's first begins with the file."""
    byte = parted.encode()
    pieces = _pieces(spark, root, parted)
    known = pieces.join(F.broadcast(_starts(pieces, byte)), ["file_path", "block"], "left") \
        .select("value", "file_path", "block", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("open", "depth_sum", "depth_low")))
    cut = known.mapInArrow(_cut(byte, level), "file_path string, block bigint, number bigint, item string, shut boolean, last boolean")
    loose = (F.col("number") == 0) & (F.col("block") > 0) | F.col("last")
    # an item is named by its number in the file: those of earlier splits, and its own in its split
    offset = cut.where("last").select("file_path", "block", (F.coalesce(F.sum("number").over(W.partitionBy("file_path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)),
                                                                       F.lit(0))).alias("offset"))
    offset = F.broadcast(offset.where("block > 0"))

    def placed(rows):
        return rows.join(offset, ["file_path", "block"], "left").withColumn("place", F.col("number") + F.coalesce("offset", F.lit(0)))

    whole = placed(cut.where(~loose)).select("file_path", "place", "item", "shut")
    parts = F.array_sort(F.collect_list(F.struct("block", "item", "shut")))
    put = placed(cut.where(loose)).groupBy("file_path", "place").agg(parts.alias("p")) \
        .select("file_path", "place", F.array_join("p.item", "").alias("item"), F.element_at("p", -1)["shut"].alias("shut"))
    return whole.unionByName(put)
