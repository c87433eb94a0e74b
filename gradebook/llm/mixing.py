"""Mixing sources to target weights by Pfair scheduling, DataFrame functions only.

A source's documents, in a fixed pseudo-random order, are cut into blocks of ``BLOCK_DOCS``.  With weight a / Q, block k of
a source is released at slot floor(k Q / a) and due by slot ceil((k + 1) Q / a).  Each slot goes to the released block
with the earliest deadline (ties: the source that sorts first), which meets every deadline, so after any number of
slots a source is less than one block away from its share.

The schedule repeats every Q slots, each source having a of them.  One period is made by a fold over its slots, ``CHUNK`` at a time; block
k of a source takes period k div a and its place k mod a there.  So documents only need their number within the source, which
comes from counts of hashed buckets, summed up in two levels, and a rank inside each bucket: no source, however large, is
ranked or summed up in one task.

The weights are whole numbers, by default the square root of a source's rows, and are kept exactly while they come to at most ``UNITS``
in all (four sources of 250 million rows each, for one).  Beyond that they are scaled to ``UNITS`` slots: a weight is then off by less
than 1 / ``UNITS`` of the whole, or is raised to one slot.  Given weights are never scaled.

A source that runs out leaves its further slots empty; ``in_mix`` marks the rows before the first such slot, for which
the weights hold to less than one block.  No row is dropped.

Defined results: a null source is a source of its own, before all others.  Null doc_id: ranked first in its source.
Equal doc_ids get neighbouring numbers in no fixed order.  Empty documents: empty result.  A source missing from given
``weights`` gets one unit; weights are whole numbers of at least 1.  Other columns pass through unread; one that bears
the name of an added column is replaced by it.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stage

BLOCK_DOCS = 8
UNITS = 65_536     # slots of a period up to which default weights stay as they are
CHUNK = 256        # slots folded at once: an appended array is never longer
BROADCAST_SOURCES = 10_000  # up to so many sources the period table is broadcast, beyond it is an ordinary join
ADDED = ("units", "block", "slot", "release", "deadline", "position", "in_mix")
DIGITS, HEAD = 4, 2  # hex digits of the bucket inside a source, and of those by which buckets are summed up first

_SOURCE = "CASE WHEN source IS NULL THEN '' ELSE concat('=', source) END"
_ORDER = "md5(coalesce(CAST(doc_id AS STRING), ''))"


def units(docs: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """One row: ``u``, the sources in order with rows n and slots a of a period, and Q.  By default a source's weight goes with
    the square root of its rows, which lifts small sources without forgetting large ones."""
    counts = docs.groupBy(F.expr(_SOURCE).alias("__mix_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        raw = F.expr("greatest(1L, CAST(floor(sqrt(n)) AS BIGINT))")
    else:
        given = F.from_json(F.lit(json.dumps({"=" + k: int(v) for k, v in weights.items()})), "map<string,bigint>")
        raw = F.greatest(F.lit(1).cast("bigint"), F.coalesce(F.element_at(given, F.col("__mix_source")), F.lit(1).cast("bigint")))
    one = counts.select("__mix_source", "n", raw.alias("r")).agg(F.array_sort(F.collect_list(F.struct("__mix_source", "n", "r"))).alias("s"))
    one = one.withColumn("t", F.expr("aggregate(s, 0L, (t, y) -> t + y.r)"))
    scale = f"IF(t <= {UNITS}L, x.r, {UNITS}L * x.r div t)" if weights is None else "x.r"
    one = one.select(F.expr(f"transform(s, x -> named_struct('source', x.__mix_source, 'n', x.n, 'a', greatest(1L, {scale})))").alias("u"))
    return one.select("u", F.expr("aggregate(u, 0L, (t, y) -> t + y.a)").alias("q"))


def period(one: DataFrame) -> DataFrame:
    """source, a, Q, k (which of its slots), slot, release and deadline for each slot of the period."""
    pick = """array_min(transform(u, (x, i) -> IF(acc.used[i] < x.a AND acc.used[i] * q div x.a <= t,
                  named_struct('due', ((acc.used[i] + 1) * q + x.a - 1) div x.a, 'i', i), NULL)))"""
    nothing = "CAST(array() AS ARRAY<STRUCT<i: INT, k: BIGINT, slot: BIGINT, due: BIGINT>>)"
    chunk = f"""aggregate(sequence(c * {CHUNK}L, least(q, (c + 1) * {CHUNK}L) - 1), named_struct('used', done.used, 'slots', {nothing}),
        (acc, t) -> transform(array({pick}), b -> named_struct(
            'used', transform(acc.used, (x, i) -> IF(i = b.i, x + 1L, x)),
            'slots', concat(acc.slots, array(named_struct('i', b.i, 'k', acc.used[b.i], 'slot', t, 'due', b.due)))))[0])"""
    fold = f"""aggregate(sequence(0L, (q - 1) div {CHUNK}L), named_struct('used', transform(u, x -> 0L), 'slots', CAST(array() AS ARRAY<ARRAY<STRUCT<i: INT, k: BIGINT, slot: BIGINT, due: BIGINT>>>)),
        (done, c) -> transform(array({chunk}), n -> named_struct('used', n.used, 'slots', concat(done.slots, array(n.slots))))[0], done -> flatten(done.slots))"""
    rows = one.where("q > 0").select("u", "q", F.explode(F.expr(fold)).alias("x"))
    return rows.select(F.expr("u[x.i].source").alias("__mix_source"), F.expr("u[x.i].n").alias("__mix_n"), F.expr("u[x.i].a").alias("__mix_a"), F.col("q").alias("__mix_q"),
                       F.col("x.k").alias("__mix_k"), F.col("x.slot").alias("__mix_slot"))


def _before(counts: DataFrame) -> DataFrame:
    """Rows of a source in the buckets before each: inside the buckets of equal first digits, and before those."""
    counts = stage(counts.withColumn("__mix_head", F.substring("__mix_bucket", 1, HEAD)), "buckets")
    heads = counts.groupBy("__mix_source", "__mix_head").agg(F.sum("__mix_in").alias("h"))
    heads = heads.select("__mix_source", "__mix_head", (F.sum("h").over(W.partitionBy("__mix_source").orderBy("__mix_head")) - F.col("h")).alias("h"))
    inside = F.sum("__mix_in").over(W.partitionBy("__mix_source", "__mix_head").orderBy("__mix_bucket")) - F.col("__mix_in")
    return counts.select("__mix_source", "__mix_head", "__mix_bucket", inside.alias("b")).join(heads, ["__mix_source", "__mix_head"]) \
        .select("__mix_source", "__mix_bucket", (F.col("h") + F.col("b")).alias("__mix_before"))


def mix_sources(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` with units, block, slot, release, deadline, position (order of the mix) and in_mix."""
    rows = docs.withColumn("__mix_source", F.expr(_SOURCE)).withColumn("__mix_order", F.expr(_ORDER)).withColumn("__mix_bucket", F.substring("__mix_order", 1, DIGITS))
    counts = rows.groupBy("__mix_source", "__mix_bucket").agg(F.count(F.lit(1)).alias("__mix_in"))
    before = _before(counts)
    rank = F.row_number().over(W.partitionBy("__mix_source", "__mix_bucket").orderBy("__mix_order", "doc_id"))
    slots = period(units(docs, weights))
    numbered = rows.withColumn("__mix_rank", rank).join(before, ["__mix_source", "__mix_bucket"]).withColumn("__mix_number", F.col("__mix_before") + F.col("__mix_rank") - 1) \
        .withColumn("__mix_block", F.expr(f"__mix_number div {block_docs}"))
    own = slots.groupBy("__mix_source").agg(F.max("__mix_a").alias("__mix_a"), F.max("__mix_q").alias("__mix_q"), F.max("__mix_n").alias("__mix_n"),
                                       F.array_sort(F.collect_list(F.struct("__mix_k", "__mix_slot"))).alias("__mix_slots"))
    slot = "(({0}) div __mix_a) * __mix_q + __mix_slots[CAST(({0}) % __mix_a AS INT)].__mix_slot"
    own = stage(own.withColumn("__mix_end", F.min(F.expr(slot.format(f"(__mix_n + {block_docs - 1}) div {block_docs}"))).over(W.partitionBy(F.lit(0)))), "period")
    placed = numbered.join(small(own, BROADCAST_SOURCES), "__mix_source").withColumn("__mix_place", F.expr(slot.format("__mix_block")))
    own_columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED]
    return placed.select(
        *own_columns, F.col("__mix_a").alias("units"), F.col("__mix_block").alias("block"), F.col("__mix_place").alias("slot"),
        F.expr("__mix_block * __mix_q div __mix_a").alias("release"), F.expr("((__mix_block + 1) * __mix_q + __mix_a - 1) div __mix_a").alias("deadline"),
        F.expr(f"__mix_place * {block_docs} + __mix_number % {block_docs}").alias("position"), (F.col("__mix_place") < F.col("__mix_end")).alias("in_mix"))
