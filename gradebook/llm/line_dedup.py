"""Line de-duplication over all documents by a deletion-neighbourhood join (edit bound 1), DataFrame functions only.

A line is a ``\\n``-split piece of a text; it is compared in lower case without outer spaces.  An occurrence is dropped when an
earlier one, by (doc_id, text hash, line number), is equal to it, or, of lines of ``MIN_CHARS`` characters and more, within
one inserted, deleted or changed character (one edit makes another word of a shorter line).

The neighbourhood of a line of length L holds the line itself (``D`` key, met by longer lines with one character
deleted) and the line without character p, for each p, filed with p (``S`` key, met by lines that differ in character p
alone).  Lines under one ``S`` key are all within one edit of each other, and under a ``D`` key the one line in full is
within one edit of every longer one; so the earliest partner is a plain minimum, and no pairs of a group are made.

Emitting L keys for each line would be L * L characters of hashing, so keys are emitted coarse to fine, and only lines
that share a coarse key with another line go on; each level keeps every pair within the bound:

0. halves: of two lines whose shorter one has m characters, the first m // 2 or the last m - m // 2 are equal;
1. ``BLOCKS`` blocks: all before and all after the block holding the edit is equal;
2. the characters of the surviving blocks only.

Each drop is verified by ``levenshtein`` on the two lines themselves.

Defined results: null, empty and blank lines are never dropped.  A null doc_id sorts first.  Rows that are equal in
doc_id and text share their keys: their lines are dropped or kept alike.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stage

MIN_CHARS = 20
BLOCKS = 64
NOT_BLANK = r"[^\x20\x09-\x0D]"
SMALL_ROWS = 1_000_000   # up to so many narrow rows (under 100 bytes each) a side of a join is broadcast


def _half_keys(norm: str = "norm") -> list[str]:
    """Four keys: for m = length and length - 1, the first m div 2 and the last m - m div 2 characters."""
    out = []
    for m in ("length({0})", "(length({0}) - 1)"):
        m = m.format(norm)
        out.append(f"xxhash64('p', {m}, left({norm}, {m} div 2))")
        out.append(f"xxhash64('s', {m}, right({norm}, {m} - {m} div 2))")
    return out


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, ta (hash of the text), line_no (from 0) and norm of every line that isn't blank."""
    # hashed below the explode: beside it, the whole text would be hashed again for every line
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("ta")) \
        .select("doc_id", "ta", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(NOT_BLANK)) \
        .select("doc_id", "ta", "line_no", F.lower(F.trim("line")).alias("norm"))


def _place(prefix: str = ""):
    return F.struct(*(F.col(prefix + c) for c in ("doc_id", "ta", "line_no")))


def distinct_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences by 128-bit line key, and one row for each distinct line: first place, half keys (null for lines compared exactly)."""
    own = lines(docs).select("doc_id", "ta", "line_no", F.xxhash64("norm").alias("ha"), F.xxhash64(F.lit(1), F.col("norm")).alias("hb"),
                             *(F.when(F.length("norm") >= MIN_CHARS, F.expr(k)).alias(f"k{i}") for i, k in enumerate(_half_keys())))
    one = own.groupBy("ha", "hb").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"),
                                      *(F.min(f"k{i}").alias(f"k{i}") for i in range(4)))
    return own.select("doc_id", "ta", "line_no", "ha", "hb"), one


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key another distinct line has too."""
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key)
    return rows.join(often, key, "left_semi")


def near_partners(docs: DataFrame, one: DataFrame) -> DataFrame:
    """(ha, hb, near): for each distinct line with a partner one edit away that stands earlier, the earliest such place."""
    keys = F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("key")
    one = one.where("k0 IS NOT NULL")
    often = stage(one.select(keys).groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key"), "half_keys")
    some = one.select("ha", "hb", "first", keys).join(small(often, SMALL_ROWS), "key", "left_semi").select("ha", "hb", "first").distinct()
    some = stage(some, "half_members")
    # the text of those lines, read at their first place
    wanted = some.select(F.col("first").alias("at"), F.col("first.ta").alias("at_ta"), F.col("first.line_no").alias("at_line"))
    texts = lines(docs).where(F.length("norm") >= MIN_CHARS).join(small(wanted, SMALL_ROWS), F.expr("ta = at_ta AND line_no = at_line AND doc_id <=> at.doc_id"), "left_semi") \
        .select(F.xxhash64("norm").alias("ha"), F.xxhash64(F.lit(1), F.col("norm")).alias("hb"), "norm", _place().alias("first")).dropDuplicates(["ha", "hb"])
    texts = stage(texts, "half_texts")
    sized = texts.select("*", F.explode(F.array(F.length("norm"), F.length("norm") - 1)).alias("m")) \
        .withColumn("g", F.expr(f"CAST(ceil(m / {BLOCKS}D) AS INT)"))
    blocks = sized.select("*", F.explode(F.expr("sequence(0, m div g)")).alias("j")) \
        .withColumn("key", F.expr("xxhash64(m, j, left(norm, j * g), right(norm, greatest(0, m - (j + 1) * g)))"))
    live = _shared(blocks.select("ha", "hb", "m", "j", "key"), "key").select("ha", "hb", "m", "j")
    live = stage(live.join(texts, ["ha", "hb"]), "block_members").withColumn("g", F.expr(f"CAST(ceil(m / {BLOCKS}D) AS INT)"))
    at = live.select("*", F.explode(F.expr("filter(sequence(j * g, (j + 1) * g), x -> x < length(norm))")).alias("p"))
    short = at.where("m = length(norm)").select(
        "ha", "hb", "first", F.expr("xxhash64('S', m, p, left(norm, p), substr(norm, p + 2))").alias("key"), F.lit(True).alias("full"))
    whole = live.where("m = length(norm)").select("ha", "hb", "first", F.expr("xxhash64('D', norm)").alias("key"), F.lit(True).alias("full"))
    longer = at.where("m = length(norm) - 1").select(
        "ha", "hb", "first", F.expr("xxhash64('D', concat(left(norm, p), substr(norm, p + 2)))").alias("key"), F.lit(False).alias("full"))
    rows = stage(short.union(whole).union(longer).distinct(), "variants")
    best = rows.groupBy("key").agg(F.min(F.when(F.col("full"), F.col("first"))).alias("low_full"),
                                   F.min(F.when(~F.col("full"), F.col("first"))).alias("low_long"))
    # S keys hold full rows only; under a D key the full line meets the longer ones
    met = rows.join(best, "key").select(
        "ha", "hb", "first", F.when(F.col("full") & F.col("low_long").isNotNull(), F.least("low_full", "low_long")).otherwise(F.col("low_full")).alias("near"))
    found = met.where("near < first").groupBy("ha", "hb").agg(F.min("near").alias("near"))
    # verified on the lines themselves
    own = found.join(texts.select("ha", "hb", "norm"), ["ha", "hb"])
    other = texts.select(F.col("first").alias("near"), F.col("norm").alias("near_norm"))
    return own.join(other, "near").where(F.levenshtein("norm", "near_norm", 1) >= 0).select("ha", "hb", "near")


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """One row for each dropped line: doc_id, ta, line_no, the earliest place of an equal or near line, and edits (0 or 1)."""
    own, one = distinct_lines(docs)
    one = stage(one, "lines")
    low = one.join(near_partners(docs, one), ["ha", "hb"], "left").where("n > 1 OR near IS NOT NULL") \
        .select("ha", "hb", F.least("first", F.coalesce("near", "first")).alias("low"), (F.coalesce(F.col("near") < F.col("first"), F.lit(False))).cast("int").alias("edits"))
    met = own.join(small(stage(low, "dropped"), SMALL_ROWS), ["ha", "hb"]).where(F.col("low") < _place())
    return met.select("doc_id", "ta", "line_no", F.col("low.doc_id").alias("first_doc_id"), F.col("low.line_no").alias("first_line_no"), "edits")


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with duplicate lines cut out of text; rows that lose lines and are left with nothing or blank lines are dropped.

    Rows that lose no line come back as they are, empty ones included.
    """
    gone = duplicate_lines(docs).groupBy("doc_id", "ta").agg(F.collect_set("line_no").alias("__llm_gone")) \
        .withColumnRenamed("doc_id", "__llm_doc_id").withColumnRenamed("ta", "__llm_ta")
    joined = docs.join(stage(gone, "gone"), F.expr("doc_id <=> __llm_doc_id") & (F.xxhash64("text") == F.col("__llm_ta")), "left")
    # the numbers of the lines that stay by a set difference, so that the cut is linear in the lines of a document
    rest = F.expr("transform(array(split(text, '\\n', -1)), s -> "
                  "array_join(transform(array_except(sequence(0, size(s) - 1), __llm_gone), i -> s[i]), '\n'))[0]")
    text = F.when(F.col("__llm_gone").isNull(), F.col("text")).otherwise(rest)
    return joined.withColumn("text", text).where(F.col("__llm_gone").isNull() | F.col("text").rlike(NOT_BLANK)).select(*docs.columns)
