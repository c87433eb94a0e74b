"""Quality rules, line first (DataFrame functions only).

Every line that holds a word is held against the rules below; failing lines are cut, and a document is rejected when
the base rules fail, or when the cut takes more than ``MAX_LOSS`` of its word characters.

Line rules, each a share or count over the line's own characters and words:

* symbols: at least ``SYMBOL_SHARE`` of the words end in or consist of ``# * $ % & | < >``;
* navigation: at least ``MENU_MARKS`` separators ``|`` or ``>`` standing alone, that make up ``MENU_SHARE`` of the words;
* shouting: at least ``MIN_LINE_WORDS`` words of which ``SHOUT_SHARE`` end in ``!!`` (or ``??``);
* repetition: at least ``MIN_LINE_WORDS`` words of which at most ``DISTINCT_SHARE`` are distinct;
* boilerplate: licence, cookie, sign-in and rights phrases of ``BOILERPLATE``.

Base figures: words ``[^\\x20\\x09-\\x0D]+`` of the whole text; word_chars, n_symbols (``#*$%&|<>``), n_dup_lines (lines with
a word, equal to an earlier line), n_repeat_words (words inside a five-word window that stands twice or more).

Defined results: null, empty and blank texts have no words, fail the base rules and are not kept.  Nothing is joined or
shuffled, so equal rows give equal results and other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOSS = 0.4

MIN_LINE_WORDS = 5
SYMBOL_SHARE = 0.4
MENU_MARKS, MENU_SHARE = 3, 0.3
SHOUT_SHARE = 0.5
DISTINCT_SHARE = 0.2
# fixed values: phrases of boilerplate lines
BOILERPLATE = ("all rights reserved", "licensed under", "terms of service", "privacy policy", "cookie policy", "accept cookies",
               "click here", "sign in to", "log in to", "subscribe to our", "permission is hereby granted")


def words(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _count_chars(text, chars: str):
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(name: str = "_words"):
    """Words covered by five-word windows found twice or more; the sort runs only where some window repeats."""
    return F.expr(f"""CASE WHEN size({name}) < 6 THEN 0L
        WHEN size(array_distinct(_windows)) = size(_windows) THEN 0L
        ELSE aggregate(
            sort_array(flatten(transform(array(sort_array(transform(_windows, (h, i) -> struct(h, i)))), s ->
                transform(filter(s, (x, i) -> (i > 0 AND s[i - 1].h = x.h) OR (i < size(s) - 1 AND s[i + 1].h = x.h)), x -> x.i)))),
            named_struct('n', 0L, 'to', 0L),
            (a, p) -> named_struct('n', a.n + least(5L, p + 5L - a.to), 'to', p + 5L), a -> a.n) END""")


def base_figures(docs: DataFrame) -> DataFrame:
    """doc_id, text, lines with a word, and the base figures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("_words", words(F.col("text")))
    rows = rows.withColumn("_windows", F.expr(
        "transform(sequence(0, greatest(size(_words) - 5, 0)), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2), get(_words, i + 3), get(_words, i + 4)))"))
    rows = rows.withColumn("_lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)))
    return rows.select(
        "doc_id", "text", "_lines", F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"), _count_chars(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeat_words().alias("n_repeat_words"))


def line_fails(x):
    """True where a line fails one of the rules; ``x`` has the line in lower case and its words."""
    own, n = x["words"], F.size(x["words"])
    last = lambda w: F.substring(w, -1, 1)
    marked = F.size(F.filter(own, lambda w: last(w).isin(*SYMBOLS)))
    marks = F.size(F.filter(own, lambda w: w.isin("|", ">")))
    shouts = F.size(F.filter(own, lambda w: w.endswith("!!") | w.endswith("??")))
    phrase = reduce(lambda a, b: a | b, (F.contains(x["low"], F.lit(p)) for p in BOILERPLATE))
    return (n > 0) & ((marked >= SYMBOL_SHARE * n) | ((marks >= MENU_MARKS) & (marks >= MENU_SHARE * n))
                      | ((n >= MIN_LINE_WORDS) & ((shouts >= SHOUT_SHARE * n) | (F.size(F.array_distinct(own)) <= DISTINCT_SHARE * n))) | phrase)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, base figures, base_failed, n_lines, n_cut_lines, loss, clean (the text without failing lines) and kept."""
    rows = base_figures(docs).withColumn("_own", F.transform("_lines", lambda x: F.struct(x.alias("line"), F.lower(x).alias("low"), words(x).alias("words"))))
    rows = rows.withColumn("_kept", F.transform(F.filter("_own", lambda x: ~line_fails(x)), lambda x: x["line"]))
    left = F.length(F.translate(F.array_join("_kept", "\n"), WHITE, ""))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    loss = F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(F.lit(0.0))
    rows = rows.select("*", failed.alias("base_failed"), loss.alias("loss"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       (~F.col("base_failed") & (F.col("loss") <= MAX_LOSS)).alias("kept"), F.size("_lines").cast("long").alias("n_lines"),
                       (F.size("_lines") - F.size("_kept")).cast("long").alias("n_cut_lines"), "loss", F.array_join("_kept", "\n").alias("clean"))
