"""Evaluation tables derived from the driver tables (spec: FIXTURES.md §2).

The reference ships no sheets, so response / rating / judgement / article tables are derived
deterministically from ``orders``, ``conversations`` and ``documents``.  The derivations fan a
case out over small fixed dimensions (models, variants, temperatures, runs); that is written
as a single ``explode`` of a literal array (a Generate node, no join), so each derived view is
one narrow stage over the source scan and grows linearly with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import sqmod
from .tables import load_table

# Fixed values of the fixture design (FIXTURES.md §2).
MODELS = [(0, "m0"), (1, "m1"), (2, "m2"), (3, "m3"), (4, "m4"), (5, "m5")]
VARIANTS = [(0, "prompt1"), (1, "prompt2"), (2, "no_letter")]
TEMPS = [(1, 0.3), (2, 0.6), (3, 1.0)]
RUNS = list(range(1, 11))
OPTIONS = "ABCDE"
# Scrambler multipliers of the fixture design.
K_CASE, K_MODEL, K_VARIANT, K_TEMP, K_RUN = 7919, 104729, 1299709, 32452843, 15485863


def _letter(idx: Column) -> Column:
    """Option letter at 0-based index."""
    return F.element_at(F.array(*[F.lit(c) for c in OPTIONS]), (idx + 1).cast("int"))


def _answer(code: int, mid: int, tk: int | None) -> str:
    """The answer of one code; without a truth number the letter is the last one, before the first there is none (an empty cell)."""
    if code >= 17:
        return {17: "HALL", 18: "A-C"}.get(code, "NONE")
    if tk is None:
        return OPTIONS[-1]
    at = tk if code < mid + 6 else int(math.fmod(tk + 1 + code, 5))
    return OPTIONS[at] if at >= 0 else "" if at == -1 else OPTIONS[at + 1]


# the answers by code, model and truth number (-4 .. 4, then none), as one text: split, it is folded to a constant array
_ANSWERS = ",".join(_answer(code, mid, tk) for code in range(20) for mid, _ in MODELS for tk in [*range(-4, 5), None])


def _response(code: Column, tk: Column, mid: Column) -> Column:
    """Looked up, so that ``code`` stands in it once: a CASE over it would have its expression repeated in each branch wherever
    Catalyst merges projections or pushes a filter down."""
    at = (F.coalesce(code.cast("int"), F.lit(19)) * len(MODELS) + mid) * 10 + F.coalesce(tk + 4, F.lit(9)) + 1
    return F.element_at(F.split(F.lit(_ANSWERS), ","), at)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the source over at least the default parallelism.

    A small source file is a single scan task; the article jobs parse each text, so that work must not stay in that one task.  On a cluster the source already has many splits and this is a no-op.
    Results don't depend on it."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= target else df.repartition(target)


CASES_PER_TASK = 10_000   # a view makes up to 180 rows a case: the work of a task is bounded whatever the size of the table


SHEETS = ([t for _, t in TEMPS], [m for _, m in MODELS])   # (temperatures, models) of all repeated sheets


def n_cases(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``orders``, from the file footers."""
    return load_table(spark, sf_dir, "orders", []).count()


def case_tasks(spark: SparkSession, sf_dir: str, sheets=SHEETS) -> int:
    """Number of tasks for the case views: it grows with the rows of ``orders``.  ``sheets``: those that a view of some of the repeated
    sheets holds; its tasks have as many rows as those of the whole view."""
    share = len(sheets[0]) * len(sheets[1]) / (len(TEMPS) * len(MODELS))
    return max(spark.sparkContext.defaultParallelism, math.ceil(n_cases(spark, sf_dir) * share / CASES_PER_TASK))


def by_case(spark: SparkSession, sf_dir: str, columns: list[str], tasks: int | None = None) -> DataFrame:
    """``columns`` of ``orders``, dealt out by the case and in its order within a task.

    The views fan a case out after this, so all rows of a case are in one task already: an aggregate by the case and further keys
    needs no shuffle of the fanned-out rows.  The number of tasks is given, so AQE doesn't fold them."""
    o = load_table(spark, sf_dir, "orders", columns)
    return o.repartition(tasks or case_tasks(spark, sf_dir), "o_orderkey").sortWithinPartitions("o_orderkey")


def cases(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    o = by_case(spark, sf_dir, ["o_orderkey", "o_custkey"], tasks)
    tk = (F.col("o_custkey") % 5).cast("int")
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        tk.alias("tk"),
        _letter(tk).alias("truth"),
        (F.col("o_orderkey") % 3 == 0).alias("labs"),
        (F.col("o_orderkey") % 4 == 0).alias("has_table"),
    )


def responses_t0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-run sheets, long form: (case_id, model, variant, truth, labs, response)."""
    dims = F.array(*[
        F.struct(F.lit(mid).alias("mid"), F.lit(m).alias("model"), F.lit(vid).alias("vid"), F.lit(v).alias("variant"))
        for mid, m in MODELS for vid, v in VARIANTS
    ])
    c = cases(spark, sf_dir).select("case_id", "tk", "truth", "labs", F.explode(dims).alias("d"))
    code = sqmod(F.col("case_id") * K_CASE + F.col("d.mid") * K_MODEL + F.col("d.vid") * K_VARIANT) % 20
    # the scrambled code is referenced by every CASE branch: compute it once in its own projection
    c = c.select("case_id", "tk", "truth", "labs", F.col("d.mid").alias("mid"), F.col("d.model").alias("model"),
                 F.col("d.variant").alias("variant"), code.alias("code"))
    return c.select(
        "case_id", "model", "variant", "truth", "labs",
        _response(F.col("code"), F.col("tk"), F.col("mid")).alias("response"),
    )


def responses_rep(spark: SparkSession, sf_dir: str, of: DataFrame | None = None, extra: tuple[str, ...] = (), only=SHEETS) -> DataFrame:
    """Repeated sheets, long form: (case_id, model, temperature, run, truth, response); 180 rows per case.

    ``of``: the cases, if they are at hand with further columns; those named in ``extra`` come along.  ``only``: temperatures and models
    of the sheets that are read."""
    models = F.array(*[F.struct(F.lit(mid).alias("mid"), F.lit(m).alias("model")) for mid, m in MODELS if m in only[1]])
    sheets = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.lit(run).alias("run"), F.lit(tid * 2 + 2).alias("open"),
                                F.lit(tid * K_TEMP + run * K_RUN).alias("step")) for tid, t in TEMPS if t in only[0] for run in RUNS])
    c = (cases(spark, sf_dir, case_tasks(spark, sf_dir, only)) if of is None else of).select("case_id", "tk", "truth", *extra, F.explode(models).alias("m"))
    # what depends on the case and the model is worked out before the sheets are fanned out
    base = F.col("case_id") * K_CASE + F.col("m.mid") * K_MODEL
    c = c.select("case_id", "tk", "truth", *extra, "m.mid", "m.model", base.alias("base"), (sqmod(base) % 20).alias("code0"))
    c = c.select("case_id", "tk", "truth", *extra, "mid", "model", "base", "code0", F.explode(sheets).alias("s"))
    step = F.col("base") + F.col("s.step")
    code = F.when(sqmod(step + 17) % 10 < F.col("s.open"), sqmod(step) % 20).otherwise(F.col("code0"))
    return c.select("case_id", "model", "s.temperature", "s.run", "truth", _response(code, F.col("tk"), F.col("mid")).alias("response"), *extra)


def responses_machine2(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses_t0(spark, sf_dir).filter(F.col("variant") == "prompt1")
    return r.select("case_id", "model", "truth",
                    F.when(F.col("case_id") % 9 == 0, F.lit("B")).otherwise(F.col("response")).alias("response"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likert ratings, long form: (case_id, model, evaluator, metric, score DOUBLE)."""
    o = by_case(spark, sf_dir, ["o_orderkey", "o_orderpriority"])
    dims = F.array(*[
        F.struct(F.lit(mid).alias("mid"), F.lit(m).alias("model"), F.lit(e).alias("eid"), F.lit(k).alias("kid"))
        for mid, m in MODELS if mid < 2 for e in (1, 2) for k in (1, 2, 3, 4, 5)
    ])
    x = o.select("o_orderkey", "o_orderpriority", F.explode(dims).alias("d"))
    h = sqmod(F.col("o_orderkey") * K_CASE + F.col("d.mid") * K_MODEL + F.col("d.eid") * K_VARIANT + F.col("d.kid") * K_RUN)
    base = F.substring("o_orderpriority", 1, 1).cast("int")
    x = x.select(F.col("o_orderkey").alias("case_id"), F.col("d.model").alias("model"),
                 F.concat(F.lit("user"), F.col("d.eid").cast("string")).alias("evaluator"),
                 F.concat(F.lit("metric"), F.col("d.kid").cast("string")).alias("metric"),
                 base.alias("base"), h.alias("h"))
    adj = F.when(F.col("h") % 10 == 0, -1).when(F.col("h") % 10 < 3, 1).otherwise(0)
    score = F.when(F.col("h") % 97 == 0, F.lit(None)).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.col("base") + adj)))
    return x.select("case_id", "model", "evaluator", "metric", score.cast("double").alias("score"))


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses_t0(spark, sf_dir).filter(F.col("model").isin("m0", "m1") & F.col("variant").isin("prompt1", "prompt2"))
    r = r.select("case_id", "model", "variant", F.explode(F.array(F.lit(1), F.lit(2))).alias("truth_position"))
    h = sqmod(F.col("case_id") * K_CASE + F.col("truth_position") * K_MODEL
              + F.ascii(F.substring("model", 2, 1)) * K_VARIANT + F.ascii(F.substring("variant", 7, 1)) * K_RUN)
    r = r.select("case_id", "model", "variant", "truth_position", h.alias("h"))
    return r.select(
        "case_id", "model", "variant", "truth_position",
        F.when(F.col("h") % 10 < 5, 1).when(F.col("h") % 10 < 9, 2).alias("preferred"),
        F.when(F.col("h") % 23 == 0, F.lit(None)).otherwise(F.col("h") % 6).cast("double").alias("agreement"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question bank (one row per case).  ``cases`` is a projection of ``orders`` so no join is needed."""
    o = load_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"])
    truth = _letter((F.col("o_custkey") % 5).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("case_id"),
        F.col("o_orderkey").cast("string").alias("case_key"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("")).otherwise(F.concat(F.lit("Case "), F.col("o_orderpriority"))).alias("case_text"),
        F.concat(F.lit("Which option fits customer "), F.col("o_custkey").cast("string"), F.lit("?")).alias("question"),
        F.lit("A. alpha; B. beta; C. gamma; D. delta; E. epsilon.").alias("options"),
        F.concat(truth, F.lit(". answer")).alias("answer"),
        F.concat(F.lit("Because of "), F.col("o_orderstatus")).alias("explanation"),
        F.when(F.col("o_orderkey") % 3 == 0, "Yes").otherwise("No").alias("labs"),
        F.when(F.col("o_orderkey") % 4 == 0, "Yes").otherwise("No").alias("has_table"),
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated outputs: user turn + the next assistant turn; join on the unique (conv_id, turn) key."""
    conv = load_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("u_text"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a_text"))
    j = u.join(a, ["conv_id", "turn"])
    fname = F.concat(
        F.lit("m"), (F.col("conv_id") % 6).cast("string"), F.lit("_promptID_00"), (F.col("turn") % 2 + 1).cast("string"),
        F.lit("_output_"), (F.col("conv_id") % 11).cast("string"), F.lit(".json"))
    return j.select("conv_id", "turn", fname.alias("file_name"),
                    F.concat(F.lit("START "), F.col("u_text"), F.lit(" END"), F.col("a_text")).alias("text"))


# One text for Spark and DuckDB: an article of either database for each document, its whole text inside.  Every 17th is cut off
# (not well-formed), prefixes and &nbsp; are undeclared as in the wild, sections nest, figures stand inside paragraphs.
_ID = "CAST(doc_id AS STRING)"
_ESCAPED = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), chr(10), ' ')"
ARTICLE_XML = f"""CASE WHEN doc_id % 4 = 0 THEN
  '<PubmedArticle><MedlineCitation><PMID>' || CAST(doc_id + 1000 AS STRING) || '</PMID><Article><ArticleTitle>' || coalesce(lang, '') || ' ' || coalesce(source, '') || '</ArticleTitle>'
  || CASE WHEN doc_id % 8 = 0 THEN '<Abstract><AbstractText Label="AIM" NlmCategory="OBJECTIVE">' || {_ESCAPED} || '</AbstractText><AbstractText>rest</AbstractText>'
     || CASE WHEN doc_id % 5 = 0 THEN '<CopyrightInformation>(c) ' || {_ID} || '</CopyrightInformation>' ELSE '' END || '</Abstract>' ELSE '' END
  || '</Article><ArticleIdList>' || CASE WHEN doc_id % 3 = 0 THEN '<ArticleID IdType="doi">10.5555/' || {_ID} || '</ArticleID>' ELSE '' END
  || '<ArticleID IdType="pmc">PMC' || {_ID} || '</ArticleID></ArticleIdList></MedlineCitation>' || CASE WHEN doc_id % 17 = 0 THEN '' ELSE '</PubmedArticle>' END
ELSE
  '<article><front><article-meta><article-id pub-id-type="pmid">' || CAST(doc_id + 1000 AS STRING) || '</article-id>'
  || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '<article-id pub-id-type="pmc"> PMC' || {_ID} || ' </article-id>' END
  || CASE WHEN doc_id % 3 = 0 THEN '<article-id pub-id-type="doi">10.5555/' || {_ID} || '</article-id>' ELSE '' END
  || '<title-group><article-title>' || coalesce(lang, '') || ' <italic>' || coalesce(source, '') || '</italic></article-title></title-group>'
  || CASE WHEN doc_id % 5 = 0 THEN '<permissions><copyright-statement> (c) ' || {_ID} || ' </copyright-statement><license license-type="cc-by-' || CAST(doc_id % 2 AS STRING)
     || '"><ext-link ext-link-type="uri" xlink:href="https://licence.example/' || {_ID} || '">terms</ext-link></license></permissions>' ELSE '' END
  || CASE WHEN doc_id % 3 = 1 THEN '<abstract><sec id="a1"><title>Aim</title><p>aim ' || {_ID} || '</p></sec><p>closing</p></abstract>' ELSE '' END
  || '</article-meta></front>'
  || CASE WHEN doc_id % 13 = 0 THEN '' ELSE '<body><p>Lead [<xref>1</xref>-<xref>3</xref>] text</p><sec id="s1"><title>Methods</title><p>' || {_ESCAPED}
     || ' (<xref rid="r1">2</xref>)</p><sec id="s1.1"><title>Sample</title><p>before <fig><label>F1</label></fig>after the figure</p></sec></sec>'
     || '<sec id="s2"><p>tail</p></sec><table-wrap><td>t</td></table-wrap><sec id="s1"><title>Results</title><p>done&nbsp;now</p></sec></body>' END
  || CASE WHEN doc_id % 17 = 0 THEN '' ELSE '</article>' END
END"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(load_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]))
    return d.select(
        F.when(F.col("doc_id") % 4 == 0, "pubmed").otherwise("pmc").alias("db"),
        (F.lit(2018) + F.col("doc_id") % 5).cast("int").alias("year"),
        "doc_id", F.expr(ARTICLE_XML).alias("xml"))


VIEWS = {
    "cases": cases, "responses_t0": responses_t0, "responses_rep": responses_rep,
    "responses_machine2": responses_machine2, "ratings": ratings, "judgements": judgements,
    "questions": questions, "generations": generations, "articles": articles,
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return VIEWS[name](spark, sf_dir)
