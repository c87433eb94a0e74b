"""Catalogue: article corpus."""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import functions as F

from ..operators import corpus as C
from ..operators.landing import append_metadata, metadata_table
from ..operators.prompts import upsert_latest
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources.tables import load_table
from ..streaming.landing_stream import SECTION_KEY, current_sections, run_metadata_stream, run_sections_stream
from .catalog import register

# Fixed value: the literature query the corpus was searched with (one term per year is derived from it).
BASE_QUERY = ('("Type 1 Diabetes"[Title/Abstract] OR "T1D"[Title/Abstract]) AND ("Pediatric"[Title/Abstract] OR '
              '"Pediatrics"[Title/Abstract] OR "Neonate"[Title/Abstract] OR "Neonates"[Title/Abstract] OR "Infant"[Title/Abstract] OR '
              '"Infants"[Title/Abstract] OR "Children"[Title/Abstract] OR "Adolescent"[Title/Abstract] OR "Adolescents"[Title/Abstract]) '
              'AND ("open access"[filter])')


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@register("clean_xrefs", views=("articles",), sql=f"""SELECT doc_id,
  regexp_replace(regexp_replace(xml, {_sq(C.XREF_WITH_BRACKETS)}, '', 'g'), {_sq(C.XREF_STANDALONE)}, '', 'g') AS xml_clean FROM articles""")
def clean_xrefs(spark, sf):
    """Citation xrefs with their brackets and separators removed, then any remaining xref."""
    return fx.articles(spark, sf).select("doc_id", C.clean_xrefs(F.col("xml")).alias("xml_clean"))


def nfkd_sql(e: str) -> str:
    """DuckDB text: canonical decomposition of the Latin-1 letters, by rule (the texts hold no others)."""
    for code in range(0xA0, 0x100):
        to = unicodedata.normalize("NFKD", chr(code))
        if to != chr(code):
            e = f"replace({e}, {_sq(chr(code))}, {_sq(to)})"
    return e


def _canon_sql(e: str) -> str:
    return f"trim(regexp_replace({nfkd_sql(e)}, '[\\s\\x0B\\x1C-\\x1F]+', ' ', 'g'))"


@register("normalize_text", sql=f"SELECT doc_id, {_canon_sql('text')} AS text_norm FROM documents")
def normalize_text(spark, sf):
    """NFKD + whitespace collapse + strip over every whole document text (Python only for non-ASCII texts)."""
    d = load_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", C.normalize_text(F.col("text")).alias("text_norm"))


def _got(pattern: str, group: int = 1, default: str = "'N/A'") -> str:
    """First match of a pattern in the document, without its tags, or the default where there is none."""
    return (f"CASE WHEN regexp_matches(xml, {_sq(pattern)}) THEN trim(regexp_replace(regexp_extract(xml, {_sq(pattern)}, {group}), '<[^>]*>', '', 'g')) "
            f"ELSE {default} END")


_CLOSED = "(db = 'pmc' AND xml LIKE '%</article>') OR (db <> 'pmc' AND xml LIKE '%</PubmedArticle>')"
_META_SQL = f"""SELECT db, year, doc_id,
  CASE WHEN ok THEN CASE WHEN db = 'pmc' THEN {_got('<article-id pub-id-type="pmid">(.*?)</article-id>')} ELSE {_got('<PMID>(.*?)</PMID>')} END END AS pmid,
  CASE WHEN ok THEN CASE WHEN db = 'pmc' THEN {_got('<article-id pub-id-type="pmc">(.*?)</article-id>')} ELSE {_got('<ArticleID IdType="pmc">(.*?)</ArticleID>')} END END AS pmc,
  CASE WHEN ok THEN CASE WHEN db = 'pmc' THEN {_got('<article-id pub-id-type="doi">(.*?)</article-id>')} ELSE {_got('<ArticleID IdType="doi">(.*?)</ArticleID>')} END END AS doi,
  CASE WHEN ok THEN CASE WHEN db = 'pmc' THEN {_got('<article-title>(.*?)</article-title>')} ELSE {_got('<ArticleTitle>(.*?)</ArticleTitle>')} END END AS article_title,
  CASE WHEN ok THEN {_got('<license license-type="([^"]*)"', 1, _sq(C.UNKNOWN_LICENSE))} END AS license_type,
  CASE WHEN ok THEN {_got('<license .*?<ext-link ext-link-type="uri" xlink:href="([^"]*)"', 1, _sq(C.NO_LICENSE_URL))} END AS license_url,
  CASE WHEN ok THEN CASE WHEN db = 'pmc' THEN {_got('<copyright-statement>(.*?)</copyright-statement><license', 1, _sq(C.NO_COPYRIGHT))}
       ELSE {_got('<CopyrightInformation>(.*?)</CopyrightInformation>', 1, _sq(C.NO_COPYRIGHT))} END END AS copyright_text,
  ok AND regexp_matches(xml, CASE WHEN db = 'pmc' THEN '<abstract>' ELSE '<Abstract>' END) AS abstract_exists,
  ok AND db = 'pmc' AND contains(xml, '<body>') AS body_exists, NOT ok AS parse_failed
FROM (SELECT *, {_CLOSED} AS ok FROM articles) a"""


def _failed(df):
    return df.withColumn("parse_failed", F.col("parse_error").isNotNull()).drop("parse_error")


@register("article_metadata", views=("articles",), sql=_META_SQL, tags=("bench",))
def article_metadata(spark, sf):
    """Per-article identifiers, title, licence, existence flags, and whether the document could be parsed."""
    return _failed(C.article_metadata(fx.articles(spark, sf)))


@register("article_key", views=("articles",), sql=f"""SELECT db, doc_id, CASE WHEN db = 'pmc' THEN pmc ELSE pmid END AS article_key
FROM ({_META_SQL}) m""")
def article_key(spark, sf):
    """The key articles are stored under (pmc id for PMC, pmid for PubMed)."""
    return C.article_key(C.article_metadata(fx.articles(spark, sf))).select("db", "doc_id", "article_key")


@register("metadata_append_split", views=("articles",), sql=f"""SELECT db, year, doc_id, CASE WHEN db = 'pmc' THEN pmc ELSE pmid END AS article_key,
  CASE WHEN body_exists THEN 'valid' ELSE 'invalid' END AS route FROM ({_META_SQL}) m""")
def metadata_append_split(spark, sf):
    """Route articles with a body to the valid table, the rest to the invalid one."""
    m = C.article_key(C.article_metadata(fx.articles(spark, sf)))
    return m.select("db", "year", "doc_id", "article_key",
                    F.when(F.col("body_exists"), "valid").otherwise("invalid").alias("route"))


@register("articles_per_year", views=("articles",), sql="SELECT db, year, count(*) AS n_articles FROM articles GROUP BY ALL")
def articles_per_year(spark, sf):
    """A35."""
    return C.articles_per_year(fx.articles(spark, sf))


@register("year_grid", views=("articles",), sql=f"""SELECT db, CAST(y.year AS INT) AS year,
  {_sq(BASE_QUERY)} || ' AND (' || CAST(y.year AS VARCHAR) || '[pdat])' AS query_term
FROM (SELECT db, min(year) AS s, max(year) AS e FROM articles GROUP BY db) r, LATERAL (SELECT unnest(range(r.s, r.e + 1)) AS year) y""")
def year_grid(spark, sf):
    """Every year of each database's range with its per-year search term."""
    return C.year_grid(fx.articles(spark, sf), BASE_QUERY).select("db", F.col("year").cast("int").alias("year"), "query_term")


def _element_rows() -> str:
    """Elements of well-formed articles, cut out of the cleaned text by pattern: (portion, position, tag, inner text)."""
    clean = (f"regexp_replace(regexp_replace(xml, {_sq(C.XREF_WITH_BRACKETS)}, '', 'g'), {_sq(C.XREF_STANDALONE)}, '', 'g')")
    bare = f"regexp_replace({clean}, '<fig>.*?</fig>|<table-wrap>.*?</table-wrap>', ' ', 'g')"
    kinds = [("abstract", 0, "sec", '<abstract><sec [^>]*>(.*?)</sec>'), ("abstract", 1, "p", '<abstract>.*?</sec><p>(.*?)</p></abstract>'),
             ("abstract", 0, "AbstractText", '<Abstract><AbstractText[^>]*>(.*?)</AbstractText>'),
             ("abstract", 1, "AbstractText", '<Abstract><AbstractText[^>]*>.*?</AbstractText><AbstractText[^>]*>(.*?)</AbstractText>'),
             ("body", 0, "p", '<body><p>(.*?)</p>'), ("body", 1, "sec", '<body><p>.*?</p><sec id="s1">(.*?</sec>)</sec><sec id="s2">'),
             ("body", 2, "sec", '<sec id="s2">(.*?)</sec>'), ("body", 3, "sec", '<sec id="s2">.*?</sec> ?<sec id="s1">(.*?)</sec></body>')]
    parts = [f"SELECT db, year, doc_id, '{p}' AS portion, {i} AS position, '{t}' AS tag, regexp_extract(x, {_sq(r)}, 1) AS inside FROM b WHERE regexp_matches(x, {_sq(r)})"
             for p, i, t, r in kinds]
    plain = "replace(replace(replace(regexp_replace(regexp_replace(inside, '^<title>.*?</title>', ''), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&amp;', '&')"
    return f"""SELECT db, year, doc_id, portion, CAST(position AS INT) AS position, tag,
  CASE WHEN tag = 'sec' THEN nullif(trim(regexp_extract(inside, '^<title>(.*?)</title>', 1)), '') END AS own_title, {_canon_sql(plain)} AS text
FROM (WITH b AS (SELECT db, year, doc_id, {bare} AS x FROM articles WHERE {_CLOSED}) {' UNION ALL '.join(parts)}) e"""


_ELEMENTS_SQL = _element_rows()


@register("article_elements", views=("articles",), tags=("bench",), sql=f"""SELECT *, false AS parse_failed FROM ({_ELEMENTS_SQL}) e
UNION ALL SELECT db, year, doc_id, NULL, NULL, NULL, NULL, NULL, true FROM articles WHERE NOT ({_CLOSED})""")
def article_elements(spark, sf):
    """Ordered sec / p / AbstractText children per article (figures and tables dropped); one flagged row for each
    article that can't be parsed."""
    return _failed(C.article_elements(fx.articles(spark, sf)))


@register("article_sections", views=("articles",), tags=("bench",), sql=f"""SELECT db, year, doc_id, portion, min(position) AS first_position, title,
  coalesce(string_agg(text, ' ' ORDER BY position) FILTER (WHERE text <> ''), '') AS text
FROM (SELECT *, coalesce(last_value(own_title IGNORE NULLS) OVER (PARTITION BY db, doc_id, portion ORDER BY position), {_sq(C.DEFAULT_TITLE)}) AS title
      FROM ({_ELEMENTS_SQL}) e) t GROUP BY ALL""")
def article_sections(spark, sf):
    """Section texts keyed by inherited title, same-title parts joined in order."""
    return C.article_sections(C.article_elements(fx.articles(spark, sf)))


_SEC = '<sec id="[^"]*">(?:<title>.*?</title>)?'
_INVENTORY_SQL = f"""WITH b AS (SELECT db, year, doc_id, portion, xml, regexp_extract_all(regexp_extract(xml, portion_rx, 1), sec_rx) AS s
  FROM (SELECT *, 'abstract' AS portion, '<abstract>(.*?)</abstract>' AS portion_rx, {_sq(_SEC)} AS sec_rx FROM articles WHERE db = 'pmc'
        UNION ALL SELECT *, 'body', '<body>(.*)</body>', {_sq(_SEC)} FROM articles WHERE db = 'pmc'
        UNION ALL SELECT *, 'abstract', '<Abstract>(.*)</Abstract>', '<AbstractText[^>]*>' FROM articles WHERE db <> 'pmc') a WHERE {_CLOSED}),
e AS (SELECT db, year, doc_id, portion, CAST(i - 1 AS INT) AS position, s[i] AS m FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM b) u),
r AS (SELECT db, year, doc_id, portion, position, CASE WHEN db = 'pmc' THEN regexp_extract(m, 'id="([^"]*)"', 1) END AS sec_id,
  CASE WHEN db = 'pmc' THEN CASE WHEN contains(m, '<title>') THEN regexp_extract(m, '<title>(.*?)</title>', 1) ELSE 'N/A' END END AS title,
  CASE WHEN db <> 'pmc' THEN coalesce(nullif(regexp_extract(m, 'Label="([^"]*)"', 1), ''), 'N/A') END AS label,
  CASE WHEN db <> 'pmc' THEN coalesce(nullif(regexp_extract(m, 'NlmCategory="([^"]*)"', 1), ''), 'N/A') END AS nlm_category FROM e
  UNION ALL SELECT db, year, doc_id, 'body', CAST(len(s) AS INT), 'blank', 'blank', NULL, NULL FROM b WHERE portion = 'body' AND contains(xml, '<body><p>'))"""


@register("section_inventory", views=("articles",), sql=f"""{_INVENTORY_SQL} SELECT *, false AS parse_failed FROM r
UNION ALL SELECT db, year, doc_id, NULL, NULL, NULL, NULL, NULL, NULL, true FROM articles WHERE NOT ({_CLOSED})""")
def section_inventory(spark, sf):
    """All body sections, nested ones too, then loose paragraphs ('blank'); abstract sections; PubMed label / NLM category."""
    return _failed(C.section_inventory(fx.articles(spark, sf)))


_JSON_PAIR = """'"' || sec_id || '":"' || title || '"'"""


@register("section_map", views=("articles",), sql=f"""{_INVENTORY_SQL}
SELECT db, doc_id, '{{' || string_agg({_JSON_PAIR}, ',' ORDER BY p) || '}}' AS body_sections
FROM (SELECT db, doc_id, sec_id, arg_max(title, position) AS title, max(position) AS p FROM r WHERE portion = 'body' GROUP BY ALL) x GROUP BY ALL""")
def section_map(spark, sf):
    """Last-wins map of section id to title per article, as JSON."""
    m = C.sections_map(C.section_inventory(fx.articles(spark, sf)))
    return m.select("db", "doc_id", F.to_json("body_sections").alias("body_sections"))


@register("article_record", views=("articles",), sql=f"""{_INVENTORY_SQL}, m AS ({_META_SQL}),
g AS (SELECT db, doc_id, count_if(portion = 'abstract') AS n_abstract_sections, count_if(portion = 'body') AS n_body_sections FROM r GROUP BY ALL)
SELECT m.db, m.doc_id, CASE WHEN m.db = 'pmc' THEN pmc ELSE pmid END AS article_key, article_title, CASE WHEN body_exists THEN 'valid' ELSE 'invalid' END AS route,
  coalesce(n_abstract_sections, 0) AS n_abstract_sections, coalesce(n_body_sections, 0) AS n_body_sections
FROM m LEFT JOIN g ON m.db = g.db AND m.doc_id = g.doc_id""")
def article_record(spark, sf):
    """The assembled record of each article with its abstract and body sections, and the table it goes to."""
    r = C.article_record(fx.articles(spark, sf))
    size = lambda c: F.size(c).cast("bigint")
    return r.select("db", "doc_id", "article_key", "article_title", F.when(F.col("body_exists"), "valid").otherwise("invalid").alias("route"),
                    size("abstract_sections").alias("n_abstract_sections"), size("body_sections").alias("n_body_sections"))


_SECTIONS = f"""SELECT db, doc_id, portion, title, coalesce(string_agg(text, ' ' ORDER BY position) FILTER (WHERE text <> ''), '') AS text
FROM (SELECT *, coalesce(last_value(own_title IGNORE NULLS) OVER (PARTITION BY db, doc_id, portion ORDER BY position), {_sq(C.DEFAULT_TITLE)}) AS title
      FROM ({_ELEMENTS_SQL}) e) t GROUP BY ALL"""


@register("sections_upsert", views=("articles",), sql=f"""SELECT db, doc_id, portion, title, CASE WHEN db = 'pmc' THEN 2 ELSE 1 END AS seq,
  CASE WHEN db = 'pmc' THEN text || ' (rev)' ELSE text END AS text FROM ({_SECTIONS}) s""")
def sections_upsert(spark, sf):
    """Cleaned sections written twice for PMC (a revised second write), the later write of each section wins."""
    first, second = _section_writes(spark, sf)
    return upsert_latest(first.unionByName(second), ["db", "doc_id", "portion", "title"], "seq")


def _section_writes(spark, sf):
    first = C.article_sections(C.article_elements(fx.articles(spark, sf))).select("db", "doc_id", "portion", "title", F.lit(1).alias("seq"), "text")
    return first, first.where("db = 'pmc'").withColumns({"seq": F.lit(2), "text": F.concat("text", F.lit(" (rev)"))})


# the record of each article, the route it takes, and the run that lands it: articles with labels come first
_LANDED_SQL = f"""{_INVENTORY_SQL}, m AS ({_META_SQL}),
bt AS (SELECT db, doc_id, '{{' || string_agg({_JSON_PAIR}, ',' ORDER BY p) || '}}' AS body_titles
      FROM (SELECT db, doc_id, sec_id, arg_max(title, position) AS title, max(position) AS p FROM r WHERE portion = 'body' GROUP BY ALL) x GROUP BY ALL),
n AS (SELECT db, doc_id, count(*) AS n FROM r WHERE portion = 'abstract' GROUP BY ALL)
SELECT CASE WHEN m.body_exists THEN 'valid' ELSE 'invalid' END AS route, CASE WHEN l.doc_id IS NULL THEN {{late}} ELSE {{early}} END AS run_id, m.db, m.year, m.doc_id,
  CASE WHEN m.db = 'pmc' THEN pmc ELSE pmid END AS article_key, pmid, pmc, doi, article_title, license_type, license_url, copyright_text, abstract_exists,
  coalesce(n.n, 0) AS n_abstract_sections, body_exists, coalesce(body_titles, '{{{{}}}}') AS body_titles
FROM m LEFT JOIN bt ON bt.db = m.db AND bt.doc_id = m.doc_id LEFT JOIN n ON n.db = m.db AND n.doc_id = m.doc_id
LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = m.doc_id"""


def _landed_sql(early: str, late: str) -> str:
    return _LANDED_SQL.replace("{early}", early).replace("{late}", late).replace("{{}}", "{}")


def _landed_rows(df):
    return df.select("route", "run_id", "db", "year", "doc_id", "article_key", "pmid", "pmc", "doi", "article_title", "license_type", "license_url", "copyright_text",
                     "abstract_exists", F.size("abstract_sections").cast("bigint").alias("n_abstract_sections"), "body_exists", F.to_json("body_titles").alias("body_titles"))


def _two_parts(spark, sf):
    """Articles with labels, and all articles."""
    arts = fx.articles(spark, sf)
    return arts.join(load_table(spark, sf, "labels", ["doc_id"]).distinct(), "doc_id", "left_semi").select(*arts.columns), arts


@register("metadata_append", views=("articles",), sql=_landed_sql("'first'", "'second'"))
def metadata_append(spark, sf):
    """A run over some articles, then a run over all that is started twice; the records of both tables, with the run that landed them."""
    table = f"{checkpoint_dir(spark)}/metadata-{uuid.uuid4().hex}"
    some, everything = _two_parts(spark, sf)
    append_metadata(C.article_record(some), table, "first")
    for _ in range(2):
        append_metadata(C.article_record(everything), table, "second")
    return _landed_rows(metadata_table(spark, table, C.article_record(everything).schema))


@register("stream_metadata_append", views=("articles",), sql=_landed_sql("'batch-0'", "'batch-1'"))
def stream_metadata_append(spark, sf):
    """2.11/S15: the same append as a stream that is started twice, from its checkpoint."""
    base = f"{checkpoint_dir(spark)}/metadata-stream-{uuid.uuid4().hex}"
    for part in _two_parts(spark, sf):
        part.write.mode("append").parquet(f"{base}/in")
        run_metadata_stream(spark, f"{base}/in", f"{base}/out", f"{base}/_checkpoint")
    return _landed_rows(metadata_table(spark, f"{base}/out", C.article_record(part).schema))


@register("stream_sections_upsert", views=("articles",), sql=f"""SELECT db, doc_id, portion, title, CASE WHEN db = 'pmc' THEN 2 ELSE 1 END AS seq,
  CASE WHEN db = 'pmc' THEN text || ' (rev)' ELSE text END AS text FROM ({_SECTIONS}) s""")
def stream_sections_upsert(spark, sf):
    """2.11/S16: section writes as a stream, the latest of each key held in the state store; stopped and resumed between the two writes."""
    base = f"{checkpoint_dir(spark)}/sections-stream-{uuid.uuid4().hex}"
    for part in _section_writes(spark, sf):
        part.select(*SECTION_KEY, "seq", "text").write.mode("append").parquet(f"{base}/in")
        run_sections_stream(spark, f"{base}/in", f"{base}/changes", f"{base}/_checkpoint")
    return current_sections(spark, f"{base}/changes")
