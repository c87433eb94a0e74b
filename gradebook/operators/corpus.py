"""Article corpus jobs (X1-X9, A35, S13-S16 helpers).

An article is parsed once, in ``mapInPandas`` (stdlib ElementTree, one document per row): there is no
built-in that keeps the order of sections and paragraphs, and the JVM's XPath functions abort a whole job on one
malformed document.  A document that can't be parsed gives a row whose ``parse_error`` says why.  Title inheritance
(W6) and same-title concatenation (X7) are Spark windows and aggregates over the element rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Citation patterns removed before parsing, and the default labels of the output.
XREF_WITH_BRACKETS = r"\s*[\[\(]?\s*<xref[^>]*>.*?</xref>\s*(?:[-–,]\s*<xref[^>]*>.*?</xref>)*\s*[\]\)]?"
XREF_STANDALONE = r"<xref[^>]*>.*?</xref>"
DEFAULT_TITLE = "Introduction"
NA = "N/A"
UNKNOWN_LICENSE = "Unknown License Type"
NO_LICENSE_URL = "No License URL Found"
NO_COPYRIGHT = "No Copyright Information Found"


def clean_xrefs(c: Column) -> Column:
    """Drop bracketed citation groups, then any remaining xref element."""
    return F.regexp_replace(F.regexp_replace(c, XREF_WITH_BRACKETS, ""), XREF_STANDALONE, "")


def _canon(text: str) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKD", text)).strip()


@F.pandas_udf(StringType())
def _normalize_any(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _canon(t))


def normalize_text(c: Column) -> Column:
    """NFKD, whitespace runs to one space, strip (Python semantics: Unicode-aware whitespace).

    ASCII has no decompositions, so ASCII rows stay in the JVM; only the others are sent to Python."""
    ascii_only = c.rlike(r"\A[\x00-\x7F]*\z")
    plain = F.regexp_replace(F.regexp_replace(c, r"[\x09-\x0D\x1C-\x20]+", " "), r"\A | \z", "")
    return F.when(ascii_only, plain).otherwise(_normalize_any(F.when(~ascii_only, c)))


# ---------------------------------------------------------------- parsing
_TAG = re.compile(r"<[^<>]*>")
_PREFIXED = re.compile(r"[\s</]([A-Za-z_][\w.-]*):[A-Za-z_]")
_ENTITY = re.compile(r"&(?!(?:amp|lt|gt|quot|apos);)([A-Za-z][A-Za-z0-9]*);")
_ROOT = re.compile(r"<[A-Za-z_][^\s/>]*")


def _repaired(xml: str) -> str:
    """Undeclared prefixes declared on the root element, named HTML entities as characters; the text is not touched."""
    declared = set(re.findall(r"xmlns:([\w.-]+)\s*=", xml)) | {"xml", "xmlns"}
    missing = sorted({p for t in _TAG.findall(xml) for p in _PREFIXED.findall(t)} - declared)
    xml = _ENTITY.sub(lambda m: html.unescape(m.group(0)), xml)
    return _ROOT.sub(lambda m: m.group(0) + "".join(f' xmlns:{p}="urn:{p}"' for p in missing), xml, count=1)


def parse_article(xml: str | None) -> tuple[ET.Element | None, str | None]:
    """(root, None), or (None, why it can't be parsed)."""
    if xml is None:
        return None, "no document"
    try:
        return ET.fromstring(xml), None
    except ET.ParseError:
        try:
            return ET.fromstring(_repaired(xml)), None
        except ET.ParseError as e:
            return None, str(e)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def _find(root, name, **attributes):
    return _pick((el for el in root.iter() if _local(el.tag) == name), attributes)


def _pick(elements, attributes: dict):
    """The first element that has the attributes."""
    return next((el for el in elements if all(el.get(k.replace("_", "-")) == v for k, v in attributes.items())), None)


def _by_name(root) -> dict[str, list]:
    """All elements by local name, in document order: one walk for any number of look-ups."""
    out: dict[str, list] = {}
    for el in root.iter():
        out.setdefault(_local(el.tag), []).append(el)
    return out


def _all(root, name) -> list:
    return [el for el in root.iter() if el is not root and _local(el.tag) == name]


def _remove(parent, child) -> None:
    """Take an element out; the text that follows it stays, set off by a space."""
    tail, at = child.tail, list(parent).index(child)
    parent.remove(child)
    if tail:
        if at:
            before = parent[at - 1]
            before.tail = f"{before.tail or ''} {tail}"
        else:
            parent.text = f"{parent.text or ''} {tail}"


def _drop(root, names) -> None:
    for parent in list(root.iter()):
        for ch in list(parent):
            if _local(ch.tag) in names:
                _remove(parent, ch)


def _text(el) -> str:
    return "".join(el.itertext())


def _text_of(el) -> str:
    parts = [t.strip() for t in el.itertext()]
    return " ".join(p for p in parts if p)


def _per_article(articles: DataFrame, xml: Column, schema: str, rows_of: Callable) -> DataFrame:
    """One parse per document; ``rows_of(db, root)`` gives the rows, a document without root one row with parse_error."""
    names = [f.split()[0] for f in re.sub(r"<[^ ]*>", "", schema).split(", ")]  # nested types are written without spaces

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for db, year, doc_id, text in zip(pdf["db"], pdf["year"], pdf["doc_id"], pdf["xml"]):
                root, error = parse_article(text)
                if root is None:
                    rows.append({"db": db, "year": year, "doc_id": doc_id, "parse_error": error})
                else:
                    rows += [{"db": db, "year": year, "doc_id": doc_id, **r} for r in rows_of(db, root)]
            out = pd.DataFrame(rows, columns=names).astype(object)
            yield out.where(out.notna(), None)

    return articles.select("db", "year", "doc_id", xml.alias("xml")).mapInPandas(fn, schema)


# ---------------------------------------------------------------- metadata
_ID_FIELDS = {"pmc": ("article-id", "pub_id_type", "article-title"), "pubmed": ("ArticleID", "IdType", "ArticleTitle")}


def _metadata(db: str, root) -> Iterator[dict]:
    tag, kind, title_tag = _ID_FIELDS["pmc" if db == "pmc" else "pubmed"]
    names = _by_name(root)

    def _find(_, name, **attributes):
        return _pick(names.get(name, ()), attributes)

    def value(el) -> str:
        return (_text(el).strip() or NA) if el is not None else NA

    out = {"pmid": value(_find(root, tag, **{kind: "pmid"}) if db == "pmc" else _find(root, "PMID")),
           "pmc": value(_find(root, tag, **{kind: "pmc"})), "doi": value(_find(root, tag, **{kind: "doi"})),
           "license_type": UNKNOWN_LICENSE, "license_url": NO_LICENSE_URL, "copyright_text": NO_COPYRIGHT}
    if db == "pmc":
        lic = _find(root, "license")
        if lic is not None:
            out["license_type"] = lic.get("license-type", UNKNOWN_LICENSE)
            link = _find(root, "ext-link", ext_link_type="uri")
            if link is not None:
                out["license_url"] = next((v for k, v in link.attrib.items() if k.endswith(("}href", "xlink:href"))), NO_LICENSE_URL)
            notice = _find(root, "copyright-statement")
            if notice is not None:
                out["copyright_text"] = "".join(t.strip() for t in notice.itertext())
    else:
        notice = _find(root, "CopyrightInformation")
        if notice is not None:
            out["copyright_text"] = _text(notice)
    title = _find(root, title_tag) if db != "pmc" or _find(root, "article-meta") is not None else None
    out["article_title"] = _text(title).strip() if title is not None else NA
    out["abstract_exists"] = _find(root, "abstract" if db == "pmc" else "Abstract") is not None
    out["body_exists"] = db == "pmc" and _find(root, "body") is not None
    yield out


_METADATA_SCHEMA = ("db string, year int, doc_id bigint, pmid string, pmc string, doi string, article_title string, license_type string, "
                    "license_url string, copyright_text string, abstract_exists boolean, body_exists boolean, parse_error string")


def article_metadata(articles: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Identifiers, title, licence, copyright and existence flags; a document that can't be parsed has NULL fields,
    no body, and its ``parse_error``."""
    m = _per_article(articles, F.col(xml_col), _METADATA_SCHEMA, _metadata)
    return m.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("abstract_exists", "body_exists")})


def article_key(meta: DataFrame) -> DataFrame:
    """Pmc id for PMC articles, pmid for PubMed ones."""
    return meta.withColumn("article_key", F.when(F.col("db") == "pmc", F.col("pmc")).otherwise(F.col("pmid")))


# ---------------------------------------------------------------- element walk
_ELEMENT_SCHEMA = ("db string, year int, doc_id bigint, portion string, position int, tag string, own_title string, text string, parse_error string")


def _elements(db: str, root) -> Iterator[dict]:
    """Direct sec / p / AbstractText children of abstract and body, in order, without figures and tables."""
    _drop(root, {"table-wrap", "fig"})
    abstract = None
    for name in ("Abstract", "abstract", "AbstractText"):  # ElementTree nodes are falsy when childless
        abstract = _find(root, name)
        if abstract is not None:
            break
    for portion, node in (("abstract", abstract), ("body", _find(root, "body"))):
        if node is None:
            continue
        for pos, el in enumerate(ch for ch in list(node) if _local(ch.tag) in ("sec", "p", "AbstractText")):
            tag, own_title = _local(el.tag), None
            if tag == "sec":
                title = _find(el, "title")
                if title is not None:
                    own_title = _text(title).strip() or None
                    _remove(next(p for p in el.iter() if title in list(p)), title)
            yield {"portion": portion, "position": pos, "tag": tag, "own_title": own_title, "text": _canon(_text_of(el))}


def article_elements(articles: DataFrame, xml_col: str = "xml") -> DataFrame:
    """Ordered element rows per article, after X1 (JVM regex) and figure/table removal; one row with ``parse_error`` for a
    document that can't be parsed."""
    return _per_article(articles, clean_xrefs(F.col(xml_col)), _ELEMENT_SCHEMA, _elements)


def article_sections(elements: DataFrame) -> DataFrame:
    """Inherit the previous title (default 'Introduction'), then join same-title texts in order.

    The window is per (article, portion): bounded by one document."""
    w = Window.partitionBy("db", "doc_id", "portion").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    e = elements.where(F.col("parse_error").isNull()).withColumn("title", F.coalesce(F.last("own_title", ignorenulls=True).over(w), F.lit(DEFAULT_TITLE)))
    g = e.groupBy("db", "year", "doc_id", "portion", "title").agg(
        F.min("position").alias("first_position"),
        F.array_sort(F.collect_list(F.struct("position", "text"))).alias("_parts"))
    texts = F.filter(F.transform("_parts", lambda p: p["text"]), lambda t: t != "")
    return g.select("db", "year", "doc_id", "portion", "first_position", "title", F.array_join(texts, " ").alias("text"))


_INVENTORY_SCHEMA = ("db string, year int, doc_id bigint, portion string, position int, sec_id string, title string, label string, "
                     "nlm_category string, parse_error string")


def _inventory(db: str, root) -> Iterator[dict]:
    """All sections, nested ones too, in document order; then the paragraphs directly under the body as 'blank'."""
    def of(sec) -> dict:
        if db != "pmc":
            return {"label": sec.get("Label", NA), "nlm_category": sec.get("NlmCategory", NA)}
        title = _find(sec, "title")
        return {"sec_id": sec.get("id", NA), "title": _text(title).strip() if title is not None else NA}

    abstract = _find(root, "abstract" if db == "pmc" else "Abstract")
    found = [("abstract", of(x)) for x in _all(abstract, "sec" if db == "pmc" else "AbstractText")] if abstract is not None else []
    body = _find(root, "body") if db == "pmc" else None
    if body is not None:
        found += [("body", of(x)) for x in _all(body, "sec")]
        found += [("body", {"sec_id": "blank", "title": "blank"}) for p in body if _local(p.tag) == "p"]
    count: dict[str, int] = {}
    for portion, fields in found:
        count[portion] = count.get(portion, -1) + 1
        yield {"portion": portion, "position": count[portion], **fields}


def section_inventory(articles: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(sec_id, title) of every section of PMC abstracts and bodies, 'blank' for loose body paragraphs; (label, nlm_category)
    of PubMed abstract texts.  ``sections_map`` gives the last-wins id -> title map (K20)."""
    return _per_article(articles, F.col(xml_col), _INVENTORY_SCHEMA, _inventory)


def sections_map(inventory: DataFrame) -> DataFrame:
    """Per article: MAP<sec_id, title>; a repeated id keeps its last title (K20), deduplicated by
    ``max_by`` before the map is built (no session-level dedup policy needed)."""
    body = inventory.filter(F.col("portion") == "body")
    last = body.groupBy("db", "doc_id", "sec_id").agg(F.max_by("title", "position").alias("title"), F.max("position").alias("p"))
    g = last.groupBy("db", "doc_id").agg(F.array_sort(F.collect_list(F.struct("p", "sec_id", "title"))).alias("s"))
    entries = F.transform("s", lambda r: F.struct(r["sec_id"].alias("k"), r["title"].alias("v")))
    return g.select("db", "doc_id", F.map_from_entries(entries).alias("body_sections"))


_SECTIONS_TYPE = "array<struct<sec_id:string,title:string,label:string,nlm_category:string>>"
_RECORD_SCHEMA = _METADATA_SCHEMA.replace("parse_error string", f"abstract_sections {_SECTIONS_TYPE}, body_sections {_SECTIONS_TYPE}, parse_error string")


def _record(db: str, root) -> Iterator[dict]:
    fields = next(_metadata(db, root))
    for portion in ("abstract", "body"):
        fields[f"{portion}_sections"] = []
    for row in _inventory(db, root):
        fields[f"{row['portion']}_sections"].append({k: row.get(k) for k in ("sec_id", "title", "label", "nlm_category")})
    yield fields


def article_record(articles: DataFrame, xml_col: str = "xml") -> DataFrame:
    """One record per article, from one parse: metadata, article key, its abstract and body sections as arrays (lossless), and
    ``body_titles``, the last-wins map of section id to title (K20), empty without a body."""
    r = _per_article(articles, F.col(xml_col), _RECORD_SCHEMA, _record)
    r = r.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("abstract_exists", "body_exists")})
    r = r.withColumns({c: F.coalesce(c, F.array().cast(_SECTIONS_TYPE)) for c in ("abstract_sections", "body_sections")})
    later = lambda i: F.slice("body_sections", i + 2, F.size("body_sections"))
    last = F.filter("body_sections", lambda x, i: ~F.exists(later(i), lambda y: y["sec_id"] == x["sec_id"]))
    entries = F.transform(last, lambda x: F.struct(x["sec_id"], x["title"]))
    return article_key(r).withColumn("body_titles", F.map_from_entries(entries))


def articles_per_year(articles: DataFrame) -> DataFrame:
    """A35."""
    return articles.groupBy("db", "year").agg(F.count("*").alias("n_articles"))


def year_grid(articles: DataFrame, base_query: str) -> DataFrame:
    """Every year between the first and last year per database, with its search term.
    A reversed range raises (the reference's start/end check)."""
    r = articles.groupBy("db").agg(F.min("year").alias("start_year"), F.max("year").alias("end_year"))
    r = r.withColumn("_chk", F.when(F.col("end_year") < F.col("start_year"),
                                    F.raise_error(F.lit("end year before start year"))).otherwise(F.lit(0)))
    g = r.select("db", F.explode(F.sequence("start_year", "end_year")).alias("year"))
    return g.withColumn("query_term", F.concat(F.lit(base_query), F.lit(" AND ("), F.col("year").cast("string"), F.lit("[pdat])")))
