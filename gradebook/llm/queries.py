"""Queries ``opN_<name>`` of the operators in this folder, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, infill, katz, language, line_dedup, mixing, near_dup, neighbours, pii, quality, repair, toxicity
from .common import table


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("clean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, remainder(4) != 2), spans=False)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digest(pii.find_spans(docs, pii.fit(docs)))


def op6_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, model = katz.katz_scores(table(spark, sf_dir, "documents"), remainder(5) != 1, remainder(5) == 1)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = neighbours.score(docs, neighbours.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0))
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), *toxicity.KINDS)


def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


OP8_SQL = f"""
WITH RECURSIVE c AS (SELECT CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, n, greatest(1, CAST(floor(sqrt(n)) AS BIGINT)) AS r FROM c),
w AS (SELECT s, n, CASE WHEN (SELECT sum(r) FROM r) <= {mixing.UNITS} THEN r ELSE greatest(1, {mixing.UNITS} * r // (SELECT CAST(sum(r) AS BIGINT) FROM r)) END AS a, row_number() OVER (ORDER BY s) AS i FROM r),
u AS (SELECT list(a ORDER BY i) AS a, CAST(sum(a) AS BIGINT) AS q, count(*) AS z FROM w),
f(t, used, p) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM u
  UNION ALL
  SELECT t + 1, now, list_min(list_transform(range(1, z + 1), lambda i: CASE WHEN now[i] < a[i] AND now[i] * q // a[i] <= t + 1
                                             THEN ((now[i] + 1) * q + a[i] - 1) // a[i] * 1000000 + i END)) % 1000000
  FROM (SELECT f.t, u.*, list_transform(range(1, z + 1), lambda i: f.used[i] + CASE WHEN i = f.p THEN 1 ELSE 0 END) AS now FROM f, u WHERE f.t + 1 < u.q) x),
slots AS (SELECT p AS i, used[p] AS k, t AS slot FROM f WHERE p > 0),
d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS num FROM d),
b AS (SELECT o.*, num // {mixing.BLOCK_DOCS} AS block, w.a, w.i, (SELECT q FROM u) AS q FROM o JOIN w USING (s)),
e AS (SELECT min(((n + {mixing.BLOCK_DOCS - 1}) // {mixing.BLOCK_DOCS} // a) * (SELECT q FROM u) + slot) AS z
      FROM w JOIN slots ON slots.i = w.i AND slots.k = ((n + {mixing.BLOCK_DOCS - 1}) // {mixing.BLOCK_DOCS}) % a)
SELECT doc_id, source, a AS units, block, (block // a) * q + slot AS slot, block * q // a AS release, ((block + 1) * q + a - 1) // a AS deadline,
       ((block // a) * q + slot) * {mixing.BLOCK_DOCS} + num % {mixing.BLOCK_DOCS} AS position, (block // a) * q + slot < (SELECT z FROM e) AS in_mix
FROM b JOIN slots ON slots.i = b.i AND slots.k = block % a
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents")).drop("ta")


OP10_SQL = f"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, lower(trim(s[i])) AS norm FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM p) x),
l AS (SELECT * FROM o WHERE regexp_matches(norm, '{line_dedup.NOT_BLANK}')),
c AS (SELECT norm, length(norm) AS n, min(row(doc_id, line_no)) AS f FROM l GROUP BY norm),
m AS (SELECT norm, f, n, unnest([n, n - 1]) AS m FROM c WHERE n >= {line_dedup.MIN_CHARS}),
h AS (SELECT norm, f, m, 0 AS side, left(norm, m // 2) AS part FROM m UNION ALL SELECT norm, f, m, 1, right(norm, m - m // 2) FROM m),
near AS (SELECT a.norm, min(b.f) AS near FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.part = b.part AND b.f < a.f AND levenshtein(a.norm, b.norm) = 1
         GROUP BY a.norm),
z AS (SELECT c.norm, CASE WHEN near < f THEN near ELSE f END AS low, CASE WHEN near < f THEN 1 ELSE 0 END AS edits FROM c LEFT JOIN near ON c.norm = near.norm)
SELECT l.doc_id, l.line_no, struct_extract(low, 1) AS first_doc_id, struct_extract(low, 2) AS first_line_no, edits
FROM l JOIN z ON l.norm = z.norm WHERE low < row(l.doc_id, l.line_no)
"""


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, unit="char"))


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
      CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '{infill.P}') OR contains(text, '{infill.S}') OR contains(text, '{infill.M}') OR h3 % 100 >= {infill.PLAIN_FROM} THEN 'plain'
           WHEN h4 % 100 < {infill.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{infill.P}' || prefix || '{infill.S}' || suffix || '{infill.M}' || middle
              ELSE '{infill.S}' || suffix || '{infill.P}' || prefix || '{infill.M}' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT -7L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    return chat.digest(chat.format_chats(chat.log_of_turns(turns.unionByName(odd))))


OP12_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
e AS (SELECT *, regexp_replace(role, '{chat.CONTROL}', '\\1\\2\\\\\\3', 'g') AS r, regexp_replace(text, '{chat.CONTROL}', '\\1\\2\\\\\\3', 'g') AS t FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('{chat.OPEN}') + length(r) + length('{chat.HEAD_END}') + length(t) + length('{chat.CLOSE}')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), there="there"))


def _op13_sql() -> str:
    """Costs, audits and repaired texts from the end of each conversation, all strings written out, by a recursive statement."""
    def way(cost: str, letter: str, s: str, line: str | None = None) -> str:
        out = f"{s}.o" if line is None else f"{line} || CASE WHEN {s}.o IS NULL THEN '' ELSE chr(10) || {s}.o END"
        return f"{{'c': {s}.c + {cost}, 'a': '{letter}' || {s}.a, 'o': {out}}}"

    def best(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"

    rows, after = [], (2, 2, 3, 2)
    for q, wants in enumerate("uuau"):
        role = "'user'" if wants == "u" else "'assistant'"
        kept = [f"CASE WHEN ok AND left(role, 1) = '{wants}' THEN {way('extra', 'K', f's{after[q]}', 'line')} END"]
        if q == 0:
            kept.append(f"CASE WHEN ok AND left(role, 1) = 's' THEN {way('extra', 'K', 's1', 'line')} END")
        rerole = f"CASE WHEN ok THEN {way('extra + 2', 'R', f's{after[q]}', f'{role} || chr(58) || text')} END"
        rows.append(f"{best(way('3', 'D', f's{q}'), *kept, rerole)} AS b{q}")
    end = [f"CAST({{'c': {c}, 'a': '{a}', 'o': {o}}} AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS s{q}"
           for q, (c, a, o) in enumerate([(0, "", "NULL"), (4, "II", "'user:' || chr(10) || 'assistant:'"), (2, "I", "'assistant:'"), (0, "", "NULL")])]
    user, assistant = "'user:'", "'assistant:'"
    body = "rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS tag FROM conversations),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(tag) + 1), lambda i: CAST(ascii(substr(tag, i, 1)) AS BIGINT))),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS k FROM c),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
      CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 0 THEN [] WHEN k = 3 THEN [0, 1] ELSE [0] END) AS x FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS z,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS copy FROM d),
f AS (SELECT *, role || ':' || text AS line, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
      CASE WHEN {body} = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right({body}, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM n),
g AS (SELECT *, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS extra FROM f),
dp AS (
  SELECT conv_id, z + 1 AS i, {', '.join(end)} FROM n WHERE i = 1
  UNION ALL
  SELECT conv_id, i, {best('b0', way('2', 'I', 'n2', user))}, {best('b1', way('2', 'I', 'n2', user))}, n2, n3
  FROM (SELECT conv_id, i, b0, b1, {best('b2', way('2', 'I', 'b3', assistant))} AS n2, {best('b3', way('2', 'I', 'b2', user))} AS n3
        FROM (SELECT g.conv_id, g.i, {', '.join(rows)} FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.i = dp.i - 1) x) y),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
      count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
      count(*) FILTER (WHERE before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
r AS (SELECT conv_id, s0.c AS cost, s0.a AS audit, coalesce(s0.o, '') AS repaired FROM dp WHERE i = 1)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""


OP13_SQL = _op13_sql()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_minhash_near_dup": op3_minhash_near_dup,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_katz_lm": op6_katz_lm,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_pfair_mixing": op8_pfair_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_chat_format": op12_chat_format,
    "op13_structure_repair": op13_structure_repair,
}

ORACLES: dict[str, str] = {
    "op8_pfair_mixing": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_chat_format": OP12_SQL,
    "op13_structure_repair": OP13_SQL,
}
