"""DuckDB text of the fixture views (FIXTURES.md §2), composed as CTEs in front of oracle SQL.

The oracle runs on the raw driver tables, so every oracle statement carries the view
definitions it needs.  Types are pinned (temperature and score DOUBLE) to match Spark.
"""

from __future__ import annotations

from ..sources.fixtures import ARTICLE_XML


def _sq(x: str) -> str:
    return f"((({x}) % 1000003) * (({x}) % 1000003) % 1000003)"


def _resp(code: str) -> str:
    return (f"CASE WHEN {code} < 6 + mid THEN substring('ABCDE', tk + 1, 1) "
            f"WHEN {code} < 17 THEN substring('ABCDE', CAST((tk + 1 + {code}) % 5 AS INT) + 1, 1) "
            f"WHEN {code} = 17 THEN 'HALL' WHEN {code} = 18 THEN 'A-C' ELSE 'NONE' END")


_BASE = "c.case_id * 7919 + m.mid * 104729"
_STEP = _BASE + " + t.tid * 32452843 + r.run * 15485863"
_RT = "c.case_id * 7919 + m.mid * 104729 + v.vid * 1299709"
_RAT = "o.o_orderkey * 7919 + m.mid * 104729 + e.eid * 1299709 + k.kid * 15485863"
_JH = ("r.case_id * 7919 + p.pos * 104729 + ascii(substring(r.model, 2, 1)) * 1299709 "
       "+ ascii(substring(r.variant, 7, 1)) * 15485863")

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "models": ((), "SELECT * FROM (VALUES (0,'m0'),(1,'m1'),(2,'m2'),(3,'m3'),(4,'m4'),(5,'m5')) AS t(mid, model)"),
    "variants": ((), "SELECT * FROM (VALUES (0,'prompt1'),(1,'prompt2'),(2,'no_letter')) AS t(vid, variant)"),
    "temps": ((), "SELECT tid, CAST(temperature AS DOUBLE) AS temperature FROM (VALUES (1,0.3),(2,0.6),(3,1.0)) AS t(tid, temperature)"),
    "runs": ((), "SELECT * FROM (VALUES (1),(2),(3),(4),(5),(6),(7),(8),(9),(10)) AS t(run)"),
    "cases": ((), """SELECT o_orderkey AS case_id, CAST(o_custkey % 5 AS INT) AS tk,
       substring('ABCDE', CAST(o_custkey % 5 AS INT) + 1, 1) AS truth,
       (o_orderkey % 3 = 0) AS labs, (o_orderkey % 4 = 0) AS has_table
FROM orders"""),
    "responses_t0": (("cases", "models", "variants"), f"""SELECT case_id, model, variant, truth, labs, {_resp('code')} AS response
FROM (SELECT c.case_id, c.tk, c.truth, c.labs, m.mid, m.model, v.variant, {_sq(_RT)} % 20 AS code
      FROM cases c CROSS JOIN models m CROSS JOIN variants v) q"""),
    "responses_rep": (("cases", "models", "temps", "runs"), f"""SELECT case_id, model, temperature, run, truth,
       CASE WHEN gate < 2 + 2 * tid THEN {_resp('code1')} ELSE {_resp('code0')} END AS response
FROM (SELECT c.case_id, c.tk, c.truth, m.mid, m.model, t.tid, t.temperature, r.run,
             {_sq(_BASE)} % 20 AS code0, {_sq(_STEP)} % 20 AS code1, {_sq(_STEP + ' + 17')} % 10 AS gate
      FROM cases c CROSS JOIN models m CROSS JOIN temps t CROSS JOIN runs r) q"""),
    "responses_machine2": (("responses_t0",), """SELECT case_id, model, truth, CASE WHEN case_id % 9 = 0 THEN 'B' ELSE response END AS response
FROM responses_t0 WHERE variant = 'prompt1'"""),
    "ratings": (("models",), f"""SELECT case_id, model, evaluator, metric,
       CAST(CASE WHEN h % 97 = 0 THEN NULL ELSE greatest(1, least(5, base + CASE WHEN h % 10 = 0 THEN -1 WHEN h % 10 < 3 THEN 1 ELSE 0 END)) END AS DOUBLE) AS score
FROM (SELECT o.o_orderkey AS case_id, m.model, 'user' || CAST(e.eid AS VARCHAR) AS evaluator,
             'metric' || CAST(k.kid AS VARCHAR) AS metric, CAST(substring(o.o_orderpriority, 1, 1) AS INT) AS base,
             {_sq(_RAT)} AS h
      FROM orders o CROSS JOIN (SELECT mid, model FROM models WHERE mid < 2) m
      CROSS JOIN (SELECT * FROM (VALUES (1),(2)) AS a(eid)) e
      CROSS JOIN (SELECT * FROM (VALUES (1),(2),(3),(4),(5)) AS b(kid)) k) q"""),
    "judgements": (("responses_t0",), f"""SELECT case_id, model, variant, truth_position,
       CASE WHEN h % 10 < 5 THEN 1 WHEN h % 10 < 9 THEN 2 ELSE NULL END AS preferred,
       CAST(CASE WHEN h % 23 = 0 THEN NULL ELSE h % 6 END AS DOUBLE) AS agreement
FROM (SELECT r.case_id, r.model, r.variant, p.pos AS truth_position, {_sq(_JH)} AS h
      FROM responses_t0 r CROSS JOIN (SELECT * FROM (VALUES (1),(2)) AS a(pos)) p
      WHERE r.model IN ('m0','m1') AND r.variant IN ('prompt1','prompt2')) q"""),
    "questions": (("cases",), """SELECT c.case_id, CAST(c.case_id AS VARCHAR) AS case_key,
       CASE WHEN c.case_id % 50 = 0 THEN '' ELSE 'Case ' || o.o_orderpriority END AS case_text,
       'Which option fits customer ' || CAST(o.o_custkey AS VARCHAR) || '?' AS question,
       'A. alpha; B. beta; C. gamma; D. delta; E. epsilon.' AS options,
       c.truth || '. answer' AS answer, 'Because of ' || o.o_orderstatus AS explanation,
       CASE WHEN c.labs THEN 'Yes' ELSE 'No' END AS labs, CASE WHEN c.has_table THEN 'Yes' ELSE 'No' END AS has_table
FROM cases c JOIN orders o ON o.o_orderkey = c.case_id"""),
    "generations": ((), """SELECT u.conv_id, u.turn, 'm' || CAST(u.conv_id % 6 AS VARCHAR) || '_promptID_00' || CAST(u.turn % 2 + 1 AS VARCHAR) || '_output_' || CAST(u.conv_id % 11 AS VARCHAR) || '.json' AS file_name,
       'START ' || u.text || ' END' || a.text AS text
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'"""),
    "articles": ((), f"""SELECT CASE WHEN doc_id % 4 = 0 THEN 'pubmed' ELSE 'pmc' END AS db, CAST(2018 + doc_id % 5 AS INT) AS year, doc_id, {ARTICLE_XML} AS xml
FROM documents"""),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs of ``names`` (and their dependencies, in order)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEW_SQL[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS (\n{VIEW_SQL[n][1]}\n)" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _graded(src: str, keys: str) -> str:
    return f"""SELECT {keys}, case_id, truth, r AS response,
       CASE WHEN r IS NULL THEN NULL WHEN contains(r, '-') THEN 'MULTI' WHEN r IN ('HALL', 'NONE') THEN 'HALL / NONE' ELSE r END AS category,
       CASE WHEN r IN ('A', 'B', 'C', 'D', 'E') THEN r END AS valid,
       (r IN ('A', 'B', 'C', 'D', 'E')) AS is_valid,
       coalesce(CASE WHEN r IN ('A', 'B', 'C', 'D', 'E') THEN r END = truth, false) AS correct
FROM (SELECT *, nullif(upper(trim(response)), '') AS r FROM {src}) s"""


VIEW_SQL.update({
    "graded_t0": (("responses_t0",), _graded("responses_t0", "model, variant, labs")),
    "graded_rep": (("responses_rep",), _graded("responses_rep", "model, temperature, run")),
    "graded_m2": (("responses_machine2",), _graded("responses_machine2", "model")),
    # per (T, model, case): label counts -> plurality vote (both tie modes)
    "votes_rep": (("graded_rep",), """SELECT temperature, model, case_id,
       sum(CASE WHEN n = top_n THEN 1 ELSE 0 END) > 1 AS tie,
       CASE WHEN sum(CASE WHEN n = top_n THEN 1 ELSE 0 END) = 1 THEN max(CASE WHEN n = top_n THEN response END) END AS vote,
       CASE WHEN sum(CASE WHEN n = top_n THEN 1 ELSE 0 END) = 1 THEN max(top_n) END AS n_vote,
       max(top_n) AS top_n, CAST(sum(n) AS BIGINT) AS n_answers
FROM (SELECT *, max(n) OVER (PARTITION BY temperature, model, case_id) AS top_n
      FROM (SELECT temperature, model, case_id, response, count(*) AS n FROM graded_rep
            WHERE response IS NOT NULL GROUP BY ALL) c) t
GROUP BY temperature, model, case_id"""),
    "per_case_rep": (("graded_rep",), """SELECT temperature, model, case_id, count_if(correct) AS n_correct, count(*) AS n_runs
FROM graded_rep GROUP BY temperature, model, case_id"""),
})
