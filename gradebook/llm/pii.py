"""Personal data by candidate gradient boosting (DataFrame functions on the main path).

Base spans (email, ip, card, phone) are leftmost, non-overlapping matches of fixed patterns, checked and never retried.

The method adds spans of two further kinds.  High-recall generators propose candidates that may overlap base spans and
each other: ``secret``, runs of 16 and more letters and digits with a digit; ``number``, runs of seven and more digits
with separators, and inside such a run every join of neighbouring digit groups, from every start, of up to
``SUB_DIGITS`` digits.  Each has yes/no features of format and context.  Small boosted trees (logistic loss, depth 2) score
them, and those over a calibrated threshold become spans, unless a base span already covers them.

Labels for the fit are weak: a number is positive where it is a base span, a secret where an assignment to a key word
(token, password, ...) stands before it; neither fact is a feature (the check digit of a number is one).  The fit reads all documents.
Only counts by feature cell, at most 2^features by kind, reach the driver; boosting works on those counts, and
the trees come back as one SQL expression.  The threshold is the lowest score at which cells of the other half of
the fit rows are still ``PRECISION`` pure.

Offsets are code points, the end exclusive.  Patterns are the stated ones in forms that Java's matcher runs in linear time
without recursion (possessive, anchored at the first character of a run), with equal matches.

Defined results: null and empty texts have no spans (the digest of an empty string).  A candidate equal to an earlier
one is one span.  Without positive candidates in the fit nothing is added.  Rows are independent; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "number")

ROUNDS, SHRINK = 20, 0.3
MIN_CELL = 5          # candidates in a cell before its purity counts
PRECISION = 0.95

# fixed values: the four base patterns, and the two generators
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+",
    "number": r"(?<![0-9])\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+",
}
CONTEXT = 16
SUB_DIGITS = 19       # the longest number of a base kind (card); a run is a candidate at any length
KEY_WORDS = r"(?i)(?:token|passw(?:or)?d|secret|api.?key|access.?key|key)[\x20\"']{0,2}[=:][\x20\"']{0,2}$"

_N_DIGITS = "length(regexp_replace(x.m, '[^0-9]', ''))"
_DOUBLED = "array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)"
_LUHN = f"""aggregate(transform(filter(split(reverse(regexp_replace(x.m, '[^0-9]', '')), ''), d -> d <> ''),
    (d, i) -> IF(i % 2 = 0, CAST(d AS INT), {_DOUBLED}[CAST(d AS INT)])), 0, (s, d) -> s + d) % 10 = 0"""
_CHECK_DIGIT = f"CASE WHEN {_N_DIGITS} BETWEEN 12 AND 19 THEN {_LUHN} ELSE false END"
FEATURES = {
    "secret": ("x.m RLIKE '^[0-9a-fA-F]+$'", "length(x.m) >= 32", "x.m RLIKE '[a-z]' AND x.m RLIKE '[A-Z]'", "right(x.c, 1) IN ('\"', '=', ':')",
               f"{_N_DIGITS} * 5 >= length(x.m)", "x.m RLIKE '[_-]'"),
    "number": ("x.m LIKE '+%'", "x.m LIKE '%(%'", "x.m RLIKE '[0-9] [0-9]'", "x.m LIKE '%-%'", "x.m RLIKE '^[0-9]+([.][0-9]+){3}$'",
               f"{_N_DIGITS} BETWEEN 12 AND 19", f"{_N_DIGITS} BETWEEN 9 AND 11", "x.c = '' OR right(x.c, 1) IN (' ', ':', '\n')",
               _CHECK_DIGIT),
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
CHECKS = {
    "email": None,
    "ip": f"x.m RLIKE '^{_PART}([.]{_PART}){{3}}$'",
    "card": _CHECK_DIGIT,
    "phone": f"{_N_DIGITS} BETWEEN 9 AND 15",
    "secret": None,
    "number": None,
}


def matches(kind: str, text: str = "text"):
    """Array of (s, e, k, m, c): span, number of the kind, matched string and the text before it, of checked matches."""
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    pairs = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("p"), F.expr(f"regexp_extract_all({text}, '{pattern}', 0)").alias("m"))
    check = CHECKS[kind] or "true"
    out = "ARRAY<STRUCT<s: INT, e: INT, k: INT, m: STRING, c: STRING>>"
    fold = f"""aggregate(_pairs, named_struct('at', 0, 'out', CAST(array() AS {out})),
        (a, x) -> named_struct('at', a.at + length(x.p) + coalesce(length(x.m), 0), 'out', IF(x.m IS NOT NULL AND ({check}),
            concat(a.out, array(named_struct('s', a.at + length(x.p), 'e', a.at + length(x.p) + length(x.m), 'k', {KINDS.index(kind)},
                                             'm', x.m, 'c', right(x.p, {CONTEXT})))), a.out)), a -> a.out)"""
    return pairs, fold, out


def _sub_runs() -> str:
    """SQL for: the runs in ``number`` and, inside each, the joins of neighbouring digit groups of 7 to ``SUB_DIGITS`` digits."""
    digit = "ch[{0}] BETWEEN '0' AND '9'"
    first = f"filter(sequence(0, size(ch) - 1), p -> {digit.format('p')} AND (p = 0 OR NOT {digit.format('greatest(p - 1, 0)')}))"
    last = f"filter(sequence(0, size(ch) - 1), p -> {digit.format('p')} AND (p = size(ch) - 1 OR NOT {digit.format('least(p + 1, size(ch) - 1)')}))"
    spans = f"""flatten(transform(sequence(0, size(a) - 1), i -> transform(sequence(i, least(size(a), i + {SUB_DIGITS}) - 1),
        j -> named_struct('s', IF(i = 0, 0, a[i]), 'e', b[j] + 1))))"""
    # by index: slice() would copy the whole array each time
    chars = "transform(sequence(y.s, y.e - 1), p -> ch[p])"
    fits = f"""y.e - y.s <= {4 * SUB_DIGITS} AND y.e - y.s < size(ch)
        AND size(filter(sequence(y.s, y.e - 1), p -> {digit.format('p')})) BETWEEN 7 AND {SUB_DIGITS}"""
    before = f"IF(y.s = 0, '', array_join(transform(sequence(greatest(y.s - {CONTEXT}, 0), y.s - 1), p -> ch[p]), ''))"
    made = f"""named_struct('s', x.s + y.s, 'e', x.s + y.e, 'k', x.k, 'm', array_join({chars}, ''),
        'c', right(concat(x.c, {before}), {CONTEXT}))"""
    inner = f"transform(filter({spans}, y -> {fits}), y -> {made})"
    for name, value in (("b", last), ("a", first), ("ch", "filter(split(x.m, ''), d -> d <> '')")):
        inner = f"flatten(transform(array({value}), {name} -> {inner}))"
    return f"concat(number, flatten(transform(number, x -> {inner})))"


def with_matches(docs: DataFrame, kinds=KINDS) -> DataFrame:
    """doc_id, text and one array column for each kind."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for kind in kinds:
        pairs, fold, out = matches(kind)
        rows = rows.withColumn("_pairs", pairs).withColumn(kind, F.expr(f"IF(size(_pairs) < 2, CAST(array() AS {out}), {fold})")).drop("_pairs")
    if "number" in kinds:
        rows = rows.withColumn("number", F.expr(f"IF(size(number) = 0, number, {_sub_runs()})"))
    return rows


def _covered(x: str = "x") -> str:
    return f"exists(_base, b -> b.s <= {x}.s AND {x}.e <= b.e)"


# ------------------------------------------------------------------------------------------ boosting on cells

def boost(cells: list[tuple[tuple[int, ...], float, float]], rounds: int = ROUNDS, shrink: float = SHRINK) -> tuple[float, list]:
    """Bias and trees from (features, rows, positive rows); a tree is (feature, feature, four leaf values by their bits)."""
    n, pos = sum(c[1] for c in cells), sum(c[2] for c in cells)
    bias = math.log((pos + 0.5) / (n - pos + 0.5))
    score, trees = [bias] * len(cells), []
    width = len(cells[0][0])
    for _ in range(rounds):
        grad = [(c[2] - c[1] / (1 + math.exp(-s)), c[1] / (1 + math.exp(-s)) / (1 + math.exp(s))) for c, s in zip(cells, score)]
        best = None
        for i, j in combinations(range(width), 2):
            leaf = [[0.0, 1.0] for _ in range(4)]
            for c, (g, h) in zip(cells, grad):
                k = 2 * c[0][i] + c[0][j]
                leaf[k][0] += g
                leaf[k][1] += h
            gain = sum(g * g / h for g, h in leaf)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, i, j, [shrink * g / h for g, h in leaf])
        _, i, j, values = best
        trees.append((i, j, values))
        score = [s + values[2 * c[0][i] + c[0][j]] for c, s in zip(cells, score)]
    return bias, trees


def tree_score(model: tuple[float, list], bits) -> float:
    bias, trees = model
    return bias + sum(v[2 * bits[i] + bits[j]] for i, j, v in trees)


def calibrate(model, cells) -> float:
    """The lowest score at and above which the cells are ``PRECISION`` pure; infinite if none is."""
    at, n, pos = math.inf, 0.0, 0.0
    for s, rows, hits in sorted(((tree_score(model, c[0]), c[1], c[2]) for c in cells), key=lambda x: -x[0]):
        n, pos = n + rows, pos + hits
        if rows >= MIN_CELL and hits < PRECISION * rows or pos < PRECISION * n:
            break
        if n >= MIN_CELL:
            at = s
    return at


def fit(docs: DataFrame) -> dict[str, tuple]:
    """kind -> (bias, trees, threshold), from the candidates of all documents: one pass counts the cells of both kinds."""
    rows = with_matches(docs).withColumn("_base", F.concat(*BASE_KINDS)).withColumn("_half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)))
    width = max(len(names) for names in FEATURES.values())

    def seen(kind: str) -> str:
        label = "exists(_base, b -> b.s = x.s AND b.e = x.e)" if kind == "number" else f"x.c RLIKE '{KEY_WORDS.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}'"
        bits = [f"CAST({f} AS INT)" for f in FEATURES[kind]] + ["0"] * (width - len(FEATURES[kind]))
        return f"transform({kind}, x -> named_struct('kind', '{kind}', 'y', CAST({label} AS INT), 'f', array({', '.join(bits)})))"

    found = rows.select("_half", F.explode(F.expr(f"concat({', '.join(seen(kind) for kind in FEATURES)})")).alias("x"))
    cells = found.groupBy("_half", "x.kind", *(F.col("x.f")[i].alias(f"f{i}") for i in range(width))).agg(F.count(F.lit(1)).alias("n"), F.sum("x.y").alias("y")).collect()
    out = {}
    for kind, names in FEATURES.items():
        halves: dict[int, list] = {0: [], 1: []}
        for r in sorted((r for r in cells if r["kind"] == kind), key=str):
            halves[r["_half"]].append((tuple(r[f"f{i}"] for i in range(len(names))), float(r["n"]), float(r["y"])))
        if sum(c[2] for c in halves[0]) and halves[1]:
            model = boost(halves[0])
            out[kind] = (*model, calibrate(model, halves[1]))
        else:
            out[kind] = (0.0, [], math.inf)
    return out


def _accepted(kind: str, bias: float, trees: list, threshold: float) -> str:
    """SQL for: the candidates of ``kind`` that score at least the threshold and that no base span covers."""
    if math.isinf(threshold):
        return f"filter({kind}, x -> false)"
    bits = FEATURES[kind]
    total = " + ".join([f"{bias!r}D", *(f"IF(f[{i}], IF(f[{j}], {v[3]!r}D, {v[2]!r}D), IF(f[{j}], {v[1]!r}D, {v[0]!r}D))" for i, j, v in trees)])
    # the features of a candidate are taken once, for all trees
    return f"filter({kind}, x -> NOT {_covered()} AND exists(array(array({', '.join(bits)})), f -> ({total}) >= {threshold - 1e-9!r}D))"


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    ordered = f"sort_array(transform({spans}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)))"
    return f"array_join(transform({ordered}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def find_spans(docs: DataFrame, model: dict[str, tuple]) -> DataFrame:
    """doc_id, text, base and all spans as arrays of (s, e, k, m, c), and the counts of the base kinds."""
    rows = with_matches(docs).withColumn("_base", F.concat(*BASE_KINDS))
    added = [F.expr(_accepted(kind, *model[kind])) for kind in FEATURES]
    return rows.select("doc_id", "text", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS), F.col("_base").alias("base"),
                       F.concat("_base", *added).alias("all"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("all")).alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    spans = "sort_array(transform(all, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)))"
    fold = f"""aggregate({spans}, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', greatest(a.at, x.e), 'out',
        IF(x.s < a.at, a.out, concat(a.out, substring(text, a.at + 1, x.s - a.at), {names}[x.k]))), a -> concat(a.out, substring(text, a.at + 1)))"""
    return found.select("doc_id", F.expr(fold).alias("text"))
