"""Toxicity by a weighted finite-state pattern grammar.

A text becomes a string of symbols: INSULT, THREAT, SUBJECT, TARGET, PATIENT, NEGATION, REPORT, clause end, sentence end, other.  All of
SUBJECT, TARGET and PATIENT name somebody: a SUBJECT as the one who acts, a TARGET as one who is acted on when it follows the
verb, a PATIENT (``dich``, ``te``) wherever it stands.  Four small transducers are composed into one automaton:

* negation: an insult or threat within ``SCOPE`` words after a negation in the same clause is marked negated;
* reported speech: after a reporting verb, up to the sentence end, it is marked reported;
* threat: a threat verb counts only with an object in reach after it, or a patient before or after it;
* target: an insult with anybody in reach, before or after it, is marked aimed.

Words are runs of letters; an ending ``n't``, with either apostrophe, makes its word a negation.

Each finished match emits one of ``KINDS``; a document's score is a logistic function of its matched clauses by kind.

What counts as an insult is learned from labelled rows: words, and word beginnings of 3 to 8 bytes, that stand in
toxic rows and hardly in others, chosen greedily by how many toxic rows they newly explain; forms of one
term, and the wording of a group of copies, stand in the same rows and count once.  Weights are a logistic regression over the kinds, drawn towards ``PRIOR``.

The fit reads at most ``FIT_ROWS`` labelled rows, the first by hash of doc_id; every document is scored, whole.

Defined results: null, empty or word-less text: the score of a text without matches.  No usable label of class 1:
nothing is learned and no insult matches.  A doc_id labelled twice is toxic if any label says so; null labels are not
used.  Other columns are not read.  Equal rows score equally, one result each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, byte_class, documents_schema, find_words, mix, only_letters, pieces, powers, stage, text_bytes
from .common import MULTIPLIERS

FIT_ROWS = 12_000
PREFIXES = range(3, 9)
SCOPE = 3
MIN_SUPPORT = 4           # toxic rows a term stands in
MIN_SHARE = 0.004         # and their share of all toxic rows of the fit
MAX_CLEAN = 0.02          # rate in other rows, against its rate in toxic rows
DEPTH = 10                # times a toxic row is explained before it counts no more: at most DEPTH / MIN_SHARE terms are chosen
SAME = 0.6                # overlap of rows from which two terms are taken as forms of one

KINDS = ("insult", "aimed", "negated", "reported", "threat")
PRIOR = {"insult": 4.0, "aimed": 5.0, "negated": 2.5, "reported": 2.5, "threat": 4.0}
BIAS = -3.0

# fixed values: function words of the grammar and threat verbs, in English, German, French and Spanish
SUBJECT = "yours youre he she they this that du sie er tu il elle ils elles ella ellos".split()
TARGET = "you your him her his them their usted ustedes".split()
PATIENT = "dich dir euch ihn te vous".split()
NEGATION = "not never no isnt arent wasnt dont doesnt nicht kein keine pas jamais nunca".split()
REPORT = "said says wrote writes claimed claims quoted reported called sagte dit dijo".split()
THREAT = """
    kill kills killing murder murdering hurt hurting destroy destroying attack attacking beat beating shoot shooting stab stabbing burn burning
    töten töte umbringen bringe schlagen schlage verprügeln verprügle erschießen erschieße erstechen erwürgen verbrennen vernichten zerstören
    tuer tue tuerai tuerons frapper frapperai détruire détruirai brûler brûlerai poignarder étrangler égorger abattre
    matar mato mataré mataremos golpear golpearé destruir destruiré quemar quemaré apuñalar disparar
""".split()

SYMBOLS = ("other", "INSULT", "THREAT", "SUBJECT", "TARGET", "PATIENT", "NEGATION", "REPORT", "CLAUSE", "SENTENCE")
SOMEBODY = ("SUBJECT", "TARGET", "PATIENT")
LETTERS = ~byte_class((ord("a"), ord("z")), (0x80, 0xFF))
_CLAUSE = byte_class(*((ord(c), ord(c)) for c in ",;:()"))
_SENTENCE = byte_class(*((ord(c), ord(c)) for c in ".!?\n"))


# ------------------------------------------------------------------------------------------ the grammar

class Transducer:
    """Deterministic transducer: ``step(state, symbol) -> (state, tuple of symbols out)``."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step


def _negation(state, s):
    """state: words of scope left."""
    if s == "NEGATION":
        return SCOPE, (s,)
    if s in ("CLAUSE", "SENTENCE"):
        return 0, (s,)
    if state and s in ("INSULT", "THREAT"):
        return state - 1, ("NOT_" + s,)
    return max(0, state - 1), (s,)


def _reported(state, s):
    if s == "REPORT":
        return 1, (s,)
    if s == "SENTENCE":
        return 0, (s,)
    if state and s.endswith(("INSULT", "THREAT")):
        return state, ("SAID_" + s,)
    return state, (s,)


def _aim(state, s):
    """state: (words since somebody was named, words since a patient, a plain insult or threat still waiting, for how many words)."""
    since, patient, wait, left = state
    end = s in ("CLAUSE", "SENTENCE")
    if s in SOMEBODY:
        after = (0, 0 if s == "PATIENT" else min(patient + 1, SCOPE + 1))
        if wait == "INSULT" or wait and s != "SUBJECT":
            return (*after, "", 0), ("aimed" if wait == "INSULT" else "threat",)
        wait = wait if left else ""
        return (*after, wait, max(0, left - 1)), ()
    out = ()
    if wait and (end or left == 0 or s.endswith(("INSULT", "THREAT"))):
        out, wait = (("insult",) if wait == "INSULT" else ()), ""
    near = patient if s == "THREAT" else since
    since, patient = (SCOPE + 1, SCOPE + 1) if end else (min(since + 1, SCOPE + 1), min(patient + 1, SCOPE + 1))
    if s.startswith("SAID_"):
        return (since, patient, wait, max(0, left - 1)), (*out, "reported")
    if s.startswith("NOT_"):
        return (since, patient, wait, max(0, left - 1)), (*out, "negated")
    if s in ("INSULT", "THREAT"):
        if near <= SCOPE:
            return (since, patient, "", 0), (*out, "aimed" if s == "INSULT" else "threat")
        return (since, patient, s, SCOPE - 1), out
    return (since, patient, wait, max(0, left - 1)), out


def compose(*chain: Transducer) -> tuple[list[dict], int]:
    """The product automaton over SYMBOLS as a table: state -> symbol -> (state, kinds)."""
    def step(state, s):
        stream, after = (s,), []
        for t, own in zip(chain, state):
            nxt = []
            for x in stream:
                own, out = t.step(own, x)
                nxt += out
            after.append(own)
            stream = tuple(nxt)
        return tuple(after), tuple(x for x in stream if x in KINDS)

    start = tuple(t.start for t in chain)
    number, table, todo = {start: 0}, [], [start]
    while todo:
        state = todo.pop(0)
        row = []
        for s in SYMBOLS:
            after, out = step(state, s)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], tuple(KINDS.index(x) for x in out)))
        table.append(row)
    return table


GRAMMAR = compose(Transducer(0, _negation), Transducer(0, _reported), Transducer((SCOPE + 1, SCOPE + 1, "", 0), _aim))
_END = SYMBOLS.index("SENTENCE")
_RESET = 2 * SCOPE + 2  # other words after which only the reported state is left


def match(symbols: np.ndarray) -> np.ndarray:
    """Matched clauses by kind in one text's symbol string (runs of ``other`` are cut at ``_RESET``)."""
    found, state = np.zeros(len(KINDS)), 0
    for s in symbols:
        state, out = GRAMMAR[state][s]
        for k in out:
            found[k] += 1
    for k in GRAMMAR[state][_END][1]:
        found[k] += 1
    return found


# ------------------------------------------------------------------------------------------ words and terms

def _hash_word(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(find_words(data, np.array([0, len(data)]), LETTERS).hash[0])


_FIXED = {SYMBOLS.index(name): np.sort(np.array([_hash_word(w) for w in words], np.uint64))
          for name, words in (("THREAT", THREAT), ("SUBJECT", SUBJECT), ("TARGET", TARGET), ("PATIENT", PATIENT), ("NEGATION", NEGATION), ("REPORT", REPORT))}


def _prefix_hashes(data: np.ndarray, words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, hashes) of the first ``size`` bytes of longer words; they differ from any whole word's hash."""
    at = np.flatnonzero(words.end - words.start > size)
    h = np.zeros(len(at), np.uint64)
    for k in range(size):
        h += (data[words.start[at] + k].astype(np.uint64) + np.uint64(1)) * powers(size)[k]
    return at, mix(h ^ MULTIPLIERS[20 + size])


def terms(data: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
    """(document, term hash) of every word and word beginning, repeated ones included."""
    docs, out = [words.doc], [words.hash]
    for size in PREFIXES:
        at, h = _prefix_hashes(data, words, size)
        docs.append(words.doc[at])
        out.append(h)
    return np.concatenate(docs), np.concatenate(out)


def _isin(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def symbols_of(data: np.ndarray, words, lexicon: dict) -> np.ndarray:
    """The symbol of each word; ``lexicon``: sorted hashes of whole words (0) and beginnings (by size)."""
    out = np.zeros(len(words.hash), np.int8)
    for s, table in _FIXED.items():
        out[_isin(words.hash, table)] = s
    insult = _isin(words.hash, lexicon[0])
    for size in PREFIXES:
        if len(lexicon[size]):
            at, h = _prefix_hashes(data, words, size)
            insult[at[_isin(h, lexicon[size])]] = True
    out[insult] = SYMBOLS.index("INSULT")
    return out


def contracted_negations(low: np.ndarray, words) -> np.ndarray:
    """Numbers of the words ``...n`` that are followed by apostrophes and the word ``t``."""
    if len(words.hash) < 2:
        return np.zeros(0, np.int64)
    gap = np.concatenate([[0], np.cumsum(low != ord("'"))])
    joined = (words.doc[1:] == words.doc[:-1]) & (gap[words.start[1:]] == gap[words.end[:-1]])
    return np.flatnonzero(joined & (low[words.end[:-1] - 1] == ord("n")) & (low[words.start[1:]] == ord("t")) & (words.end[1:] - words.start[1:] == 1))


def features(data: np.ndarray, offsets: np.ndarray, lexicon: dict) -> np.ndarray:
    """(documents, KINDS) matched clauses."""
    low = only_letters(LOWER[data])
    words = find_words(low, offsets, LETTERS)
    out = np.zeros((len(offsets) - 1, len(KINDS)))
    symbol = symbols_of(low, words, lexicon)
    symbol[contracted_negations(low, words)] = SYMBOLS.index("NEGATION")
    hot = np.unique(words.doc[(symbol == 1) | (symbol == 2)])
    for d in hot:
        lo, hi = words.first[d], words.first[d] + words.per_doc[d]
        own = symbol[lo:hi]
        body = low[offsets[d]:offsets[d + 1]]
        ends = np.flatnonzero(_CLAUSE[body] | _SENTENCE[body])
        mark = np.where(_SENTENCE[body[ends]], _END, _END - 1)
        at = np.concatenate([words.start[lo:hi] - offsets[d], ends])
        kind = np.concatenate([own, mark])
        kind = kind[np.argsort(at, kind="stable")]
        # runs of other words longer than every scope change nothing further
        other = kind == 0
        since = np.arange(len(kind)) - np.maximum.accumulate(np.where(other, -1, np.arange(len(kind))))
        out[d] = match(kind[~other | (since <= _RESET)])
    return out


# ------------------------------------------------------------------------------------------ fit and score

def fit_rows(docs: DataFrame, labels: DataFrame, label: str, usable, limit: int) -> DataFrame:
    """text and y of at most ``limit`` labelled rows: the first by hash of doc_id among those that ``usable`` allows."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(usable & F.col("y").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("text", "y")  # at most `limit` narrow rows


def _toxic_terms(batches):
    """Distinct terms of each toxic row, under a row key made of its text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in pieces(offsets):
            low = only_letters(LOWER[data[offsets[i]:offsets[j]]])
            words = find_words(low, offsets[i:j + 1] - offsets[i], LETTERS)
            doc, h = terms(low, words)
            pair = np.unique(np.stack([doc.astype(np.uint64), h], axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
            key = np.array(batch.column("row").slice(i, j - i).to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[pair[:, 0].astype(np.int64)] if len(pair) else np.zeros(0, np.int64)),
                                              pa.array(pair[:, 1].view(np.int64))], names=["row", "term"])


def _clean_counts(known: np.ndarray) -> Callable:
    def fn(batches):
        count = np.zeros(len(known), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in pieces(offsets):
                low = only_letters(LOWER[data[offsets[i]:offsets[j]]])
                doc, h = terms(low, find_words(low, offsets[i:j + 1] - offsets[i], LETTERS))
                keep = _isin(h, known)
                k = np.unique(np.stack([doc[keep], np.searchsorted(known, h[keep])]), axis=1)[1] if keep.any() else np.zeros(0, np.int64)
                count += np.bincount(k, minlength=len(known))
        k = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(known[k].view(np.int64)), pa.array(count[k])], names=["term", "n"])
    return fn


def learn_lexicon(rows: DataFrame) -> np.ndarray:
    """Hashes of the insult terms.  What reaches the driver is bounded by the fit rows and ``MIN_SUPPORT``."""
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic:
        return np.zeros(0, np.uint64)
    pair = T.StructType([T.StructField("row", T.LongType()), T.StructField("term", T.LongType())])
    least = max(MIN_SUPPORT, int(MIN_SHARE * toxic))
    seen = stage(rows.where("y = 1").select(F.xxhash64("text").alias("row"), "text").dropDuplicates(["row"]).mapInArrow(_toxic_terms, pair), "terms")
    often = [(r["term"], r["n"]) for r in seen.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).collect()]
    if not often:
        return np.zeros(0, np.uint64)
    known = np.sort(np.array([t for t, _ in often], np.int64).view(np.uint64))
    counted = T.StructType([T.StructField("term", T.LongType()), T.StructField("n", T.LongType())])
    other = {r["term"]: r["n"] for r in rows.where("y = 0").select("text").mapInArrow(_clean_counts(known), counted)
             .groupBy("term").agg(F.sum("n").alias("n")).collect()}
    good = [t for t, n in often if other.get(t, 0) / max(1, clean) <= MAX_CLEAN * n / toxic]
    if not good:
        return np.zeros(0, np.uint64)
    near = seen.join(F.broadcast(rows.sparkSession.createDataFrame([(t,) for t in good], "term long")), "term", "left_semi")
    rows_of: dict[int, set] = {}
    for r in near.groupBy("term").agg(F.collect_set("row").alias("rows")).collect():
        rows_of[r["term"]] = set(r["rows"])
    chosen, times = [], Counter()
    order = list(rows_of)
    while order:
        gain = {t: sum(times[r] < DEPTH for r in rows_of[t]) for t in order}
        best = min(order, key=lambda t: (-gain[t], other.get(t, 0), t))
        if gain[best] < least:
            break
        chosen.append(best)
        times.update(rows_of[best])
        same = lambda t: len(rows_of[t] & rows_of[best]) >= SAME * len(rows_of[t] | rows_of[best])  # noqa: B023, E731
        order = [t for t in order if gain[t] >= least and not same(t)]
    return np.sort(np.array(chosen, np.int64).view(np.uint64))


def _kinds(lexicon: dict) -> Callable:
    def fn(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in pieces(offsets):
                x = features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], lexicon)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(i, j - i), *(pa.array(x[:, k]) for k in range(len(KINDS)))], names=["y", *KINDS])
    return fn


def _design(x: np.ndarray) -> np.ndarray:
    return np.log2(1 + x)


def learn_weights(rows: DataFrame, lexicon: dict) -> np.ndarray:
    """Bias and weights, from the table of distinct feature rows (at most the fit rows)."""
    schema = T.StructType([T.StructField("y", T.IntegerType())] + [T.StructField(k, T.DoubleType()) for k in KINDS])
    cells = rows.select("text", "y").mapInArrow(_kinds(lexicon), schema) \
        .groupBy("y", *KINDS).agg(F.count(F.lit(1)).alias("n")).collect()
    prior = np.array([BIAS, *(PRIOR[k] for k in KINDS)])
    if not cells:
        return prior
    x = np.array([[1.0, *_design(np.array([r[k] for k in KINDS]))] for r in cells])
    y, n = np.array([float(r["y"] > 0) for r in cells]), np.array([float(r["n"]) for r in cells])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + (w - prior)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    """Lexicon by beginning size (0: whole words) and weights; small, sent with the tasks."""

    def __init__(self, lexicon: dict, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights


def fit(docs: DataFrame, labels: DataFrame, usable, limit: int = FIT_ROWS, label: str = "toxic") -> Model:
    rows = stage(fit_rows(docs, labels, label, usable, limit), "fit")
    found = learn_lexicon(rows)
    lexicon = {0: found, **{size: found for size in PREFIXES}}
    return Model(lexicon, learn_weights(rows, lexicon))


def _chances(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(score, matched clauses by kind) of each text."""
    x = features(data, offsets, model.lexicon)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + _design(x) @ model.weights[1:], -30, 30))), x


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and matched clauses by kind for every row."""
    def fn(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in pieces(offsets):
                p, x = _chances(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], model)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(p), *(pa.array(x[:, k].astype(np.int64)) for k in range(len(KINDS)))],
                                                 names=["doc_id", "score", *KINDS])

    schema = documents_schema(docs, [("score", T.DoubleType()), *((k, T.LongType()) for k in KINDS)])
    return docs.select("doc_id", "text").mapInArrow(fn, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``."""
    def fn(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            p = [_chances(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], model)[0] for i, j in pieces(offsets)]
            if p:
                yield batch.filter(pa.array(np.concatenate(p) < threshold))

    return docs.mapInArrow(fn, docs.schema)
