"""Language identification: script ranges narrow the candidates, Viterbi labels spans of mixed text.

Fit, on at most about ``FIT_ROWS`` labelled rows (those whose hash of doc_id falls under a share of all): for each
language, counts of letter trigrams hashed to ``BUCKETS`` (words padded by a blank on both sides, lower-cased where ASCII),
and the share of its letters in each script range.  A word is a run of ASCII letters and of characters beyond ASCII that
are letters or marks by their general category: quotes, dashes and signs part words and speak for no language.

Prediction: a word's score for a language is the sum of its trigram log probabilities.  A word whose script makes up
under ``SCRIPT_SHARE`` of a language's letters can't be of that language, unless that excludes all of them.  The best label sequence
over a document's words under a penalty of ``SWITCH`` for each change is found by Viterbi, for many documents at a time.
lang is the label of most letters, score the share of those letters.

Defined results: null text, or a text without a letter: ``und`` with score 0.  A fit without any usable row: all ``und``.
Ties go to the language that sorts first.  Rows are independent; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, byte_class, documents_schema, find_words, only_letters, pieces, text_bytes, wide_characters

FIT_ROWS = 30_000
BUCKETS = 1 << 15
SWITCH = 8.0
SCRIPT_SHARE = 0.005
SMOOTH = 0.5
VITERBI_BYTES = 8 << 20   # text labelled at once; one longer document is a piece of its own

LETTERS = ~byte_class((ord("a"), ord("z")), (0x80, 0xFF))

# fixed values: first code points of script ranges; a range ends where the next one starts
SCRIPTS = ("latin", "greek", "cyrillic", "armenian_hebrew", "arabic", "indic", "kana_cjk", "hangul", "other")
RANGES = ((0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian_hebrew"), (0x0600, "arabic"),
          (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "indic"), (0x0E00, "other"), (0x1100, "hangul"),
          (0x1200, "other"), (0x1C80, "cyrillic"), (0x1C90, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2DE0, "cyrillic"),
          (0x2E00, "other"), (0x2E80, "kana_cjk"), (0x3130, "hangul"), (0x3190, "kana_cjk"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
          (0xA720, "latin"), (0xA800, "other"), (0xA8E0, "indic"), (0xA900, "other"), (0xA960, "hangul"), (0xA980, "other"), (0xAC00, "hangul"),
          (0xD800, "other"), (0xF900, "kana_cjk"), (0xFB00, "latin"), (0xFB13, "armenian_hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
          (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana_cjk"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "kana_cjk"), (0x40000, "other"))
COMBINING = (0x0300, 0x036F)   # marks of any script: they take that of their letter
_FROM = np.array([c for c, _ in RANGES])
_KIND = np.array([SCRIPTS.index(name) for _, name in RANGES], np.int8)


def scripts(low: np.ndarray) -> np.ndarray:
    """The script of each letter, at its first byte; -1 elsewhere.  ``low`` holds no wide characters but letters and marks."""
    out = np.where((low >= ord("a")) & (low <= ord("z")), np.int8(0), np.int8(-1))
    at, code, _ = wide_characters(low)
    mark = (code >= COMBINING[0]) & (code <= COMBINING[1])
    out[at] = np.where(mark, -1, _KIND[np.searchsorted(_FROM, code, side="right") - 1])
    return out


def trigrams(low: np.ndarray, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, first character's place, bucket) of each byte trigram of the padded words."""
    length = words.end - words.start
    if not len(length):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.cumsum(length) - length
    number = np.repeat(np.arange(len(length)), length)
    at = np.arange(int(length.sum())) - np.repeat(first, length) + np.repeat(words.start, length)
    here = low[at].astype(np.uint32)
    before = np.where(at == words.start[number], 32, low[np.maximum(at - 1, 0)]).astype(np.uint32)
    after = np.where(at + 1 == words.end[number], 32, low[np.minimum(at + 1, len(low) - 1)]).astype(np.uint32)
    h = (before << np.uint32(16) | here << np.uint32(8) | after) * np.uint32(0x9E3779B1)
    return number, at, (h >> np.uint32(17)).astype(np.int64)


def _counts(batches):
    """Trigram and script counts of each language among a task's rows."""
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for i, j in pieces(offsets):
            low = only_letters(LOWER[data[offsets[i]:offsets[j]]])
            words = find_words(low, offsets[i:j + 1] - offsets[i], LETTERS)
            number, _, bucket = trigrams(low, words)
            names = sorted(set(langs[i:j]))
            code = np.array([names.index(x) for x in langs[i:j]])
            own = code[words.doc[number]] if len(number) else number
            table = np.bincount(own * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            kind = scripts(low)
            place = np.flatnonzero(kind >= 0)
            who = code[np.searchsorted(offsets[i:j + 1] - offsets[i], place, side="right") - 1] if len(place) else place
            script = np.bincount(who * len(SCRIPTS) + kind[place], minlength=len(names) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
            for k, name in enumerate(names):
                a, b = found.setdefault(name, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPTS), np.int64)))
                a += table[k]
                b += script[k]
    for name, (a, b) in found.items():
        both = np.concatenate([a, b])
        k = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k), pa.array(both[k])], names=["lang", "k", "n"])


class Model:
    """Languages in order, (languages, BUCKETS) log probabilities, (languages, SCRIPTS) shares; bounded by the number of languages."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)
        self.allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))


def fit(docs: DataFrame, usable, limit: int = FIT_ROWS) -> Model:
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    total = rows.count()
    parts = 1_000_000
    share = parts if total <= limit else max(1, parts * limit // total)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share).select("text", "lang")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    got = some.mapInArrow(_counts, schema).groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    table[[langs.index(x) for x in got["lang"]], got["k"].to_numpy(np.int64)] = got["n"]
    return Model(langs, table[:, :BUCKETS], table[:, BUCKETS:])


def word_scores(low: np.ndarray, words, model: Model) -> np.ndarray:
    """(words, languages) log probabilities, with languages ruled out by the word's script far down."""
    number, at, bucket = trigrams(low, words)
    n = len(words.hash)
    first = np.searchsorted(number, np.arange(n))
    out = np.empty((n, len(model.langs)), np.float32)
    for k in range(len(model.langs)):
        out[:, k] = np.add.reduceat(model.logp[k][bucket], first) if n else 0
    # the script of a word's last non-ASCII letter, else of its first
    script_of = scripts(low)
    kind = script_of[at]
    out_of = np.where((kind >= 0) & (low[at] >= 0x80), at, -1)
    last = np.maximum.reduceat(out_of, first) if n else first
    script = script_of[np.where(last >= 0, last, words.start)] if n else first
    fits = model.allowed[:, np.maximum(script, 0)].T & (script >= 0)[:, None]
    fits |= ~fits.any(axis=1, keepdims=True)
    return np.where(fits, out, out - np.float32(1e4))


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word; documents advance together, longest first."""
    labels = np.zeros(len(scores), np.int16)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    if not len(order):
        return labels
    first, count = first[order], count[order]
    alive = np.searchsorted(-count, -np.arange(int(count[0])), side="left")  # documents longer than t
    stay = np.zeros(scores.shape, bool)
    best_before = np.zeros(len(scores), np.int16)
    total = scores[first].copy()
    for t in range(1, int(count[0])):
        n = alive[t]
        at, cur = first[:n] + t, total[:n]
        top = cur.argmax(axis=1)
        jump = np.take_along_axis(cur, top[:, None], 1) - np.float32(switch)
        keep = cur >= jump
        stay[at] = keep
        best_before[at] = top
        total[:n] = np.where(keep, cur, jump) + scores[at]
    label = total.argmax(axis=1)
    last = count - 1
    labels[first + last] = label
    for t in range(int(count[0]) - 1, 0, -1):
        n = alive[t]
        at = first[:n] + t
        own = label[:n]
        label[:n] = np.where(stay[at, own], own, best_before[at])
        labels[at - 1] = label[:n]
    return labels


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _predict(model: Model, spans: bool) -> Callable:
    def fn(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in pieces(offsets, VITERBI_BYTES):
                low = only_letters(LOWER[data[offsets[i]:offsets[j]]])
                own = offsets[i:j + 1] - offsets[i]
                got, scores = [], []
                for a, b in pieces(own):
                    words = find_words(low[own[a]:own[b]], own[a:b + 1] - own[a], LETTERS)
                    scores.append(word_scores(low[own[a]:own[b]], words, model))
                    got.append((words.doc + a, words.start + own[a], words.end + own[a], words.per_doc))
                doc, start, end, per_doc = (np.concatenate(x) for x in zip(*got))
                first = np.cumsum(per_doc) - per_doc
                names, share, runs = [], [], []
                n_lang = len(model.langs)
                if n_lang:
                    label = viterbi(np.concatenate(scores), first, per_doc)
                    letters = np.bincount(doc * n_lang + label, weights=end - start, minlength=(j - i) * n_lang).reshape(-1, n_lang)
                ascii_letter = np.zeros(j - i, bool)
                at = np.flatnonzero((low >= ord("a")) & (low <= ord("z")))
                ascii_letter[np.searchsorted(own, at, side="right") - 1] = True
                for d in range(j - i):
                    lo, hi = first[d], first[d] + per_doc[d]
                    known = n_lang and hi > lo and (ascii_letter[d] or _has_letter(low[own[d]:own[d + 1]].tobytes().decode()))
                    if not known:
                        names.append("und")
                        share.append(0.0)
                        runs.append([])
                        continue
                    k = int(letters[d].argmax())
                    names.append(model.langs[k])
                    share.append(float(letters[d, k] / letters[d].sum()))
                    if spans:
                        cut = np.concatenate([[lo], np.flatnonzero(np.diff(label[lo:hi])) + lo + 1, [hi]])
                        runs.append([{"lang": model.langs[label[x]], "first": int(x - lo), "last": int(y - lo - 1)} for x, y in zip(cut[:-1], cut[1:])])
                    else:
                        runs.append([])
                columns = [batch.column("doc_id").slice(i, j - i), pa.array(names, pa.string()), pa.array(share, pa.float64())]
                if spans:
                    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
                    columns.append(pa.array(runs, kind))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"] + ["spans"] * spans)
    return fn


def identify(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, and spans: runs of words (numbers among the letter words) of one language."""
    extra = [("lang_pred", T.StringType()), ("score", T.DoubleType())]
    if spans:
        extra.append(("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))))
    return docs.select("doc_id", "text").mapInArrow(_predict(model, spans), documents_schema(docs, extra))
