"""op7: words count beside shapes, and the whole operator equals a plain one."""

import collections
import random

import numpy as np

from gradebook.llm import neighbours
from gradebook.llm.common import LOWER, NOT_ALNUM, find_words, text_bytes
from pyspark.sql import functions as F


def frames(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, (t, _) in enumerate(texts)], "doc_id bigint, text string, extra string")
    labels = spark.createDataFrame([(k, y) for k, (_, y) in enumerate(texts) if y is not None], "doc_id bigint, quality int")
    return docs, labels


def sentences(rng, words, n):
    return [" ".join(rng.choice(words) for _ in range(30)) for _ in range(n)]


def made(rng):
    """Good and bad texts of equal shapes that differ in their words alone."""
    good = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    bad = ["".join(rng.choice("stuvwxyz") for _ in range(5)) for _ in range(60)]
    return good, bad


def test_texts_that_differ_by_words_alone(spark):
    rng = random.Random(3)
    good, bad = made(rng)
    texts = [(t, 1) for t in sentences(rng, good, 60)] + [(t, 0) for t in sentences(rng, bad, 60)]
    asked = [(t, None) for t in sentences(rng, good, 10) + sentences(rng, bad, 10)]
    docs, labels = frames(spark, texts + asked)
    model = neighbours.fit(docs, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in neighbours.score(docs, model).collect()}
    # the cut of the query (0.3) and its mirror image
    assert min(got[k] for k in range(120, 130)) > 0.7 and max(got[k] for k in range(130, 140)) < 0.3


def test_unknown_words_are_no_sure_vote(spark):
    rng = random.Random(5)
    good, bad = made(rng)
    texts = [(t, 1) for t in sentences(rng, good, 80)] + [(t, 0) for t in sentences(rng, bad, 20)]
    strange = " ".join("".join(rng.choice("ijklmnopqr") for _ in range(5)) for _ in range(30))
    docs, labels = frames(spark, [*texts, (strange, None), (sentences(rng, good, 1)[0], None)])
    got = {r["doc_id"]: r["score"] for r in neighbours.score(docs, neighbours.fit(docs, labels, F.lit(True))).collect()}
    assert got[100] < 0.99 < got[101]


def plain_scores(texts, asked):
    """Scores by dictionaries of terms, a full singular value decomposition and a sort."""
    def words(t):
        data, offsets = text_bytes(__import__("pyarrow").array([t]))
        return [int(h) for h in find_words(LOWER[data], offsets, NOT_ALNUM).hash]

    seen = collections.Counter(w for t, _ in texts for w in set(words(t)))
    signed = {w: w - (1 << 64) if w >> 63 else w for w in seen}
    top = sorted((w for w in seen if seen[w] > 1), key=lambda w: (-seen[w], signed[w]))[:neighbours.WORDS]
    place = {w: i for i, w in enumerate(sorted(top))}

    def row(t):
        data, offsets = text_bytes(__import__("pyarrow").array([t]))
        out = np.zeros(neighbours.DIM)
        out[:neighbours.SHAPES] = neighbours.shapes(data, offsets)[0]
        own = words(t)
        for w in own:
            out[neighbours.SHAPES + place.get(w, neighbours.WORDS)] += 1
        for a, b in zip(own, own[1:]):
            if a in place and b in place:
                m = [int(x) for x in neighbours.MULTIPLIERS[:2]]
                h = neighbours.mix(np.array([(a * m[0] + b * m[1]) % (1 << 64)], np.uint64))[0]
                out[neighbours.SHAPES + neighbours.WORDS + 1 + int(h) % neighbours.PAIRS] += 1
        return np.log1p(out)

    x = np.array([row(t) for t, _ in texts])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1
    idf[neighbours.SHAPES + neighbours.WORDS] = 1

    def length_one(v):
        n = np.linalg.norm(v)
        return v / n if n else v

    def whole(r):
        r = r * idf
        return np.concatenate([length_one(r[:neighbours.SHAPES]), length_one(r[neighbours.SHAPES:])])

    x = np.array([whole(r) for r in x])
    space = np.linalg.svd(x, full_matrices=False)[2][:neighbours.RANK]
    voters = np.array([length_one(space @ r) for r in x])
    y = np.array([float(k > 0) for _, k in texts])
    k = min(neighbours.K + 1, len(voters))
    least = [np.sort(np.maximum(voters @ v, 0))[-k] for v in voters]
    doubt = neighbours.DOUBT * neighbours.K * np.quantile(least, neighbours.UNLIKE) ** neighbours.SHARP
    out = []
    for t in asked:
        r = whole(row(t))
        near = sorted(((float(s), l) for s, l in zip(voters @ length_one(space @ r), y)), reverse=True)[:neighbours.K]
        w = sum(max(s, 0) ** neighbours.SHARP for s, _ in near) + doubt
        out.append((sum(max(s, 0) ** neighbours.SHARP * l for s, l in near) + doubt * y.mean()) / w if r.any() and w else y.mean())
    return out


def test_whole_operator_equals_brute_force(spark):
    rng = random.Random(8)
    good, bad = made(rng)
    texts = [(" ".join(rng.choice(good if rng.random() < p else bad) for _ in range(rng.randrange(5, 40))), int(p > 0.5)) for p in [0.9, 0.2] * 25]
    texts = list(dict(texts).items())  # no ties between equal voters
    asked = [" ".join(rng.choice(good + bad) for _ in range(rng.randrange(1, 60))) for _ in range(20)] + ["", None, " \t ", "Ü ß 日本", "!!! ???", "Word " * 3000]
    docs, labels = frames(spark, texts + [(t, None) for t in asked])
    got = {r["doc_id"]: r["score"] for r in neighbours.score(docs, neighbours.fit(docs, labels, F.lit(True))).collect()}
    for k, want in enumerate(plain_scores(texts, asked)):
        assert abs(got[len(texts) + k] - want) < 0.01, (k, got[len(texts) + k], want)
