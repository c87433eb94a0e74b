"""Operators against plain versions on the smallest tables."""

import random

import numpy as np
import pytest
from brute import base_figures, classes, contamination, dropped_lines, katz, pii

from gradebook.llm import components, decontam, katz as katz_lm, language, line_dedup, mixing, near_dup, neighbours, quality, toxicity
from gradebook.llm import pii as pii_op
from gradebook.llm.queries import QUERIES, remainder


def pairs_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


# ---------------------------------------------------------------------------------------- near-duplicates

def test_near_duplicates_equal_brute_force(spark, sf, real):
    want, sets = classes(pairs_of(real["documents"]), 85)
    got = QUERIES["op3_minhash_near_dup"](spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Chains of edited copies, cut into small blocks, keep every class whole."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng, rows = random.Random(3), []
    for g in range(3):
        text = [f"g{g}w{k}" for k in range(90)]
        for i in range(60):
            if i % 3 == 0:
                text = list(text)
                text[rng.randrange(90)] = f"e{g}x{i}"
            rows.append((1000 * g + i, " ".join(text)))
    want, _ = classes(rows, 80)
    got = near_dup.near_duplicates(frame(spark, rows), 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_one_id_with_different_texts(spark):
    """Each text is linked and kept on its own: none is lost, and no link is."""
    rng = random.Random(12)
    a, b, c = (" ".join(f"{x}{rng.randrange(10 ** 6)}" for _ in range(60)) for x in "abc")
    near = lambda text: text + " and one more word"
    rows = [(1, a), (5, near(a)), (5, b), (5, b), (2, near(b)), (7, c), (7, near(c)), (7, ""), (None, a), (9, None), (9, None)]
    got = sorted(str((r["doc_id"], r["component_id"], r["kept"])) for r in near_dup.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted(map(str, [(1, 1, True), (5, 1, False), (5, 2, False), (5, 2, False), (2, 2, True), (7, 7, True), (7, 7, True), (7, 7, True), (None, None, True), (9, 9, True), (9, 9, True)]))
    left = near_dup.keep_one(frame(spark, rows)).collect()
    kept = sorted(str((r["doc_id"], r["text"])) for r in left if r["doc_id"] != 7)
    assert kept == sorted(map(str, [(1, a), (2, near(b)), (None, a), (9, None)]))
    assert sorted(r["text"] for r in left if r["doc_id"] == 7) in (["", c], ["", near(c)])
    alone = near_dup.keep_one(frame(spark, [(1, a), (5, near(a)), (5, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in alone) == [(1, a), (5, b)]


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in nodes}


def test_posterior_bound_is_monotone_and_spares_similar_pairs():
    least = near_dup.least_matches(0.85)
    assert list(least) == [32, 64, 96, 128, 160] and sorted(least.values()) == list(least.values())
    rng = np.random.default_rng(1)
    assert all((rng.binomial(n, 0.85, 200_000) >= m).all() for n, m in least.items())
    assert (rng.binomial(160, 0.5, 10_000) < least[160]).all()


# ---------------------------------------------------------------------------------------- decontamination

def test_contamination_equals_brute_force(spark, sf, real):
    want = contamination(pairs_of(real["documents"]), [(r["item_id"], r["text"]) for r in real["benchmark"].collect()])
    got = QUERIES["op5_decontamination"](spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert any(w[-1] for w in want)


@pytest.mark.parametrize("per_block", [3, 10_000])
def test_blocks_and_short_items(spark, per_block):
    items = [(1, "alpha beta gamma"), (2, " ".join(f"t{i}" for i in range(25))), (3, None), (4, ""), (5, "alpha beta gamma"), (None, "solo")]
    docs = [(1, "x alpha beta gamma y"), (2, " ".join(f"t{i}" for i in range(3, 20))), (3, "alpha beta"), (4, None), (5, "solo solo"), (5, "solo solo"),
            (6, " ".join(["t1"] * 30)), (7, "Alpha-BETA gamma t0 t1 t2 t3 t4 t5 t6 t7 t8 t9"), (None, "solo")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.digest(decontam.contamination(frame(spark, docs), bench, windows_per_block=per_block)).collect()
    want = contamination(docs, [("null" if i is None else i, t) for i, t in items])
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    left = decontam.keep_clean(frame(spark, docs), bench, windows_per_block=per_block).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(str(d) for d, w in zip(docs, want) if not w[-1])


# ---------------------------------------------------------------------------------------- quality, personal data

def test_quality_figures_equal_brute_force(real):
    docs = pairs_of(real["documents"])
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.quality(real["documents"]).collect()}
    assert got == {i: base_figures(t) for i, t in docs}


def test_quality_verdicts_follow_labels(real):
    rows = quality.quality(real["documents"]).join(real["labels"], "doc_id").collect()
    assert not [r["doc_id"] for r in rows if r["quality"] == 0 and r["kept"]]
    assert sum(r["kept"] or r["base_failed"] for r in rows if r["quality"] == 1) >= 0.97 * sum(r["quality"] == 1 for r in rows)


def test_quality_cuts_lines(spark):
    good = "the first line tells of a quiet day by the sea and of nothing else at all"
    text = f"{good}\nHome | About | News | Contact\n{good} again\nAll rights reserved\nBUY!! NOW!! GET!! YOURS!! TODAY!!"
    r = quality.quality(frame(spark, [(1, text)])).first()
    assert r["clean"] == f"{good}\n{good} again" and r["n_cut_lines"] == 3


def test_base_spans_equal_brute_force(spark, sf, real):
    import hashlib

    got = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, sf).collect()}
    for i, text in pairs_of(real["documents"]):
        counts, spans = pii(text)
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == counts
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[i]["spans"].split(",")) or not spans


def test_boosting_learns_cells_and_calibrates():
    cells = [((1, 0, 0), 100.0, 98.0), ((1, 1, 0), 50.0, 50.0), ((0, 1, 0), 80.0, 2.0), ((0, 0, 1), 300.0, 0.0)]
    model = pii_op.boost(cells)
    at = pii_op.calibrate(model, cells)
    assert [pii_op.tree_score(model, c[0]) >= at for c in cells] == [True, True, False, False]


def test_redaction(spark):
    rows = [(1, "mail a@b.example now"), (2, None)]
    found = pii_op.find_spans(frame(spark, rows), {k: (0.0, [], float("inf")) for k in pii_op.FEATURES})
    assert {r["doc_id"]: r["text"] for r in pii_op.redact(found).collect()} == {1: "mail [email] now", 2: ""}


# ---------------------------------------------------------------------------------------- learned operators

def test_language_held_out_and_spans(spark, sf, real):
    rows = QUERIES["op2_language_id"](spark, sf).join(real["documents"].select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    texts = {r["lang"]: " ".join(r["text"].split()[:60]) for r in real["documents"].where("length(text) > 1500").collect()}
    model = language.fit(real["documents"], remainder(4) != 2)
    got = language.identify(frame(spark, [(1, texts["de"] + " " + texts["es"])]), model).first()
    assert [s["lang"] for s in got["spans"]] == ["de", "es"] and 0.3 < got["score"] < 0.7


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    count = np.array([4, 1, 0, 3])
    scores = rng.normal(size=(8, 3)).astype(np.float32)
    first = np.cumsum(count) - count
    got = language.viterbi(scores, first, count, 0.7)
    for f, c in zip(first, count):
        value = lambda path: sum(scores[f + t, k] for t, k in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
        assert not c or abs(value(tuple(got[f:f + c])) - max(value(p) for p in product(range(3), repeat=c))) < 1e-5


def test_katz_equals_brute_force(spark, sf, real, monkeypatch):
    monkeypatch.setattr(katz_lm, "CHUNK_BYTES", 100_000)
    want, total = katz(pairs_of(real["documents"]), katz_lm.discounts, katz_lm.K, katz_lm.BEYOND)
    for r in QUERIES["op6_katz_lm"](spark, sf).collect():
        held, n, known, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score) < 1e-6


def test_katz_packing_round_trip():
    x = np.sort(np.random.default_rng(1).integers(0, 2 ** 63, 1000).astype(np.uint64))
    assert (katz_lm.unpack(katz_lm.pack(x, True), np.uint64, True) == x).all()
    assert (katz_lm.unpack(katz_lm.pack(-x.astype(np.float64)), np.float64) == -x.astype(np.float64)).all()
    assert len(katz_lm.unpack(katz_lm.pack(x[:0], True), np.uint64, True)) == 0


def test_quality_votes_on_held_out_rows(spark, sf, real):
    rows = QUERIES["op7_quality_classifier"](spark, sf).join(real["labels"], "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_votes_equal_plain_cosine():
    rng = np.random.default_rng(4)
    model = neighbours.Model(rng.normal(size=(neighbours.DIM, 5)).astype(np.float32), neighbours.unit(rng.normal(size=(90, 5))).astype(np.float32), rng.integers(0, 2, 90).astype(float))
    x = rng.random((7, neighbours.DIM)).astype(np.float32)
    got = neighbours.vote(x, model)
    for row, g in zip(x, got):
        v = row @ model.project
        s = model.voters @ (v / np.linalg.norm(v))
        top = np.argsort(-s)[:neighbours.K]
        w = np.maximum(s[top], 0).astype(float) ** neighbours.SHARP
        assert abs(g - (w * model.labels[top]).sum() / w.sum()) < 1e-4


def toxic_frame(spark, n=600):
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(["dolt", "oaf", f"grump{rng.choice('abcdefgh')}"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_terms_and_stems(spark):
    docs, labels = toxic_frame(spark)
    model = toxicity.fit(docs, labels, remainder(5) != 0)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(remainder(5) == 0).collect()
    assert all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows)


def test_grammar_kinds():
    kinds = lambda *names: dict(zip(toxicity.KINDS, toxicity.match(np.array([toxicity.SYMBOLS.index(n) for n in names], np.int8))))
    assert kinds("other", "INSULT", "other")["insult"] == 1
    assert kinds("TARGET", "other", "INSULT")["aimed"] == 1 and kinds("INSULT", "TARGET")["aimed"] == 1
    assert kinds("NEGATION", "other", "INSULT")["negated"] == 1 and kinds("NEGATION", "CLAUSE", "INSULT")["insult"] == 1
    assert kinds("REPORT", "CLAUSE", "INSULT")["reported"] == 1 and kinds("REPORT", "SENTENCE", "INSULT")["insult"] == 1
    assert kinds("THREAT", "TARGET")["threat"] == 1 and sum(kinds("THREAT", "other").values()) == 0
    assert kinds("INSULT", "INSULT", "CLAUSE")["insult"] == 2


# ---------------------------------------------------------------------------------------- lines, mixing

def test_dropped_lines_equal_brute_force(spark, real):
    rng = random.Random(6)
    docs = pairs_of(real["documents"])[:40]
    lines = [x for _, t in docs for x in (t or "").split("\n") if len(x) > 25][:60] + ["a" * 40, "a" * 41, "ab" * 20, "x" * 700 + "y", "0123456789" * 20]
    for i in range(60):
        made = []
        for _ in range(4):
            x = list(rng.choice(lines))
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(x))
                x[k:k + rng.choice([0, 1])] = rng.choice(["", "q", x[k]])
            made.append("".join(x))
        docs.append((100_000 + i, "\n".join(made)))
    got = {(r["doc_id"], r["line_no"]): (r["first_doc_id"], r["first_line_no"], r["edits"]) for r in line_dedup.duplicate_lines(frame(spark, docs)).collect()}
    want = dropped_lines(docs, line_dedup.MIN_CHARS)
    assert got == want and sum(x[2] for x in want.values()) > 20


def test_line_cut_keeps_the_rest(spark):
    same = "this line stands in many documents of the corpus"
    docs = [(1, f"{same}\nown text of the first"), (2, f"own text of the second\n{same}\nshort"), (3, same), (4, None), (5, ""), (6, "Short"), (7, "shor")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_duplicate_lines(frame(spark, docs)).collect()}
    assert got == {1: docs[0][1], 2: "own text of the second\nshort", 4: None, 5: "", 7: "shor"}


@pytest.mark.parametrize("weights", [None, {"s0": 5, "s1": 3, "s2": 2}])
def test_mix_deviates_less_than_a_block(spark, weights):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('s', CAST(least(id % 7, 2) AS STRING)) AS source")
    rows = mixing.mix_sources(docs, weights).collect()
    assert len(rows) == 4000 and len({r["position"] for r in rows}) == 4000
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    unit = {r["source"]: r["units"] for r in rows}
    assert weights is None or unit == weights
    end = max(r["slot"] for r in rows if r["in_mix"])
    of = {r["slot"]: r["source"] for r in rows}
    done = dict.fromkeys(unit, 0)
    for t in range(end + 1):
        done[of[t]] += 1
        assert all(abs(done[s] - unit[s] / sum(unit.values()) * (t + 1)) < 1 for s in unit)


# ---------------------------------------------------------------------------------------- executors without the package

def test_sent_objects_carry_their_classes(tmp_path):
    """What op5 and op7 broadcast is read by a process that has no copy of the package."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    model = neighbours.Model(np.eye(neighbours.DIM, 4, dtype=np.float32), np.eye(4, dtype=np.float32), np.ones(4))
    block = decontam.Block([], decontam.WINDOW)
    (tmp_path / "sent").write_bytes(cloudpickle.dumps([model, block]))
    code = "from pyspark import cloudpickle; m, b = cloudpickle.loads(open('sent', 'rb').read()); print(m.prior, type(b).__name__)"
    out = subprocess.run([sys.executable, "-c", code + "\ntry:\n import gradebook\n print('found')\nexcept ImportError:\n print('none')"], cwd=tmp_path, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(x for x in sys.path if "site-packages" in x)})
    assert out.stdout.split() == ["1.0", "Block", "none"], out.stderr
