"""Letters beyond ASCII, the grammar's targets and negations, and language labels against a plain version."""

import math
from collections import Counter
from itertools import groupby

import numpy as np
import unicodedata

from gradebook.llm import language, toxicity
from gradebook.llm.common import LOWER, only_letters
from pyspark.sql import functions as F


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_only_letters_equals_category():
    rng = np.random.default_rng(4)
    text = "".join(chr(c) for c in [*rng.integers(0x80, 0xD800, 4000), *rng.integers(0xE000, 0x110000, 4000), *range(0x2000, 0x2070), 0x2019, 0x02BC]) + "plain"
    want = b"".join((c.encode() if ord(c) < 128 or unicodedata.category(c)[0] in "LM" and ord(c) != 0x02BC else
                     (b"'" if ord(c) in (0x2018, 0x2019, 0x02BC) else b" ") * len(c.encode())) for c in text if ord(c) < 0x20000)
    data = np.frombuffer("".join(c for c in text if ord(c) < 0x20000).encode(), np.uint8)
    assert only_letters(data).tobytes() == want


def kinds(text, insults=()):
    table = np.sort(np.array([toxicity._hash_word(w) for w in insults], np.uint64))
    lexicon = {0: table, **{k: np.zeros(0, np.uint64) for k in toxicity.PREFIXES}}
    data = np.frombuffer(text.encode(), np.uint8)
    return {k: int(n) for k, n in zip(toxicity.KINDS, toxicity.features(data, np.array([0, len(data)]), lexicon)[0]) if n}


def test_threats_need_an_object():
    assert kinds("they burn wood in the stove") == {} and kinds("he will attack the problem") == {}
    assert kinds("i will kill you") == kinds("ich werde dich töten") == kinds("je vais te tuer") == kinds("te voy a matar") == {"threat": 1}
    assert kinds("we are hurting them") == kinds("they will burn, kill her") == {"threat": 1}
    assert kinds("you burn wood") == {} and kinds("burn. you") == {}


def test_negations_with_apostrophes():
    for text in ("he isn't an idiot", "he isn’t an idiot", "he isnt an idiot"):
        assert kinds(text, ["idiot"]) == {"negated": 1}
    assert kinds("he is an “idiot”", ["idiot"]) == {"aimed": 1} and kinds("isn t idiot", ["idiot"]) == {"insult": 1}


def labels_of(text, rows):
    """Plain trigram counts, script shares and best label sequence; word -> label numbers, and the share of the winner."""
    names = sorted({lang for _, lang in rows})

    def words(x):
        x = x.translate({c: c + 32 for c in range(65, 91)})
        for key, run in groupby(x, lambda c: "a" <= c <= "z" or ord(c) >= 128 and unicodedata.category(c)[0] in "LM" and c not in "ʼ"):
            if key:
                yield "".join(run)

    def grams(word):
        b = b" " + word.encode() + b" "
        return [(int.from_bytes(b[k:k + 3], "big") * 0x9E3779B1 % 2**32) >> 17 for k in range(len(b) - 2)]

    counts = {n: Counter() for n in names}
    for t, lang in rows:
        for w in words(t):
            counts[lang].update(grams(w))
    score = [[sum(math.log((counts[n][g] + language.SMOOTH) / (sum(counts[n].values()) + language.SMOOTH * language.BUCKETS)) for g in grams(w)) for n in names]
             for w in words(text)]
    best, back = list(score[0]), []
    for row in score[1:]:
        top = max(range(len(names)), key=lambda k: best[k])
        back.append([k if best[k] >= best[top] - language.SWITCH else top for k in range(len(names))])
        best = [max(best[k], best[top] - language.SWITCH) + row[k] for k in range(len(names))]
    label = [max(range(len(names)), key=lambda k: best[k])]
    for row in reversed(back):
        label.append(row[label[-1]])
    label = label[::-1]
    size = Counter()
    for w, k in zip(words(text), label):
        size[names[k]] += len(w.encode())
    win = min(size, key=lambda n: (-size[n], n))
    return win, size[win] / sum(size.values())


def test_language_equals_plain_version_and_ignores_punctuation(spark, real):
    some = real["documents"].where("lang IS NOT NULL AND text IS NOT NULL AND length(text) < 1500")
    rows = [(r["text"], r["lang"]) for r in some.orderBy("doc_id").limit(120).collect()]
    model = language.fit(some.orderBy("doc_id").limit(120), F.lit(True))
    texts = [t for t, _ in rows[:30]] + [rows[0][0][:200] + "’" + rows[7][0][:200] + " — “" + rows[3][0][:150]]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame(spark, list(enumerate(texts))), model).collect()}
    for k, text in enumerate(texts):
        name, share = labels_of(text, rows)
        assert got[k][0] == name and abs(got[k][1] - share) < 1e-9
    plain = spark.createDataFrame([(1, "it is what it is and nobody knows", "en"), (2, "c’est l’été, qu’il dit — voilà", "fr")], "doc_id long, text string, lang string")
    model = language.fit(plain, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame(spark, [(1, "it’s"), (2, "“—” … 12 🙂"), (3, "été")]), model).collect()}
    assert got[1][0] == "en" and got[2] == ("und", 0.0) and got[3][0] == "fr"


def test_scripts_by_code_point():
    low = only_letters(LOWER[np.frombuffer("aéжñ한か語αאع é".encode(), np.uint8)])
    found = [language.SCRIPTS[k] for k in language.scripts(low) if k >= 0]
    assert found == ["latin", "latin", "cyrillic", "latin", "hangul", "kana_cjk", "kana_cjk", "greek", "armenian_hebrew", "arabic", "latin"]
