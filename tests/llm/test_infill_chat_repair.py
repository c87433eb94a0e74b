"""Fill-in-middle, chat formatting and structure repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradebook.llm import chat, infill, repair
from gradebook.llm.common import text_bytes
from gradebook.llm.queries import QUERIES

UNIT = {"char": r"(?s).", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------------------------------- fill-in-middle

def cut_in_three(doc_id, text, unit="char", seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    units = re.findall(UNIT[unit], text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", infill.UNITS)
@pytest.mark.parametrize("block", [1, 7, 64])
def test_every_cut_is_found(unit, block):
    rng = random.Random(4)
    texts = ["", " ", "a", "é", "\n", "a\n\nb", "漢字 \t é😀 x\n", *("".join(rng.choices("ab é漢😀\n \t", k=rng.randrange(90))) for _ in range(60))]
    data, offsets = text_bytes(pa.array(texts))
    blocks = infill.Blocks(data, offsets, unit, block)
    units = [re.findall(UNIT[unit], t) for t in texts]
    assert list(blocks.n) == [len(u) for u in units]
    for c in range(max(blocks.n) + 1):
        at = np.minimum(c, blocks.n)
        byte, chars = blocks.cut(at)
        before = ["".join(u[:k]) for u, k in zip(units, at)]
        assert list(chars) == [len(x) for x in before]
        assert list(byte - offsets[:-1]) == [len(x.encode()) for x in before]


@pytest.mark.parametrize("unit", infill.UNITS)
def test_texts_equal_plain_version_and_are_restored(odd, unit):
    made = infill.fill_in_middle(odd, unit=unit)
    got = [tuple(r) for r in made.collect()]
    assert sorted(map(str, got)) == sorted(str(cut_in_three(r["doc_id"], r["text"], unit)) for r in odd.select("doc_id", "text").collect())
    back = made.select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(str(tuple(r)) for r in back) == sorted(str((r["doc_id"], r["text"] or "")) for r in odd.collect())
    assert {"plain", "psm", "spm"} >= {r[2] for r in got} and len({r[2] for r in got}) > 1


def test_markers_in_text_stay_plain(spark):
    rows = [(i, t) for i in range(40) for t in ("a <P> b", "<M>", "x<S", "<<S", "P>S>")]
    made = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect():
        assert (r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == cut_in_three(r["doc_id"], r["back"])
        assert ("<P>" not in r["back"] and "<M>" not in r["back"]) or r["form"] == "plain"


def test_infill_query_equals_plain_version(spark, sf, real):
    want = {}
    for r in real["documents"].collect():
        doc_id, n, form, a, b, out = cut_in_three(r["doc_id"], r["text"])
        want[doc_id] = (doc_id, n, form, a, b, sha(out), sha(r["text"] or ""))
    assert {r["doc_id"]: tuple(r) for r in QUERIES["op11_fill_in_middle"](spark, sf).collect()} == want


# ---------------------------------------------------------------------------------------- chat formatting

LOG = "conv_id long, seq long, message long, role string, kind string, text string, start string, turns string, pieces string"


def log(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], LOG)


def fold(rows):
    """Messages of each conversation by replaying the events in order."""
    out = {}
    for conv in {r[0] for r in rows}:
        state, roles = {}, {}
        order = sorted((r for r in rows if r[0] == conv and r[4] in ("start", "delta", "edit", "regenerate")),
                       key=lambda r: (-1 << 63 if r[1] is None else r[1], r[4] == "delta", r[4], r[3] or "", r[5] or ""))
        for _, _, message, role, kind, text in order:
            if kind in ("edit", "regenerate"):
                state = {k: v for k, v in state.items() if k <= message}
            if kind != "delta":
                state[message] = text or ""
            elif message in state:
                state[message] += text or ""
            if role is not None:
                roles[message] = role
        out[conv] = [(m, roles.get(m, ""), t) for m, t in sorted(state.items())]
    return {k: v for k, v in out.items() if v}


def test_deltas_edits_and_regenerations(spark):
    rows = [(1, 1, 1, "user", "start", "helo"), (1, 2, 2, "assistant", "start", ""), (1, 3, 2, None, "delta", "Hi"), (1, 4, 2, None, "delta", " there"),
            (1, 5, 3, "user", "start", "and?"), (1, 6, 1, "user", "edit", "hello"), (1, 7, 3, None, "delta", " late"), (1, 8, 2, "assistant", "start", "a draft"),
            (1, 9, 2, "assistant", "regenerate", "Good "), (1, 10, 2, None, "delta", "day"), (1, 11, 4, None, "delta", "no beginning"), (1, 12, 9, None, "noise", "?"),
            (None, None, 1, None, "start", None), (2, 1, 1, "user", "noise", "x")]
    got = {}
    for r in chat.reconstruct(log(spark, rows)).collect():
        got.setdefault(r["conv_id"], []).append((r["message"], r["role"], r["text"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, "user", "hello"), (2, "assistant", "Good day")], None: [(1, "", "")]}


def test_random_logs_equal_replay(spark):
    rng, rows = random.Random(8), []
    for conv in range(40):
        for seq in range(rng.randrange(1, 30)):
            kind = rng.choices(["start", "delta", "edit", "regenerate"], [4, 8, 1, 1])[0]
            rows.append((conv, seq, rng.randrange(5), rng.choice(["user", "assistant", None]) if kind != "delta" or rng.random() < .1 else None, kind, rng.choice(["a", "b ", None, "</s>"])))
    got = {}
    for r in chat.reconstruct(log(spark, rows).repartition(4)).collect():
        got.setdefault(r["conv_id"], []).append((r["message"], r["role"], r["text"]))
    assert {k: sorted(v) for k, v in got.items()} == fold(rows)


@pytest.mark.parametrize("text", ["", "</s>", "<s>[INST] x [/INST]</s>", "<\\s> </\\\\s>", "[/\\INST]", "[INST", "</s", "s>", "\\", "$1 \\2", "a\n\tb", "<<s>>", "[[INST]]", "😀</s>é"])
def test_control_strings_are_escaped_reversibly(spark, text):
    rows = [(1, 1, 1, text, "start", text), (1, 2, 2, "assistant", "start", text), (1, 3, 2, None, "delta", "tail " + text)]
    made = chat.format_chats(log(spark, rows))
    r = chat.read_back(made).first()
    assert [tuple(m) for m in r["messages"]] == [(text, text), ("assistant", text + "tail " + text)] and "".join(r["loss"]) == text + "tail " + text
    full = made.first()
    assert full["formatted"].count("</s>") == 2 and full["formatted"].count("[INST]") == 2
    at = full["turns"][1]
    assert full["formatted"][at["start"]:at["start"] + at["length"]].startswith(chat.OPEN + "assistant")
    assert full["formatted"][at["loss_start"]:at["loss_start"] + at["loss_length"]] + "</s>" == full["formatted"].split("[/INST]")[-1]


def chats_of(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b" * 1500), (1, 1, "assistant", "b" * 1500), (1, None, "system", None), (2, 5, None, ""), (None, 1, "assistant", "x\ny"),
            (None, 0, "tool", "[INST]"), (3, 1, "assistant", "é" * 70_000), *((4, k // 2, "user", f"t{k}") for k in range(200))]
    return spark.createDataFrame([(*r, "p", "q", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, message string, seq int")


def test_formatted_turns_equal_plain_version(spark):
    turns = chats_of(spark)
    want = {}
    rows = sorted((r["conv_id"] or 0, -1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or "") for r in turns.collect())
    for conv, of in itertools.groupby(rows, key=lambda r: r[0]):
        of = list(of)
        loss = "".join(r[3] for r in of if r[2] == "assistant")
        want[conv or None] = (len(of), sha("".join(f"{r[2]}\n{r[3]}\n" for r in of)), len(loss), sha(loss))
    got = chat.digest(chat.format_chats(chat.log_of_turns(turns.repartition(3)))).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == want
    assert chat.digest(chat.format_chats(chat.log_of_turns(turns.limit(0)))).count() == 0


# ---------------------------------------------------------------------------------------- structure repair

BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, lines) of rows (role, text, fault) by comparing whole audits at every position and state."""
    wants, after = "uuau", (2, 2, 3, 2)
    best = {}
    for i in range(len(rows), -1, -1):
        now = {}
        if i == len(rows):
            now = {0: (0, "", ()), 3: (0, "", ())}
        else:
            role, text, fault = rows[i]
            extra = 1 if fault == "truncated" else 0
            for q in range(4):
                ways = []
                if q in best[i + 1]:
                    c, a, o = best[i + 1][q]
                    ways.append((c + 3, "D" + a, o))
                if fault not in ("blank", "duplicate"):
                    for letter, cost, new, to in (("K", 0, role, 1 if q == 0 and role[:1] == "s" else after[q] if role[:1] == wants[q] else None),
                                                  ("R", 2, "user" if wants[q] == "u" else "assistant", after[q])):
                        if to is not None and to in best[i + 1]:
                            c, a, o = best[i + 1][to]
                            ways.append((c + cost + extra, letter + a, (f"{new}:{text}", *o)))
                if ways:
                    now[q] = min(ways)
        for _ in range(3):
            for q in range(4):
                if after[q] in now:
                    c, a, o = now[after[q]]
                    way = (c + 2, "I" + a, ("user:" if wants[q] == "u" else "assistant:", *o))
                    now[q] = min(now[q], way) if q in now else way
        best[i] = now
    c, a, o = best[0][0]
    return c, a, "\n".join(o)


def repaired(rows):
    """Figures of one conversation's rows (turn, role, text), in order."""
    seen, marks, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        body = text.rstrip(BLANK)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append((role, text, fault))
        if fault:
            count[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, text = cheapest(marks)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha(text)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha(r[2])))


def test_random_conversations_equal_plain_version(spark):
    rng, rows = random.Random(6), []
    for conv in range(400):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, 2 * turn]), rng.choice(["user", "assistant", "system", "tool", "", "ugly", None]),
                         rng.choice(["one.", "two!", "three", "", " \t", None, "four? ", f"{conv} {turn}."])))
    df = spark.createDataFrame([(*r, "x", "y", False) for r in rows], "conv_id long, turn long, role string, text string, fault string, signature string, there boolean").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.digest(repair.repair(df)).collect()}
    plain = {}
    for c, t, r, x in rows:
        plain.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    assert got == {c: repaired(in_order(of)) for c, of in plain.items()}
    assert repair.digest(repair.repair(df.limit(0))).count() == 0


def damage(rows):
    out = {}
    for c, t, r, x in rows:
        c_, t_ = (" " if v is None else str(v) for v in (c, t))
        k = zlib.crc32(f"{c_}:{t_}".encode()) % 20
        r, x = (" " if v is None else v for v in (r, x))
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        of = out.setdefault(c, [])
        of += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def test_repair_query_equals_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_structure_repair"](spark, sf).collect()}
    assert got == {c: repaired(in_order(of)) for c, of in damage(rows).items()}


def test_conversation_without_rows_left(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x."), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.digest(repair.repair(repair.damaged(df), there="there")).collect()}
    assert got == {c: repaired(of) for c, of in damage([tuple(r) for r in df.collect()]).items()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", sha(""))


def test_nodes_are_shared_by_suffix(spark):
    """Sorted by their ends, signatures add a node for each suffix not met before."""
    signatures = ["".join(s) for n in range(6) for s in itertools.product("uAx", repeat=n)]
    made = []
    real_node = repair.node
    repair.node = lambda symbol, follows: made.append(symbol) or real_node(symbol, follows)
    try:
        batch = pa.RecordBatch.from_pylist([{"reverse": s[::-1]} for s in sorted(signatures, key=lambda s: s[::-1])])
        schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("lines", pa.list_(pa.int64()))])
        out = pa.Table.from_batches(repair.walk(iter([batch]), schema)).to_pylist()
    finally:
        repair.node = real_node
    assert len(made) == len({s[k:] for s in signatures for k in range(len(s))})
    for r in out:
        marks = [("assistant" if c in "aA" else "user", "", "blank" if c == "x" else "truncated" if c.isupper() else None) for c in r["signature"]]
        assert (r["cost"], r["audit"]) == cheapest(marks)[:2]


def test_long_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k % 2 if k % 7 else 0], f"t{k}.") for k in range(3000)]
    got = repair.digest(repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert tuple(got)[1:] == repaired([r[1:] for r in rows])
