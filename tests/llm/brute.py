"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low_words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = low_words(text)
    if len(w) >= 5:
        return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def classes(docs, percent):
    """doc_id -> smallest doc_id reachable, over (doc_id, text) with distinct ids."""
    sets = {i: shingle_set(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i, s in sets.items() if s)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, sets


def contamination(docs, items, size=10):
    """[(doc_id, n_words, n_hit, n_items, sha, contaminated)] for (id, text) lists."""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").encode().lower())
        for i in range(max(len(w) - size + 1, min(len(w), 1))):
            windows[tuple(w[i:i + size])].add(str(item))
    out = []
    for d, text in docs:
        w, hit, found = ALNUM.findall((text or "").encode().lower()), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i:i + n]))):
                    hit.update(range(i, i + n))
                    found |= got
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def base_figures(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def pii(text):
    """(counts by kind, digest) of the base spans."""
    spans, counts = [], []
    for k, (kind, pattern) in enumerate(PII):
        got = [m for m in re.finditer(pattern, text or "") if _valid(kind, m.group(0))]
        counts.append(len(got))
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in got]
    return counts, [s for _, _, s in sorted(spans)]


def katz(docs, discounts, k_max, beyond):
    """doc_id -> (held out, tokens, known, base score, score); N."""
    uni, pairs, tokens = Counter(), Counter(), {}
    for i, text in docs:
        w = [*low_words(text), "</s>"]
        tokens[i] = w
        if crc32(str(i).encode()) % 5 != 1:
            uni.update(w)
            pairs.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)
    of = [Counter(c.values()) for c in (uni, pairs)]
    e, d = (discounts([c[r] for r in range(1, k_max + 2)]) for c in of)
    disc = lambda c, z: z[c - 1] * c if c <= k_max else c - beyond
    unknown = 1 - sum(disc(c, e) for c in uni.values()) / n
    chance = lambda w: disc(uni[w], e) / n if uni[w] else unknown
    total, mass, back = Counter(), Counter(), Counter()
    for (h, w), c in pairs.items():
        total[h] += c
        mass[h] += disc(c, d)
        back[h] += chance(w)
    out = {}
    for i, w in tokens.items():
        base = sum(math.log10((uni[x] + .5) / (n + .5 * (v + 1))) for x in w)
        score = 0.0
        for h, x in zip(["<s>", *w], w):
            if pairs[h, x]:
                score += math.log10(disc(pairs[h, x], d) / total[h])
            else:
                alpha = (1 - mass[h] / total[h]) / (1 - back[h]) if total[h] else 1.0
                score += math.log10(alpha * chance(x))
        out[i] = (crc32(str(i).encode()) % 5 == 1, len(w), sum(uni[x] > 0 for x in w), base, score)
    return out, n


def edits(a, b):
    """Levenshtein distance, up to 2."""
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if a[i:] == b[i:]:
        return 0
    return 1 if a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:] else 2


def dropped_lines(docs, least):
    """{(doc_id, line): (first doc_id, first line, edits)} over (doc_id, text) in order of doc_id: equal lines, and near ones of ``least`` characters."""
    seen, out = [], {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            norm = line.strip(" ").lower()
            if not norm.strip(" \t\n\v\f\r"):
                continue
            bound = 1 if len(norm) >= least else 0
            near = next(((i, n, edits(norm, x)) for i, n, x in seen if x == norm or bound and len(x) >= least and edits(norm, x) <= bound), None)
            if near:
                out[d, no] = near
            seen.append((d, no, norm))
    return out


def cut_texts(docs, least):
    """doc_id -> text after the line stage, over (doc_id, text) with distinct ids: lines that repeat are cut, documents left blank by
    that are dropped."""
    gone, out = dropped_lines(docs, least), {}
    for d, text in docs:
        lines = text.split("\n") if text is not None else []
        left = [x for k, x in enumerate(lines) if (d, k) not in gone]
        if len(left) == len(lines) or "".join(left).strip(" \t\n\v\f\r"):
            out[d] = "\n".join(left) if text is not None else None
    return out
