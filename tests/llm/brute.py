"""Brute-force versions of the operators' contracts, in plain Python, and the small fixture they share."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD6 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "id long, key long, a string, uid long, h1 string, size string, `_row` string, `odd.name` string")
BENCHMARK = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short Passage here"), (3, None),
             (4, ""), (12, "One two three four five six seven eight nine ten"), (5, "ünï cödé wörds ñ1 ñ2 ñ3 ñ4 ñ5 ñ6 ñ7 ñ8")]


def texts() -> list[tuple]:
    """(doc_id, text, source): copies, near copies, a shared passage, periodic and long texts, odd characters."""
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice(["ba", "ko", "lim", "tre", "Su", "nö", "x9", "q"]) for _ in range(rnd.randint(1, 4))) for _ in range(900)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))

    passage = "This shared passage goes through many documents and is well over one hundred bytes long so it repeats, word by word."
    rows = []
    for i in range(40):
        rows.append((i, prose(rnd.randint(1, 90)) + (" " + passage if i % 3 == 0 else ""), f"src{i % 3}"))
    base = prose(160).split(" ")
    for i in range(60):  # one group of near copies, larger than any leaf
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((100 + i, " ".join(words), "src0"))
    for i in range(25):  # one group of exact copies
        rows.append((200 + i, rows[3][1] + " copied text that is long enough to be a repeat of more than one hundred bytes " * 2, "src0"))
    rows += [(300, None, None), (301, "", "src1"), (302, " \t\n ", "src1"), (303, "one", "src1"), (304, "ONE", "src1"),
             (305, "two words", None), (306, "a" * 3000, "src1"), (307, "ab" * 900 + "a" * 700, "src2"),
             (308, prose(9000), "src2"), (309, "日本語の文字 \U0001F600 é é \x1c\x85\xa0 end", "src2"),
             (310, "mail bob@example.com or 10.0.0.256 or 10.0.0.25; card 4111 1111 1111 1111, +1 (415) 555-0100!", "src2"),
             (311, "ONE two, three four five six SEVEN eight nine ten! eleven twelve - short passage here", "src2"),
             (312, "x one two three four five six seven eight nine ten one two three four five six seven eight nine ten", "src2"),
             (313, "<|endoftext|> It's WORD*** <|STARTOFTEXT|>. don't", "src2"),
             (314, "ÜNÏ cödé wörds ñ1 ñ2 ñ3 ñ4 ñ5 ñ6 ñ7 ñ8 ünï cödé wörds ñ1 ñ2 ñ3 ñ4 ñ5 ñ6 ñ7 ñ8", "src1")]
    rows.append(rows[5])  # a row given twice
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None, 7, 8, "x", 9, "y", "z", "r", "o") for d, t, s in rows], SCHEMA)


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def near_duplicates(rows, k=3, percent=85):
    sets = [(d, shingles(t, k)) for d, t, _ in rows]
    links = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n]
             if x and y and 100 * len(x & y) >= percent * len(x | y)]
    reach = components({d for d, _ in sets}, links)
    return sorted((d, len(s), reach[d], reach[d] == d) for d, s in sets)


def repeats(rows, length=100):
    out, seen, done = [], set(), {}
    for d, t, _ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        if (d, raw) not in done:
            mark = bytearray(len(raw))
            for p in range(len(raw) - length + 1):
                if raw[p:p + length] in seen:
                    mark[p:p + length] = b"\1" * length
                seen.add(raw[p:p + length])
            kept = bytes(b for b, m in zip(raw, mark) if not m)
            done[d, raw] = (d, len(raw), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(kept).hexdigest())
        out.append(done[d, raw])
    return sorted(out)


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def contamination(rows, benchmark, n=10):
    windows = defaultdict(set)
    for item, text in benchmark:
        words = WORD6.findall((text or "").translate(LOWER))
        k = min(n, len(words))
        for i in range(len(words) - k + 1 if words else 0):
            windows[tuple(words[i:i + k])].add(item)
    out = []
    for d, t, _ in rows:
        words, hit, items = WORD6.findall((t or "").translate(LOWER)), set(), set()
        for k in {len(w) for w in windows}:
            for i in range(len(words) - k + 1):
                if found := windows.get(tuple(words[i:i + k])):
                    items |= found
                    hit |= set(range(i, i + k))
        out.append((d, len(words), len(hit), tuple(sorted(map(str, items))), bool(hit)))
    return sorted(out, key=repr)


def targets(rows, weights=(5, 2, 1), cap=3):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s, v in share.items() if v > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else share[s] for s in names}, sizes
        full |= over
