"""Plain versions of operators 11 to 13."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

LEGAL = ("su", "ua", "au")


# --- conversations -------------------------------------------------------------------------------------------

def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(place.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def lightest(rows):
    """All ways to edit, by increasing cost: plain relaxation over (rows used, turns said so far as text)."""
    best = {(0, ""): (0, "", ())}
    done = {}
    while best:
        key = min(best, key=lambda k: (best[k][0], k[0], best[k][1]))
        cost, audit, said = best.pop(key)
        at, state = key
        done[key] = (cost, audit, said)
        nexts = []
        for r in "ua":
            if (state, r) in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                nexts.append(((at, r), cost + 2, audit + "I", said + (({"u": "user", "a": "assistant"}[r], ""),)))
        if at < len(rows):
            role, text, drop, cut = rows[at]
            nexts.append(((at + 1, state), cost + 3, audit + "D", said))
            if not drop:
                if role[:1] in ("s", "u", "a") and (state, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    nexts.append(((at + 1, role[:1]), cost + cut, audit + "K", said + ((role, text),)))
                for r in "ua":
                    if (state, r) in (("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                        nexts.append(((at + 1, r), cost + 2 + cut, audit + "R", said + (({"u": "user", "a": "assistant"}[r], text),)))
        for k, c, a, s in nexts:
            if k not in done and (k not in best or (c, a) < best[k][:2]):
                best[k] = (c, a, s)
    return min(done[k] for k in ((len(rows), ""), (len(rows), "a")) if k in done)


def repaired(rows):
    groups = {}
    for conv, *_ in rows:
        groups.setdefault(conv, [])
    for conv, turn, role, text in damaged(rows):
        groups[conv].append((turn, role, text))
    out = []
    for conv, held in groups.items():
        held.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:64], hashlib.md5(t[2].encode()).hexdigest()))
        seen, steps, counts = set(), [], Counter()
        for _, role, text in held:
            end = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            steps.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(held, held[1:]))
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, said = lightest(steps)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def every_way(steps):
    """The cheapest audit by trying every string of edits, for very few rows."""
    found = []
    for size in range(len(steps) + 5):
        for audit in itertools.product("DIKR", repeat=size):
            if sum(e != "I" for e in audit) != len(steps):
                continue
            for spoken in itertools.product("ua", repeat=sum(e in "RI" for e in audit)):
                cost, at, roles, free, ok = 0, 0, "", iter(spoken), True
                for e in audit:
                    if e == "I":
                        cost, roles = cost + 2, roles + next(free)
                        continue
                    role, _, drop, cut = steps[at]
                    at += 1
                    if e == "D":
                        cost += 3
                    elif drop:
                        ok = False
                        break
                    else:
                        cost += cut + 2 * (e == "R")
                        roles += next(free) if e == "R" else role[:1] or "?"
                if ok and re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, "".join(audit)))
    return min(found)


# --- spelling ------------------------------------------------------------------------------------------------

def spelling(rows, min_length=7, min_count=2, ratio=10, damage=31):
    counts = Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    letters = sorted(set("".join(counts)))
    near = {}
    for w in counts:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + c + w[j:] for i in range(len(w) + 1) for c in letters for j in (i, i + 1) if j <= len(w)}
        near[w] = {x for x in edits if x in counts and x != w}
    form = {}
    for w, n in counts.items():
        if near[w]:
            top = min(near[w], key=lambda x: (-counts[x], x))
            if counts[top] >= ratio * n:
                form[w] = top
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out, key=repr)
