"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Further candidates come from looser
shapes: written-out addresses, phone numbers without a plus, social security and bank account numbers, names
after a title or an introduction, and secrets (long runs of letters and digits). Every candidate, base ones included,
gets a vote (for, against, none) of each labeler: strict pattern, checksum (for secrets: whether the characters are
as mixed as random ones), gazetteer (for secrets: whether something is set to it), context words before it, and clean edges.

The votes of all candidates are counted by pattern (kind, votes, length class): a table whose size is
bounded by the number of patterns, whatever the corpus. On it, EM estimates every labeler's reliability
and each pattern's probability of being personal data, and a logistic regression on votes, kind and length
class is trained on those probabilities: the final span classifier. A span that is no base span is
reported if a labeler speaks for it, its probability is at least `accept` and it overlaps no base span.

Scale: one map over the texts, one aggregation of patterns, one map over narrow rows. Patterns are linear in
the text (possessive, anchored at run starts), so long runs of digits or letters cost no more than others.

Input rules: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows are
separate rows; a null doc_id is kept; an empty table gives an empty result and a model without evidence,
which accepts base spans only; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_text", "phone_local", "ssn", "iban", "name", "secret")
KINDS = BASE + ADDED
LABELERS = ("strict", "checksum", "gazetteer", "context", "edges")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_EMAIL_TEXT = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]++"
                         r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z]{2,}+(?![\w])")
_PHONE_LOCAL = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof)\. ?[A-Z][a-z]++(?: [A-Z][a-z]++)?(?!\w)"
                   r"|(?<=[Mm]y name is )[A-Z][a-z]++(?: [A-Z][a-z]++)?(?!\w)")
#: Keys and tokens: at least 20 characters, letters and digits among them.
_SECRET = re.compile(r"(?<![\w+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[\w+/-]{20,}+(?:={1,2})?(?![\w+/-])", re.ASCII)

#: Words that announce a kind, looked for in the 40 characters before a span.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"), "email_text": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "address", "host", "server"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "contact"),
    "phone_local": ("call", "phone", "tel", "mobile", "fax", "contact"),
    "ssn": ("ssn", "social", "security"), "iban": ("iban", "account", "bank", "transfer"),
    "name": ("name", "dear", "contact", "sincerely"),
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "credential", "bearer", "auth")}
#: Top-level domains, country codes of calls, given names: the gazetteers.
DOMAINS = frozenset("com org net edu gov io de fr es uk eu info it nl ch at be ca us co ru jp cn in br au".split())
CALLING = ("1", "33", "34", "44", "49", "39", "41", "43", "31", "32", "7", "81", "86", "91", "55", "61")
GIVEN = frozenset("James Mary John Anna Maria Peter Paul Hans Marie Pierre Jean Carlos Ana Jose Luis David Sarah Laura "
                  "Michael Thomas Robert Linda Julia Martin Sofia Lucas Emma Max Eva".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds: leftmost, non-overlapping per kind, failing matches dropped."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        # the local part is the run of its characters that ends here; scan back, not forward from every start
        start = at
        while start > end and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def added_candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern, hint in (("email_text", _EMAIL_TEXT, ("dot", "at")), ("phone_local", _PHONE_LOCAL, None),
                                ("ssn", _SSN, ("-",)), ("iban", _IBAN, None),
                                ("name", _NAME, ("Mr", "Ms", "Dr", "Prof", "y name is ")), ("secret", _SECRET, None)):
        if kind == "email_text" and not ("(at)" in text or "[at]" in text or "{at}" in text or " dot " in text):
            continue
        if hint and not any(h in text for h in hint):
            continue
        out.extend((kind, *m.span()) for m in pattern.finditer(text))
    return out


def mixed(span: str) -> bool:
    """Whether a run's characters are spread as in a random key: bits per character against what its kinds allow."""
    n = len(span)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(span).values())
    symbols = 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", span) else 36 if span in (span.lower(), span.upper()) else 62
    return bits >= 0.8 * math.log2(min(n, symbols))


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """One of 1 (for), -1 (against), 0 (none) of each labeler."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    before = text[max(0, start - 40):start].lower()
    strict = 1 if kind in BASE or kind in ("ssn", "iban") else 0
    check = gazetteer = 0
    if kind == "card":
        check = 1
    elif kind == "ip":
        check = -1 if span.startswith("0") else 1
    elif kind == "iban":
        moved = span.replace(" ", "")[4:] + span.replace(" ", "")[:4]
        check = 1 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else -1
    elif kind == "secret":
        check = 1 if mixed(span) else -1
    elif kind == "ssn":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind in ("email", "email_text"):
        gazetteer = 1 if re.split(r"\W+", span.strip().lower())[-1] in DOMAINS else -1
    elif kind == "phone":
        gazetteer = 1 if digits.startswith(CALLING) else -1
    elif kind == "phone_local":
        gazetteer = -1 if digits[0] in "01" else 0
    elif kind == "secret":
        gazetteer = 1 if before.rstrip(" \"'`").endswith(("=", ":")) else 0
    elif kind == "name":
        gazetteer = 1 if GIVEN.intersection(span.split()) else 0
    context = 1 if any(w in before for w in CONTEXT[kind]) else 0
    left, right = text[start - 1:start], text[end:end + 1]
    edges = -1 if (left.isalnum() or right.isalnum()) else 0
    return strict, check, gazetteer, context, edges


def pattern_key(kind: str, vote: tuple[int, ...], length: int) -> str:
    return f"{kind}|{','.join(map(str, vote))}|{min(4, length // 8)}"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kinds, starts, ends, patterns): one row per document, all candidates in order of start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], [], []]
            for text in batch.column(1).to_pylist():
                found = base_spans(text) + added_candidates(text) if text else []
                found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                for col, value in zip(cols, ([KINDS.index(k) for k, _, _ in found], [s for _, s, _ in found],
                                             [e for _, _, e in found],
                                             [pattern_key(k, votes(text, k, s, e), e - s) for k, s, e in found])):
                    col.append(value)
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                             ["doc_id", "kinds", "starts", "ends", "patterns"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, kinds array<int>, starts array<long>, ends array<long>, patterns array<string>")


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: (probability of each pattern, accuracy of each labeler where it votes).

    A labeler that votes is right with a probability of its own, the same for and against; one that has no
    opinion says nothing. Kinds have their own share of true spans.
    """
    kinds = np.array([KINDS.index(p.split("|")[0]) for p, _ in patterns])
    cast = np.array([[int(v) for v in p.split("|")[1].split(",")] for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    accuracy, share = np.full(len(LABELERS), 0.8), np.full(len(KINDS), 0.5)
    post = np.full(len(n), 0.5)
    for _ in range(rounds):
        weight = np.log(accuracy) - np.log1p(-accuracy)
        log = np.log(share[kinds]) - np.log1p(-share[kinds]) + cast @ weight
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        for m in range(len(LABELERS)):
            right = (n * np.where(cast[:, m] > 0, new, 1 - new))[cast[:, m] != 0].sum()
            accuracy[m] = np.clip((right + 4) / (n[cast[:, m] != 0].sum() + 5), 0.55, 0.99)
        for k in range(len(KINDS)):
            share[k] = ((n * new)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, accuracy


def _features(patterns: list[str]) -> np.ndarray:
    rows = []
    for p in patterns:
        kind, cast, length = p.split("|")
        one = [1.0] + [float(kind == k) for k in KINDS] + [float(length == str(v)) for v in range(5)]
        for v in cast.split(","):
            one += [float(v == "1"), float(v == "-1")]
        rows.append(one)
    return np.array(rows)


def train_classifier(patterns: list[tuple[str, int]], rounds: int = 30, ridge: float = 1.0) -> dict[str, float]:
    """Logistic regression (Newton) on EM's probabilities, weighted by count: pattern -> probability."""
    if not patterns:
        return {}
    post, _ = reliabilities(patterns)
    x, n = _features([p for p, _ in patterns]), np.array([c for _, c in patterns], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)),
                               x.T @ (n * (post - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {name: float(v) for (name, _), v in zip(patterns, p)}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>), spans by start, then kind: one row per input row."""
    found = store(candidates(docs, id_col, text_col), "pii")
    counted = found.select(F.explode("patterns").alias("p")).groupBy("p").count()
    model = train_classifier(sorted((r["p"], r["count"]) for r in counted.collect()))  # bounded by the patterns
    taken = {p for p, v in model.items() if v >= accept and "1" in p.split("|")[1].replace("-1", "").split(",")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            out = []
            for kinds, starts, ends, names in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                fixed = [(s, e) for k, s, e in zip(kinds, starts, ends) if k < len(BASE)]
                spans, free = [], 0
                for k, s, e, name in zip(kinds, starts, ends, names):
                    if k >= len(BASE):
                        if name not in taken or s < free or any(a < e and s < b for a, b in fixed):
                            continue
                        free = e
                    spans.append({"kind": KINDS[k], "start": s, "end": e, "base": k < len(BASE)})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return found.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def pii_digest(docs: DataFrame, **options) -> DataFrame:
    """Counts of base spans, the digest of their places, and all spans as text."""
    def render(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                     s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["base"])
    return find_pii(docs, **options).select(
        "doc_id", *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(render(base).cast("binary"), 256).alias("base_sha256"), render(F.col("spans")).alias("spans"))
