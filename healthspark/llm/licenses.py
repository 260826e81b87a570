"""Licence scan: Aho-Corasick over words and identifier tags, licence expressions by a shunting yard.

One automaton runs over a text's words (A-Z lower-cased, joined by single blanks) and finds every place of every
notice phrase, whatever stands between the words. A second one runs over the lower-cased text and finds
identifier tags; what follows a tag on its line is read as a licence expression: identifiers joined by OR, AND
and WITH (which bind in that order, loosest first) and brackets. The shunting yard evaluates while it reads:
a value is the obligation that remains, where OR leaves the choice of the lighter side, AND takes on the heavier
one, and WITH lightens a copyleft licence by its exception. Reading stops where
the line no longer continues an expression; the longest whole expression up to there counts.

Labels: base phrases give `mit`, `apache` and `gpl`; further phrases and every licence of an expression add their
own. The score is the probability that the text carries a licence, taking each kind of evidence as independent:
1 - product of (1 - weight) over distinct pieces of evidence.

Scale: one map over the texts, no shuffle; memory is a text and its words. Both automata, the patterns and
the yard are linear in the text.

Input rules: a null or empty text has no words, no labels, score 0; very long texts are read whole; overlapping
and repeated places all count; repeated rows and null doc_ids are kept as they are; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices: phrase -> (label, weight as evidence).
NOTICES = {
    "apache license version 2 0": ("apache-2.0", 0.9), "apache software license": ("apache", 0.7),
    "affero general public license": ("agpl", 0.9), "lesser general public license": ("lgpl", 0.9),
    "general public license version 2": ("gpl-2.0", 0.9), "general public license version 3": ("gpl-3.0", 0.9),
    "bsd license": ("bsd", 0.7), "redistribution and use in source and binary forms": ("bsd", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.8), "isc license": ("isc", 0.7),
    "mozilla public license": ("mpl", 0.8), "eclipse public license": ("epl", 0.8), "zlib license": ("zlib", 0.7),
    "boost software license": ("bsl", 0.8), "public domain": ("public-domain", 0.5),
    "this is free and unencumbered software": ("unlicense", 0.9), "creative commons attribution": ("cc-by", 0.7),
    "cc by": ("cc-by", 0.6), "cc by sa": ("cc-by-sa", 0.7), "cc by nc": ("cc-by-nc", 0.7), "cc by nd": ("cc-by-nd", 0.7),
    "cc0": ("cc0", 0.6), "all rights reserved": ("proprietary", 0.4), "proprietary and confidential": ("proprietary", 0.7)}
BASE_WEIGHT, EXPRESSION_WEIGHT = 0.8, 0.95
#: Tags before an expression; True: identifiers that are not listed are believed.
TAGS = {"spdx-license-identifier:": True, "license-identifier:": True, "license:": False, "licence:": False,
        "license =": False, "license=": False, "licensed under": False}
#: Obligation: 0 none, 1 notice, 2 the file or library, 3 the whole work, 4 the network or no derived work, 5 unknown.
IDENTIFIERS = {
    "cc0-1.0": 0, "unlicense": 0, "0bsd": 0, "wtfpl": 0, "mit": 1, "mit-0": 0, "isc": 1, "zlib": 1, "bsl-1.0": 1, "apache-2.0": 1,
    "apache-1.1": 1, "bsd-2-clause": 1, "bsd-3-clause": 1, "bsd-4-clause": 1, "python-2.0": 1, "artistic-2.0": 1, "cc-by-3.0": 1,
    "cc-by-4.0": 1, "mpl-1.1": 2, "mpl-2.0": 2, "epl-1.0": 2, "epl-2.0": 2, "cddl-1.0": 2, "lgpl-2.1": 2, "lgpl-2.1-only": 2,
    "lgpl-2.1-or-later": 2, "lgpl-3.0": 2, "lgpl-3.0-only": 2, "lgpl-3.0-or-later": 2, "gpl-2.0": 3, "gpl-2.0-only": 3,
    "gpl-2.0-or-later": 3, "gpl-3.0": 3, "gpl-3.0-only": 3, "gpl-3.0-or-later": 3, "cc-by-sa-4.0": 3, "agpl-3.0": 4,
    "agpl-3.0-only": 4, "agpl-3.0-or-later": 4, "cc-by-nc-4.0": 4, "cc-by-nd-4.0": 4, "cc-by-nc-sa-4.0": 4}
UNKNOWN = 5
#: Exceptions and the obligation that a heavier copyleft licence keeps under them.
EXCEPTIONS = {"classpath-exception-2.0": 2, "gcc-exception-3.1": 1, "llvm-exception": 1, "linux-syscall-note": 2,
              "bison-exception-2.2": 1, "autoconf-exception-3.0": 1, "font-exception-2.0": 1, "openssl-exception": 3}

#: Every ASCII byte that is neither digit nor letter is a blank; A-Z are lower-cased before.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TOKEN = re.compile(rb"[ \t]*+([()]|[A-Za-z0-9][A-Za-z0-9.+-]*+)")
BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Value:
    names: frozenset
    obligation: int
    text: str


def _obligation(token: str, believed: bool) -> int | None:
    """What an identifier asks for; None if it is none."""
    plain = token.rstrip(".").removesuffix("+")
    if plain in IDENTIFIERS:
        return IDENTIFIERS[plain]
    return UNKNOWN if believed and plain not in EXCEPTIONS else None


def _apply(operator: str, a: int, b: int) -> int:
    if operator == "with":  # what is not known is not lightened either
        return a if a == UNKNOWN else min(a, b)
    return min(a, b) if operator == "or" else max(a, b)


def _reduce(values: list[int], operators: list[str], least: int) -> None:
    while operators and operators[-1] != "(" and BINDS[operators[-1]] >= least:
        b, a = values.pop(), values.pop()
        values.append(_apply(operators.pop(), a, b))


def evaluate(line: bytes, believed: bool = True, start: int = 0) -> Value | None:
    """The longest whole expression at `start`; None if there is none. Linear: what is whole is only put
    together at the last place where every bracket was closed."""
    tokens, whole, depth, after_value = [], 0, 0, False
    at = start
    while m := _TOKEN.match(line, at):
        token = m.group(1).decode()
        low = token.lower()
        if token == "(" and not after_value:
            depth += 1
        elif token == ")" and after_value and depth:
            depth -= 1
        elif low in BINDS and after_value:
            if low == "with" and tokens[-1] == ")":
                break  # an exception belongs to one licence
            after_value = False
        elif low not in BINDS and token not in "()" and not after_value:
            if tokens and tokens[-1] == "with":
                if low.rstrip(".") not in EXCEPTIONS or len(tokens) > 2 and tokens[-3] == "with":
                    break
                low = low.rstrip(".")
            elif _obligation(low, believed) is None:
                break
            after_value = True
        else:
            break
        tokens.append(low)
        at = m.end()
        if after_value and not depth:
            whole = len(tokens)
        if token.endswith("."):
            break  # the sentence ends
    if not whole:
        return None
    tokens = [t if t in "()" else t.rstrip(".") for t in tokens[:whole]]
    names, values, operators = set(), [], []
    for k, token in enumerate(tokens):
        if token == "(":
            operators.append(token)
        elif token == ")":
            _reduce(values, operators, 1)
            operators.pop()
        elif token in BINDS:
            _reduce(values, operators, BINDS[token])
            operators.append(token)
        elif k and tokens[k - 1] == "with":
            values.append(EXCEPTIONS[token])
        else:
            names.add(token)
            values.append(_obligation(token, believed))
    _reduce(values, operators, 1)
    return Value(frozenset(names), values[0], " ".join(tokens))


def automata():
    """(phrases, tags): values are (kind, label, words or weight) and (believed, length)."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES}:
        phrases.add_word(f" {phrase} ", phrase)
    for tag, believed in TAGS.items():
        tags.add_word(tag, (tag, believed))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: bytes, phrases, tags) -> dict:
    """Places, labels, expressions, obligation and score of one text."""
    low = text.lower()
    words = re.sub(b"  +", b" ", b" " + low.translate(_WORDS) + b" ").decode("latin-1")
    places, labels, base, evidence = [], set(), set(), {}
    for end, phrase in phrases.iter(words):
        if phrase in BASE:
            places.append(end - len(phrase) - 1)  # the blank before it
            base.add(BASE[phrase])
            evidence[phrase] = BASE_WEIGHT
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels.add(label)
            evidence[phrase] = weight
    first = last = None
    if places:
        first, last = (words.count(" ", 0, p) for p in (min(places), max(places)))
    found, obligation = [], None
    for end, (tag, believed) in tags.iter(low.decode("latin-1")):
        value = evaluate(low, believed, end + 1)  # tokens are set apart by blanks and tabs: a line's end stops it
        if value is None:
            continue
        found.append(value.text)
        labels |= value.names
        obligation = value.obligation if obligation is None else max(obligation, value.obligation)
        evidence["tag " + value.text] = EXPRESSION_WEIGHT if believed else BASE_WEIGHT
    doubt = 1.0
    for weight in sorted(evidence.values()):
        doubt *= 1 - weight
    return {"n_words": words.count(" ") - 1, "n_base": len(places), "first_word": first, "last_word": last,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels | base)), "score": 1 - doubt,
            "expressions": sorted(set(found)), "obligation": obligation}


_OUT = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("expressions", pa.list_(pa.string())), ("obligation", pa.int32())]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, obligation.

    `expressions` are the distinct expressions found; `obligation` is that of the heaviest one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, tags = automata()
        for batch in batches:
            rows = [scan(text.as_py() or b"", phrases, tags) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[c] for r in rows], t) for c, t in _OUT]],
                                             ["doc_id", *[c for c, _ in _OUT]])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
             "score double, expressions array<string>, obligation int")
