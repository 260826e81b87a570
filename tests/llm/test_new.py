"""Licence scan, conversation repair, spelling variants: against brute force, odd input, empty tables."""

import random
import re

import brute
import brute_new
import pytest

from healthspark.llm import licenses, repair, spelling


# --- licences ------------------------------------------------------------------------------------------------

LICENSED = [
    (1, "Released under the MIT License.", "s"), (2, "mit license MIT-LICENSE mit\n\tlicense", "s"), (3, None, "s"), (4, "", "s"),
    (5, "GNU General Public License, general public license version 3", "s"), (6, "émit license mit licensé", "s"),
    (7, "x\n// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */\ny", "s"),
    (8, "License: AGPL-3.0.\nnothing", "s"), (9, "license: of the house", "s"), (10, "mit license " * 20_000, "s"),
    (10, "mit license", "s"), (None, "Apache License", "s"), (11, "mit", "s"), (12, "license mit license mit", "s"),
    (13, "Licensed under CC BY-NC 4.0.", "s"), (14, "SPDX-License-Identifier: LicenseRef-Own-1 OR", "s"), (15, "MIT\x00License", "s")]


def test_license_places_equal_the_words(spark):
    got = {}
    for r in licenses.scan_licenses(brute.frame(spark, LICENSED)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(LICENSED)
    for doc, text, _ in LICENSED:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, base = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            here = [i for i in range(len(words)) if words[i:i + len(p)] == p]
            places += here
            base |= {label} if here else set()
        want = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        rows = [(r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got[doc]]
        assert want in rows, doc
        for r in got[doc]:
            assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    one = {k: v[0] for k, v in got.items()}
    assert one[7]["labels"] == "apache-2.0,gpl-2.0-only,mit" and one[7]["obligation"] == 2
    assert one[8]["labels"] == "agpl-3.0" and one[9]["labels"] == "" and one[13]["labels"] == "cc-by,cc-by-nc"
    assert one[14]["expressions"] == ["licenseref-own-1"] and one[14]["obligation"] == licenses.UNKNOWN
    assert one[5]["labels"] == "gpl,gpl-3.0"


def _expression(rnd, depth):
    """(text, obligation) of a random expression, bracketed where its operator binds less than the one around it."""
    if depth == 0 or rnd.random() < 0.3:
        name = rnd.choice(sorted(licenses.IDENTIFIERS))
        value = licenses.IDENTIFIERS[name]
        if rnd.random() < 0.3:
            more = rnd.choice(sorted(licenses.EXCEPTIONS))
            return f"{name} WITH {more}", min(value, licenses.EXCEPTIONS[more]), 3
        return name.upper(), value, 3
    binds = rnd.choice([1, 2])
    parts = [_expression(rnd, depth - 1) for _ in range(rnd.randint(2, 3))]
    text = (" OR ", " and ")[binds - 1].join(f"( {t} )" if b < binds or rnd.random() < 0.2 else t for t, _, b in parts)
    return text, (min if binds == 1 else max)(v for _, v, _ in parts), binds


def test_expressions_equal_their_trees():
    rnd = random.Random(3)
    for _ in range(2000):
        text, value, _ = _expression(rnd, 4)
        got = licenses.evaluate(text.encode())
        assert got.obligation == value and got.text.split() == text.lower().replace("(", "( ").replace(")", " )").split(), text


@pytest.mark.parametrize("line,text", [
    ("MIT License (see file)", "mit"), ("MIT OR", "mit"), ("(MIT OR ISC", None), ("OR MIT", None), ("", None), ("MIT) AND ISC", "mit"),
    ("MIT AND (ISC OR", "mit"), ("MIT WITH ISC", "mit"), ("(MIT) WITH LLVM-exception", "( mit )"), ("MIT. OR ISC", "mit"),
    ("GPL-2.0 WITH LLVM-exception WITH LLVM-exception", "gpl-2.0 with llvm-exception"), ("MIT\nOR ISC", "mit"),
    ("MIT\tOR ISC+", "mit or isc+"), ("LLVM-exception", None)])
def test_longest_whole_expression(line, text):
    got = licenses.evaluate(line.encode(), believed=False)
    assert (got and got.text) == text


def test_long_license_lines_are_linear():
    phrases, tags = licenses.automata()
    for text in (b"license: " * 100_000, b"spdx-license-identifier: " + b"mit or " * 100_000, b"license: " + b"(" * 300_000,
                 b"spdx-license-identifier: " + b" " * 500_000, b"spdx-license-identifier: " + b"a and " * 100_000 + b"b"):
        licenses.scan(text, phrases, tags)


# --- conversations -------------------------------------------------------------------------------------------

SCHEMA = "conv_id long, turn long, role string, text string, conv string, seq string"


def _conversations():
    rnd = random.Random(8)
    rows = []
    for conv in range(120):
        role = ["user", "assistant"]
        for turn in range(rnd.choice([1, 2, 3, 4, 8, 20])):
            rows.append((conv, turn, "system" if turn == 0 and conv % 3 == 0 else role[(turn + (conv % 3 == 0)) % 2],
                         rnd.choice(["One.", "Two!", "Three? ", "four", "", " \n", "same.", f"no {turn}."])))
    rows += [(500, 0, "user", "hi.")] * 9 + [(501, None, None, None), (501, None, "user", "b."), (501, 3, "tool", "c."), (501, 3, "user", "d.")]
    rows += [(None, 1, "user", "x."), (None, 2, "assistant", None), (502, 7, "", "y."), (502, 9, "assistant", "z" * 100_000 + ".")]
    rows += [(503, t, rnd.choice(["user", "assistant", "system"]), f"t {t % 40}" + "." * (t % 2)) for t in range(700)]
    return rows


@pytest.mark.parametrize("options", [{"max_rows": 3, "fan": 2}, {"max_bytes": 2000, "fan": 3}])
def test_repair_equals_brute_force(spark, options):
    rows = _conversations()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = repair.repair_digest(repair.damage(df), df, **options)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_new.repaired(rows)


def test_agenda_equals_every_way():
    rnd = random.Random(4)
    for _ in range(60):
        steps = [(rnd.choice(["system", "user", "assistant", "tool", ""]), "t", rnd.random() < 0.2, 0) for _ in range(rnd.randint(0, 3))]
        steps = [(r, t, d, int(not d and rnd.random() < 0.3)) for r, t, d, _ in steps]
        blocks = [repair.Step(r[:1], d, bool(c)).block() for r, _, d, c in steps]
        ends = repair.lightest(blocks, repair.START, True, repair.ACCEPTING)
        (cost, audit, _), = ends.values()
        assert (cost, audit) == brute_new.every_way(steps) == brute_new.lightest(steps)[:2]


def test_blocks_join_like_rows():
    rnd = random.Random(5)
    for _ in range(40):
        steps = [repair.Step(rnd.choice("suat"), rnd.random() < 0.2, rnd.random() < 0.3).block() for _ in range(12)]
        whole = {p: repair.lightest(steps, p, True) for p in range(4)}
        blocks = [{(p, q): w[:2] for p in range(4) for q, w in repair.lightest(steps[i:i + 4], p, True).items()} for i in (0, 4, 8)]
        for p in range(4):
            joined = repair.lightest(blocks, p, False)
            assert {q: w[:2] for q, w in joined.items()} == {q: w[:2] for q, w in whole[p].items()}
            for q, (cost, audit, path) in joined.items():
                at = [p, *path]
                assert at[-1] == q and sum(blocks[k][at[k], at[k + 1]][0] for k in range(3)) == cost
                assert "".join(blocks[k][at[k], at[k + 1]][1] for k in range(3)) == audit


def test_repaired_turns_are_a_dialogue(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in _conversations()], SCHEMA)
    said = {}
    for r in repair.repaired_turns(df, max_rows=5, fan=3).collect():
        said.setdefault(r["conv_id"], []).append((r["seq"], r["position"], r["role"]))
    assert len(said) > 100 and None in said
    for turns in said.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for _, _, r in sorted(turns)))


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair_digest(repair.damage(df), df).count() == 0
    one = spark.createDataFrame([(1, 1, "user", "a.", "x", "y")], SCHEMA)
    assert [tuple(r) for r in repair.repair_digest(one.where("false"), one).collect()] == \
        [(1, 0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")]


# --- spelling ------------------------------------------------------------------------------------------------

def _prose():
    rnd = random.Random(11)
    stems = ["".join(rnd.choice(["an", "be", "cin", "dro", "é", "tion", "ment", "Ü"]) for _ in range(rnd.randint(2, 5))) for _ in range(80)]
    rows = []
    for doc in range(60):
        words = [rnd.choice(stems[:1 + min(79, int(rnd.expovariate(0.1)))]) for _ in range(300)]
        for _ in range(30):
            k = rnd.randrange(len(words))
            w, i = words[k], rnd.randrange(len(words[k]) + 1)
            words[k] = rnd.choice([w[:i] + w[i + 1:], w[:i] + "q" + w[i:], w[:i] + "x" + w[i + 1:], w + "n", w.upper()])
        rows.append((doc, rnd.choice([" ", ", ", "×", "ł"]).join(words), "s"))
    rows += [(None, "abcdefgh abcdefgh abcdefgx", "s"), (900, None, "s"), (901, "", "s"), (902, "a" * 20_000 + " " + "a" * 19_999, "s"),
             (903, "a" * 20_000 + " " + "a" * 19_999, "s"), rows[0], (904, "中文字中文字中文字 ١٢٣", "s")]
    return rows


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("options", [{}, {"list_limit": 2, "dictionary": 5}, {"min_length": 4, "ratio": 2, "damage": None},
                                     {"min_length": 9, "list_limit": 3, "damage": 3}])
def test_spelling_equals_brute_force(spark, options):
    rows = [r for r in _prose() if len(r[1] or "") < 30_000]
    got = spelling.spelling_groups(brute.frame(spark, rows), **{"damage": 31, **options})
    want = brute_new.spelling(rows, **{k: v for k, v in options.items() if k in ("min_length", "ratio", "damage")})
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == want
    assert sum(w[1] is not None for w in want) > 3


def test_very_long_words_and_no_words(spark):
    rows = [r for r in _prose() if r[0] in (902, 903)]
    rows += [(905, " ".join("ab" * 30 + "c" * k for k in (2, 3, 4, 5, 6) for _ in range(2 + k)), "s")]  # 62 to 66 letters
    got = {len(r["word"]): r for r in spelling.spelling_groups(brute.frame(spark, rows), ratio=2).collect()}
    assert {k: r["n_near"] for k, r in got.items()} == {20_000: 1, 19_999: 1, 62: 1, 63: 2, 64: 2, 65: 2, 66: 1}
    assert spelling.spelling_groups(brute.frame(spark, [])).count() == 0
    assert spelling.spelling_groups(brute.frame(spark, [(1, None, "s"), (2, "ab cd", "s")])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(brute.frame(spark, rows), min_length=3).count()


def test_affected_grams_never_exceed_the_bound():
    """What the index takes for granted: a variant keeps all grams but as many as the word's bound."""
    rnd = random.Random(12)
    for _ in range(3000):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(8, 14)))
        qmax = rnd.choice([2, 3, 4])
        grams = {word[i:i + q] for q in range(2, qmax) for i in range(len(word))} | {"ab", "bc", "abc"}
        frequent = frozenset(g for g in grams if rnd.random() < 0.5)
        i, c = rnd.randrange(len(word)), rnd.choice("abcd")
        other = rnd.choice([word[:i] + word[i + 1:], word[:i] + c + word[i:], word[:i] + c + word[i + 1:], word + c])
        a, b = ({f"{w[:lo]} {w[hi:]}" for lo, hi in spelling.surviving(w, frequent, qmax)[0]} for w in (word, other))
        assert other == word or a & b - {" "}, (word, other, frequent)
        texts = [[w[s:e] for s, e in spelling.decompose(w, frequent, qmax)] for w in (word, other)]
        shared = len(texts[0]) - sum(g in texts[1] for g in texts[0])
        assert shared <= spelling.surviving(word, frequent, qmax)[1]
