"""DuckDB SQL for the queries that SQL can state: plain definitions, no hashing and no candidate search."""

from __future__ import annotations

from .chat import DEFAULT, Template
from .common import ASCII_UPPER

LOWER = f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}')"
#: Smallest id reachable over the rows of `links(a, b)`.
REACH = """
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (SELECT a, b FROM edges UNION SELECT id, b FROM reach JOIN edges ON r = a),
least_id AS (SELECT id, least(id, min(r)) AS component_id FROM reach GROUP BY id)"""

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT k, min(doc_id) AS id, any_value(n) AS n FROM n GROUP BY k),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
  WHERE x.doc_id IN (SELECT id FROM c) AND y.doc_id IN (SELECT id FROM c) GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN c p ON p.id = a JOIN c q ON q.id = b
  WHERE 100 * shared.k >= 85 * (p.n + q.n - shared.k)
  UNION SELECT c.id, n.doc_id FROM n JOIN c USING (k) WHERE n.doc_id <> c.id),
{REACH}
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
  doc_id = coalesce(component_id, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_id ON least_id.id = doc_id"""

OP5 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS r
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id
  WHERE x.r > 0 AND y.r > 0 AND list_dot_product(x.e, y.e) / (x.r * y.r) >= 0.95),
degree AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id),
{REACH}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
  vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN degree ON degree.id = vec_id LEFT JOIN least_id ON least_id.id = vec_id"""

_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
pos AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, pos.k, item_id FROM pos JOIN win ON pos.g = win.g AND pos.k = win.k),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS x FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(x), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(x, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


def _chat(template: Template, control: str) -> str:
    def escaped(column: str) -> str:
        out = rf"replace({column}, '\', '\\')"
        for mark in template.marks():
            out = rf"replace({out}, '{mark}', '{mark[0]}\{mark[1:]}')"
        return out

    marks = " ".join(f"WHEN '{r}' THEN {len(o) + len(c)}" for r, (o, c, _) in template.roles.items())
    other = f"{sum(map(len, template.other))} + length({escaped('role')})"
    loss = ", ".join(f"'{r}'" for r, (_, _, under) in template.roles.items() if under)
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{control}' UNION ALL SELECT -7, 1, 'assistant', '{control}')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role IN ({loss})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({loss})), '')) AS loss_sha256,
  sum(length({escaped('text')}) + CASE role {marks} ELSE {other} END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


#: The checksum's table of 256 entries, by its rule.
_CRC = """crc AS (
  SELECT list(c8 ORDER BY i) AS t FROM (
    SELECT i, i AS c0, """ + ", ".join(
    f"xor(c{k} >> 1, (c{k} & 1) * 3988292384) AS c{k + 1}" for k in range(8)) + """ FROM (SELECT unnest(range(256)) AS i)))"""


def _crc32(chars: str) -> str:
    """Checksum of a list of characters up to U+00FF, as UTF-8."""
    as_bytes = (f"flatten(list_transform({chars}, lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] "
                "ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END))")
    return f"xor(list_reduce({as_bytes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _weigh(state: str, cost: str, edit: str, said: str = "''") -> str:
    return (f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', "
            f"'t': {state}.t || {said}}} END")


def _repair() -> str:
    at = {k: f"x.s[{i}]" for i, k in enumerate("0sua", 1)}
    moves = {"s": "0", "u": "0sa", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    turned = "chr(10) || y.role || ':' || y.text"

    def row(to: str) -> str:
        ways = [_weigh(at[to], "3", "D")]
        for before in moves.get(to, ""):
            ways.append(f"CASE WHEN NOT y.must_go AND y.initial = '{to}' THEN {_weigh(at[before], 'y.cut', 'K', turned)} END")
            if to in name:
                said = f"chr(10) || '{name[to]}:' || y.text"
                ways.append(f"CASE WHEN NOT y.must_go THEN {_weigh(at[before], '2 + y.cut', 'R', said)} END")
        return f"list_min([{', '.join(ways)}])"

    def inserted(to: str) -> str:
        said = f"chr(10) || '{name.get(to)}:'"
        ways = [at[to]] + [_weigh(at[before], "2", "I", said) for before in moves[to] if to in name]
        return f"list_min([{', '.join(ways)}])"

    step = (f"CASE WHEN y.kind = 'row' THEN [{', '.join(row(k) for k in '0sua')}] "
            f"ELSE [{at['0']}, {at['s']}, {inserted('u')}, {inserted('a')}] END")
    state = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)[]"
    nothing = "{'s': NULL::" + state + ", 'kind': 'insert', 'initial': '', 'must_go': false, 'cut': 0::BIGINT, 'role': '', 'text': ''}"
    start = nothing.replace(f"NULL::{state}", f"[{{'c': 0, 'a': '', 't': ''}}, NULL, NULL, NULL]::{state}")
    return rf"""
WITH {_CRC},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc32("string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')")} % 20 AS fate
  FROM conversations CROSS JOIN crc),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM o),
f AS (SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)) AS k FROM d),
a AS (SELECT *, k > min(k) OVER (PARTITION BY conv_id, role, text) AS again FROM f),
g AS (SELECT *, body = '' AS blank, body <> '' AND again AS duplicate,
  body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS initial,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM a),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
  count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'initial': initial, 'must_go': blank OR duplicate, 'cut': truncated::BIGINT, 'role': role, 'text': text}} ORDER BY k) AS steps
  FROM g GROUP BY conv_id),
s AS (SELECT * EXCLUDE (steps), list_concat([{nothing}, {nothing}], flatten(list_transform(steps, lambda r: [
  {nothing.replace("'insert'", "'row'").replace("'initial': ''", "'initial': r.initial").replace("'must_go': false", "'must_go': r.must_go")
   .replace("0::BIGINT", "r.cut").replace("'role': ''", "'role': r.role").replace("'text': ''", "'text': r.text")},
  {nothing}, {nothing}]))) AS steps FROM c),
e AS (SELECT * EXCLUDE (steps), list_reduce(steps, lambda x, y: {nothing.replace(f"NULL::{state}", step)}, {start}).s AS ends FROM s),
b AS (SELECT * EXCLUDE (ends), list_min([ends[1], ends[4]]) AS best FROM e)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(substr(coalesce(best.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN b ON i.conv_id IS NOT DISTINCT FROM b.conv_id"""


OP13 = rf"""
WITH RECURSIVE {_CRC},
runs AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
held AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, k, {_crc32("string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')")} AS h FROM held CROSS JOIN crc),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
    sum(k)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
holes AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS m FROM near GROUP BY word),
forms AS (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form,
  CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
way(word, up) AS (SELECT word, form FROM forms WHERE form IS NOT NULL
  UNION ALL SELECT way.word, f.form FROM way JOIN forms f ON f.word = way.up WHERE f.form IS NOT NULL),
roots AS (SELECT way.word, way.up AS root FROM way JOIN forms f ON f.word = way.up WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near::BIGINT AS n_near, form_n FROM forms LEFT JOIN roots USING (word)"""


def oracles(control: str) -> dict[str, str]:
    return {"op1_minhash_dedup": OP1, "op5_embedding_dedup": OP5, "op6_decontamination": OP6,
            "op7_chat_format": _chat(DEFAULT, control), "op12_conversation_repair": _repair(), "op13_spelling_variants": OP13}
