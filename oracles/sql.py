"""DuckDB reference SQL for the correctness gate.

An independent, row-at-a-time formulation of the same semantics as the Spark
library: lines are unnested, the block-comment state is a windowed
``last_value(... IGNORE NULLS)``, function extents use ``lead``. Only the fixed
values (regex tables, word lists) are shared with the library.

Every oracle is ``WITH <chain> SELECT ...`` over the driver's pre-registered
views (``lineitem``, ``documents``, ``pages``).
"""

from __future__ import annotations

from healthspark.functions import dims
from healthspark.sources.driver_corpora import DUCKDB_COPIES, K1_LINES_SQL


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def qlist(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


LB = q(dims.LINE_BREAK_REGEX)
STRIP_RE = q(f"^{dims.STRIP_CLASS}+|{dims.STRIP_CLASS}+$")


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, {STRIP_RE}, '', 'g')"


def case_lang(col: str, table: dict, fn, default: str) -> str:
    parts = [f"WHEN {q(k)} THEN {fn(v)}" for k, v in table.items() if v]
    return f"(CASE {col} " + " ".join(parts) + f" ELSE {default} END)"


def first_group(expr: str, pats) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({expr}, {q(p)}, 1), '')" for p in pats) + ")"


def any_match(expr: str, pats) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, {q(p)})" for p in pats) + ")"


def contains_any(expr: str, frags) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(f)})" for f in frags) + ")"


# ---------------------------------------------------------------------------
# corpora
# ---------------------------------------------------------------------------

def corpus_cte(kind: str) -> str:
    if kind == "k1":
        lines = K1_LINES_SQL.replace("{lineitem}", "lineitem").replace("{copies}", DUCKDB_COPIES)
        return (f"k1_lines AS ({lines}),\n"
                "corpus AS (SELECT any_value(repo_id) AS repo_id, any_value(path) AS path, "
                "string_agg(line || sep, '' ORDER BY line_no) AS content FROM k1_lines GROUP BY src, copy)")
    if kind == "k1one":
        return corpus_cte("k1").replace("any_value(repo_id) AS repo_id", "'all' AS repo_id").replace(
            "any_value(path) AS path", "any_value(repo_id) || '/' || any_value(path) AS path")
    if kind == "k2":
        return ("corpus AS (SELECT source AS repo_id, lang || '/doc_' || CAST(doc_id AS VARCHAR) "
                "|| '.md' AS path, text AS content FROM documents)")
    if kind == "k2one":
        return ("corpus AS (SELECT 'documents' AS repo_id, source || '/' || lang || '/doc_' "
                "|| CAST(doc_id AS VARCHAR) || '.md' AS path, text AS content FROM documents)")
    if kind == "table":
        return "corpus AS (SELECT repo_id, path, content FROM fixture_corpus)"
    if kind == "k3":
        return ("corpus AS (SELECT regexp_extract(url, '^[A-Za-z]+://([^./:]+)', 1) AS repo_id, "
                "CAST(page_id AS VARCHAR) || '.html' AS path, html AS content FROM pages)")
    raise ValueError(kind)


def _ext_values() -> str:
    return ", ".join(f"({q(k)}, {q(v)})" for k, v in dims.LANGUAGE_BY_EXTENSION.items())


def _comment_values() -> str:
    rows = []
    for lang, (single, bo, bc) in dims.COMMENT_TOKENS.items():
        rows.append(f"({q(lang)}, {q(single)}, {q(bo) if bo else 'NULL'}, {q(bc) if bc else 'NULL'})")
    return ", ".join(rows)


def scan_ctes(extra_ignores=()) -> str:
    ign = qlist(list(dims.IGNORED_DIR_NAMES) + list(extra_ignores))
    tdirs = qlist(dims.TEST_DIR_NAMES)
    return f"""
ext_dim(ext, language) AS (VALUES {_ext_values()}),
path_parts AS (SELECT repo_id, path, content, string_split(path, '/') AS parts FROM corpus),
path_rules AS (
  SELECT repo_id, path, content, parts[len(parts)] AS fname,
    len(list_filter(parts[1:len(parts) - 1], lambda d: list_contains({ign}, lower(d))
        OR starts_with(d, '.') OR ends_with(lower(d), '.egg-info'))) > 0 AS dir_ignored,
    ({contains_any('lower(path)', dims.IGNORED_FILE_FRAGMENTS)} OR starts_with(parts[len(parts)], '.')) AS file_ignored,
    lower(regexp_extract(parts[len(parts)], '^.+(\\.[^.]+)$', 1)) AS extension,
    (len(list_filter(string_split(lower(path), '/'), lambda c: list_contains({tdirs}, c))) > 0
      OR {contains_any('lower(parts[len(parts)])', dims.TEST_NAME_FRAGMENTS)}) AS is_test
  FROM path_parts
),
rules_lang AS (
  SELECT r.*, e.language FROM path_rules r LEFT JOIN ext_dim e ON e.ext = r.extension
),
scanned AS (
  SELECT repo_id, path, extension, language, is_test, CAST(strlen(content) AS BIGINT) AS size_bytes,
         md5(content) AS md5, content AS text, contains(content, chr(0)) AS is_binary
  FROM rules_lang
  WHERE NOT dir_ignored AND NOT file_ignored AND language IS NOT NULL
)"""


def line_ctes() -> str:
    todo = q("(?i)" + dims.TODO_PATTERN)
    func = case_lang("language", dims.FUNCTION_PATTERNS, lambda p: first_group("line", p), "NULL")
    cls = case_lang("language", dims.CLASS_PATTERNS, lambda p: first_group("line", p), "NULL")
    imp = case_lang("language", dims.IMPORT_PATTERNS, lambda p: any_match("line", p), "false")
    err = case_lang("language", dims.ERROR_PATTERNS, lambda p: any_match("line", p), "false")
    branch = qlist(dims.BRANCH_KEYWORDS)[1:-1]
    feat = case_lang("language", dims.FEATURE_PATTERNS,
                     lambda ps: " + ".join(f"len(regexp_extract_all(text, {q(p)}))" for p in ps), "0")
    return f"""
comment_dim(language, single, bopen, bclose) AS (VALUES {_comment_values()}),
analysed AS (SELECT *, CAST({feat} AS BIGINT) AS feature_count FROM scanned WHERE NOT is_binary),
split_text AS (
  SELECT repo_id, path, language, is_test, string_split_regex(text, {LB}) AS arr FROM analysed
),
split_n AS (
  SELECT *, CASE WHEN len(arr) > 0 AND arr[len(arr)] = '' THEN len(arr) - 1 ELSE len(arr) END AS n_lines
  FROM split_text
),
raw_lines AS (
  SELECT repo_id, path, language, is_test, n_lines, unnest(arr) AS line,
         unnest(generate_series(1, len(arr))) AS line_no
  FROM split_n
),
lines1 AS (
  SELECT l.repo_id, l.path, l.language, l.is_test, l.n_lines, l.line, CAST(l.line_no AS BIGINT) AS line_no,
         {strip('l.line')} AS s, coalesce(c.single, '#') AS single, c.bopen, c.bclose
  FROM raw_lines l LEFT JOIN comment_dim c ON c.language = l.language
  WHERE l.line_no <= l.n_lines
),
lines2 AS (
  SELECT *,
    CASE WHEN bopen IS NOT NULL AND contains(s, bopen) AND NOT contains(s, bclose) THEN 1
         WHEN bopen IS NOT NULL AND contains(s, bclose) AND NOT contains(s, bopen) THEN 0 END AS mark,
    (bopen IS NOT NULL AND (contains(s, bopen) OR contains(s, bclose))) AS has_tok
  FROM lines1
),
lines3 AS (
  SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY repo_id, path ORDER BY line_no
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS state_before
  FROM lines2
),
lines4 AS (
  SELECT *, CASE WHEN s = '' THEN 'blank'
                 WHEN has_tok OR state_before = 1 OR starts_with(s, single) THEN 'comment'
                 ELSE 'code' END AS kind
  FROM lines3
),
items AS (
  SELECT *,
    CASE WHEN kind = 'code' THEN {func} END AS func_name,
    CASE WHEN kind = 'code' THEN {cls} END AS class_name,
    CASE WHEN kind <> 'blank' THEN {strip(f"nullif(regexp_extract(line, {todo}, 1), '')")} END AS todo,
    (kind <> 'blank' AND {imp}) AS is_import,
    (kind <> 'blank' AND {err}) AS has_error,
    CASE WHEN kind <> 'blank' THEN regexp_extract_all(line, {q(dims.STRING_LITERAL_PATTERN)}, 1)
         ELSE [] END AS lits,
    (kind <> 'blank' AND regexp_extract(lower(s), '^([^ (]*)', 1) IN ({branch})) AS is_branch
  FROM lines4
),
fn_rows AS (
  SELECT repo_id, path, language, is_test, func_name AS name, line_no AS start_line,
         coalesce(lead(line_no) OVER (PARTITION BY repo_id, path ORDER BY line_no) - 1, n_lines) AS end_line
  FROM items WHERE func_name IS NOT NULL
),
functions AS (
  SELECT repo_id, path, language, is_test, name, CAST(start_line AS BIGINT) AS start_line,
         CAST(end_line AS BIGINT) AS end_line, CAST(end_line - start_line + 1 AS BIGINT) AS line_count,
         {contains_any('lower(name)', dims.SENSITIVE_NAME_FRAGMENTS)} AS is_sensitive,
         (end_line - start_line + 1) > {dims.LONG_FUNCTION_LINES} AS is_long
  FROM fn_rows
),
cl_rows AS (
  SELECT repo_id, path, language, is_test, class_name AS name, line_no AS start_line,
         coalesce(lead(line_no) OVER (PARTITION BY repo_id, path ORDER BY line_no) - 1, n_lines) AS end_line
  FROM items WHERE class_name IS NOT NULL
),
classes AS (
  SELECT repo_id, path, language, is_test, name, CAST(start_line AS BIGINT) AS start_line,
         CAST(end_line AS BIGINT) AS end_line, CAST(0 AS BIGINT) AS method_count
  FROM cl_rows
),
todos AS (SELECT repo_id, path, line_no, todo AS content FROM items WHERE todo IS NOT NULL),
imports AS (SELECT repo_id, path, line_no, s AS text FROM items WHERE is_import),
literals AS (SELECT repo_id, path, line_no, unnest(lits) AS literal FROM items),
line_agg AS (
  SELECT repo_id, path, count(*) AS total_lines,
    count_if(kind = 'code') AS code_lines, count_if(kind = 'comment') AS comment_lines,
    count_if(kind = 'blank') AS blank_lines, count(func_name) AS function_count,
    count(class_name) AS class_count, count_if(is_import) AS import_count,
    count(todo) AS todo_count, sum(len(lits)) AS literal_count, count_if(is_branch) AS branch_lines,
    bool_or(has_error) AS has_error_handling
  FROM items GROUP BY repo_id, path
),
file_facts AS (
  SELECT a.repo_id, a.path, a.language, a.is_test, a.size_bytes, a.md5,
    CAST(coalesce(g.total_lines, 0) AS BIGINT) AS total_lines,
    CAST(coalesce(g.code_lines, 0) AS BIGINT) AS code_lines,
    CAST(coalesce(g.comment_lines, 0) AS BIGINT) AS comment_lines,
    CAST(coalesce(g.blank_lines, 0) AS BIGINT) AS blank_lines,
    CAST(coalesce(g.function_count, 0) AS BIGINT) AS function_count,
    CAST(coalesce(g.class_count, 0) AS BIGINT) AS class_count,
    CAST(coalesce(g.import_count, 0) AS BIGINT) AS import_count,
    CAST(coalesce(g.todo_count, 0) AS BIGINT) AS todo_count,
    CAST(coalesce(g.literal_count, 0) AS BIGINT) AS literal_count,
    CAST(coalesce(g.branch_lines, 0) AS BIGINT) AS branch_lines,
    a.feature_count,
    coalesce(g.has_error_handling, false) AS has_error_handling,
    CASE WHEN coalesce(g.code_lines, 0) > 0
         THEN (g.function_count + g.class_count + g.branch_lines) / g.code_lines * 100.0
         ELSE 0.0 END AS complexity
  FROM analysed a LEFT JOIN line_agg g ON g.repo_id = a.repo_id AND g.path = a.path
)"""


def chain(kind: str, *parts: str, extra_ignores=()) -> str:
    ctes = [corpus_cte(kind), scan_ctes(extra_ignores)]
    ctes += [p for p in parts]
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def clamp(expr: str) -> str:
    return f"greatest(CAST(0.0 AS DOUBLE), least(CAST(1.0 AS DOUBLE), {expr}))"


def smell_ctes() -> str:
    exempt = qlist(dims.DEAD_CODE_EXEMPT_NAMES)[1:-1]
    return f"""
repos AS (SELECT DISTINCT repo_id FROM corpus),
fn_style AS (
  SELECT repo_id, CASE
    WHEN contains(name, '_') AND lower(name) = name AND upper(name) <> name THEN 'snake'
    WHEN upper(left(name, 1)) = left(name, 1) AND lower(left(name, 1)) <> left(name, 1)
         AND NOT contains(name, '_') THEN 'pascal'
    WHEN lower(left(name, 1)) = left(name, 1) AND upper(left(name, 1)) <> left(name, 1)
         AND lower(name) <> name THEN 'camel' END AS style
  FROM functions
),
all_names AS (SELECT repo_id, name FROM functions UNION ALL SELECT repo_id, name FROM classes),
ff_sum AS (
  SELECT repo_id, sum(code_lines) AS total_code, sum(comment_lines) AS total_comments,
    sum(import_count) AS total_imports, sum(function_count) AS total_functions,
    sum(class_count) AS total_classes,
    sum(CASE WHEN NOT is_test THEN function_count ELSE 0 END) AS nontest_functions,
    sum(CASE WHEN NOT is_test AND has_error_handling THEN function_count ELSE 0 END) AS handled_functions
  FROM file_facts GROUP BY repo_id
),
name_sum AS (SELECT repo_id, count(*) AS total_names,
  count_if(length(name) > {dims.VERBOSE_NAME_LENGTH}) AS verbose_names FROM all_names GROUP BY repo_id),
style_sum AS (SELECT repo_id, count_if(style = 'snake') AS snake_names, count_if(style = 'camel') AS camel_names,
  count_if(style = 'pascal') AS pascal_names FROM fn_style GROUP BY repo_id),
name_counts AS (SELECT repo_id, name, count(*) AS n FROM functions GROUP BY repo_id, name),
dup_sum AS (SELECT repo_id, sum(n) AS duplicate_definitions, count(*) AS duplicate_names
  FROM name_counts WHERE n > 1 AND name NOT IN ({exempt}) GROUP BY repo_id),
lit_counts AS (SELECT repo_id, literal, count(*) AS n FROM literals GROUP BY repo_id, literal),
lit_sum AS (SELECT repo_id, sum(n) AS total_literals,
  sum(CASE WHEN n >= {dims.COPY_PASTE_MIN_OCCURRENCES} AND length(literal) > 20 THEN n ELSE 0 END) AS repeated_literals,
  count_if(n >= {dims.COPY_PASTE_MIN_OCCURRENCES} AND length(literal) > 20) AS repeated_patterns
  FROM lit_counts GROUP BY repo_id),
smell_inputs AS (
  SELECT r.repo_id,
    CAST(coalesce(f.total_code, 0) AS BIGINT) AS total_code, CAST(coalesce(f.total_comments, 0) AS BIGINT) AS total_comments,
    CAST(coalesce(f.total_imports, 0) AS BIGINT) AS total_imports, CAST(coalesce(f.total_functions, 0) AS BIGINT) AS total_functions,
    CAST(coalesce(f.total_classes, 0) AS BIGINT) AS total_classes,
    CAST(coalesce(n.total_names, 0) AS BIGINT) AS total_names,
    CAST(coalesce(n.verbose_names, 0) AS BIGINT) AS verbose_names,
    CAST(coalesce(s.snake_names, 0) AS BIGINT) AS snake_names,
    CAST(coalesce(s.camel_names, 0) AS BIGINT) AS camel_names,
    CAST(coalesce(s.pascal_names, 0) AS BIGINT) AS pascal_names,
    CAST(coalesce(f.nontest_functions, 0) AS BIGINT) AS nontest_functions,
    CAST(coalesce(f.handled_functions, 0) AS BIGINT) AS handled_functions,
    CAST(coalesce(d.duplicate_definitions, 0) AS BIGINT) AS duplicate_definitions,
    CAST(coalesce(d.duplicate_names, 0) AS BIGINT) AS duplicate_names,
    CAST(coalesce(l.total_literals, 0) AS BIGINT) AS total_literals,
    CAST(coalesce(l.repeated_literals, 0) AS BIGINT) AS repeated_literals,
    CAST(coalesce(l.repeated_patterns, 0) AS BIGINT) AS repeated_patterns
  FROM repos r LEFT JOIN ff_sum f USING (repo_id) LEFT JOIN name_sum n USING (repo_id) LEFT JOIN style_sum s USING (repo_id)
  LEFT JOIN dup_sum d USING (repo_id) LEFT JOIN lit_sum l USING (repo_id)
),
smells_wide AS (
  SELECT *,
    CASE WHEN total_code = 0 THEN 0.0 ELSE {clamp(f"total_comments / total_code / {_dbl(dims.EXCESSIVE_COMMENT_RATIO)}")} END AS excessive_comments,
    CASE WHEN total_names = 0 THEN 0.0 ELSE {clamp(f"verbose_names / total_names * {_dbl(2.0)}")} END AS verbose_naming,
    CASE WHEN total_functions = 0 THEN 0.0 ELSE {clamp(f"total_imports / total_functions / {_dbl(dims.BOILERPLATE_IMPORT_RATIO)}")} END AS boilerplate_heavy,
    CASE WHEN snake_names + camel_names + pascal_names < {dims.INCONSISTENT_MIN_NAMES} THEN 0.0
         ELSE {clamp(f"{_dbl(1.0)} - greatest(snake_names, camel_names, pascal_names) / (snake_names + camel_names + pascal_names)")} END AS inconsistent_patterns,
    CASE WHEN total_functions = 0 THEN 0.0 ELSE {clamp(f"duplicate_definitions / total_functions * {_dbl(5.0)}")} END AS dead_code_indicators,
    CASE WHEN total_code < {dims.OVER_ENGINEERING_MIN_LOC} THEN 0.0
         ELSE {clamp(f"(total_classes / total_code * {_dbl(1000.0)} - {_dbl(10.0)}) / {_dbl(20.0)}")} END AS over_engineering,
    CASE WHEN nontest_functions = 0 THEN 0.0 ELSE {clamp(f"{_dbl(1.0)} - handled_functions / nontest_functions")} END AS missing_error_handling,
    CASE WHEN total_literals < {dims.COPY_PASTE_MIN_TOTAL} THEN 0.0 ELSE {clamp(f"repeated_literals / total_literals * {_dbl(2.0)}")} END AS copy_paste_artifacts
  FROM smell_inputs
),
smells_long AS (
  SELECT repo_id, smell, ordinal, score FROM (
    {" UNION ALL ".join(f"SELECT repo_id, {q(s)} AS smell, {i + 1} AS ordinal, CAST({s} AS DOUBLE) AS score FROM smells_wide" for i, s in enumerate(dims.SMELL_ORDER))}
  )
)"""


def smell_result_sql() -> str:
    says = {
        "excessive_comments": pct1("CASE WHEN total_code > 0 THEN total_comments / total_code ELSE 0.0 END") + " || '% comment lines per code line'",
        "verbose_naming": f"{v('verbose_names')} || ' of ' || {v('total_names')} || ' names are long'",
        "boilerplate_heavy": f"{v('total_imports')} || ' imports for ' || {v('total_functions')} || ' functions'",
        "inconsistent_patterns":
            f"CASE WHEN snake_names + camel_names + pascal_names < {dims.INCONSISTENT_MIN_NAMES} THEN 'too few names to compare styles' ELSE "
            + pct1("greatest(snake_names, camel_names, pascal_names) / (snake_names + camel_names + pascal_names)")
            + " || '% of names follow the main style' END",
        "dead_code_indicators": f"{v('duplicate_names')} || ' names defined repeatedly'",
        "over_engineering": f"{v('total_classes')} || ' classes in ' || {v('total_code')} || ' code lines'",
        "missing_error_handling": f"{v('nontest_functions - handled_functions')} || ' of ' || {v('nontest_functions')} "
                                  "|| ' functions in files that handle no error'",
        "copy_paste_artifacts": f"{v('repeated_patterns')} || ' literals used again and again'",
    }
    return " UNION ALL ".join(
        f"SELECT repo_id, {q(x)} AS smell, CAST({i + 1} AS BIGINT) AS ordinal, CAST({x} AS DOUBLE) AS score, {says[x]} AS description "
        "FROM smells_wide" for i, x in enumerate(dims.SMELL_ORDER))


def dup_ctes(threshold: float = dims.NEAR_DUP_DEFAULT_THRESHOLD) -> str:
    wl, wf, wc = dims.SIMILARITY_WEIGHTS
    return f"""
exact_groups AS (
  SELECT repo_id, md5, count(*) AS n_files, min(path) AS first_path, max(path) AS last_path
  FROM file_facts GROUP BY repo_id, md5 HAVING count(*) > 1
),
exact_members AS (
  SELECT f.repo_id, f.md5, g.first_path, g.n_files, f.path
  FROM file_facts f JOIN exact_groups g ON g.repo_id = f.repo_id AND g.md5 = f.md5
),
eligible AS (SELECT repo_id, path, language, code_lines FROM file_facts WHERE code_lines >= {dims.NEAR_DUP_MIN_CODE_LINES}),
fset AS (SELECT DISTINCT repo_id, path, name FROM functions),
cset AS (SELECT DISTINCT repo_id, path, name FROM classes),
fk AS (SELECT repo_id, path, count(*) AS k FROM fset GROUP BY repo_id, path),
ck AS (SELECT repo_id, path, count(*) AS k FROM cset GROUP BY repo_id, path),
all_pairs AS (
  SELECT a.repo_id, a.language, a.path AS path1, b.path AS path2, a.code_lines AS l1, b.code_lines AS l2
  FROM eligible a JOIN eligible b ON a.repo_id = b.repo_id AND a.language = b.language AND a.path < b.path
),
f_shared AS (
  SELECT p.repo_id, p.path1, p.path2, count(*) AS s FROM all_pairs p
  JOIN fset x ON x.repo_id = p.repo_id AND x.path = p.path1
  JOIN fset y ON y.repo_id = p.repo_id AND y.path = p.path2 AND y.name = x.name
  GROUP BY p.repo_id, p.path1, p.path2
),
c_shared AS (
  SELECT p.repo_id, p.path1, p.path2, count(*) AS s FROM all_pairs p
  JOIN cset x ON x.repo_id = p.repo_id AND x.path = p.path1
  JOIN cset y ON y.repo_id = p.repo_id AND y.path = p.path2 AND y.name = x.name
  GROUP BY p.repo_id, p.path1, p.path2
),
pair_sims AS (
  SELECT p.repo_id, p.language, p.path1, p.path2,
    CASE WHEN l1 = 0 AND l2 = 0 THEN 1.0 WHEN l1 = 0 OR l2 = 0 THEN 0.0 ELSE least(l1, l2) / greatest(l1, l2) END AS line_sim,
    CASE WHEN coalesce(fa.k, 0) = 0 OR coalesce(fb.k, 0) = 0 THEN 0.0
         ELSE coalesce(fs.s, 0) / (fa.k + fb.k - coalesce(fs.s, 0)) END AS func_sim,
    CASE WHEN coalesce(ca.k, 0) = 0 OR coalesce(cb.k, 0) = 0 THEN 0.0
         ELSE coalesce(cs.s, 0) / (ca.k + cb.k - coalesce(cs.s, 0)) END AS class_sim
  FROM all_pairs p
  LEFT JOIN fk fa ON fa.repo_id = p.repo_id AND fa.path = p.path1
  LEFT JOIN fk fb ON fb.repo_id = p.repo_id AND fb.path = p.path2
  LEFT JOIN ck ca ON ca.repo_id = p.repo_id AND ca.path = p.path1
  LEFT JOIN ck cb ON cb.repo_id = p.repo_id AND cb.path = p.path2
  LEFT JOIN f_shared fs ON fs.repo_id = p.repo_id AND fs.path1 = p.path1 AND fs.path2 = p.path2
  LEFT JOIN c_shared cs ON cs.repo_id = p.repo_id AND cs.path1 = p.path1 AND cs.path2 = p.path2
),
near AS (
  SELECT *, line_sim * {_dbl(wl)} + func_sim * {_dbl(wf)} + class_sim * {_dbl(wc)} AS similarity
  FROM pair_sims
  WHERE line_sim * {_dbl(wl)} + func_sim * {_dbl(wf)} + class_sim * {_dbl(wc)} >= {_dbl(threshold)}
),
near_kept AS (
  SELECT n.* FROM near n WHERE NOT EXISTS (
    SELECT 1 FROM exact_groups g WHERE g.n_files = 2 AND g.repo_id = n.repo_id
      AND g.first_path = n.path1 AND g.last_path = n.path2)
),
lang_first AS (SELECT repo_id, language, min(path) AS lang_order FROM eligible GROUP BY repo_id, language),
all_dups AS (
  SELECT repo_id, true AS is_exact, 1.0 AS similarity, first_path AS file_1,
         CASE WHEN n_files = 2 THEN last_path END AS file_2, n_files, md5 AS group_key,
         0 AS kind_order, -1.0 AS sim_order, '' AS lang_order
  FROM exact_groups
  UNION ALL
  SELECT n.repo_id, false, n.similarity, n.path1, n.path2, 2, CAST(to_json([n.path1, n.path2]) AS VARCHAR),
         1, -n.similarity, l.lang_order
  FROM near_kept n JOIN lang_first l ON l.repo_id = n.repo_id AND l.language = n.language
),
dup_counts AS (
  SELECT r.repo_id, count(d.file_1) AS duplicate_groups, count(CASE WHEN d.is_exact THEN 1 END) AS exact_groups,
         count(CASE WHEN NOT d.is_exact THEN 1 END) AS near_pairs
  FROM (SELECT DISTINCT repo_id FROM corpus) r LEFT JOIN all_dups d ON d.repo_id = r.repo_id GROUP BY r.repo_id
),
sig AS (
  SELECT e.repo_id, e.path, e.language, min(e.path) OVER w AS first, count(*) OVER w AS n_files
  FROM (SELECT e.*, coalesce(f.x, []) AS fx, coalesce(c.x, []) AS cx FROM eligible e
        LEFT JOIN (SELECT repo_id, path, list_sort(list(name)) AS x FROM fset GROUP BY ALL) f ON f.repo_id = e.repo_id AND f.path = e.path
        LEFT JOIN (SELECT repo_id, path, list_sort(list(name)) AS x FROM cset GROUP BY ALL) c ON c.repo_id = e.repo_id AND c.path = e.path) e
  WINDOW w AS (PARTITION BY e.repo_id, e.language, e.code_lines, e.fx, e.cx)
),
sig_pairs AS (
  SELECT n.repo_id, n.language, least(a.first, b.first) AS path1, greatest(a.first, b.first) AS path2,
         any_value(CASE WHEN a.first <= b.first THEN a.n_files ELSE b.n_files END) AS n_files1,
         any_value(CASE WHEN a.first <= b.first THEN b.n_files ELSE a.n_files END) AS n_files2,
         count(*) AS n_pairs, any_value(line_sim) AS line_sim, any_value(func_sim) AS func_sim,
         any_value(class_sim) AS class_sim, any_value(similarity) AS similarity
  FROM near n JOIN sig a ON a.repo_id = n.repo_id AND a.path = n.path1 JOIN sig b ON b.repo_id = n.repo_id AND b.path = n.path2
  GROUP BY n.repo_id, n.language, least(a.first, b.first), greatest(a.first, b.first)
),
dup_member_rows AS (
  SELECT repo_id, 'exact' AS kind, md5 AS group_key, path FROM exact_members
  UNION ALL
  SELECT DISTINCT s.repo_id, 'near', s.first, s.path FROM sig s JOIN sig_pairs p
    ON p.repo_id = s.repo_id AND p.language = s.language AND (p.path1 = s.first OR p.path2 = s.first)
)"""


def metric_ctes() -> str:
    smells = list(dims.SMELL_ORDER)
    high = " + ".join(f"CASE WHEN {s} >= {dims.HIGH_SMELL_SCORE} THEN 1 ELSE 0 END" for s in smells)
    fix = " + ".join(f"CASE WHEN {s} > {dims.FIX_SMELL_SCORE} THEN 1 ELSE 0 END" for s in smells)
    tiers = " ".join(f"WHEN test_to_code_ratio >= {f} THEN {p}" for f, p in dims.TEST_RATIO_TIERS)
    risk = " ".join(f"WHEN health_score >= {f} THEN {q(n)}" for f, n in dims.RISK_LEVELS)
    density = dims.DEFECT_DENSITY_BASE * dims.AI_DEFECT_MULTIPLIER
    return f"""
fcounts AS (SELECT repo_id, count(*) AS total_files, count_if(NOT is_test) AS source_files,
  count_if(is_test) AS test_files FROM scanned GROUP BY repo_id),
fn_issue AS (
  SELECT fn.repo_id, count_if(fn.is_long) AS long_functions,
         count_if(fn.is_sensitive AND NOT ff.has_error_handling) AS sensitive_unhandled
  FROM functions fn JOIN file_facts ff ON ff.repo_id = fn.repo_id AND ff.path = fn.path
  GROUP BY fn.repo_id
),
atotals AS (
  SELECT repo_id, sum(total_lines) AS total_lines, sum(code_lines) AS code_lines,
    sum(comment_lines) AS comment_lines, sum(blank_lines) AS blank_lines,
    sum(CASE WHEN NOT is_test THEN code_lines ELSE 0 END) AS source_loc,
    sum(CASE WHEN is_test THEN code_lines ELSE 0 END) AS test_loc,
    sum(function_count) AS total_functions, sum(class_count) AS total_classes,
    sum(import_count) AS total_imports, sum(todo_count) AS todos_count,
    sum(feature_count) AS feature_count
  FROM file_facts GROUP BY repo_id
),
smell_flags AS (SELECT repo_id, {", ".join(smells)}, {high} AS high_smells, {fix} AS fix_smells FROM smells_wide),
m0 AS (
  SELECT r.repo_id,
    {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ["total_files", "source_files", "test_files", "total_lines", "code_lines", "comment_lines", "blank_lines", "source_loc", "test_loc", "total_functions", "total_classes", "total_imports", "todos_count", "long_functions", "sensitive_unhandled", "feature_count", "duplicate_groups", "high_smells", "fix_smells"])},
    {", ".join(f"coalesce({s}, 0.0) AS {s}" for s in smells)}
  FROM repos r LEFT JOIN fcounts USING (repo_id) LEFT JOIN atotals USING (repo_id)
  LEFT JOIN fn_issue USING (repo_id) LEFT JOIN smell_flags USING (repo_id)
  LEFT JOIN dup_counts USING (repo_id)
),
m1 AS (
  SELECT *,
    CASE WHEN source_loc > 0 THEN test_loc / source_loc ELSE 0.0 END AS test_to_code_ratio,
    {_dbl(density)} AS defect_density,
    CAST(floor(source_loc / {_dbl(1000.0)} * {_dbl(density)}) AS BIGINT) AS estimated_defects,
    CAST(CASE WHEN feature_count <= 0 THEN 0
         ELSE pow(2, least(feature_count, {dims.FEATURE_EXPONENT_CAP})) - 1 - least(feature_count, {dims.FEATURE_EXPONENT_CAP}) END AS BIGINT) AS feature_interactions
  FROM m0
),
m2 AS (
  SELECT *,
    CAST(CASE {tiers} ELSE {dims.TEST_RATIO_FLOOR_PENALTY} END AS BIGINT) AS penalty_tests,
    CAST(least(20, high_smells * 4) AS BIGINT) AS penalty_smells,
    CAST(least(10, duplicate_groups * 2) AS BIGINT) AS penalty_duplicates,
    CAST(least(10, long_functions) AS BIGINT) AS penalty_long_functions,
    CAST(least(10, sensitive_unhandled * 2) AS BIGINT) AS penalty_error_handling,
    CAST(CASE WHEN todos_count > 20 THEN 5 WHEN todos_count > 10 THEN 3 WHEN todos_count > 5 THEN 1 ELSE 0 END AS BIGINT) AS penalty_todos,
    CAST(CASE WHEN source_loc > 0 AND total_classes / source_loc * {_dbl(1000.0)} > {dims.CLASS_DENSITY_LIMIT} THEN 5 ELSE 0 END AS BIGINT) AS penalty_class_density
  FROM m1
),
m3 AS (
  SELECT *, CAST(greatest(0, least(100, 100 - (penalty_tests + penalty_smells + penalty_duplicates
      + penalty_long_functions + penalty_error_handling + penalty_todos + penalty_class_density))) AS BIGINT) AS health_score
  FROM m2
),
repo_metrics AS (SELECT *, CASE {risk} ELSE {q(dims.RISK_FLOOR)} END AS risk_level FROM m3)"""


def pct1(x: str) -> str:
    t = f"CAST(floor(({x}) * CAST(1000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"
    return f"(CAST(CAST(floor({t} / 10) AS BIGINT) AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR))"


def pct0(x: str) -> str:
    return f"CAST(CAST(floor(({x}) * CAST(100.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR)"


def v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


NL = "chr(10)"
NL2 = "chr(10) || chr(10)"


def fix_ctes() -> str:
    desc_map = "CASE smell " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in dims.SMELL_DESCRIPTIONS.items()) + " END"
    return f"""
fx_m AS (SELECT repo_id, test_to_code_ratio, source_loc, test_loc, source_files, todos_count, duplicate_groups
         FROM repo_metrics),
fn_first3 AS (
  SELECT repo_id, path, string_agg(name, ', ' ORDER BY start_line) AS first3 FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY start_line) AS rn FROM functions)
  WHERE rn <= 3 GROUP BY repo_id, path
),
g1_rank AS (
  SELECT f.repo_id, f.path, f.function_count, t.first3,
         row_number() OVER (PARTITION BY f.repo_id ORDER BY f.function_count DESC, f.path) AS rank
  FROM file_facts f JOIN fn_first3 t ON t.repo_id = f.repo_id AND t.path = f.path
  JOIN fx_m m ON m.repo_id = f.repo_id
  WHERE NOT f.is_test AND f.function_count > 0 AND m.test_to_code_ratio < 0.1
),
g1 AS (
  SELECT g.repo_id, 1 AS rule_order, 'tests_critical' AS rule, 'CRITICAL' AS priority,
    'Add tests: test code is almost absent' AS title,
    {v('any_value(m.source_loc)')} || ' source lines are covered by ' || {v('any_value(m.test_loc)')}
      || ' test lines (' || {pct1('any_value(m.test_to_code_ratio)')} || '% ratio); aim for at least 80%.' AS description,
    'Write test files for these modules, which have no tests yet:' || {NL2}
      || string_agg('- ' || g.path || ' (' || {v('g.function_count')} || ' functions, no tests); start with: ' || g.first3, {NL} ORDER BY g.rank)
      || {NL2} || 'For each function cover normal inputs, edge cases and error paths, at least three cases per function. Begin with '
      || arg_min(g.path, g.rank) || '.' AS prompt,
    string_agg(g.path, {NL} ORDER BY g.rank) AS affected,
    'Run the test suite with coverage and compare the ratio.' AS verification
  FROM g1_rank g JOIN fx_m m ON m.repo_id = g.repo_id WHERE g.rank <= 5 GROUP BY g.repo_id
),
g2_rank AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.repo_id ORDER BY f.line_count DESC, f.path, f.start_line) AS rank
  FROM functions f JOIN fx_m m ON m.repo_id = f.repo_id
  WHERE NOT f.is_test AND m.test_to_code_ratio >= 0.1 AND m.test_to_code_ratio < 0.5
),
g2 AS (
  SELECT g.repo_id, 2 AS rule_order, 'tests_moderate' AS rule, 'HIGH' AS priority, 'Close the gap in test code' AS title,
    'Test ratio is ' || {pct1('any_value(m.test_to_code_ratio)')} || '% against a target of 80%: about '
      || {v('CAST(floor(any_value(m.source_loc) * CAST(0.8 AS DOUBLE)) AS BIGINT) - any_value(m.test_loc)')} || ' more test lines are needed.' AS description,
    'Test coverage is ' || {pct1('any_value(m.test_to_code_ratio)')} || '%; add roughly '
      || {v('CAST(floor(any_value(m.source_loc) * CAST(0.8 AS DOUBLE)) AS BIGINT) - any_value(m.test_loc)')}
      || ' lines of tests. Longest functions first:' || {NL2}
      || string_agg('- ' || g.path || ': ' || g.name || '() spans ' || {v('g.line_count')} || ' lines', {NL} ORDER BY g.rank)
      || {NL2} || 'For each one test normal operation, edge cases and error handling.' AS prompt,
    string_agg(DISTINCT g.path, {NL} ORDER BY g.path) AS affected,
    'Re-run the coverage report.' AS verification
  FROM g2_rank g JOIN fx_m m ON m.repo_id = g.repo_id WHERE g.rank <= 10 GROUP BY g.repo_id
),
g3_rank AS (
  SELECT fn.*, row_number() OVER (PARTITION BY fn.repo_id ORDER BY fn.path, fn.start_line) AS rank
  FROM functions fn JOIN file_facts ff ON ff.repo_id = fn.repo_id AND ff.path = fn.path
  WHERE fn.is_sensitive AND NOT ff.has_error_handling
),
g3 AS (
  SELECT repo_id, 3 AS rule_order, 'error_handling' AS rule, 'CRITICAL' AS priority,
    {v('count(*)')} || ' sensitive functions lack error handling' AS title,
    'Functions that touch payments, credentials or deletions live in files without any error handling. This is a reliability and security risk.' AS description,
    'Add input validation, error handling and logging to:' || {NL2}
      || string_agg('- ' || path || ': ' || name || '() lines ' || {v('start_line')} || '-' || {v('end_line')}, {NL} ORDER BY rank)
      || {NL2} || 'Start with ' || arg_min(name, rank) || '() in ' || arg_min(path, rank) || '.' AS prompt,
    string_agg(DISTINCT path, {NL} ORDER BY path) AS affected,
    'Check every listed function for validation and exception handling.' AS verification
  FROM g3_rank WHERE rank <= 5 GROUP BY repo_id
),
dup_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY kind_order, sim_order, lang_order, file_1, file_2) AS group_rank,
         row_number() OVER (PARTITION BY repo_id, is_exact ORDER BY kind_order, sim_order, lang_order, file_1, file_2) AS kind_rank
  FROM all_dups
),
dup_lines AS (
  SELECT repo_id, kind_rank AS rank, '- ' || {v('n_files')} || ' equal files, group ' || group_key || ', the first being ' || file_1 AS l
  FROM dup_ranked WHERE is_exact AND kind_rank <= 3
  UNION ALL
  SELECT repo_id, kind_rank + 3, '- ' || file_1 || ' and ' || file_2 || ' agree to ' || {pct0('similarity')} || '%'
  FROM dup_ranked WHERE NOT is_exact AND kind_rank <= 2
),
dup_flat AS (
  SELECT d.repo_id, d.group_rank, m.path FROM dup_ranked d
  JOIN exact_members m ON m.repo_id = d.repo_id AND m.md5 = d.group_key WHERE d.is_exact AND d.group_rank <= 10
  UNION ALL SELECT repo_id, group_rank, file_1 FROM dup_ranked WHERE NOT is_exact AND group_rank <= 10
  UNION ALL SELECT repo_id, group_rank, file_2 FROM dup_ranked WHERE NOT is_exact AND group_rank <= 10
),
dup_aff AS (
  SELECT repo_id, string_agg(path, {NL} ORDER BY rk) AS affected FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY group_rank, path) AS rk FROM dup_flat)
  WHERE rk <= 10 GROUP BY repo_id
),
dup_txt AS (SELECT repo_id, string_agg(l, {NL} ORDER BY rank) AS evidence FROM dup_lines GROUP BY repo_id),
g4 AS (
  SELECT m.repo_id, 4 AS rule_order, 'duplicates' AS rule, 'HIGH' AS priority,
    'Keep one file of each of ' || {v('m.duplicate_groups')} || ' sets of copies' AS title,
    'The same code lives in several files. Every change has to be made more than once.' AS description,
    'Reduce each set to one file (all files of a set: table fix_files) and point its users there:' || {NL2}
      || coalesce(t.evidence, '') || {NL2} || 'The test suite has to pass as before.' AS prompt,
    a.affected, 'No reference names a file that is gone.' AS verification
  FROM fx_m m LEFT JOIN dup_txt t ON t.repo_id = m.repo_id LEFT JOIN dup_aff a ON a.repo_id = m.repo_id
  WHERE m.duplicate_groups > 0
),
g5_rank AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY path, start_line) AS rank FROM functions WHERE is_long
),
g5 AS (
  SELECT repo_id, 5 AS rule_order, 'long_functions' AS rule, 'MEDIUM' AS priority,
    {v('count(*)')} || ' functions are too long' AS title,
    'More than 80 lines in one function usually hold several jobs. Give each job its own function.' AS description,
    'Take these apart, job by job:' || {NL2}
      || string_agg('- ' || path || ': ' || name || '() is ' || {v('line_count')} || ' lines (lines '
                    || {v('start_line')} || '-' || {v('end_line')} || ')', {NL} ORDER BY rank)
      || {NL2} || 'Start with ' || arg_min(name, rank) || '() in ' || arg_min(path, rank) || '.' AS prompt,
    string_agg(DISTINCT path, {NL} ORDER BY path) AS affected,
    'None of the listed functions exceeds the limit any more.' AS verification
  FROM g5_rank WHERE rank <= 5 GROUP BY repo_id
),
g6 AS (
  SELECT repo_id, 6 AS rule_order, 'smells' AS rule, 'MEDIUM' AS priority,
    {v('count(*)')} || ' smell scores are high' AS title,
    'These scores point at habits of generated code. Look at the evidence of each.' AS description,
    'Look into each of these and simplify where it is justified:' || {NL2}
      || string_agg('- ' || smell || ' (' || {pct0('score')} || '%): ' || ({desc_map}), {NL} ORDER BY score DESC, ordinal) AS prompt,
    '' AS affected, 'A new scan shows lower scores.' AS verification
  FROM smells_long WHERE score > {dims.FIX_SMELL_SCORE} GROUP BY repo_id
),
g7_rank AS (
  SELECT t.*, row_number() OVER (PARTITION BY t.repo_id ORDER BY t.path, t.line_no) AS rank
  FROM todos t JOIN fx_m m ON m.repo_id = t.repo_id WHERE m.todos_count > 5
),
g7 AS (
  SELECT g.repo_id, 7 AS rule_order, 'todos' AS rule, 'LOW' AS priority,
    'Work through ' || {v('any_value(m.todos_count)')} || ' open markers' AS title,
    'Each marker is a decision that someone put off. Take it or drop it.' AS description,
    'There are ' || {v('any_value(m.todos_count)')} || ' markers; the first ' || {v('count(*)')} || ':' || {NL2}
      || string_agg('- ' || g.path || ':' || {v('g.line_no')} || ': '
                    || CASE WHEN length(g.content) > 60 THEN substr(g.content, 1, 60) || '...' ELSE g.content END,
                    {NL} ORDER BY g.rank)
      || {NL2} || 'Start with those that report faults.' AS prompt,
    string_agg(DISTINCT g.path, {NL} ORDER BY g.path) AS affected,
    'A new scan finds fewer markers.' AS verification
  FROM g7_rank g JOIN fx_m m ON m.repo_id = g.repo_id WHERE g.rank <= 15 GROUP BY g.repo_id
),
g8 AS (
  SELECT repo_id, 8 AS rule_order, 'size' AS rule, 'LOW' AS priority, 'The code base is large' AS title,
    {v('source_loc')} || ' source lines: look for dead code and merge utilities.' AS description,
    'This code base has ' || {v('source_loc')} || ' source lines in ' || {v('source_files')}
      || ' source files. Remove dead code, merge similar utilities and drop generated files.' AS prompt,
    '' AS affected, 'Track line counts over time.' AS verification
  FROM fx_m WHERE source_loc > 10000
),
fix_rules AS (
  SELECT * FROM g1 UNION ALL SELECT * FROM g2 UNION ALL SELECT * FROM g3 UNION ALL SELECT * FROM g4
  UNION ALL SELECT * FROM g5 UNION ALL SELECT * FROM g6 UNION ALL SELECT * FROM g7 UNION ALL SELECT * FROM g8
),
fix_plan AS (
  SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY rule_order) AS BIGINT) AS fix_no,
         rule, priority, title, description, prompt, affected, verification
  FROM fix_rules
),
fix_file_rows AS (
  SELECT f.repo_id, f.fix_no, d.group_rank, d.path FROM fix_plan f JOIN (
    SELECT d.repo_id, d.kind_rank AS group_rank, m.path FROM dup_ranked d
    JOIN exact_members m ON m.repo_id = d.repo_id AND m.md5 = d.group_key WHERE d.is_exact AND d.kind_rank <= 3
    UNION ALL SELECT repo_id, kind_rank + 3, unnest([file_1, file_2]) FROM dup_ranked WHERE NOT is_exact AND kind_rank <= 2) d
  ON d.repo_id = f.repo_id WHERE f.rule = 'duplicates'
),
fix_headers AS (
  SELECT m.repo_id, m.health_score, m.risk_level, count(f.fix_no) AS fixes
  FROM repo_metrics m LEFT JOIN fix_plan f ON f.repo_id = m.repo_id GROUP BY ALL
)"""


def smell_detail_ctes() -> str:
    exempt = qlist(dims.DEAD_CODE_EXEMPT_NAMES)[1:-1]
    ratio = "(f.comment_lines / f.code_lines)"
    imp = "(f.import_count / f.function_count)"
    return f"""
sd_rows AS (
  SELECT f.repo_id, 'excessive_comments' AS smell,
         row_number() OVER (PARTITION BY f.repo_id ORDER BY {ratio} DESC, f.path) AS rank,
         f.path AS subject, {ratio} AS value, f.path || ': ' || {pct1(ratio)} || '% comment lines' AS detail
  FROM file_facts f JOIN smells_wide w ON w.repo_id = f.repo_id
  WHERE f.code_lines > 0 AND {ratio} > {dims.EXCESSIVE_COMMENT_RATIO} AND w.excessive_comments > 0.5
  UNION ALL
  SELECT repo_id, 'verbose_naming', row_number() OVER (PARTITION BY repo_id ORDER BY path, k, start_line),
         name, CAST(length(name) AS DOUBLE), path || ': ' || name
  FROM (SELECT repo_id, path, name, 0 AS k, start_line FROM functions
        UNION ALL SELECT repo_id, path, name, 1, start_line FROM classes)
  WHERE length(name) > {dims.VERBOSE_NAME_LENGTH}
  UNION ALL
  SELECT f.repo_id, 'boilerplate_heavy', row_number() OVER (PARTITION BY f.repo_id ORDER BY f.path),
         f.path, {imp}, f.path || ': ' || {v('f.import_count')} || ' import lines for ' || {v('f.function_count')} || ' functions'
  FROM file_facts f JOIN smells_wide w ON w.repo_id = f.repo_id
  WHERE f.function_count > 0 AND {imp} > {dims.BOILERPLATE_IMPORT_RATIO} AND w.boilerplate_heavy > 0.3
  UNION ALL
  SELECT repo_id, 'dead_code_indicators',
         row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, fpath, fline), name, CAST(n AS DOUBLE),
         {v('n')} || ' definitions of ' || name
  FROM (SELECT repo_id, name, count(*) AS n, arg_min(path, (path, start_line)) AS fpath,
               arg_min(start_line, (path, start_line)) AS fline FROM functions GROUP BY repo_id, name)
  WHERE n > 1 AND name NOT IN ({exempt})
  UNION ALL
  SELECT f.repo_id, 'over_engineering', row_number() OVER (PARTITION BY f.repo_id ORDER BY f.path),
         f.path, CAST(f.class_count AS DOUBLE),
         f.path || ' holds ' || {v('f.class_count')} || ' classes on ' || {v('f.code_lines')} || ' code lines'
  FROM file_facts f JOIN smells_wide w ON w.repo_id = f.repo_id
  WHERE f.class_count > 3 AND f.code_lines < 200 AND w.over_engineering > 0.3
  UNION ALL
  SELECT repo_id, 'missing_error_handling', row_number() OVER (PARTITION BY repo_id ORDER BY function_count DESC, path),
         path, CAST(function_count AS DOUBLE),
         path || ' handles no errors in ' || {v('function_count')} || ' functions'
  FROM file_facts WHERE NOT is_test AND NOT has_error_handling AND function_count > 0
  UNION ALL
  SELECT repo_id, 'copy_paste_artifacts',
         row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, fpath, fline, literal),
         substr(literal, 1, 40), CAST(n AS DOUBLE),
         {v('n')} || ' uses of a literal starting ' || substr(literal, 1, 40)
  FROM (SELECT repo_id, literal, count(*) AS n, arg_min(path, (path, line_no)) AS fpath,
               arg_min(line_no, (path, line_no)) AS fline FROM literals GROUP BY repo_id, literal)
  WHERE n >= {dims.COPY_PASTE_MIN_OCCURRENCES} AND length(literal) > 20
    AND repo_id IN (SELECT repo_id FROM smells_wide WHERE total_literals >= {dims.COPY_PASTE_MIN_TOTAL})
  UNION ALL
  SELECT repo_id, 'inconsistent_patterns', x.k, x.style, CAST(x.n AS DOUBLE), {v('x.n')} || ' names in ' || x.style
  FROM (SELECT repo_id, unnest([{{'k': 1, 'style': 'snake_case', 'n': snake_names}}, {{'k': 2, 'style': 'camelCase', 'n': camel_names}},
               {{'k': 3, 'style': 'PascalCase', 'n': pascal_names}}]) AS x
        FROM smells_wide WHERE snake_names + camel_names + pascal_names >= {dims.INCONSISTENT_MIN_NAMES})
),
smell_details AS (
  SELECT repo_id, smell, CAST(rank AS BIGINT) AS rank, subject, value, detail FROM sd_rows WHERE rank <= 5
)"""
