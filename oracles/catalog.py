"""DuckDB oracle SQL per query name (see ``healthspark/plans/catalog.py``)."""

from __future__ import annotations

from .sql import chain, line_ctes

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


SCAN_COLS = "repo_id, path, extension, language, is_test, size_bytes"
LINE_STATS = "repo_id, path, total_lines, code_lines, comment_lines, blank_lines"

# 2.1 scans ------------------------------------------------------------------
oracle("scan_files", chain("k1") + f"SELECT {SCAN_COLS} FROM scanned")
oracle("path_rules", chain("k1") +
       "SELECT repo_id, path, dir_ignored, file_ignored, extension, language, is_test FROM rules_lang")
oracle("scan_user_ignore", chain("k1", extra_ignores=["core", "Pods"]) + f"SELECT {SCAN_COLS} FROM scanned")
oracle("language_breakdown", chain("k1") +
       "SELECT repo_id, language, count(*) AS files, count_if(is_test) AS test_files, "
       "CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM scanned GROUP BY repo_id, language")

# 2.2 lines -------------------------------------------------------------------
oracle("line_stats", chain("k2", line_ctes()) + f"SELECT {LINE_STATS} FROM file_facts")
oracle("line_stats_code", chain("k1", line_ctes()) + f"SELECT {LINE_STATS} FROM file_facts")
oracle("line_stats_html", chain("k3", line_ctes()) + f"SELECT {LINE_STATS} FROM file_facts")
oracle("line_kinds", chain("k1", line_ctes()) +
       "SELECT repo_id, path, line_no, kind, s AS stripped FROM lines4")
oracle("todos", chain("k1", line_ctes()) + "SELECT repo_id, path, line_no, content FROM todos")
oracle("imports", chain("k1", line_ctes()) + "SELECT repo_id, path, line_no, text FROM imports")
oracle("string_literals", chain("k1", line_ctes()) + "SELECT repo_id, path, line_no, literal FROM literals")
oracle("string_literals_html", chain("k3", line_ctes()) +
       "SELECT repo_id, path, line_no, literal FROM literals")
oracle("error_handling", chain("k1", line_ctes()) + "SELECT repo_id, path, has_error_handling FROM file_facts")
oracle("branch_lines", chain("k1", line_ctes()) + "SELECT repo_id, path, branch_lines FROM file_facts")

# 2.3 structure -----------------------------------------------------------------
oracle("functions", chain("k1", line_ctes()) +
       "SELECT repo_id, path, language, is_test, name, start_line, end_line, line_count, "
       "is_sensitive, is_long FROM functions")
oracle("classes", chain("k1", line_ctes()) +
       "SELECT repo_id, path, language, is_test, name, start_line, end_line, method_count FROM classes")
oracle("sensitive_functions", chain("k1", line_ctes()) +
       "SELECT repo_id, path, name, start_line FROM functions WHERE is_sensitive")
oracle("long_functions", chain("k1", line_ctes()) +
       "SELECT repo_id, path, name, start_line, line_count FROM functions WHERE is_long")
oracle("file_facts", chain("k1", line_ctes()) + "SELECT * FROM file_facts")
for chunked in ("file_facts", "functions", "classes"):  # chunks change nothing
    oracle(f"{chunked}_chunked", ORACLES[chunked])
# a tree on disk: files of every thirteenth size end in a NUL byte and are not analysed
NO_NUL = "size_bytes % 13 <> 0"
oracle("tree_file_facts", chain("k1", line_ctes()) + f"SELECT * FROM file_facts WHERE {NO_NUL}")
oracle("tree_functions_chunked", chain("k1", line_ctes()) + f"""
SELECT x.repo_id, x.path, x.language, x.is_test, x.name, x.start_line, x.end_line, x.line_count, x.is_sensitive, x.is_long
FROM functions x JOIN file_facts f ON f.repo_id = x.repo_id AND f.path = x.path WHERE {NO_NUL}""")
oracle("tree_scan", chain("k1") + f"SELECT {SCAN_COLS.replace('size_bytes', 'size_bytes + (size_bytes % 13 = 0)::BIGINT AS size_bytes')} FROM scanned")
oracle("file_facts_docs", chain("k2", line_ctes()) + "SELECT * FROM file_facts")
oracle("feature_counts", chain("k1", line_ctes()) +
       "SELECT repo_id, CAST(sum(feature_count) AS BIGINT) AS feature_count FROM file_facts GROUP BY repo_id")

# 2.4 duplicates -------------------------------------------------------------------
from .sql import dup_ctes, metric_ctes, smell_ctes  # noqa: E402

K1_ALL = chain("k1", line_ctes(), smell_ctes(), dup_ctes(), metric_ctes())
oracle("exact_duplicates", chain("k1", line_ctes(), dup_ctes()) +
       "SELECT repo_id, md5, first_path, n_files, path FROM exact_members")
oracle("exact_duplicates_docs", chain("k2one", line_ctes(), dup_ctes()) +
       "SELECT repo_id, md5, first_path, n_files, path FROM exact_members")
oracle("near_duplicates", chain("k1", line_ctes(), dup_ctes()) +
       "SELECT repo_id, language, path1, path2, line_sim, func_sim, class_sim, similarity FROM near")
oracle("all_duplicates", chain("k1", line_ctes(), dup_ctes()) +
       "SELECT repo_id, is_exact, similarity, file_1, file_2, CAST(n_files AS BIGINT) AS n_files, group_key, "
       "CAST(kind_order AS BIGINT) AS kind_order, CAST(sim_order AS DOUBLE) AS sim_order, lang_order FROM all_dups")
oracle("duplicate_summary", chain("k1", line_ctes(), dup_ctes()) + "SELECT * FROM dup_counts")
oracle("duplicate_summary_low", chain("k1", line_ctes(), dup_ctes(0.25)) + "SELECT * FROM dup_counts")
oracle("duplicate_summary_all", chain("k1", line_ctes(), dup_ctes(0.0)) + "SELECT * FROM dup_counts")
LINKS = """
SELECT e.repo_id, e.language, e.path, e.code_lines, count(n.path) AS n_links FROM eligible e LEFT JOIN (
  SELECT repo_id, path1 AS path FROM near UNION ALL SELECT repo_id, path2 FROM near) n
ON n.repo_id = e.repo_id AND n.path = e.path GROUP BY ALL"""
oracle("near_links", chain("k1", line_ctes(), dup_ctes()) + LINKS)
oracle("near_links_low", chain("k1", line_ctes(), dup_ctes(0.25)) + LINKS)
oracle("duplicate_ranks", chain("k1", line_ctes(), dup_ctes()) + """
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY kind_order, sim_order, lang_order, file_1, file_2) AS group_rank,
  is_exact, similarity, file_1, file_2, CAST(n_files AS BIGINT) AS n_files FROM all_dups""")
oracle("near_signature_pairs", chain("k1", line_ctes(), dup_ctes()) + "SELECT * FROM sig_pairs")
oracle("duplicate_members", chain("k1", line_ctes(), dup_ctes()) + "SELECT * FROM dup_member_rows")
oracle("near_pairs_top10", chain("k1", line_ctes(), dup_ctes()) + """
SELECT * FROM (
  SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY sim_order, lang_order, file_1, file_2) AS rank,
         file_1, file_2, similarity FROM all_dups WHERE NOT is_exact) WHERE rank <= 10""")

# 2.5 smells ------------------------------------------------------------------------
oracle("smell_inputs", chain("k1", line_ctes(), smell_ctes()) + "SELECT * FROM smell_inputs")
oracle("smell_scores", chain("k1", line_ctes(), smell_ctes()) +
       "SELECT repo_id, smell, CAST(ordinal AS BIGINT) AS ordinal, score FROM smells_long")
from .sql import smell_result_sql  # noqa: E402

oracle("smell_results", chain("k1", line_ctes(), smell_ctes()) + smell_result_sql())
oracle("smell_scores_html", chain("k3", line_ctes(), smell_ctes()) +
       "SELECT repo_id, smell, CAST(ordinal AS BIGINT) AS ordinal, score FROM smells_long")

# 2.6 metrics -------------------------------------------------------------------------
PENALTIES = ("penalty_tests, penalty_smells, penalty_duplicates, penalty_long_functions, "
             "penalty_error_handling, penalty_todos, penalty_class_density")
oracle("language_stats", chain("k1", line_ctes()) + """
SELECT s.repo_id, s.language, count(*) AS files, count_if(s.is_test) AS test_files,
       CAST(coalesce(max(l.lines), 0) AS BIGINT) AS lines
FROM scanned s LEFT JOIN (SELECT repo_id, language, sum(code_lines) AS lines FROM file_facts
                          GROUP BY repo_id, language) l
  ON l.repo_id = s.repo_id AND l.language = s.language
GROUP BY s.repo_id, s.language""")
oracle("repo_metrics", K1_ALL + "SELECT * FROM repo_metrics")
oracle("repo_metrics_user_ignore", chain("k1", line_ctes(), smell_ctes(), dup_ctes(), metric_ctes(), extra_ignores=["src"])
       + "SELECT * FROM repo_metrics")
oracle("repo_metrics_docs", chain("k2", line_ctes(), smell_ctes(), dup_ctes(), metric_ctes())
       + "SELECT * FROM repo_metrics")
oracle("health_score", K1_ALL + f"SELECT repo_id, {PENALTIES}, health_score, risk_level FROM repo_metrics")
oracle("defect_estimate", K1_ALL + "SELECT repo_id, source_loc, defect_density, estimated_defects FROM repo_metrics")
oracle("feature_interactions", K1_ALL + "SELECT repo_id, feature_count, feature_interactions FROM repo_metrics")
oracle("sensitive_unhandled", chain("k1", line_ctes()) + """
SELECT fn.repo_id, fn.path, fn.name, fn.start_line, fn.end_line FROM functions fn
JOIN file_facts ff ON ff.repo_id = fn.repo_id AND ff.path = fn.path
WHERE fn.is_sensitive AND NOT ff.has_error_handling""")
oracle("functions_by_file", chain("k1", line_ctes()) +
       "SELECT repo_id, path, count(*) AS function_count, string_agg(name, ',' ORDER BY start_line) AS names "
       "FROM functions GROUP BY repo_id, path")
oracle("repo_summary", K1_ALL + """
SELECT repo_id, total_files, source_files, test_files, source_loc, test_loc, test_to_code_ratio,
  total_functions, total_classes, feature_count, feature_interactions, estimated_defects, health_score,
  risk_level, duplicate_groups, todos_count, long_functions, smell_scores, languages
FROM repo_metrics LEFT JOIN (
  SELECT repo_id, string_agg(smell || '=' || CAST(floor(score * 1000 + 0.5) AS BIGINT), ',' ORDER BY ordinal) AS smell_scores
  FROM smells_long GROUP BY repo_id) USING (repo_id) LEFT JOIN (
  SELECT repo_id, string_agg(language || '=' || n, ',' ORDER BY language) AS languages
  FROM (SELECT repo_id, language, count(*) AS n FROM scanned GROUP BY ALL) GROUP BY repo_id) USING (repo_id)""")

# 2.7 fix plan ------------------------------------------------------------------------
from .sql import fix_ctes  # noqa: E402

K1_FIX = chain("k1", line_ctes(), smell_ctes(), dup_ctes(), metric_ctes(), fix_ctes())
oracle("fix_plan", K1_FIX + "SELECT * FROM fix_plan")
oracle("fix_plan_docs", chain("k2", line_ctes(), smell_ctes(), dup_ctes(), metric_ctes(), fix_ctes())
       + "SELECT * FROM fix_plan")
oracle("fix_files", K1_FIX + "SELECT * FROM fix_file_rows")
oracle("fix_plans", K1_FIX + "SELECT * FROM fix_headers")
oracle("fix_plan_one_repo", chain("k1one", line_ctes(), smell_ctes(), dup_ctes(), metric_ctes(), fix_ctes())
       + "SELECT * FROM fix_plan")
oracle("fix_priority_counts", K1_FIX + "SELECT repo_id, priority, count(*) AS fixes FROM fix_plan GROUP BY ALL")

# 2.8 renderings, 2.9 report tables ---------------------------------------------------------
from .sql import NL, NL2, v  # noqa: E402

K1_MET = chain("k1", line_ctes(), smell_ctes(), dup_ctes(), metric_ctes())
oracle("report_summary", K1_MET + """
SELECT repo_id, health_score, risk_level, total_files, source_files, test_files, source_loc + test_loc AS total_loc,
       source_loc, test_loc, test_to_code_ratio, estimated_defects FROM repo_metrics""")
oracle("report_files", chain("k1", line_ctes()) + """
SELECT f.repo_id, f.path, f.language, f.total_lines AS lines, f.code_lines, f.comment_lines, f.complexity,
       f.function_count AS functions, f.class_count AS classes, f.todo_count AS todos,
       CAST(coalesce(s.sens, 0) AS BIGINT) AS sensitive_functions, CAST(coalesce(s.lng, 0) AS BIGINT) AS long_functions
FROM file_facts f LEFT JOIN (SELECT repo_id, path, count_if(is_sensitive) AS sens, count_if(is_long) AS lng
                             FROM functions GROUP BY repo_id, path) s
  ON s.repo_id = f.repo_id AND s.path = f.path""")
oracle("report_issues", chain("k1", line_ctes()) + """
SELECT repo_id, 'todo' AS kind, path, line_no AS line, CAST(NULL AS VARCHAR) AS name, content AS value FROM todos
UNION ALL SELECT repo_id, 'sensitive_function', path, start_line, name, CAST(NULL AS VARCHAR) FROM functions WHERE is_sensitive
UNION ALL SELECT repo_id, 'long_function', path, start_line, name, CAST(line_count AS VARCHAR) FROM functions WHERE is_long""")
oracle("complex_files", chain("k1", line_ctes()) +
       """SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, path) AS rank, path, complexity, score
FROM (SELECT *, CAST(format('{:.1f}', complexity) AS DOUBLE) AS score FROM file_facts WHERE complexity > 10)""")
oracle("language_share", chain("k1", line_ctes()) + """,
ls AS (
  SELECT s.repo_id, s.language, coalesce(max(l.lines), 0) AS lines
  FROM scanned s LEFT JOIN (SELECT repo_id, language, sum(code_lines) AS lines FROM file_facts GROUP BY ALL) l
    ON l.repo_id = s.repo_id AND l.language = s.language GROUP BY s.repo_id, s.language
),
lt AS (SELECT *, sum(lines) OVER (PARTITION BY repo_id) AS total,
              row_number() OVER (PARTITION BY repo_id ORDER BY lines DESC, language) AS rank FROM ls)
SELECT repo_id, CAST(rank AS BIGINT) AS rank, language, CAST(lines AS BIGINT) AS lines,
       lines / total * CAST(100.0 AS DOUBLE) AS percent
FROM lt WHERE total > 0 AND rank <= 10""".replace("WITH ", "WITH ", 1))
oracle("smell_ranking", chain("k1", line_ctes(), smell_ctes()) + """
SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, ordinal) AS BIGINT) AS rank,
       smell, score, CASE WHEN score < 0.3 THEN 'ok' WHEN score < 0.6 THEN 'warn' ELSE 'danger' END AS severity
FROM smells_long""")
oracle("coverage_label", K1_MET + """
SELECT repo_id, test_to_code_ratio * CAST(100.0 AS DOUBLE) AS test_ratio_percent,
       CASE WHEN test_to_code_ratio * CAST(100.0 AS DOUBLE) >= 80 THEN 'good'
            WHEN test_to_code_ratio * CAST(100.0 AS DOUBLE) >= 50 THEN 'low' ELSE 'critical' END AS coverage_label
FROM repo_metrics""")
oracle("metric_cards", K1_MET + """
SELECT repo_id, source_loc, source_files, test_to_code_ratio, test_loc, test_files, estimated_defects,
       defect_density, feature_count, feature_interactions, total_functions, total_classes, todos_count
FROM repo_metrics""")
oracle("top_duplicates", chain("k1", line_ctes(), dup_ctes()) + """
SELECT * FROM (
  SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY kind_order, sim_order, lang_order,
         file_1, file_2) AS BIGINT) AS group_rank, is_exact, similarity, file_1, file_2,
         CAST(n_files AS BIGINT) AS n_files FROM all_dups) WHERE group_rank <= 10""")
oracle("top_fixes", K1_FIX + """
SELECT f.repo_id, f.fix_no, f.priority, f.title, m.fix_smells AS smells_over_half
FROM fix_plan f JOIN repo_metrics m ON m.repo_id = f.repo_id WHERE f.fix_no <= 3""")
oracle("render_notes", K1_FIX + f"""
, notes AS (
  SELECT repo_id, string_agg('- ' || title || ' (' || lower(priority) || '). ' || split_part(description, '.', 1) || '.', {NL} ORDER BY fix_no) AS body
  FROM fix_plan WHERE fix_no <= 5 GROUP BY repo_id
)
SELECT m.repo_id, '## State of the code' || {NL2} || 'Score ' || {v('m.health_score')} || ' of 100, risk '
       || m.risk_level || '. Most pressing:' || {NL2} || coalesce(n.body, '- Nothing urgent was found') AS notes
FROM repo_metrics m LEFT JOIN notes n ON n.repo_id = m.repo_id""")
oracle("render_rules", K1_FIX + f"""
, rl AS (
  SELECT repo_id, string_agg(CASE WHEN priority = 'CRITICAL' THEN '- First of all: ' || lower(title)
                                  WHEN priority = 'HIGH' THEN '- Ahead of new work: ' || lower(title)
                                  ELSE '- When there is time: ' || lower(title) END, {NL} ORDER BY fix_no) AS body
  FROM fix_plan WHERE fix_no <= 5 GROUP BY repo_id
)
SELECT m.repo_id, '# Working rules (score ' || {v('m.health_score')} || ' of 100, risk ' || m.risk_level || ')' || {NL2}
  || '## From the fix plan' || {NL2} || coalesce(r.body, '') || {NL2} || '## At all times' || {NL2}
  || CASE WHEN m.health_score < 60
          THEN '- Hold new features back while the list above is open' || {NL} || '- Give each new function a test and a way to fail'
          ELSE '- Let tests come in the same change as the code' || {NL} || '- One job per function' END
  || {NL} || '- Look for existing code before adding a file' AS rules
FROM repo_metrics m LEFT JOIN rl r ON r.repo_id = m.repo_id""")
oracle("render_markdown", K1_FIX + f"""
, fx AS (
  SELECT *, CASE WHEN coalesce(affected, '') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(affected, {NL}) END AS aff
  FROM fix_plan
),
blocks AS (
  SELECT repo_id, string_agg(
    '## ' || CASE priority WHEN 'CRITICAL' THEN '[!!]' WHEN 'HIGH' THEN '[!]' WHEN 'MEDIUM' THEN '[~]' ELSE '[.]' END
    || ' ' || priority || ': ' || title || {NL2} || description || {NL2}
    || CASE WHEN len(aff) > 0 THEN 'Affected files:' || {NL}
            || array_to_string(list_transform(aff[1:5], lambda p: '- `' || p || '`'), {NL})
            || CASE WHEN len(aff) > 5 THEN {NL} || '- ... and ' || {v('len(aff) - 5')} || ' more' ELSE '' END
            || {NL2} ELSE '' END
    || '### Prompt ' || {v('fix_no')} || ': ' || title || {NL} || '```' || {NL} || prompt || {NL} || '```' || {NL2}
    || 'Verification: ' || verification || {NL2} || '---' || {NL}, {NL} ORDER BY fix_no) AS body
  FROM fx GROUP BY repo_id
)
SELECT m.repo_id, '# Fix instructions' || {NL} || '> Repository: ' || m.repo_id || ' | Health score: '
  || {v('m.health_score')} || '/100 (' || m.risk_level || ' risk)' || {NL2}
  || coalesce(b.body, 'No fixes needed: the code base looks healthy.' || {NL}) AS markdown
FROM repo_metrics m LEFT JOIN blocks b ON b.repo_id = m.repo_id""")

# 2.5 smell evidence -------------------------------------------------------------------
from .sql import smell_detail_ctes  # noqa: E402

oracle("smell_details", chain("k1", line_ctes(), smell_ctes(), smell_detail_ctes()) + "SELECT * FROM smell_details")
oracle("smell_details_html", chain("k3", line_ctes(), smell_ctes(), smell_detail_ctes()) + "SELECT * FROM smell_details")
oracle("content_hash", chain("k2", line_ctes()) + "SELECT repo_id, path, md5, size_bytes FROM file_facts")

# the bounded JSON document: the same text, built piece by piece
_num = "CAST(floor(({0}) * CAST(1000.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)"
oracle("report_json", K1_MET + f""",
lg AS (
  SELECT repo_id, string_agg('"' || language || '":{{"files":' || files || ',"lines":' || lines || ',"test_files":' || tests || '}}', ',' ORDER BY language) AS t
  FROM (SELECT s.repo_id, s.language, count(*) AS files, count_if(s.is_test) AS tests, CAST(coalesce(max(l.lines), 0) AS BIGINT) AS lines
        FROM scanned s LEFT JOIN (SELECT repo_id, language, sum(code_lines) AS lines FROM file_facts GROUP BY ALL) l
          ON l.repo_id = s.repo_id AND l.language = s.language GROUP BY s.repo_id, s.language) GROUP BY repo_id
),
sm AS (
  SELECT repo_id, string_agg('"' || smell || '":' || {_num.format("score")}, ',' ORDER BY smell) AS t FROM smells_long GROUP BY repo_id
),
fl AS (SELECT repo_id, count(*) AS n FROM file_facts GROUP BY repo_id),
iss AS (
  SELECT repo_id, sum(todo_count) AS todos, any_value(0) AS z FROM file_facts GROUP BY repo_id
),
fi AS (SELECT repo_id, count_if(is_sensitive) AS s, count_if(is_long) AS l FROM functions GROUP BY repo_id)
SELECT m.repo_id, '{{"meta":{{"tool":"healthspark","repository":"' || m.repo_id || '"}},"summary":{{"health_score":' || health_score
  || ',"risk_level":"' || risk_level || '","total_files":' || total_files || ',"source_files":' || source_files || ',"test_files":' || test_files
  || ',"total_loc":' || (source_loc + test_loc) || ',"source_loc":' || source_loc || ',"test_loc":' || test_loc
  || ',"test_to_code_per_mille":' || {_num.format("test_to_code_ratio")} || ',"estimated_defects":' || estimated_defects || '}},"languages":{{'
  || coalesce(lg.t, '') || '}},"smell_scores_per_mille":{{' || coalesce(sm.t, '') || '}},"files":' || coalesce(fl.n, 0)
  || ',"issues":{{"todo":' || coalesce(iss.todos, 0) || ',"sensitive_function":' || coalesce(fi.s, 0) || ',"long_function":' || coalesce(fi.l, 0) || '}}}}' AS json
FROM repo_metrics m LEFT JOIN lg ON lg.repo_id = m.repo_id LEFT JOIN sm ON sm.repo_id = m.repo_id
LEFT JOIN fl ON fl.repo_id = m.repo_id LEFT JOIN iss ON iss.repo_id = m.repo_id LEFT JOIN fi ON fi.repo_id = m.repo_id""")

# the documents' lists, part by part: the first part of each repository is its header
oracle("report_document", chain("k1", line_ctes()) + """,
counts AS (SELECT f.repo_id, f.path, count(CASE WHEN x.is_sensitive THEN 1 END) AS sens, count(CASE WHEN x.is_long THEN 1 END) AS lng
  FROM file_facts f LEFT JOIN functions x ON x.repo_id = f.repo_id AND x.path = f.path GROUP BY f.repo_id, f.path),
scored AS (SELECT *, CAST(format('{:.1f}', complexity) AS DECIMAL(20,1)) AS score FROM file_facts),
rows_ AS (
  SELECT r.repo_id, u.section, 0 AS item, 0.0::DOUBLE AS o, '' AS path, 0::BIGINT AS line, u.text
  FROM (SELECT DISTINCT repo_id FROM corpus) r, (VALUES (0, ''), (1, ',"files":['), (2, '],"issues":{"complex_files":['),
    (3, '],"long_functions":['), (4, '],"sensitive_functions":['), (5, '],"todos":['), (6, ']}}')) u(section, text)
  UNION ALL
  SELECT f.repo_id, 1, 1, 0.0, f.path, 0, to_json({'path': f.path, 'language': f.language, 'lines': f.total_lines,
    'code_lines': f.code_lines, 'comment_lines': f.comment_lines, 'complexity': f.score, 'functions': f.function_count,
    'classes': f.class_count, 'issues': {'todos': f.todo_count, 'sensitive_functions': c.sens, 'long_functions': c.lng}})::VARCHAR
  FROM scored f JOIN counts c ON c.repo_id = f.repo_id AND c.path = f.path
  UNION ALL
  SELECT repo_id, 2, 1, -score, path, 0, to_json({'file': path, 'score': score})::VARCHAR FROM scored WHERE complexity > 10
  UNION ALL
  SELECT repo_id, 3, 1, 0.0, path, start_line, to_json({'file': path, 'name': name, 'lines': line_count})::VARCHAR
  FROM functions WHERE is_long
  UNION ALL
  SELECT repo_id, 4, 1, 0.0, path, start_line, to_json({'file': path, 'name': name, 'line': start_line})::VARCHAR
  FROM functions WHERE is_sensitive
  UNION ALL
  SELECT repo_id, 5, 1, 0.0, path, line_no, to_json({'file': path, 'line': line_no, 'content': content})::VARCHAR FROM todos),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY section, item, o, path, line, text) AS part,
    row_number() OVER (PARTITION BY repo_id, section, item ORDER BY o, path, line, text) AS k FROM rows_)
SELECT repo_id, CAST(section AS BIGINT) AS section, part, CASE WHEN item = 1 AND k > 1 THEN ',' ELSE '' END || text AS text
FROM placed WHERE section > 0""")
