"""Test corpora built from the driver's tables.

The driver tables hold no source code, so three corpora are derived from them.
Each builder only produces rows of the corpus schema ``(repo_id, path, content)``;
all analysis happens later in the library's operators, which do not know how
the rows were made.

* **K1 "code"** (``lineitem``): one line of code per lineitem row, grouped into
  files by part key, with line templates for eighteen languages. The line-level
  recipe is one SQL text that Spark and DuckDB both accept verbatim, so the
  DuckDB oracle rebuilds the identical corpus.
* **K2 "documents as Markdown"** (``documents``): repo = source,
  path = ``<lang>/doc_<id>.md``, content = text (Unicode prose).
* **K3 "pages as HTML"** (``pages``): repo = first label of the host,
  path = ``<page_id>.html``, content = html.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Portable SQL (Spark SQL and DuckDB): one row per line of the K1 corpus. Every lineitem row is a line
# of the file named by its part key; some files have copies under names of their own (one group
# of 25), some an empty file beside them.
# Placeholders: {lineitem} = the lineitem relation, {copies} = the copies of a line.
K1_LINES_SQL = '''
WITH src AS (
  SELECT CASE WHEN l_partkey % 40 < 5 THEN l_partkey - l_partkey % 40 ELSE l_partkey END AS src,
         l_partkey AS p, l_orderkey AS o, CAST(l_linenumber AS BIGINT) AS ln,
         l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q
  FROM {lineitem}
),
files AS (
  SELECT *,
         CAST(FLOOR(src / 10) AS BIGINT) AS block,
         ROW_NUMBER() OVER (PARTITION BY src ORDER BY p, o, ln, s, q) AS line_no,
         (o * 7 + ln * 3 + s) % 24 AS k,
         (s + ln * 5 + o % 7) % 6 AS nk,
         CAST(o % 13 AS VARCHAR(20)) AS v,
         CASE WHEN src % 97 = 0 THEN -1 ELSE 0 END AS first_copy,
         CASE WHEN src % 500 = 170 THEN 24 WHEN src % 400 = 130 THEN 2
              WHEN src % 200 IN (130, 150, 170, 190) THEN 1 ELSE 0 END AS last_copy
  FROM src
),
numbered AS (
  SELECT src, src + copy AS fid, copy, o, ln, s, q, block, line_no, k, nk, v FROM files {copies}
),
typed AS (
  SELECT *,
    CASE (src * 5 + block) % 20
      WHEN 0 THEN 'py' WHEN 1 THEN 'py' WHEN 2 THEN 'py' WHEN 3 THEN 'js'
      WHEN 4 THEN 'ts' WHEN 5 THEN 'go' WHEN 6 THEN 'java' WHEN 7 THEN 'rb'
      WHEN 8 THEN 'rs' WHEN 9 THEN 'md' WHEN 10 THEN 'R' WHEN 11 THEN 'kt'
      WHEN 12 THEN 'swift' WHEN 13 THEN 'cs' WHEN 14 THEN 'php' WHEN 15 THEN 'dart'
      WHEN 16 THEN 'c' WHEN 17 THEN 'cpp' WHEN 18 THEN 'sh' ELSE 'dat' END AS lang,
    CASE WHEN ln % 2 = 0 THEN '    ' ELSE '' END AS ind,
    CASE nk
      WHEN 0 THEN 'load_data_' || v
      WHEN 1 THEN 'fetchItem' || v
      WHEN 2 THEN 'BuildItem' || v
      WHEN 3 THEN 'verify_token_' || v
      WHEN 4 THEN 'compute_total_' || v
      ELSE 'handle_incoming_request_with_retry_policy_' || v END AS fname,
    CASE WHEN o % 9 = 0 THEN 'AbstractRepositoryConnectionFactoryBean' || v
         ELSE 'Model' || CAST(o % 11 AS VARCHAR(20)) END AS cname,
    CASE WHEN src % 40 = 0 AND (o * 7 + ln * 3 + s) % 24 IN (7, 8) THEN 1 ELSE 0 END AS long_file_header,
    CAST(block % 20 AS BIGINT) AS repo_no
  FROM numbered
),
lines AS (
  SELECT src, fid, copy, block, repo_no, lang, line_no,
    CASE
      WHEN k IN (0, 1) THEN CASE WHEN o % 3 = 0 THEN '   ' ELSE '' END
      WHEN k = 2 THEN ind || CASE WHEN lang IN ('py', 'rb', 'md', 'R', 'sh', 'dat') THEN '# ' ELSE '// ' END
                      || 'note about step ' || CAST(o AS VARCHAR(20))
      WHEN k = 3 AND repo_no % 4 <> 1 THEN ind
                      || CASE WHEN lang IN ('py', 'rb', 'md', 'R', 'sh', 'dat') THEN '# ' ELSE '// ' END
                      || CASE o % 5 WHEN 0 THEN 'TODO: ' WHEN 1 THEN 'FIXME ' WHEN 2 THEN 'hack: '
                                    WHEN 3 THEN 'XXX ' ELSE 'Bug: ' END
                      || 'revisit case ' || CAST(q AS VARCHAR(20))
      WHEN k = 4 THEN CASE lang
                      WHEN 'py' THEN ind || '"""Summary of block ' || CAST(o % 50 AS VARCHAR(20))
                      WHEN 'rb' THEN '=begin'
                      WHEN 'md' THEN '<!-- remark ' || v
                      WHEN 'R' THEN '# section ' || v
                      WHEN 'dat' THEN 'record ' || v
                      WHEN 'sh' THEN '# section ' || v
                      ELSE ind || '/* begin notes ' || v END
      WHEN k = 5 THEN CASE lang
                      WHEN 'py' THEN ind || 'end of docstring"""'
                      WHEN 'rb' THEN '=end'
                      WHEN 'md' THEN 'closing remark -->'
                      WHEN 'R' THEN 'x <- 1'
                      WHEN 'dat' THEN 'record end'
                      WHEN 'sh' THEN 'x=1'
                      ELSE ind || 'end notes */' END
      WHEN k = 6 THEN CASE lang
                      WHEN 'py' THEN CASE WHEN s % 2 = 0 THEN 'import os'
                                          ELSE 'from pkg' || CAST(s % 5 AS VARCHAR(20)) || ' import helper' END
                      WHEN 'js' THEN CASE WHEN s % 2 = 0 THEN 'import lib from "lib"'
                                          ELSE 'const lib' || v || ' = require("lib");' END
                      WHEN 'ts' THEN 'import { thing } from "./thing";'
                      WHEN 'go' THEN 'import "fmt"'
                      WHEN 'java' THEN 'import java.util.List;'
                      WHEN 'rb' THEN 'require "json"'
                      WHEN 'rs' THEN 'use std::io;'
                      WHEN 'kt' THEN 'import kotlin.math.max'
                      WHEN 'swift' THEN 'import Foundation'
                      WHEN 'cs' THEN 'using System.Text;'
                      WHEN 'php' THEN CASE WHEN s % 2 = 0 THEN 'use App;' ELSE 'require "boot.php";' END
                      WHEN 'dart' THEN 'import "dart:io";'
                      WHEN 'c' THEN '#include <stdio.h>'
                      WHEN 'cpp' THEN '#include <vector>'
                      WHEN 'sh' THEN 'source ./lib.sh'
                      ELSE 'library(stats)' END
      WHEN k IN (7, 8) AND (long_file_header = 0 OR line_no <= 5) THEN CASE lang
                      WHEN 'py' THEN CASE WHEN o % 4 = 0 THEN 'async def ' ELSE 'def ' END || fname || '(arg):'
                      WHEN 'js' THEN CASE WHEN o % 3 = 0 THEN 'const ' || fname || ' = (a, b) => {'
                                          ELSE 'function ' || fname || '(a, b) {' END
                      WHEN 'ts' THEN 'function ' || fname || '(a: number): number {'
                      WHEN 'go' THEN 'func ' || fname || '(a int) int {'
                      WHEN 'java' THEN '    public static int ' || fname || '(int a) {'
                      WHEN 'rb' THEN 'def ' || fname
                      WHEN 'rs' THEN 'pub fn ' || fname || '(a: i32) -> i32 {'
                      WHEN 'kt' THEN CASE WHEN o % 4 = 0 THEN 'suspend fun ' ELSE 'fun ' END || fname || '(a: Int): Int {'
                      WHEN 'swift' THEN CASE WHEN o % 4 = 0 THEN '    static func ' ELSE 'func ' END || fname || '(a: Int) -> Int {'
                      WHEN 'cs' THEN '    public async Task ' || fname || '(int a) {'
                      WHEN 'php' THEN CASE WHEN o % 4 = 0 THEN '    private static function ' ELSE 'function ' END || fname || '($a) {'
                      WHEN 'dart' THEN CASE WHEN o % 4 = 0 THEN 'void ' ELSE '' END || fname || '(int a) async {'
                      WHEN 'c' THEN 'int ' || fname || '(int a) {'
                      WHEN 'cpp' THEN 'int ' || fname || '(int a) {'
                      WHEN 'sh' THEN fname || '() {'
                      ELSE fname || ' <- function(x) {' END
      WHEN k = 9 AND o % 3 = 0 THEN CASE lang
                      WHEN 'py' THEN 'class ' || cname || ':'
                      WHEN 'js' THEN 'class ' || cname || ' {'
                      WHEN 'ts' THEN 'export class ' || cname || ' {'
                      WHEN 'go' THEN 'type ' || cname || ' struct {'
                      WHEN 'java' THEN 'public class ' || cname || ' {'
                      WHEN 'rb' THEN 'class ' || cname
                      WHEN 'rs' THEN 'pub struct ' || cname || ' {'
                      WHEN 'kt' THEN CASE WHEN o % 2 = 0 THEN 'data class ' ELSE 'class ' END || cname || '(val a: Int)'
                      WHEN 'swift' THEN CASE WHEN o % 2 = 0 THEN 'struct ' ELSE 'class ' END || cname || ' {'
                      WHEN 'cs' THEN 'public partial class ' || cname || ' {'
                      WHEN 'php' THEN 'class ' || cname || ' {'
                      WHEN 'dart' THEN 'class ' || cname || ' {'
                      WHEN 'cpp' THEN 'class ' || cname || ' {'
                      ELSE 'setClass("' || cname || '")' END
      WHEN k = 10 THEN ind || CASE
                      WHEN lang IN ('py') THEN CASE o % 3 WHEN 0 THEN 'if value > ' || CAST(q AS VARCHAR(20)) || ':'
                                                           WHEN 1 THEN 'for item in items:' ELSE 'elif ready:' END
                      WHEN lang IN ('rb', 'R', 'md', 'sh', 'dat') THEN 'if value > ' || CAST(q AS VARCHAR(20))
                      ELSE CASE o % 3 WHEN 0 THEN 'if (value > ' || CAST(q AS VARCHAR(20)) || ') {'
                                      WHEN 1 THEN 'while (running) {' ELSE 'switch (mode) {' END END
      WHEN k = 11 AND (s + ln) % 3 = 0 THEN ind || CASE lang
                      WHEN 'py' THEN CASE WHEN o % 2 = 0 THEN 'try:' ELSE 'except ValueError:' END
                      WHEN 'js' THEN CASE WHEN o % 2 = 0 THEN 'try {' ELSE 'promise.catch(onError);' END
                      WHEN 'ts' THEN 'try {'
                      WHEN 'go' THEN 'if err != nil {'
                      WHEN 'java' THEN CASE WHEN o % 2 = 0 THEN 'try {' ELSE 'catch (Exception e) {' END
                      WHEN 'rb' THEN 'rescue StandardError'
                      WHEN 'rs' THEN 'let v = parse(x)?;'
                      WHEN 'kt' THEN CASE WHEN o % 2 = 0 THEN 'try {' ELSE 'catch (e: Exception) {' END
                      WHEN 'swift' THEN CASE WHEN o % 2 = 0 THEN 'do {' ELSE 'catch let error {' END
                      WHEN 'cs' THEN CASE WHEN o % 2 = 0 THEN 'try {' ELSE 'catch (Exception e) {' END
                      WHEN 'php' THEN 'catch (Exception $e) {'
                      WHEN 'dart' THEN 'try {'
                      WHEN 'c' THEN 'if (errno != 0) {'
                      WHEN 'cpp' THEN 'try {'
                      WHEN 'sh' THEN 'set -e'
                      ELSE 'tryCatch(run())' END
      WHEN k = 12 THEN ind || 'message = "the configured value for step '
                      || CAST(o % 40 AS VARCHAR(20)) || ' was rejected"'
      WHEN k = 13 THEN CASE lang
                      WHEN 'py' THEN '@app.route("/items/' || v || '")'
                      WHEN 'js' THEN 'app.get("/items", handler);'
                      WHEN 'ts' THEN 'router.post("/items", handler);'
                      WHEN 'go' THEN 'http.HandleFunc("/items", handler)'
                      WHEN 'rb' THEN 'get "/items"'
                      WHEN 'php' THEN 'Route::get("/items", "Items@index");'
                      ELSE ind || 'route_' || v || ' = 1' END
      ELSE ind || CASE
                      WHEN lang IN ('js', 'ts', 'rs') THEN 'let value' || CAST(s AS VARCHAR(20)) || ' = ' || CAST(q AS VARCHAR(20)) || ';'
                      WHEN lang = 'go' THEN 'value' || CAST(s AS VARCHAR(20)) || ' := ' || CAST(q AS VARCHAR(20))
                      WHEN lang IN ('java', 'cs', 'c', 'cpp', 'dart') THEN 'int value' || CAST(s AS VARCHAR(20)) || ' = ' || CAST(q AS VARCHAR(20)) || ';'
                      WHEN lang = 'md' THEN 'Plain prose about item ' || CAST(s AS VARCHAR(20))
                      ELSE 'value_' || CAST(s AS VARCHAR(20)) || ' = ' || CAST(q AS VARCHAR(20)) END
    END AS line
  FROM typed
)
SELECT
  'repo_' || CAST(repo_no AS VARCHAR(20)) AS repo_id,
  CASE
    WHEN fid % 31 = 0 THEN 'src/assets.mapping/'
    WHEN fid % 7 = 0 AND repo_no NOT IN (3, 11) THEN 'tests/'
    WHEN fid % 7 = 1 THEN CASE WHEN fid % 2 = 0 THEN 'node_modules/pkg/' ELSE 'lib/.cache/' END
    WHEN fid % 7 = 2 AND repo_no NOT IN (3, 11) THEN 'src/latest_'
    WHEN fid % 7 = 3 THEN 'Pods/'
    WHEN fid % 7 = 4 THEN 'src/core/'
    ELSE 'src/' END
  || CASE WHEN copy < 0 THEN 'empty_' WHEN copy > 0 THEN 'copy_' ELSE 'mod_' END
  || CAST(src AS VARCHAR(20)) || CASE WHEN copy > 0 THEN '_' || CAST(copy AS VARCHAR(20)) ELSE '' END
  || '.' || lang AS path,
  src, copy, line_no,
  CASE WHEN copy < 0 THEN '' ELSE line END AS line,
  CASE WHEN copy < 0 THEN '' WHEN src % 9 = 4 THEN chr(13) || chr(10) ELSE chr(10) END AS sep
FROM lines
'''

#: One row per copy of a line: the only clause that the two dialects write differently.
SPARK_COPIES = "LATERAL VIEW explode(sequence(first_copy, last_copy)) t AS copy"
DUCKDB_COPIES = ", unnest(generate_series(first_copy, last_copy)) AS t(copy)"


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def k1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 line rows: repo_id, path, src, copy, line_no, line, sep. Every lineitem row is a line of copy 0."""
    rel = f"parquet.`{sf_dir.rstrip('/')}/lineitem.parquet`"
    return spark.sql(K1_LINES_SQL.replace("{lineitem}", rel).replace("{copies}", SPARK_COPIES))


def k1_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 corpus (repo_id, path, content, size_bytes): lines joined in line order, each with its separator.

    Builder only: per-file string assembly of the synthetic rows (one row per file is the corpus
    schema); no analysis is done here. One scan and one exchange: lines are numbered per source file,
    and the grouping keys start with the same column.
    """
    lines = F.sort_array(F.collect_list(F.struct("line_no", F.concat("line", "sep").alias("l"))))
    joined = F.array_join(lines["l"], "")
    return (k1_lines(spark, sf_dir).groupBy("src", "copy")
            .agg(F.first("repo_id").alias("repo_id"), F.first("path").alias("path"), joined.alias("content"))
            .select("repo_id", "path", "content", F.octet_length("content").cast("bigint").alias("size_bytes")))


def k1_single_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 as one repository: rules that need a large code base can fire."""
    return k1_corpus(spark, sf_dir).select(
        F.lit("all").alias("repo_id"), F.concat_ws("/", "repo_id", "path").alias("path"), "content", "size_bytes")


def k2_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: documents as Markdown files, one repository per ``source``."""
    d = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return d.select(
        F.col("source").alias("repo_id"),
        F.concat(F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("content")).repartition(_parts(spark), "repo_id", "path")


def k2_single_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2 as one repository (copies across sources become visible to exact-duplicate search)."""
    d = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return d.select(
        F.lit("documents").alias("repo_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"),
                 F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("content")).repartition(_parts(spark), "repo_id", "path")


def k3_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: web pages as HTML files, one repository per first host label."""
    p = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return p.select(
        F.regexp_extract("url", r"^[A-Za-z]+://([^./:]+)", 1).alias("repo_id"),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("content")).repartition(_parts(spark), "repo_id", "path")
