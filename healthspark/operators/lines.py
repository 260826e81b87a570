"""Per-line classification (blank / comment / code) and per-line content checks.

Design: a file is one row, so the lines of a file never need to meet again
after a shuffle. Lines are produced with ``split`` and classified with
higher-order array functions *inside the file's row*: the analysis of a corpus
is a map-only stage (no Exchange), whatever the corpus size or skew between
repositories. Only the line-level child table (:func:`lines`) explodes rows.

Rules reproduced (deliberate heuristics of the original tool, kept as they are):

* blank: the stripped line is empty (also inside a block comment);
* comment: the stripped line contains the block-open or block-close token, or a
  block is open, or it starts with the single-line token. Python's open and
  close token are both triple quotes, so no block is ever entered and docstring
  bodies count as code;
* TODO, import and error checks run on every non-blank line (comments included),
  function and class starts only on code lines.

Every lambda below only references its own arguments and plain per-row columns:
intermediate arrays are zipped in, never looked up from inside a lambda, so each
step is linear in the number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.text import any_match, by_language, first_group, split_lines, strip, u

LINE_TABLES = (dims.IMPORT_PATTERNS, dims.ERROR_PATTERNS, dims.JVM_FUNCTION_PATTERNS, dims.CLASS_PATTERNS)


def _null_str() -> Column:
    return F.lit(None).cast("string")


def comment_tokens(language: Column) -> tuple[Column, Column, Column]:
    """(single-line prefix, block open, block close) for the row's language; NULL = none."""
    single = by_language(language, {k: F.lit(v[0]) for k, v in dims.COMMENT_TOKENS.items()},
                         F.lit(dims.DEFAULT_SINGLE_COMMENT))
    blocks = {k: v for k, v in dims.COMMENT_TOKENS.items() if v[1] is not None}
    opener = by_language(language, {k: F.lit(v[1]) for k, v in blocks.items()}, _null_str())
    closer = by_language(language, {k: F.lit(v[2]) for k, v in blocks.items()}, _null_str())
    return single, opener, closer


def _per_language(language: Column, table: dict[str, list[str]] | dict[int, list[str]], fn, default: Column) -> Column:
    return by_language(language, {k: fn(v) for k, v in table.items() if v}, default)


def with_line_records(files: DataFrame, text_col: str = "text",
                      language_col: str = "language", keep_block: bool = False) -> DataFrame:
    """Add ``_recs``: array<struct> with one classified record per line of the text.

    Record fields: line_no, line, stripped, kind, todo, is_import, has_error,
    literals, is_branch, func_name, class_name.

    With ``keep_block`` also ``_head``, the number of first lines whose state is the one before the text, and
    ``_exit``, the state after it (NULL: as before it).
    """
    language = F.col(language_col)
    single, opener, closer = comment_tokens(language)
    # per-file token columns: lambdas read them as plain values (no CASE per line)
    df = files.withColumn("_single", single).withColumn("_open", opener).withColumn("_close", closer)
    single, opener, closer = F.col("_single"), F.col("_open"), F.col("_close")
    # a number per language, which the choices of a line's patterns compare faster than names
    numbers = {name: i for i, name in enumerate(sorted({n for t in LINE_TABLES for n in t}))}
    df = df.withColumn("_lang", by_language(language, {k: F.lit(v) for k, v in numbers.items()}, F.lit(-1)))

    def per_language(table: dict[str, list[str]], fn, default: Column) -> Column:
        return _per_language(F.col("_lang"), {numbers[k]: v for k, v in table.items()}, fn, default)

    def has_open(x: Column) -> Column:
        return x["open"]

    def has_close(x: Column) -> Column:
        return x["close"]

    df = df.withColumn("_raw", split_lines(F.col(text_col)))
    df = df.withColumn("_base", F.transform("_raw", lambda line: F.struct(
        line.alias("line"), strip(line).alias("stripped"))))
    df = df.withColumn("_base", F.transform("_base", lambda x: F.struct(
        x["line"].alias("line"), x["stripped"].alias("stripped"),
        F.contains(x["stripped"], opener).alias("open"), F.contains(x["stripped"], closer).alias("close"))))
    # Block-comment toggles: 1 = opens a block, 0 = closes it (lines with both keep the state).
    df = df.withColumn("_marks", F.filter(
        F.transform("_base", lambda x, i: F.struct(
            i.alias("i"),
            F.when(has_open(x) & ~has_close(x), F.lit(1))
             .when(has_close(x) & ~has_open(x), F.lit(0)).alias("m"))),
        lambda t: t["m"].isNotNull()))
    # State before each line = mark of the last toggle strictly above it (0 before any):
    # expand every toggle into the run of lines it governs.
    n = F.size("_raw")
    toggle_idx = F.transform("_marks", lambda t: t["i"])
    next_idx = F.concat(F.slice(toggle_idx, 2, F.greatest(F.size(toggle_idx) - 1, F.lit(0))),
                        F.array(n - 1))
    first_idx = F.coalesce(F.try_element_at("_marks", F.lit(1))["i"], n - 1)
    df = df.withColumn("_state", F.concat(
        F.array_repeat(F.lit(0), first_idx + 1),
        F.flatten(F.filter(
            F.zip_with("_marks", next_idx,
                       lambda t, nx: F.when(t.isNotNull(), F.array_repeat(t["m"], nx - t["i"]))),
            lambda a: a.isNotNull()))))
    # Line kind in its own pass, so the comment test runs once per line.
    df = df.withColumn("_kinds", F.zip_with("_base", "_state", lambda x, st: (
        F.when(x["stripped"] == F.lit(""), F.lit("blank"))
         .when(F.coalesce(has_open(x) | has_close(x) | (st == F.lit(1)) | x["stripped"].startswith(single),
                          F.lit(False)), F.lit("comment"))
         .otherwise(F.lit("code")))))

    todo_re = u(dims.TODO_PATTERN, "iU")

    def record(z: Column, i: Column) -> Column:
        x = z["_base"]
        line, s = x["line"], x["stripped"]
        kind = z["_kinds"]
        blank = kind == F.lit("blank")
        code = kind == F.lit("code")
        # cheap pre-filters (substring tests) guard the regular expressions
        # a marker needs one of its openers somewhere in the line (exact necessary condition)
        maybe_todo = F.lit(False)
        for opener in dims.TODO_OPENERS:
            maybe_todo = maybe_todo | F.contains(line, F.lit(opener))
        todo_raw = F.when(maybe_todo, F.nullif(F.regexp_extract(line, todo_re, 1), F.lit("")))
        has_quote = F.contains(line, F.lit('"')) | F.contains(line, F.lit("'"))
        # first word = text before the first ' ' or '('; one character more than the longest keyword decides
        start = F.lower(F.substring(s, 1, max(map(len, dims.BRANCH_KEYWORDS)) + 1))
        is_branch = F.substring_index(F.substring_index(start, " ", 1), "(", 1).isin(dims.BRANCH_KEYWORDS)
        return F.struct(
            (i + 1).alias("line_no"),
            line.alias("line"),
            s.alias("stripped"),
            kind.alias("kind"),
            F.when(~blank, strip(todo_raw)).alias("todo"),
            (~blank & per_language(dims.IMPORT_PATTERNS,
                                   lambda p: any_match(line, p), F.lit(False))).alias("is_import"),
            (~blank & per_language(dims.ERROR_PATTERNS,
                                   lambda p: any_match(line, p), F.lit(False))).alias("has_error"),
            F.when(~blank & has_quote,
                   F.regexp_extract_all(line, F.lit(dims.STRING_LITERAL_PATTERN), 1)).alias("literals"),
            (~blank & is_branch).alias("is_branch"),
            F.when(code, per_language(dims.JVM_FUNCTION_PATTERNS,
                                      lambda p: first_group(line, p), _null_str())).alias("func_name"),
            F.when(code, per_language(dims.CLASS_PATTERNS,
                                      lambda p: first_group(line, p), _null_str())).alias("class_name"),
        )

    df = df.withColumn("_recs", F.transform(F.arrays_zip("_base", "_kinds"), record))
    if keep_block:
        df = df.withColumn("_head", first_idx + 1).withColumn("_exit", F.try_element_at("_marks", F.lit(-1))["m"])
    return df.drop("_raw", "_base", "_marks", "_state", "_kinds", "_single", "_open", "_close", "_lang")


def lines(analysed: DataFrame) -> DataFrame:
    """Line table: repo_id, path, language, is_test, line_no, line, stripped, kind.

    ``analysed`` is the output of :func:`structure.file_analysis` (which keeps
    ``_recs`` when asked) or any frame with ``_recs``.
    """
    return (analysed.select("repo_id", "path", "language", "is_test",
                            F.explode("_recs").alias("r"))
            .select("repo_id", "path", "language", "is_test",
                    F.col("r.line_no").alias("line_no"), F.col("r.line").alias("line"),
                    F.col("r.stripped").alias("stripped"), F.col("r.kind").alias("kind")))


def feature_count(text: Column, language: Column) -> Column:
    """Route/feature matches over the whole text: sum over the language's patterns."""
    def total(patterns: list[str]) -> Column:
        out = F.lit(0)
        for p in patterns:
            out = out + F.regexp_count(text, F.lit(u(p)))
        return out
    return _per_language(language, dims.FEATURE_PATTERNS, total, F.lit(0)).cast("bigint")
