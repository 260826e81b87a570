"""Static dimension data: languages, path rules, comment tokens, regex rules, thresholds.

FIXED VALUES. Everything in this module is a constant that must equal the
heuristics the engine reproduces (extension map, directory and file-name lists,
sensitive-name fragments, per-language regular expressions, score thresholds).
They are stated plainly and in their natural order.

Regular expressions are written once, in a syntax both Java (Spark) and RE2
(DuckDB, used by the SQL oracle) accept: a literal ``{`` is always escaped.
Spark callers prefix ``(?U)`` so that ``\\w`` and ``\\s`` are Unicode-aware,
which is what the original heuristics (Python ``re`` on ``str``) use.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES: file extension (lower case, with dot) -> language
# ('.R' is listed by the original map but is unreachable there, because the
#  suffix is lower-cased before the lookup; '.r' covers it.)
# --------------------------------------------------------------------------
LANGUAGE_BY_EXTENSION: dict[str, str] = {
    ".py": "Python", ".pyw": "Python", ".pyi": "Python",
    ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".jsx": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript", ".mts": "TypeScript", ".cts": "TypeScript",
    ".html": "HTML", ".htm": "HTML",
    ".css": "CSS", ".scss": "CSS", ".sass": "CSS", ".less": "CSS",
    ".json": "JSON", ".xml": "XML", ".yaml": "YAML", ".yml": "YAML", ".md": "Markdown",
    ".go": "Go", ".rs": "Rust", ".java": "Java",
    ".kt": "Kotlin", ".kts": "Kotlin",
    ".swift": "Swift", ".cs": "C#", ".php": "PHP",
    ".rb": "Ruby", ".rake": "Ruby",
    ".dart": "Dart",
    ".c": "C", ".h": "C",
    ".cpp": "C++", ".hpp": "C++", ".cc": "C++", ".cxx": "C++",
    ".scala": "Scala", ".sc": "Scala",
    ".ex": "Elixir", ".exs": "Elixir",
    ".lua": "Lua",
    ".pl": "Perl", ".pm": "Perl",
    ".r": "R",
    ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell",
    ".vue": "Vue", ".svelte": "Svelte", ".sql": "SQL", ".hs": "Haskell",
    ".ml": "OCaml", ".mli": "OCaml",
    ".fs": "F#", ".fsx": "F#",
    ".clj": "Clojure", ".cljs": "Clojure", ".cljc": "Clojure",
    ".erl": "Erlang", ".hrl": "Erlang",
    ".zig": "Zig", ".nim": "Nim", ".cr": "Crystal",
    ".groovy": "Groovy", ".gvy": "Groovy",
}

# --------------------------------------------------------------------------
# FIXED VALUES: test classification
# A path component (file name included) equal to one of TEST_DIR_NAMES, or a
# lower-cased file name containing one of TEST_NAME_FRAGMENTS, marks a test.
# --------------------------------------------------------------------------
TEST_DIR_NAMES: list[str] = [
    "test", "tests", "spec", "specs", "__tests__", "__test__", "test_", "_test", "testing",
]
TEST_NAME_FRAGMENTS: list[str] = [
    "test_", "_test.", ".test.", ".spec.", "_spec.", "spec_", "tests.", "test.", "_tests.",
]

# --------------------------------------------------------------------------
# FIXED VALUES: ignored directories (compared with the lower-cased directory
# name, so the mixed-case entries 'Pods' and 'DerivedData' never match) and
# ignored file fragments (substring of the lower-cased path).
# --------------------------------------------------------------------------
IGNORED_DIR_NAMES: list[str] = [
    ".git", ".svn", ".hg", ".bzr",
    "node_modules", "vendor", "vendors", ".vendor", "bower_components", "jspm_packages",
    "venv", ".venv", "env", ".env", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", "site-packages", "dist-packages", ".eggs", "*.egg-info", ".tox", ".nox",
    "build", "dist", "out", "output", "target", "bin", ".build", "_build",
    ".idea", ".vscode", ".vs", ".eclipse", ".settings",
    "coverage", ".coverage", "htmlcov", ".nyc_output",
    ".cache", ".tmp", "tmp", "temp", ".temp", "logs", ".next", ".nuxt", ".output",
    ".vercel", ".netlify", ".serverless", ".terraform", "Pods", "DerivedData",
    ".gradle", ".m2", ".cargo", "pkg",
]
IGNORED_FILE_FRAGMENTS: list[str] = [
    ".min.js", ".min.css", ".bundle.js", ".chunk.js", "-lock.json", ".lock", ".map",
]

# --------------------------------------------------------------------------
# FIXED VALUES: function-name fragments that mark a "sensitive" function
# --------------------------------------------------------------------------
SENSITIVE_NAME_FRAGMENTS: list[str] = [
    "payment", "pay_", "_pay", "charge", "billing", "invoice",
    "auth", "authenticate", "login", "logout", "signin", "signout", "signup", "register",
    "password", "passwd", "token", "secret", "key", "credential", "api_key", "apikey",
    "encrypt", "decrypt", "hash", "verify", "validate",
    "admin", "delete", "remove", "destroy", "transfer", "withdraw", "deposit",
]

# --------------------------------------------------------------------------
# FIXED VALUES: comment tokens per language: (single-line prefix, block open,
# block close). Languages not listed use ('#', None, None).
# --------------------------------------------------------------------------
DEFAULT_SINGLE_COMMENT = "#"
COMMENT_TOKENS: dict[str, tuple[str, str | None, str | None]] = {
    "Python": ("#", '"""', '"""'),
    "JavaScript": ("//", "/*", "*/"),
    "TypeScript": ("//", "/*", "*/"),
    "Go": ("//", "/*", "*/"),
    "Rust": ("//", "/*", "*/"),
    "Java": ("//", "/*", "*/"),
    "Kotlin": ("//", "/*", "*/"),
    "Swift": ("//", "/*", "*/"),
    "C#": ("//", "/*", "*/"),
    "PHP": ("//", "/*", "*/"),
    "Ruby": ("#", "=begin", "=end"),
    "Dart": ("//", "/*", "*/"),
    "C": ("//", "/*", "*/"),
    "C++": ("//", "/*", "*/"),
    "Shell": ("#", None, None),
}

# --------------------------------------------------------------------------
# FIXED VALUES: function-start patterns per language, tried in order; group 1
# is the name. Matched on code lines only.
# --------------------------------------------------------------------------
FUNCTION_PATTERNS: dict[str, list[str]] = {
    "Python": [
        r"^\s*def\s+(\w+)\s*\(",
        r"^\s*async\s+def\s+(\w+)\s*\(",
    ],
    "JavaScript": [
        r"^\s*function\s+(\w+)\s*\(",
        r"^\s*async\s+function\s+(\w+)\s*\(",
        r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(",
        r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function",
        r"^\s*(\w+)\s*:\s*(?:async\s+)?function",
        r"^\s*(\w+)\s*\([^)]*\)\s*\{",
    ],
    "TypeScript": [
        r"^\s*function\s+(\w+)\s*[<(]",
        r"^\s*async\s+function\s+(\w+)\s*[<(]",
        r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(",
        r"^\s*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?function",
        r"^\s*(?:public|private|protected)?\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*[:{]",
    ],
    "Go": [
        r"^\s*func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(",
    ],
    "Rust": [
        r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*[<(]",
    ],
    "Java": [
        r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+)?\s*\{",
    ],
    "Kotlin": [
        r"^\s*(?:fun|suspend\s+fun)\s+(\w+)\s*[<(]",
    ],
    "Swift": [
        r"^\s*(?:func|class\s+func|static\s+func)\s+(\w+)\s*[<(]",
    ],
    "C#": [
        r"^\s*(?:public|private|protected|internal)?\s*(?:static\s+)?(?:async\s+)?(?:\w+\s+)+(\w+)\s*\([^)]*\)\s*\{",
    ],
    "PHP": [
        r"^\s*(?:public|private|protected)?\s*(?:static\s+)?function\s+(\w+)\s*\(",
    ],
    "Ruby": [
        r"^\s*def\s+(?:self\.)?(\w+)",
    ],
    "Dart": [
        r"^\s*(?:\w+\s+)?(\w+)\s*\([^)]*\)\s*(?:async\s*)?\{",
    ],
}

# The JVM's regex engine recurses once per round of a repeated group, so `(?:\w+\s+)+` overflows
# its stack on a line of a few thousand words. Spark uses these forms of the same languages: words and
# blanks as one character class, which the engine walks in a loop (the optional modifiers are words too).
JVM_FUNCTION_PATTERNS: dict[str, list[str]] = {
    **FUNCTION_PATTERNS,
    "Java": [r"^\s*\w[\w\s]*\s(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+)?\s*\{"],
    "C#": [r"^\s*\w[\w\s]*\s(\w+)\s*\([^)]*\)\s*\{"],
}

# --------------------------------------------------------------------------
# FIXED VALUES: class-start patterns per language (group 1 is the name)
# --------------------------------------------------------------------------
CLASS_PATTERNS: dict[str, list[str]] = {
    "Python": [r"^\s*class\s+(\w+)"],
    "JavaScript": [r"^\s*class\s+(\w+)"],
    "TypeScript": [r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"],
    "Go": [r"^\s*type\s+(\w+)\s+struct\s*\{"],
    "Rust": [r"^\s*(?:pub\s+)?struct\s+(\w+)"],
    "Java": [r"^\s*(?:public\s+)?(?:abstract\s+)?class\s+(\w+)"],
    "Kotlin": [r"^\s*(?:data\s+)?class\s+(\w+)"],
    "Swift": [r"^\s*(?:class|struct)\s+(\w+)"],
    "C#": [r"^\s*(?:public\s+)?(?:partial\s+)?class\s+(\w+)"],
    "PHP": [r"^\s*class\s+(\w+)"],
    "Ruby": [r"^\s*class\s+(\w+)"],
    "Dart": [r"^\s*class\s+(\w+)"],
}

# --------------------------------------------------------------------------
# FIXED VALUES: import-line patterns per language (any match counts once)
# --------------------------------------------------------------------------
IMPORT_PATTERNS: dict[str, list[str]] = {
    "Python": [r"^\s*import\s+(\S+)", r"^\s*from\s+(\S+)\s+import"],
    "JavaScript": [r"^\s*import\s+", r"^\s*(?:const|let|var)\s+\w+\s*=\s*require\("],
    "TypeScript": [r"^\s*import\s+"],
    "Go": [r"^\s*import\s+"],
    "Rust": [r"^\s*use\s+"],
    "Java": [r"^\s*import\s+"],
    "Kotlin": [r"^\s*import\s+"],
    "Swift": [r"^\s*import\s+"],
    "C#": [r"^\s*using\s+"],
    "PHP": [r"^\s*(?:use|require|include)"],
    "Ruby": [r"^\s*require"],
    "Dart": [r"^\s*import\s+"],
}

# --------------------------------------------------------------------------
# FIXED VALUES: error-handling patterns per language (any match on any
# non-blank line marks the file as handling errors)
# --------------------------------------------------------------------------
ERROR_PATTERNS: dict[str, list[str]] = {
    "Python": [r"^\s*try\s*:", r"^\s*except\s*"],
    "JavaScript": [r"^\s*try\s*\{", r"\.catch\s*\("],
    "TypeScript": [r"^\s*try\s*\{", r"\.catch\s*\("],
    "Go": [r"if\s+err\s*!=\s*nil"],
    "Rust": [r"\?\s*;", r"\.unwrap_or"],
    "Java": [r"^\s*try\s*\{", r"^\s*catch\s*\("],
    "Kotlin": [r"^\s*try\s*\{", r"^\s*catch\s*\("],
    "Swift": [r"^\s*do\s*\{", r"^\s*catch\s*"],
    "C#": [r"^\s*try\s*\{", r"^\s*catch\s*\("],
    "PHP": [r"^\s*try\s*\{", r"^\s*catch\s*\("],
    "Ruby": [r"^\s*begin\s*$", r"^\s*rescue\s*"],
    "Dart": [r"^\s*try\s*\{", r"^\s*catch\s*\("],
}

# --------------------------------------------------------------------------
# FIXED VALUES: route / feature patterns per language, counted over the whole
# file text (every match of every pattern counts)
# --------------------------------------------------------------------------
FEATURE_PATTERNS: dict[str, list[str]] = {
    "Python": [
        r"@app\.route\(",
        r"@router\.\w+\(",
        r"@api_view\(",
        r"path\(['\"]",
        r"url\(['\"]",
        r"def\s+\w+_view\(",
    ],
    "JavaScript": [
        r"app\.(get|post|put|patch|delete)\(",
        r"router\.(get|post|put|patch|delete)\(",
        r"export\s+(default\s+)?function\s+\w+Page",
        r"export\s+(default\s+)?function\s+\w+Route",
        r"getServerSideProps",
        r"getStaticProps",
    ],
    "TypeScript": [
        r"app\.(get|post|put|patch|delete)\(",
        r"router\.(get|post|put|patch|delete)\(",
        r"export\s+(default\s+)?function\s+\w+Page",
        r"export\s+(default\s+)?function\s+\w+Route",
        r"getServerSideProps",
        r"getStaticProps",
    ],
    "Go": [
        r"http\.HandleFunc\(",
        r"r\.HandleFunc\(",
        r"router\.(GET|POST|PUT|PATCH|DELETE)\(",
        r"e\.(GET|POST|PUT|PATCH|DELETE)\(",
    ],
    "Ruby": [
        r"get\s+['\"]",
        r"post\s+['\"]",
        r"put\s+['\"]",
        r"patch\s+['\"]",
        r"delete\s+['\"]",
        r"resources\s+:",
    ],
    "PHP": [
        r"Route::(get|post|put|patch|delete)\(",
        r"->get\(['\"]",
        r"->post\(['\"]",
    ],
}

# --------------------------------------------------------------------------
# FIXED VALUES: task markers and long string literals
# --------------------------------------------------------------------------
TODO_PATTERN = r"(?:#|//|/\*|\*|<!--)\s*(?:TODO|FIXME|HACK|XXX|BUG)\s*:?\s*(.+)"
STRING_LITERAL_PATTERN = r"[\"']([^\"']{20,})[\"']"

# First word of a lower-cased stripped line that counts as a branch.
BRANCH_KEYWORDS: list[str] = [
    "if", "else", "elif", "for", "while", "switch", "case", "match", "try", "catch",
]

# Function names never counted as duplicate definitions.
DEAD_CODE_EXEMPT_NAMES: list[str] = ["__init__", "main", "setup", "teardown", "run"]

# --------------------------------------------------------------------------
# FIXED VALUES: line splitting and stripping
# Line boundaries are those of Python's str.splitlines; strip characters are
# those of str.strip (Unicode white space plus \x1c-\x1f).
# --------------------------------------------------------------------------
LINE_BREAK_REGEX = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"
STRIP_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same set as plain characters (for btrim): every character str.strip() removes.
STRIP_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
               + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")
# Comment openers a task marker starts with (TODO_PATTERN's first group), used
# as an exact, cheap pre-filter before the regular expression runs.
TODO_OPENERS = ["#", "//", "*", "<!--"]

# --------------------------------------------------------------------------
# FIXED VALUES: thresholds and model constants
# --------------------------------------------------------------------------
LONG_FUNCTION_LINES = 80            # a function is long when line_count > 80
EXCESSIVE_COMMENT_RATIO = 0.5
VERBOSE_NAME_LENGTH = 35
BOILERPLATE_IMPORT_RATIO = 3.0
COPY_PASTE_MIN_OCCURRENCES = 5
COPY_PASTE_MIN_TOTAL = 10
INCONSISTENT_MIN_NAMES = 5
OVER_ENGINEERING_MIN_LOC = 100
NEAR_DUP_MIN_CODE_LINES = 10
NEAR_DUP_DEFAULT_THRESHOLD = 0.5
SIMILARITY_WEIGHTS = (0.3, 0.5, 0.2)  # line, function, class

DEFECT_DENSITY_BASE = 25.0           # defects per KLOC, average code base
AI_DEFECT_MULTIPLIER = 1.7

TEST_RATIO_TIERS = [(0.8, 0), (0.5, 10), (0.2, 25), (0.1, 35)]  # (at least, penalty)
TEST_RATIO_FLOOR_PENALTY = 40
HIGH_SMELL_SCORE = 0.7
FIX_SMELL_SCORE = 0.5
RISK_LEVELS = [(80, "LOW"), (60, "MODERATE"), (40, "ELEVATED"), (20, "HIGH")]
RISK_FLOOR = "CRITICAL"
CLASS_DENSITY_LIMIT = 20             # classes per KLOC before the -5 penalty
FEATURE_EXPONENT_CAP = 20

SMELL_ORDER: list[str] = [
    "excessive_comments",
    "verbose_naming",
    "boilerplate_heavy",
    "inconsistent_patterns",
    "dead_code_indicators",
    "over_engineering",
    "missing_error_handling",
    "copy_paste_artifacts",
]

# Own wording: one sentence per smell, used by the fix plan and reports.
SMELL_DESCRIPTIONS: dict[str, str] = {
    "excessive_comments": "Comment lines are high relative to code lines",
    "verbose_naming": "Function or class names longer than 35 characters",
    "boilerplate_heavy": "Many import lines per defined function",
    "inconsistent_patterns": "Function names mix snake_case, camelCase and PascalCase",
    "dead_code_indicators": "The same function name is defined more than once",
    "over_engineering": "Many classes per thousand lines of code",
    "missing_error_handling": "Functions live in files without any error handling",
    "copy_paste_artifacts": "Long string literals repeated many times",
}
