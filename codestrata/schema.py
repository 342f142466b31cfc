"""Table shapes and the fixed value tables of the analysis."""

from __future__ import annotations

from pyspark.sql import types as T

CHANGES = T.StructType(
    [
        T.StructField("repo", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
    ]
)

# One row per violation.  The files a violation points at are rows of REFS, not an array, since
# one group of copies may hold a large share of the corpus.
VIOLATION_COLUMNS = [
    "repo",
    "detector",
    "path",
    "rule_no",
    "line",
    "vkey",
    "rule_id",
    "severity",
    "category",
    "title",
    "description",
    "suggestion",
    "n_refs",
]
# Order of the violations of one repository ("path" sorts by its components).
VIOLATION_ORDER = ["detector", "path", "rule_no", "line", "vkey"]

# A reference carries the place of its violation, so that reports need no join.  Within a
# violation, references are in the order of "ref_at" (a path, or '') and "ref_no"; "ref_path" is
# the file they count for.
REF_COLUMNS = ["repo", "severity", *VIOLATION_ORDER, "ref_at", "ref_no", "ref_path", "ref"]

VIOLATIONS = (
    "repo string, detector int, path string, rule_no int, line int, vkey string, rule_id string,"
    " severity string, category string, title string, description string, suggestion string,"
    " n_refs long"
)
REFS = (
    "repo string, severity string, detector int, path string, rule_no int, line int, vkey string,"
    " ref_at string, ref_no int, ref_path string, ref string"
)
REPOS = "repo string, language string, total_files long"

# Severities, their penalties, and the categories.
CRITICAL, WARNING, INFO = "CRITICAL", "WARNING", "INFO"
SEVERITIES = [CRITICAL, WARNING, INFO]
PENALTY = {CRITICAL: 15, WARNING: 5, INFO: 1}

DUPLICATION = "Duplication"
BOUNDARY = "BoundaryViolation"
ANTI_PATTERN = "AntiPattern"
NAMING = "NamingInconsistency"
DEAD_CODE = "DeadCode"

# Detectors in the order their rows are listed.
DETECTORS = {DUPLICATION: 0, ANTI_PATTERN: 1, NAMING: 2, BOUNDARY: 3, DEAD_CODE: 4}

UNKNOWN = "Unknown"

# Extensions that decide the language of a repository.
DETECTED_EXTENSIONS = {
    ".go": "Go",
    ".py": "Python",
    ".java": "Java",
    ".ts": "TypeScript",
    ".js": "JavaScript",
    ".rs": "Rust",
}

# Two more extensions are read once the language is known.
SOURCE_EXTENSIONS = {**DETECTED_EXTENSIONS, ".tsx": "TypeScript", ".jsx": "JavaScript"}

BRACE_LANGUAGES = ["Go", "Java", "TypeScript", "JavaScript"]

# Directory names a scan never enters.
SKIPPED_DIRECTORIES = [
    ".git",
    "node_modules",
    "vendor",
    ".venv",
    "venv",
    "__pycache__",
    "dist",
    "build",
    "out",
    ".idea",
    ".vscode",
    "target",
    ".cache",
    ".gradle",
    ".mvn",
    "bin",
]

# The shorter list that applies to change events.
UNWATCHED_DIRECTORIES = [".git", "node_modules", "vendor", ".venv", "dist", "build", ".cache"]

# Layers in priority order, and the words that mark a path or import as theirs.
LAYERS = [
    (
        "presentation",
        "handler|controller|view|ui|api|route|endpoint|http|rest|graphql|grpc",
    ),
    ("application", "service|usecase|use_case|application|app|command|query"),
    ("domain", "domain|model|entity|aggregate|repository|repo"),
    (
        "infrastructure",
        "infra|infrastructure|db|database|storage|cache|queue|email|notification"
        "|persistence|adapter",
    ),
]

# Fixed values: (importing layer, imported layer) pairs that are not allowed.
FORBIDDEN_PAIRS = [
    ("presentation", "infrastructure"),
    ("presentation", "domain"),
    ("application", "infrastructure"),
]
