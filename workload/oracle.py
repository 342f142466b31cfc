"""SQL for DuckDB that gives what the queries give.

For the derived corpus, positions, lengths and counts are taken from the numbers the corpus was
made from; the SQL does not cut functions out of a text.
"""

from __future__ import annotations

from workload.derived import CORPUS_SQL
from workload.queries import CHANGE_OP, CHANGE_PATH, EVENT_PAUSE_MS

_SPACE = (
    r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

_LAYER_WORDS = {
    "presentation": "handler|controller|view|ui|api|route|endpoint|http|rest|graphql|grpc",
    "application": "service|usecase|use_case|application|app|command|query",
    "domain": "domain|model|entity|aggregate|repository|repo",
    "infrastructure": "infra|infrastructure|db|database|storage|cache|queue|email|notification"
    "|persistence|adapter",
}

_SECRET = (
    "(?i)(?:api_?key|secret|password|token|passwd)\\s*[:=]\\s*"
    "[\"''][A-Za-z0-9+/=_\\-]{10,}[\"'']"
)


# Identifier, severity and languages of each rule, in rule order; and its texts.
_RULES = [
    (
        'silent-error',
        'CRITICAL',
        ('Go',),
        'Result of a call thrown away',
        "A call's result is assigned to the blank name, so a failure leaves no trace.",
        'Rework what silent-error points at, or exclude the path.',
    ),
    (
        'bare-panic',
        'WARNING',
        ('Go',),
        'Panic instead of an error value',
        'The code stops the process where a caller could have handled an error.',
        'Rework what bare-panic points at, or exclude the path.',
    ),
    (
        'broad-except',
        'WARNING',
        ('Python',),
        'Handler that catches everything',
        'An except clause without a specific type hides faults that nobody expected.',
        'Rework what broad-except points at, or exclude the path.',
    ),
    (
        'print-debug',
        'INFO',
        ('Go', 'Python', 'Java'),
        'Output by print statement',
        'Text goes straight to standard output and bypasses the logger.',
        'Rework what print-debug points at, or exclude the path.',
    ),
    (
        'hardcoded-secret',
        'CRITICAL',
        ('Go', 'Python', 'Java', 'TypeScript', 'JavaScript'),
        'Secret written into the source',
        "A literal next to a credential's name looks like a real key or password.",
        'Rework what hardcoded-secret points at, or exclude the path.',
    ),
    (
        'todo-fixme-critical',
        'INFO',
        ('Go', 'Python', 'Java', 'TypeScript', 'JavaScript'),
        'Open marker comment',
        'A marker for unfinished work was left in the code.',
        'Rework what todo-fixme-critical points at, or exclude the path.',
    ),
    (
        'god-function',
        'WARNING',
        ('Go', 'Python', 'Java', 'TypeScript', 'JavaScript'),
        'Function too long',
        'A function is longer than the limit and likely does several things.',
        'Rework what god-function points at, or exclude the path.',
    ),
]
_FIELDS = ["rule_id", "severity", "languages", "title", "description", "suggestion"]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _layer(value: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({value}, '(?i){words}') THEN '{layer}'"
        for layer, words in _LAYER_WORDS.items()
    )
    return f"CASE {cases} END"


def _rule(field: str) -> str:
    cases = " ".join(
        f"WHEN {n} THEN {_quote(rule[_FIELDS.index(field)])}" for n, rule in enumerate(_RULES)
    )
    return f"CASE rule_no {cases} END"


# Documents -------------------------------------------------------------------------------------

_LINES = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
    generate_subscripts(string_split(text, chr(10)), 1) AS line_no,
    len(string_split(text, chr(10))) AS n
  FROM documents
),
lines AS (
  SELECT doc_id, line_no, regexp_replace(raw, '\\r$', '') AS line
  FROM split WHERE NOT (line_no = n AND raw = '')
),
trimmed AS (
  SELECT *, regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS t FROM lines
),
no_slashes AS (
  SELECT *, CASE WHEN strpos(t, '//') > 1 THEN left(t, strpos(t, '//') - 1) ELSE t END AS s
  FROM trimmed
),
no_hashes AS (
  SELECT *, CASE WHEN strpos(s, '#') > 1 THEN left(s, strpos(s, '#') - 1) ELSE s END AS h
  FROM no_slashes
),
normal AS (
  SELECT doc_id, line_no, line, regexp_replace(
    regexp_replace(h, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g') AS normalized
  FROM no_hashes
)
"""

_DOCUMENT_HASHES = (
    _LINES
    + """,
hashes AS (
  SELECT source AS repo, CAST(d.doc_id AS VARCHAR) AS path,
    substr(sha256(string_agg(normalized, chr(10) ORDER BY line_no)), 1, 24) AS hash
  FROM normal n JOIN documents d ON d.doc_id = n.doc_id GROUP BY 1, 2
)
"""
)

_SECRET_SQL = f"""
WITH found AS (
  SELECT source, doc_id, string_split_regex(text, '{_SECRET}') AS g,
    regexp_extract_all(text, '{_SECRET}') AS m
  FROM documents WHERE regexp_matches(text, '{_SECRET}')
),
numbered AS (
  SELECT source, doc_id, len(m) AS n, k,
    array_to_string(g[1:k], '') || array_to_string(m[1:k - 1], '') AS before
  FROM found, unnest(range(1, len(m) + 1)) AS t(k)
),
secrets AS (
  SELECT source AS repo, CAST(doc_id AS VARCHAR) AS path, CAST(k - 1 AS INT) AS ord,
    CAST(1 + strlen(before) - strlen(replace(before, chr(10), '')) AS INT) AS line
  FROM numbered
)
"""

# The derived corpus ----------------------------------------------------------------------------

_BASE = (
    CORPUS_SQL
    + """,
visible AS (SELECT * FROM corpus WHERE coalesce(prefix, '') <> 'vendor/'),
named AS (
  SELECT repo, CASE lower(ext) WHEN '.go' THEN 'Go' WHEN '.py' THEN 'Python'
    WHEN '.java' THEN 'Java' WHEN '.ts' THEN 'TypeScript' WHEN '.js' THEN 'JavaScript'
    WHEN '.rs' THEN 'Rust' END AS lang FROM visible
),
ranked AS (
  SELECT repo, lang, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, lang) AS place
  FROM named WHERE lang IS NOT NULL GROUP BY repo, lang
),
languages AS (
  SELECT c.repo, coalesce(any_value(r.lang), 'Unknown') AS language, count(*) AS n_files
  FROM corpus c LEFT JOIN ranked r ON r.repo = c.repo AND r.place = 1 GROUP BY c.repo
),
sources AS (
  SELECT v.*, language AS lang FROM visible v JOIN languages USING (repo)
  WHERE CASE lower(ext) WHEN '.go' THEN 'Go' WHEN '.py' THEN 'Python' WHEN '.java' THEN 'Java'
    WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.js' THEN 'JavaScript'
    WHEN '.jsx' THEN 'JavaScript' WHEN '.rs' THEN 'Rust' END = language
),
sfn AS (
  SELECT fn.*, s.lang FROM fn JOIN (SELECT repo, path, lang FROM sources) s USING (repo, path)
),
body_lines AS (
  SELECT *, opening
    || CASE WHEN has_error = 1 THEN chr(10) || error_text ELSE '' END
    || CASE WHEN has_broad = 1 THEN chr(10) || broad_text ELSE '' END
    || CASE WHEN has_todo = 1 THEN chr(10) || todo_text ELSE '' END
    || CASE WHEN has_secret = 1 THEN chr(10) || secret_text ELSE '' END
    || CASE WHEN has_print = 1 THEN chr(10) || print_text ELSE '' END
    || repeat(chr(10) || body_text, n_body)
    || CASE WHEN lang = 'Python' THEN '' ELSE chr(10) || closing END AS normalized
  FROM sfn WHERE lang <> 'Rust'
),
blocks AS (
  SELECT repo, path, lang, start_line AS line,
    CAST(n_inner + CASE WHEN lang = 'Python' THEN 1 ELSE 2 END AS INT) AS line_count,
    substr(sha256(normalized), 1, 24) AS hash,
    '    ' || array_to_string(string_split(normalized, chr(10))[1:4], chr(10) || '    ')
      || chr(10) || '    ...' AS preview
  FROM body_lines
  WHERE n_inner + CASE WHEN lang = 'Python' THEN 1 ELSE 2 END >= 8
),
groups AS (
  SELECT repo, hash, any_value(preview) AS preview, count(*) AS n,
    CASE WHEN count(*) >= 3 THEN 'CRITICAL' ELSE 'WARNING' END AS severity
  FROM blocks GROUP BY repo, hash HAVING count(*) >= 2
),
gods AS (
  SELECT repo, path, start_line AS line, CAST(n_inner + 1 AS INT) AS length, name
  FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY start_line) AS nth
    FROM sfn WHERE lang IN ('Go', 'Java', 'Python') AND n_inner + 1 > 80
  ) WHERE nth = 1
),
marks AS (
  SELECT repo, path, 0 AS rule_no, start_line + 1 AS line FROM sfn WHERE has_error = 1
  UNION ALL SELECT repo, path, CASE lang WHEN 'Go' THEN 1 ELSE 2 END,
    start_line + 1 + has_error FROM sfn WHERE has_broad = 1
  UNION ALL SELECT repo, path, 5, start_line + 1 + has_error + has_broad
    FROM sfn WHERE has_todo = 1 AND todo_hit = 1 AND lang <> 'Rust'
  UNION ALL SELECT repo, path, 4, start_line + 1 + has_error + has_broad + has_todo
    FROM sfn WHERE has_secret = 1
  UNION ALL SELECT repo, path, 3, start_line + 1 + has_error + has_broad + has_todo + has_secret
    FROM sfn WHERE has_print = 1
),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY repo, path, rule_no ORDER BY line) AS nth,
    count(*) OVER (PARTITION BY repo, path, rule_no) AS n
  FROM marks
),
imports AS (
  SELECT repo, path, lang, dir, 0 AS ord, import_1 AS target FROM sources WHERE lang <> 'Rust'
  UNION ALL SELECT repo, path, lang, dir, 1, 'os' FROM sources WHERE lang = 'Python'
  UNION ALL SELECT repo, path, lang, dir, CASE lang WHEN 'Python' THEN 2 ELSE 1 END, import_2
    FROM sources WHERE lang <> 'Rust'
),
layered AS (
  SELECT *, CASE dir WHEN 'api' THEN 'presentation' WHEN 'service' THEN 'application'
      WHEN 'domain' THEN 'domain' WHEN 'db' THEN 'infrastructure' END AS from_layer,
    CASE replace(target, '.', '/') WHEN 'core/db' THEN 'infrastructure'
      WHEN 'app/service' THEN 'application' WHEN 'x/domain' THEN 'domain'
      WHEN 'web/api' THEN 'presentation' WHEN 'shared/cache' THEN 'infrastructure' END AS to_layer
  FROM imports
),
crossing AS (
  SELECT * FROM layered WHERE (from_layer, to_layer) IN (('presentation', 'infrastructure'),
    ('presentation', 'domain'), ('application', 'infrastructure'))
),
defs AS (SELECT repo, path, start_line AS line, name FROM sfn WHERE lang <> 'Rust'),
dead AS (
  SELECT repo, path, line, name
  FROM defs JOIN (SELECT repo, name FROM sfn GROUP BY 1, 2 HAVING count(*) = 1)
    USING (repo, name)
  WHERE NOT starts_with(lower(name), 'test')
),
go_names AS (
  SELECT repo, count(*) FILTER (p_partkey % 3 = 0) AS caps_files,
    count(*) FILTER (p_partkey % 3 = 1) AS camel_files
  FROM sources WHERE lang = 'Go' GROUP BY repo
  HAVING count(*) >= 5 AND caps_files > 0 AND camel_files > 0
),
py_functions AS (
  SELECT repo, path, start_line, name, l_linenumber IN (1, 2) AS is_camel
  FROM sfn WHERE lang = 'Python'
),
py_placed AS (
  SELECT *, row_number() OVER
    (PARTITION BY repo, is_camel ORDER BY string_split(path, '/'), start_line) AS nth
  FROM py_functions
),
py_names AS (
  SELECT repo, count(*) FILTER (is_camel) AS camel, count(*) FILTER (NOT is_camel) AS snake,
    string_agg(name, ', ' ORDER BY nth) FILTER (is_camel AND nth <= 3) AS camel_examples,
    string_agg(name, ', ' ORDER BY nth) FILTER (NOT is_camel AND nth <= 3) AS snake_examples
  FROM py_placed JOIN (SELECT repo FROM sources GROUP BY 1 HAVING count(*) >= 5) USING (repo)
  GROUP BY repo HAVING camel > 0 AND snake > 2
)
"""
)

# What the patterns of its own repository leave.
_KEPT_BY_REPO = """CASE WHEN regexp_matches(repo, '[02468]$')
      THEN coalesce(prefix, '') <> 'x/migrations/'
        AND NOT regexp_matches(path, '(^|/)f[^/]*7_0\\.[^/]*(/|$)')
      ELSE coalesce(prefix, '') <> 'gen/' AND NOT regexp_matches(path, '(^|/)f[^/]_[0-9]\\.py(/|$)') END"""

_SCAN = (
    _BASE
    + f""",
pattern_rows AS (
  SELECT repo, path, rule_no, any_value(n) AS n, {_rule("rule_id")} AS rule_id
  FROM hits GROUP BY repo, path, rule_no
),
v AS (
  SELECT repo, 0 AS detector, '' AS path, 0 AS rule_no, 0 AS line, 'duplicate:' || hash AS vkey,
    'duplicate-block' AS rule_id, severity, 'Duplication' AS category,
    'Same function body in ' || n || ' places' AS title,
    'Functions with the same normalised text were found.' || chr(10) || chr(10)
      || 'Start of the text:' || chr(10) || preview AS description,
    'Keep one copy in a shared place and call it.' AS suggestion, n AS n_refs
  FROM groups
  UNION ALL
  SELECT repo, 1, path, rule_no, 0, rule_id || ':' || path, rule_id, {_rule("severity")},
    'AntiPattern', {_rule("title")}, {_rule("description")}, {_rule("suggestion")},
    n
  FROM pattern_rows
  UNION ALL
  SELECT repo, 1, path, 6, line, 'god-function:' || path, 'god-function', 'WARNING',
    'AntiPattern', 'Function `' || name || '` is ' || length || ' lines long',
    '`' || name || '` in ' || path || ' takes ' || length || ' lines, the limit is 80.'
      || chr(10) || 'Long functions tend to do several things.',
    {_quote(_RULES[6][5])}, 1
  FROM gods
  UNION ALL
  SELECT repo, 2, '', 0, 0, 'naming-go', 'naming-go', 'WARNING', 'NamingInconsistency',
    'Constants named in two styles',
    caps_files || ' files declare constants in capitals and ' || camel_files
      || ' in camel case.' || chr(10) || 'Go code uses camel case.',
    'Rename the constants in capitals.', 1
  FROM go_names
  UNION ALL
  SELECT repo, 2, '', 0, 0, 'naming-python', 'naming-python', 'WARNING', 'NamingInconsistency',
    'Functions named in two styles: ' || camel || ' camel case, ' || snake || ' snake case',
    'PEP 8 asks for snake case.' || chr(10) || 'Camel case: ' || camel_examples || chr(10)
      || 'Snake case: ' || snake_examples,
    'Rename the functions in camel case.', 1
  FROM py_names
  UNION ALL
  SELECT repo, 3, path, 0, ord, 'boundary:' || path || ':' || ord, 'layer-boundary', 'CRITICAL',
    'BoundaryViolation', 'Import from ' || to_layer || ' into ' || from_layer,
    '`' || path || '` is in the ' || from_layer || ' layer and imports straight from the '
      || to_layer || ' layer.' || chr(10) || 'The layers in between are skipped.',
    'Rework what layer-boundary points at, or exclude the path.', 1
  FROM crossing
),
refs AS (
  SELECT repo, severity, 0 AS detector, '' AS path, 0 AS rule_no, 0 AS line,
    'duplicate:' || hash AS vkey, b.path AS ref_path, b.line AS ref_no,
    b.path || ':' || b.line AS ref, b.path AS ref_at
  FROM blocks b JOIN groups USING (repo, hash)
  UNION ALL
  SELECT repo, {_rule("severity")}, 1, path, rule_no, 0, {_rule("rule_id")} || ':' || path, path,
    nth - 1, path || ':' || line, ''
  FROM hits
  UNION ALL
  SELECT repo, 'WARNING', 1, path, 6, line, 'god-function:' || path, path, 0, path || ':' || line, ''
  FROM gods
  UNION ALL
  SELECT repo, 'WARNING', 2, '', 0, 0, 'naming-go', 'multiple files', 0, 'multiple files', ''
  FROM go_names
  UNION ALL
  SELECT repo, 'WARNING', 2, '', 0, 0, 'naming-python', 'multiple files', 0, 'multiple files', ''
  FROM py_names
  UNION ALL
  SELECT repo, 'CRITICAL', 3, path, 0, ord, 'boundary:' || path || ':' || ord, path, 0, path, ''
  FROM crossing
),
counted AS (
  SELECT repo, count(*) AS violation_count, count(*) FILTER (severity = 'CRITICAL') AS criticals,
    count(*) FILTER (severity = 'WARNING') AS warnings,
    count(*) FILTER (severity = 'INFO') AS infos,
    count(*) FILTER (category = 'Duplication') AS duplicate_sets,
    count(*) FILTER (category = 'BoundaryViolation') AS broken_boundaries,
    count(*) FILTER (category = 'AntiPattern') AS anti_patterns
  FROM v GROUP BY repo
),
totals AS (
  SELECT l.repo, language, coalesce(total_files, 0) AS total_files,
    coalesce(violation_count, 0) AS violation_count, coalesce(criticals, 0) AS criticals,
    coalesce(warnings, 0) AS warnings, coalesce(infos, 0) AS infos,
    coalesce(duplicate_sets, 0) AS duplicate_sets,
    coalesce(broken_boundaries, 0) AS broken_boundaries,
    coalesce(anti_patterns, 0) AS anti_patterns,
    greatest(0, 100 - 15 * coalesce(criticals, 0) - 5 * coalesce(warnings, 0)
      - coalesce(infos, 0)) AS score
  FROM languages l LEFT JOIN counted USING (repo)
    LEFT JOIN (SELECT repo, count(*) AS total_files FROM sources GROUP BY 1) USING (repo)
),
advice AS (
  SELECT repo, 0 AS n, duplicate_sets || ' copied functions to merge' AS s
    FROM totals WHERE duplicate_sets > 0
  UNION ALL SELECT repo, 1, broken_boundaries || ' imports to reroute'
    FROM totals WHERE broken_boundaries > 0
  UNION ALL SELECT repo, 2, anti_patterns || ' risky places to rewrite'
    FROM totals WHERE anti_patterns > 0
),
ranks(severity, sev) AS (VALUES ('CRITICAL', 1), ('WARNING', 2), ('INFO', 3)),
first_rules AS (
  SELECT *, row_number() OVER (PARTITION BY repo, category, title
    ORDER BY detector, string_split(path, '/'), rule_no, line, vkey) AS nth
  FROM v
)
"""
)


def _first_sentence(text: str) -> str:
    return (
        f"CASE WHEN strpos({text}, '.') > 1 THEN left({text}, strpos({text}, '.')) "
        f"WHEN strpos({text}, chr(10)) > 1 THEN left({text}, strpos({text}, chr(10)) - 1) "
        f"WHEN strlen({text}) > 120 THEN "
        + "coalesce("
        + ", ".join(
            f"TRY(decode(encode({text})[1:{120 - cut}])) || "
            + ("''" if cut == 0 else "chr(65533)")
            for cut in range(4)
        )
        + f") || '...' ELSE {text} END"
    )


_CONVENTIONS = """CASE language WHEN 'Go' THEN 'gofmt decides on the layout.'
  WHEN 'Python' THEN 'PEP 8: lines have 79 characters at most.'
  WHEN 'Java' THEN 'One top-level class per source file.'
  WHEN 'TypeScript' THEN 'The compiler runs in strict mode.' END"""

_ROW = (
    "repo, section, sev, detector, path, rule_no, line, vkey, item, ref_at, ref_no, text"
)


def _doc_row(
    text: str, source: str, section: int, sev="0", at="0, '', 0, 0, ''", item=0, ref="'', 0"
) -> str:
    return (
        f"SELECT repo, {section} AS section, {sev} AS sev, {at}, {item} AS item, {ref}, "
        f"{text} AS text FROM {source}"
    )


_PLACE = "detector, path, rule_no, line, vkey"


def _document(rows: list[str]) -> str:
    body = "\nUNION ALL\n".join(rows)
    return _SCAN + f", document({_ROW.replace(' ', '')}) AS (\n{body}\n)\nSELECT * FROM document"


def _j(value: str) -> str:
    return f"CAST(to_json({value}) AS VARCHAR)"


# What the documents tell to do, in place of the text that rules have in common.
_REMEDIES = {
    "silent-error": "'Check the returned error and log, wrap or return it.'",
    "bare-panic": "'Return an error and let the caller decide.'",
    "broad-except": "'Name the exception types this code can deal with.'",
    "print-debug": "'Write through the project''s logger at a fitting level.'",
    "hardcoded-secret":
        "'Load it from a secret store or the environment, and revoke the old one.'",
    "todo-fixme-critical": "'Move it to the issue tracker and delete the marker.'",
    "god-function": "'Split it into functions with one task each.'",
    "layer-boundary": "'Declare an interface in the ' || split_part(title, ' into ', 2) || "
        "' layer and have the implementation passed in.'",
}
_REMEDY = (
    "CASE suggestion "
    + " ".join(
        f"WHEN 'Rework what {rule_id} points at, or exclude the path.' THEN {text}"
        for rule_id, text in _REMEDIES.items()
    )
    + " ELSE suggestion END"
)


_MARKDOWN = _document(
    [
        _doc_row(
            "concat('# ', repo, chr(10), chr(10), '| | |', chr(10), '|-|-|', chr(10), "
            "'| language | ', language, ' |', chr(10), '| files scanned | ', total_files, ' |', "
            "chr(10), '| findings | ', violation_count, ' |', chr(10), '| score | ', score, ' |', "
            "CASE WHEN violation_count = 0 THEN concat(chr(10), chr(10), 'Nothing was found.') END)",
            "totals",
            0,
        ),
        _doc_row(
            "concat(chr(10), '## ', count(*), ' ', lower(severity))",
            "v JOIN ranks USING (severity) GROUP BY repo, severity, sev",
            1,
            "sev",
            "-1, '', 0, 0, ''",
        ),
        *[
            _doc_row(text, "v JOIN ranks USING (severity)", 1, "sev", _PLACE, item)
            for item, text in [
                (0, "concat(chr(10), '### ', title, ' (`', rule_id, '`)')"),
                (10, "'Category: ' || category"),
                (20, "description"),
                (30, "'Where:'"),
                (40, f"'To do: ' || {_REMEDY}"),
            ]
        ],
        _doc_row(
            "'* ' || ref",
            "refs JOIN ranks USING (severity)",
            1,
            "sev",
            _PLACE,
            31,
            "ref_at, ref_no",
        ),
        _doc_row(
            "chr(10) || '## Left to do'", "(SELECT DISTINCT repo FROM advice)", 2, ref="'', -1"
        ),
        _doc_row(
            "'* ' || s",
            "(SELECT repo, s, row_number() OVER (PARTITION BY repo ORDER BY n) - 1 AS k "
            "FROM advice)",
            2,
            ref="'', k",
        ),
    ]
)

_JSON = _document(
    [
        _doc_row(
            f"'{{\"RepoPath\":' || {_j('repo')} || ',\"Language\":' || {_j('language')} || "
            "',\"TotalFiles\":' || total_files || ',\"Violations\":' || "
            "CASE WHEN violation_count > 0 THEN '[' ELSE 'null' END",
            "totals",
            0,
        ),
        _doc_row(
            "CASE WHEN nth = 1 THEN '' ELSE ',' END || '{\"Severity\":' || "
            f"{_j('severity')} || ',\"Category\":' || {_j('category')} || ',\"Title\":' || "
            f"{_j('title')} || ',\"Description\":' || {_j('description')} || ',\"Files\":['",
            "(SELECT *, row_number() OVER (PARTITION BY repo ORDER BY detector, "
            "string_split(path, '/'), rule_no, line, vkey) AS nth FROM v)",
            1,
            at=_PLACE,
        ),
        _doc_row(
            f"'],\"Suggestion\":' || {_j(_REMEDY)} || '}}'", "v", 1, at=_PLACE, item=20
        ),
        _doc_row(
            f"CASE WHEN nth = 1 THEN '' ELSE ',' END || {_j('ref')}",
            "(SELECT *, row_number() OVER (PARTITION BY repo, vkey ORDER BY "
            "string_split(ref_at, '/'), ref_no) AS nth FROM refs)",
            1,
            at=_PLACE,
            item=10,
            ref="ref_at, ref_no",
        ),
        _doc_row(
            "CASE WHEN violation_count > 0 THEN ']' ELSE '' END || ',\"Suggestions\":' || "
            "coalesce((SELECT '[' || string_agg(CAST(to_json(s) AS VARCHAR), ',' ORDER BY n) || "
            "']' FROM advice a WHERE a.repo = totals.repo), 'null') || "
            "',\"Modules\":null,\"Stats\":{\"FilesScanned\":' || violation_count || "
            "',\"DuplicateSets\":' || duplicate_sets || ',\"BrokenBoundaries\":' || "
            "broken_boundaries || ',\"AntiPatterns\":' || anti_patterns || '}}'",
            "totals",
            2,
        ),
    ]
)

_RULES_DOCUMENT = _document(
    [
        _doc_row("'# Rules for ' || repo || ' (' || language || ')'", "totals", 0),
        _doc_row(
            f"chr(10) || {_CONVENTIONS}", f"totals WHERE {_CONVENTIONS} IS NOT NULL", 0, item=10
        ),
        _doc_row(
            "chr(10) || '## ' || title || chr(10) || "
            + _first_sentence("description")
            + " || chr(10) || 'Rule: ' || suggestion",
            "first_rules WHERE nth = 1",
            1,
            at=_PLACE,
        ),
    ]
)

_CONTEXT_DOCUMENT = _document(
    [
        _doc_row(
            "concat('# ', repo, chr(10), total_files, ' files of ', language, ', score ', score)",
            "totals",
            0,
        ),
        _doc_row(
            f"chr(10) || coalesce({_CONVENTIONS}, "
            "'Keep to the conventions that the existing code follows.')",
            "totals",
            0,
            item=10,
        ),
        *[
            _doc_row(
                f"chr(10) || '## {title}'",
                f"totals WHERE {column} > 0",
                1,
                place,
                "-1, '', 0, 0, ''",
            )
            for place, column, title in (
                ("1", "criticals", "Must not spread"),
                ("2", "warnings", "Better avoided"),
            )
        ],
        _doc_row(
            "'* ' || title || CASE WHEN severity = 'CRITICAL' THEN ' (' || "
            + _first_sentence("description")
            + f" || '): ' ELSE ': ' END || {_REMEDY}",
            "v JOIN ranks USING (severity) WHERE severity <> 'INFO'",
            1,
            "sev",
            _PLACE,
        ),
        _doc_row(
            "concat(chr(10), '## Before writing code', chr(10), chr(10), "
            "'1. Search for code that does the same', chr(10), "
            "'2. Make sure the code goes into the right layer', chr(10), "
            "'3. Use the naming of the existing code', chr(10), "
            "'4. Handle every error', chr(10), '5. Keep functions at 80 lines or fewer')",
            "totals",
            2,
        ),
    ]
)

# Change events ---------------------------------------------------------------------------------

_CHANGES = f"""
WITH changes AS (
  SELECT event_type AS repo, {CHANGE_PATH} AS path, {CHANGE_OP} AS op, ts, event_id FROM events
),
changed AS (
  SELECT * FROM changes
  WHERE op = 'write' AND NOT regexp_matches(path, '(vendor|dist)/')
    AND regexp_matches(lower(path), '\\.(go|py|java|ts|tsx|js|jsx|rs)$')
)
"""

ORACLE: dict[str, str] = {
    "flagship": _SECRET_SQL
    + """SELECT source AS repo, count(*) AS total_files, count(path) AS criticals,
      greatest(0, 100 - 15 * count(path)) AS score
    FROM documents LEFT JOIN (SELECT DISTINCT path FROM secrets) ON path = CAST(doc_id AS VARCHAR)
    GROUP BY source""",
    "read_corpus": _BASE + "SELECT repo, path, sha256(text) AS hash FROM visible",
    "line_shapes": _BASE
    + """, raw AS (
      SELECT repo, path, unnest(string_split(text, chr(10))) AS line FROM sources
    )
    SELECT repo, path,
      CAST(sum(CASE WHEN regexp_matches(line, '^[ \\t]*(func|def|function|public|async) ')
        THEN 1 ELSE 0 END) AS BIGINT) AS openings,
      CAST(sum(length(line) - length(ltrim(line, ' ' || chr(9)))) AS BIGINT) AS blanks
    FROM raw GROUP BY repo, path""",
    "skip_dirs": _BASE + "SELECT repo, path FROM visible",
    "exclude": _BASE
    + """SELECT repo, path FROM corpus
    WHERE coalesce(prefix, '') NOT IN ('x/migrations/', 'gen/')
      AND NOT regexp_matches(path, '(^|/)f[^/]*7_0\\.[^/]*(/|$)')
      AND NOT regexp_matches(path, '(^|/)f[^/]_[0-9]\\.py(/|$)')""",
    "exclude_by_repo": _BASE + f"SELECT repo, path FROM corpus WHERE {_KEPT_BY_REPO}",
    "detect_language": _BASE + "SELECT repo, language, n_files FROM languages",
    "source_files": _BASE + "SELECT repo, path, lang FROM sources",
    "text_prefix": """
    WITH cut AS (
      SELECT doc_id, coalesce(TRY(decode(encode(text)[1:4096])), TRY(decode(encode(text)[1:4095])),
        TRY(decode(encode(text)[1:4094])), TRY(decode(encode(text)[1:4093]))) AS prefix
      FROM documents
    )
    SELECT CAST(doc_id AS VARCHAR) AS path, length(prefix) AS n_chars, sha256(prefix) AS hash
    FROM cut""",
    "lines": _LINES + "SELECT CAST(doc_id AS VARCHAR) AS path, line_no, line FROM lines",
    "normalize_line": _LINES
    + "SELECT CAST(doc_id AS VARCHAR) AS path, line_no, normalized FROM normal",
    "block_hash": "SELECT CAST(doc_id AS VARCHAR) AS path, substr(sha256(text), 1, 24) AS hash "
    "FROM documents",
    "preview": _LINES
    + """, shown AS (
      SELECT doc_id, line_no, normalized,
        row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS nth
      FROM normal WHERE normalized <> ''
    )
    SELECT CAST(d.doc_id AS VARCHAR) AS path, '    ' || coalesce(
      string_agg(normalized, chr(10) || '    ' ORDER BY nth), '') || chr(10) || '    ...'
      AS preview
    FROM documents d LEFT JOIN shown s ON s.doc_id = d.doc_id AND nth <= 4 GROUP BY d.doc_id""",
    "first_sentence": "SELECT CAST(doc_id AS VARCHAR) AS path, "
    + _first_sentence("text")
    + " AS sentence FROM documents",
    "secret_hits": _SECRET_SQL + "SELECT repo, path, ord, line FROM secrets",
    "pattern_hits": _BASE
    + f"""SELECT repo, path, {_rule("rule_id")} AS rule_id, nth - 1 AS ord, line
    FROM hits""",
    "capped_locations": _BASE
    + """SELECT repo, path, rule_no, string_agg(path || ':' || line, ' ' ORDER BY nth)
      || CASE WHEN any_value(n) >= 5 THEN ' ...' ELSE '' END AS refs
    FROM hits WHERE nth <= 5 GROUP BY repo, path, rule_no""",
    "rule_languages": _BASE
    + "SELECT repo, language, rule_id, severity FROM languages JOIN (VALUES "
    + ", ".join(
        f"('{rule_id}', '{severity}', '{language}')"
        for rule_id, severity, applies, *_ in _RULES
        for language in applies
    )
    + ") AS r(rule_id, severity, applies) ON applies = language",
    "segment_brace": _BASE
    + "SELECT repo, path, line, line_count, hash, preview FROM blocks WHERE lang <> 'Python'",
    "segment_indent": _BASE
    + "SELECT repo, path, line, line_count, hash, preview FROM blocks WHERE lang = 'Python'",
    "god_function": _BASE + "SELECT repo, path, line, length, name FROM gods",
    "duplicate_groups": _BASE + "SELECT repo, hash, preview, n, severity FROM groups",
    "duplicate_blocks": _BASE
    + "SELECT repo, hash, path, line, n FROM blocks JOIN groups USING (repo, hash)",
    "duplicate_blocks_corpus": _BASE
    + """SELECT hash, repo, path, line, n FROM (
      SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM blocks
    ) WHERE n >= 2""",
    "duplicate_documents": _DOCUMENT_HASHES
    + """SELECT repo, hash, path, n FROM (
      SELECT *, count(*) OVER (PARTITION BY repo, hash) AS n FROM hashes
    ) WHERE n >= 2""",
    "duplicate_documents_corpus": _DOCUMENT_HASHES
    + """SELECT repo, hash, path, n FROM (
      SELECT *, count(*) OVER (PARTITION BY hash) AS n FROM hashes
    ) WHERE n >= 2""",
    "imports": _BASE + "SELECT repo, path, ord, target FROM imports",
    "path_layers": _BASE
    + """SELECT repo, path, CASE dir WHEN 'api' THEN 'presentation'
      WHEN 'service' THEN 'application' WHEN 'domain' THEN 'domain'
      WHEN 'db' THEN 'infrastructure' END AS layer FROM corpus""",
    "import_layers": _BASE + "SELECT repo, path, ord, target, to_layer AS layer FROM layered",
    "boundary_violations": _BASE
    + "SELECT repo, path, ord, target, from_layer, to_layer FROM crossing",
    "page_link_boundaries": f"""
    WITH links AS (
      SELECT url AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target,
        generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS ord
      FROM pages
    ),
    parts AS (
      SELECT path, unnest(string_split(path, '/')) AS part,
        generate_subscripts(string_split(path, '/'), 1) AS nth
      FROM (SELECT DISTINCT path FROM links)
    ),
    placed AS (
      SELECT path, arg_min(layer, nth) AS from_layer
      FROM (SELECT path, nth, {_layer("part")} AS layer FROM parts)
      WHERE layer IS NOT NULL GROUP BY path
    )
    SELECT path, ord, target, from_layer, {_layer("target")} AS to_layer
    FROM links JOIN placed USING (path)
    WHERE (from_layer, {_layer("target")}) IN (('presentation', 'infrastructure'),
      ('presentation', 'domain'), ('application', 'infrastructure'))""",
    "custom_layers": f"""
    WITH links AS (
      SELECT url AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target,
        generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS ord
      FROM pages
    ),
    parts AS (
      SELECT path, unnest(string_split(path, '/')) AS part,
        generate_subscripts(string_split(path, '/'), 1) AS nth
      FROM (SELECT DISTINCT path FROM links)
    ),
    placed AS (
      SELECT path, arg_min(layer, nth) AS from_layer
      FROM (SELECT path, nth, CASE WHEN regexp_matches(part, '(?i)www|//') THEN 'top' WHEN regexp_matches(part, '[0-9]{{2}}') THEN 'deep' WHEN regexp_matches(part, '(?i)[a-z]') THEN 'rest' END AS layer FROM parts)
      WHERE layer IS NOT NULL GROUP BY path
    )
    SELECT path, ord, target, from_layer, CASE WHEN regexp_matches(target, '(?i)www|//') THEN 'top' WHEN regexp_matches(target, '[0-9]{{2}}') THEN 'deep' WHEN regexp_matches(target, '(?i)[a-z]') THEN 'rest' END AS to_layer
    FROM links JOIN placed USING (path)
    WHERE (from_layer, CASE WHEN regexp_matches(target, '(?i)www|//') THEN 'top' WHEN regexp_matches(target, '[0-9]{{2}}') THEN 'deep' WHEN regexp_matches(target, '(?i)[a-z]') THEN 'rest' END) IN (('rest', 'top'), ('deep', 'top'), ('deep', 'rest'), ('rest', 'deep'))""",
    "definitions": _BASE + "SELECT repo, path, line, name FROM defs",
    "identifier_frequency": """
    SELECT lang AS repo, name, count(*) AS n FROM (
      SELECT lang, unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) AS name
      FROM documents
    ) GROUP BY lang, name""",
    "code_identifier_frequency": _BASE
    + """SELECT repo, name, count(*) AS n FROM (
      SELECT repo, unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*')) AS name
      FROM sources
    ) GROUP BY repo, name""",
    "dead_code": _BASE + "SELECT repo, path, line, name FROM dead",
    "naming_go": _BASE + "SELECT repo, caps_files, camel_files FROM go_names",
    "naming_python": _BASE
    + "SELECT repo, camel, snake, camel_examples, snake_examples FROM py_names",
    "python_names": _BASE
    + """SELECT repo, path, CASE WHEN is_camel THEN 'camel' ELSE 'snake' END AS style,
      row_number() OVER (PARTITION BY repo, path, is_camel ORDER BY start_line) - 1 AS pos, name
    FROM py_functions""",
    "scan": _SCAN
    + "SELECT repo, vkey, rule_id, severity, category, path, line, title, n_refs FROM v",
    "scan_references": _SCAN + "SELECT repo, vkey, severity, ref_path, ref FROM refs",
    "scan_with_dead_code": _SCAN
    + """SELECT repo, vkey, category, severity, path, line FROM v
      UNION ALL SELECT repo, 'dead-code:' || path || ':' || line, 'DeadCode', 'WARNING', path, line
      FROM dead""",
    "scan_without_detectors": _BASE
    + """SELECT l.repo, count(s.path) AS total_files, 0 AS violation_count, 0 AS duplicate_sets,
      0 AS broken_boundaries, 0 AS anti_patterns
    FROM languages l LEFT JOIN sources s USING (repo) GROUP BY l.repo""",
    "scan_with_options": _SCAN.replace("END = language\n", f"END = language AND {_KEPT_BY_REPO}\n")
    .replace("n_inner + 1 > 80", "n_inner + 1 > 60")
    .replace("THEN 1 ELSE 2 END >= 8", "THEN 1 ELSE 2 END >= 12")
    + """SELECT repo, vkey, rule_id, severity, category, path, line, title, n_refs FROM v
      WHERE category <> 'BoundaryViolation' OR title = 'Import from infrastructure into presentation'
      UNION ALL SELECT repo, 'go-marker:' || path, 'go-marker', 'CRITICAL', 'AntiPattern', path, 0,
        'Marker in Go', any_value(h.n)
      FROM hits h JOIN (SELECT repo, path FROM sources WHERE lang = 'Go') USING (repo, path)
      WHERE rule_no = 5 GROUP BY repo, path""",
    "custom_rules": """
    WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
        generate_subscripts(string_split(text, chr(10)), 1) AS line
      FROM documents
    ),
    found AS (
      SELECT doc_id, line, 'address' AS rule_id, 'WARNING' AS severity,
        len(regexp_extract_all(t, '[A-Za-z0-9.]+@[A-Za-z0-9]+')) AS n_hits FROM lines
      UNION ALL SELECT doc_id, line, 'licence', 'INFO',
        len(regexp_extract_all(t, '(?i)licen[cs]e')) FROM lines
      UNION ALL SELECT doc_id, line, 'number', 'CRITICAL',
        len(regexp_extract_all(t, '[0-9]{3}[-. ][0-9]{4}')) FROM lines
    )
    SELECT CAST(doc_id AS VARCHAR) AS path, rule_id, severity, line, n_hits FROM found
    WHERE n_hits > 0""",
    "stats": _SCAN
    + """SELECT repo, total_files, violation_count, duplicate_sets, broken_boundaries,
      anti_patterns FROM totals""",
    "suggestions": _SCAN
    + """SELECT repo, coalesce(string_agg(s, '; ' ORDER BY n), '') AS suggestions
    FROM totals LEFT JOIN advice USING (repo) GROUP BY repo""",
    "health_score": _SCAN
    + """SELECT repo, score, CASE WHEN score < 40 THEN 'Critical Drift'
      WHEN score < 70 THEN 'Degraded' WHEN score < 85 THEN 'Fair' ELSE 'Excellent' END AS label
    FROM totals""",
    "gate": _SCAN + "SELECT repo, criticals > 0 AS failed FROM totals",
    "by_severity": _SCAN
    + "SELECT repo, sev, detector, vkey, title FROM v JOIN ranks USING (severity)",
    "worst_offenders": _SCAN
    + """, files AS (
      SELECT repo, ref_path AS file, count(*) AS n, count(*) OVER (PARTITION BY repo) AS several,
        row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, ref_path) AS place
      FROM refs GROUP BY repo, ref_path
    )
    SELECT repo, file, n FROM files WHERE several >= 2 AND place <= 5""",
    "guardrail_rules": _SCAN
    + f"""SELECT repo, category, title, {_first_sentence("description")} AS reason,
      suggestion AS required FROM first_rules WHERE nth = 1""",
    "language_conventions": _BASE
    + f"SELECT repo, language, {_CONVENTIONS} AS conventions FROM languages",
    "report_json": _JSON,
    "report_markdown": _MARKDOWN,
    "guardrail_markdown": _RULES_DOCUMENT,
    "context_markdown": _CONTEXT_DOCUMENT,
    "changed_sources": _CHANGES + "SELECT repo, path, op, event_id FROM changed",
    "debounce": _CHANGES
    + f""", gaps AS (
      SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER by_time <= {EVENT_PAUSE_MS * 1000}
        THEN 0 ELSE 1 END AS starts
      FROM changed WINDOW by_time AS (PARTITION BY repo ORDER BY ts, path)
    ),
    bursts AS (
      SELECT *, sum(starts) OVER (PARTITION BY repo ORDER BY ts, path
        ROWS UNBOUNDED PRECEDING) AS burst FROM gaps
    )
    SELECT repo, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_ts,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts, count(*) AS n,
      last(path ORDER BY ts, path) AS path
    FROM bursts GROUP BY repo, burst""",
    "rescan_stream": _SCAN
    + "SELECT repo, vkey, rule_id, severity, category, path, line, title, n_refs FROM v",
}
ORACLE["debounce_stream"] = ORACLE["debounce"]
