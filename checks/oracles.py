"""SQL counterparts of the registered queries for DuckDB.

They state results in another way wherever that is possible: rules as a union of plain
regular-expression filters, dependencies and syntax findings from how the inputs are built,
range comparisons as joins. Nothing here is shared with the Spark operators but the rule
catalogue.
"""

from __future__ import annotations

from siftguard.config import ScanConfig
from siftguard.operators.rulescan import rule_label
from siftguard.rules import scanner_base, select_rules
from siftguard.rules.advisories import ADVISORIES
from siftguard.rules.remediation import REMEDIES
from siftguard.rules.semantic import SEMANTIC_RULES
from siftguard.sources.rule_files import user_rules

from . import manifests as man
from .derived import FILES_SQL, lines_sql
from .registry import CHUNK, FAMILIES, NOW, PAGE_RULES, SIZE_LIMIT, USER_RULES, many_rules

MARKER = r"(?i)(#|//)\s*(nosec|noqa|siftguard\s*:\s*ignore)(\s*:?\s*(.+))?$"
SNIPPET = r"regexp_replace(text, '\s+$', '')"
OUT = "file, line, severity, title, cwe_id, scanner, code_snippet"


def q(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _values(rules) -> str:
    rows = ", ".join(
        f"({r.rule_ord}, {q(rule_label(r))}, {q(r.severity)}, {r.weight}, {q(r.title)}, {q(r.cwe_id)}, {q(r.description)}, {q(r.fix)})"
        for r in rules)
    return f"(VALUES {rows}) AS r(rule_ord, scanner, severity, sev_weight, title, cwe_id, description, fix)"


def hits(rules, source: str = "kinds") -> str:
    """Findings as a union of one filter per rule. ``source`` has path, kind, line, text."""
    parts = []
    for r in rules:
        tests = [f"regexp_matches(text, {q(r.pattern)})"]
        if r.not_pattern:
            tests.append(f"NOT regexp_matches(text, {q(r.not_pattern)})")
        if r.kind:
            tests.append(f"kind = '{r.kind}'")
        if r.exts:
            tests.append("(" + " OR ".join(f"suffix(path, '{e}')" for e in r.exts) + ")")
        parts.append(f"SELECT path AS file, line, text, {r.rule_ord} AS rule_ord FROM {source} WHERE {' AND '.join(tests)}")
    return f"""SELECT h.file, h.line, r.severity, r.sev_weight, r.title, r.description, {SNIPPET} AS code_snippet, r.cwe_id,
      r.fix, r.scanner, r.rule_ord, h.text FROM ({' UNION ALL '.join(parts)}) h JOIN {_values(rules)} USING (rule_ord)"""


KINDS = """SELECT l.path, l.line, l.text, k.kind FROM lines l JOIN (
    SELECT path, CASE WHEN lower(split_part(path, '/', -1)) = 'dockerfile' THEN 'dockerfile'
      WHEN lower(split_part(path, '/', -1)) IN ('docker-compose.yml', 'docker-compose.yaml') THEN 'compose'
      WHEN suffix(path, '.tf') OR suffix(path, '.hcl') THEN 'terraform'
      WHEN (suffix(path, '.yml') OR suffix(path, '.yaml')) AND contains(content, 'apiVersion:') AND contains(content, 'kind:') THEN 'k8s'
      WHEN (suffix(path, '.yml') OR suffix(path, '.yaml')) AND contains(content, 'services:') THEN 'compose' END AS kind
    FROM files) k USING (path)"""


def _with(**tables: str) -> str:
    return "WITH " + ", ".join(f"{name} AS ({body})" for name, body in tables.items()) + " "


CODE = {"lines": lines_sql(), "files": FILES_SQL, "kinds": KINDS}

# Which template lines the syntax rules must report, told by their text. Files named bad…
# hold a syntax error in every line cycle, so they report nothing.
SEMANTIC_LINES = [
    ("^import os, pickle", "Insecure Import — pickle"), ("^from marshal ", "Insecure Import — marshal"),
    ("^import telnetlib", "Insecure Import — telnetlib (plaintext protocol)"),
    ("^import ftplib", "Insecure Import — ftplib (plaintext FTP)"),
    ("^import cgi", "Insecure Import — cgi module (deprecated, XSS risk)"),
    (r"eval\(expr", "Code Injection — eval() with non-literal argument"),
    (r"exec\( code", "Code Injection — exec() with non-literal argument"),
    (r'os\.system\("ls " \+', "Command Injection — os.system() with dynamic argument"),
    ("shell=True", "Command Injection — subprocess with shell=True"),
    (r'execute\(f"|execute\(".*" \+ k', "SQL Injection — Dynamic Query in execute()"),
    ("debug=True", "Sensitive Data Exposure — Flask debug=True"),
    ("sock.bind", "Network Binding — Listening on 0.0.0.0"),
    (r"assert user.*is_admin", "Security Logic in assert Statement"),
]


def semantic() -> str:
    by_title = {}
    for rule in SEMANTIC_RULES:
        title = rule.title.strip("'")
        if title.startswith("concat("):
            before, after = title.split("'")[1], title.split("'")[3]
            for name in ("eval", "exec", "system", "popen"):
                by_title[before + name + after] = rule
        else:
            by_title[title] = rule
    parts = []
    for pattern, title in SEMANTIC_LINES:
        r = by_title[title]
        weight = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2}[r.severity]
        parts.append(f"""SELECT path AS file, line, '{r.severity}' AS severity, {weight} AS sev_weight, {q(title)} AS title,
          {q(r.description)} AS description, {SNIPPET} AS code_snippet, {q(r.cwe_id)} AS cwe_id, {q(r.fix)} AS fix,
          'ASTScanner' AS scanner, {scanner_base('ast_scanner')} AS rule_ord, text
          FROM lines WHERE suffix(path, '.py') AND NOT contains(path, '/bad') AND regexp_matches(text, {q(pattern)})""")
    return " UNION ALL ".join(parts)


def _rules(*scanners: str, severity: str = "INFO"):
    return select_rules(ScanConfig(enabled_scanners=list(scanners), min_severity=severity))


SUPPRESSED = f"""(regexp_matches(text, '{MARKER}') AND (
    len(list_filter(list_transform(string_split(coalesce(regexp_extract(text, '{MARKER}', 4), ''), ','), lambda x: lower(trim(x))), lambda x: x <> '')) = 0
    OR len(list_filter(list_transform(string_split(coalesce(regexp_extract(text, '{MARKER}', 4), ''), ','), lambda x: lower(trim(x))),
           lambda x: x <> '' AND contains(lower(title), x))) > 0))"""


def _remedy() -> str:
    branches = []
    for r in REMEDIES:
        snippet, extra = r.snippet, ""
        if "(?!" in snippet:  # no lookahead here: look at the text after the last call instead
            snippet = r"yaml\.load\s*\("
            extra = r" AND NOT regexp_matches(regexp_extract(code_snippet, '.*yaml\.load\s*\((.*)$', 1), 'Loader\s*=\s*yaml\.SafeLoader')"
        branches.append(f"WHEN regexp_matches(title, {q(r.title)}) AND regexp_matches(code_snippet, {q(snippet)}){extra} THEN {q(r.text())}")
    return f"CASE {' '.join(branches)} ELSE fix END"


DEDUP = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY file, line, title ORDER BY rule_ord) AS rn
    FROM {source}) WHERE rn = 1"""

RAW = {**CODE, "raw": hits(_rules(*FAMILIES, "iac")) + " UNION ALL " + semantic()}
FOUND = {**RAW, "kept": f"SELECT * FROM raw WHERE NOT {SUPPRESSED}", "single": DEDUP.format(source="kept"),
         "found": f"SELECT * REPLACE ({_remedy()} AS fix) FROM single"}
_EVERY = {**RAW, "pins": man.PINS_SQL, "deps": man.EXPECTED_DEPS, "kept": f"SELECT * FROM raw WHERE NOT {SUPPRESSED}", "single": DEDUP.format(source="kept")}
BASE = """SELECT DISTINCT lower(file) AS f, lower(title) AS t, line + (line * 7 + length(file)) % 9 - 4 AS l FROM found"""
LISTED = """EXISTS (SELECT 1 FROM base WHERE f = lower(file) AND t = lower(title) AND line >= greatest(1, l - 3) AND line <= l + 3)"""

COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))
MODULE = "regexp_extract(file, '/m([0-9]+)/', 1)"
BY_MODULE = f"SELECT {MODULE} AS module, {COUNTS}, count(*) AS total FROM found GROUP BY 1"

PARTS = "(VALUES " + ", ".join(
    f"({i}, {q(p)}, {q(m)}, {q(c)}, {q(s)}, {q(f'{d} Affected up to {m}.')}, {q(f'Move to {p} {x} or later.')})"
    for i, (p, m, c, s, d, x) in enumerate(ADVISORIES)) + ") AS a(adv_ord, apkg, max_version, cve, asev, adesc, afix)"


def _key(version: str) -> str:
    return (f"list_transform(range(1, 5), lambda i: coalesce(try_cast(list_extract("
            f"string_split(replace({version}, '-', '.'), '.'), i) AS BIGINT), 0))")


def _weight(column: str) -> str:
    return f"CASE {column} WHEN 'CRITICAL' THEN 5 WHEN 'HIGH' THEN 4 WHEN 'MEDIUM' THEN 3 ELSE 2 END"


PINS = {"pins": man.PINS_SQL, "deps": man.EXPECTED_DEPS}
ADVISED = {**PINS, "raw": f"""SELECT file, line, asev AS severity, {_weight('asev')} AS sev_weight,
    'Vulnerable Dependency — ' || pkg || ' ' || ver || ' (' || cve || ')' AS title, 'CWE-1035' AS cwe_id,
    'DependencyScanner' AS scanner, code_snippet, i * 100 + adv_ord AS rule_ord, afix AS fix
    FROM deps JOIN {PARTS} ON apkg = pkg_key AND {_key('ver')} <= {_key('max_version')}"""}

# Findings of every scanner over code and manifests.
LINE_FOUND = {**_EVERY, "advised": DEDUP.format(source="(" + ADVISED["raw"] + ")"),
              "found": "SELECT file, line, title, severity, scanner FROM single UNION ALL SELECT file, line, title, severity, scanner FROM advised"}
LINE_RAW = {**LINE_FOUND, "found": f"SELECT file, line, title FROM raw UNION ALL SELECT file, line, title FROM ({ADVISED['raw']})", "base": BASE}
DIFF = {**LINE_FOUND, "base": BASE, "marked": f"SELECT file, line, title, severity, {LISTED} AS known FROM found"}

HISTORY = {"scans": man.HISTORY_SQL, "child": man.HISTORY_FINDINGS_SQL}
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("critical", "high", "medium", "low", "info", "total"))


def _text_lines(table: str, path: str, text: str) -> str:
    """Lines of a text column; the texts are split at line feeds and other breaks alike."""
    broken = f"regexp_replace({text}, '\\r\\n|[\\x0b\\f\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g')"
    return f"""SELECT path, CAST(NULL AS VARCHAR) AS kind, CAST(i AS INTEGER) AS line, parts[i] AS text FROM (
      SELECT path, parts, unnest(range(1, len(parts) + CASE WHEN parts[-1] = '' THEN 0 ELSE 1 END)) AS i FROM (
        SELECT {path} AS path, string_split({broken}, chr(10)) AS parts FROM {table}))"""


DOC_LINES = _text_lines("documents", "'docs/' || CAST(doc_id AS VARCHAR) || '.txt'", "text")
CHAT_LINES = _text_lines("conversations", "'chat/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.txt'", "text")
PAGE_LINES = _text_lines("pages", "'pages/' || CAST(page_id AS VARCHAR) || '.html'", "html")

DEPS_OUT = "SELECT file, manifest, pkg, pkg_key, ver, line, code_snippet FROM deps WHERE manifest = '{}'"
SARIF_ID = "substr(translate(title, ' /—', '__'), 1, 64)"
LEVEL = "CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'none' END"
SCORE = "CASE severity WHEN 'CRITICAL' THEN '9.0' WHEN 'HIGH' THEN '7.0' WHEN 'MEDIUM' THEN '5.0' WHEN 'LOW' THEN '3.0' ELSE '1.0' END"
EDITOR = "CASE severity WHEN 'CRITICAL' THEN 'Error' WHEN 'HIGH' THEN 'Error' WHEN 'MEDIUM' THEN 'Warning' WHEN 'LOW' THEN 'Information' ELSE 'Hint' END"
RELATIVE = "CASE WHEN starts_with(file, 'src/') THEN substr(file, 5) ELSE file END"
FLAGS = ", ".join(f"CAST(sum(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {v}" for k, v in man.EVENT_SEVERITY.items())


def _listing() -> str:
    rules = select_rules(ScanConfig())
    parts = []
    for label in dict.fromkeys(rule_label(r) for r in rules):
        mine = [r for r in rules if rule_label(r) == label]
        gates = sorted({g for r in mine for g in ([r.kind] if r.kind else r.exts)})
        parts.append(f"({q(label)}, {len(mine)}, {q(','.join(gates))})")
    parts += [f"('ASTScanner', {len(SEMANTIC_RULES)}, '.py')", f"('DependencyScanner', {len(ADVISORIES)}, {q(','.join(sorted(m.lower() for m in man.MANIFESTS)))})",
              "('LongLineScanner', 1, '.js,.py')"]
    everything = " UNION ALL ".join(f"SELECT file, scanner FROM ({x})" for x in (hits(rules), semantic(), ADVISED["raw"])) + """
      UNION ALL SELECT path, 'LongLineScanner' FROM lines WHERE (suffix(path, '.py') OR suffix(path, '.js')) AND length(text) > 40"""
    return _with(**CODE, **PINS, raw=everything) + f"""SELECT l.scanner, CAST(l.rules AS BIGINT) AS rules, l.gates,
      CAST(count(raw.file) AS BIGINT) AS hits FROM (VALUES {', '.join(parts)}) AS l(scanner, rules, gates)
      LEFT JOIN raw USING (scanner) GROUP BY ALL"""


def _part(label: str) -> str:
    return f"nullif(regexp_extract(fix, '(?m)^\\s*{label}:\\s*(.+)$', 1), '')"


ORACLES = {
    **{f"scan_{f}": _with(**CODE) + f"SELECT {OUT} FROM ({hits(_rules(f))})" for f in FAMILIES},
    **{f"scan_iac_{k}": _with(**CODE) + f"SELECT {OUT} FROM ({hits([r for r in _rules('iac') if r.kind == k])})"
       for k in ("dockerfile", "compose", "terraform", "k8s")},
    "iac_kind": _with(**CODE) + "SELECT DISTINCT path AS file, coalesce(kind, 'none') AS kind FROM kinds",
    "scan_user_rules": _with(**CODE) + f"SELECT {OUT} FROM ({hits(user_rules(USER_RULES))})",
    "scan_secrets_documents": _with(kinds=DOC_LINES) + f"SELECT {OUT} FROM ({hits(_rules('secrets'))})",
    "scan_secrets_conversations": _with(kinds=CHAT_LINES) + f"SELECT {OUT} FROM ({hits(_rules('secrets'))})",
    "scan_pages": _with(kinds=PAGE_LINES) + f"SELECT {OUT} FROM ({hits([*_rules('xss'), *user_rules(PAGE_RULES)])})",
    "scan_semantic_python": _with(lines=lines_sql()) + f"SELECT {OUT} FROM ({semantic()})",
    "plugin_scan": _with(lines=lines_sql()) + """SELECT path AS file, line, 'INFO' AS severity, 'Long line' AS title,
        'LongLineScanner' AS scanner, text AS code_snippet FROM lines
        WHERE (suffix(path, '.py') OR suffix(path, '.js')) AND length(text) > 40""",
    "corpus_subset": _with(**CODE, changed=lines_sql("(SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01')"))
    + f"SELECT {OUT} FROM ({hits(_rules('sql_injection'))}) WHERE file IN (SELECT path FROM changed)",
    "line_explode": _with(kinds=DOC_LINES) + "SELECT path AS file, line, text FROM kinds",
    "binary_filter": """SELECT 'd' || CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(b) AS BIGINT) AS length,
        CASE WHEN len(list_filter(regexp_extract_all(substr(hex(b), 1, 16384), '..'),
             lambda x: x < '09' OR (x >= '0E' AND x < '20') OR x = '7F')) / least(octet_length(b), 8192)::DOUBLE > 0.30
             THEN 'binary' ELSE 'scanned' END AS status
        FROM (SELECT doc_id, encode(translate(text, 'aeiou', repeat(chr(1), 5))) AS b FROM documents)""",
    "files_scanned_skipped": f"""SELECT lang, count(*) FILTER (WHERE octet_length(encode(text)) <= {SIZE_LIMIT}) AS files_scanned,
        count(*) FILTER (WHERE octet_length(encode(text)) > {SIZE_LIMIT}) AS files_skipped FROM documents GROUP BY lang""",
    **{f"deps_{name}": _with(**PINS) + DEPS_OUT.format(manifest) for name, manifest in {
        "requirements": "requirements.txt", "package_json": "package.json", "poetry_lock": "poetry.lock",
        "pipfile_lock": "pipfile.lock", "yarn_lock": "yarn.lock", "package_lock": "package-lock.json"}.items()},
    "version_key": _with(pins=man.PINS_SQL, odd="""SELECT p_partkey, ver || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-rc1'
        WHEN 2 THEN '.7.9' ELSE 'b2' END AS ver FROM pins""")
    + f"SELECT p_partkey, ver, array_to_string({_key('ver')}, '.') AS ver_key FROM odd",
    "advisory_join": _with(**ADVISED) + f"SELECT {OUT} FROM raw",
    "dependency_findings": _with(**ADVISED) + f"SELECT {OUT} FROM ({DEDUP.format(source='raw')})",
    "osv_severity": f"SELECT advisory_id, severity FROM ({man.EXPECTED_OSV})",
    "osv_fix_version": f"SELECT advisory_id, ecosystem, pkg, ver, fix_version FROM ({man.EXPECTED_OSV})",
    "osv_match": _with(**PINS, eco="SELECT *, CASE WHEN form IN (0, 2, 3) THEN 'PyPI' ELSE 'npm' END AS ecosystem FROM deps",
        osv=f"SELECT ecosystem, pkg, ver, advisory_id, severity, fix_version FROM ({man.EXPECTED_OSV}) UNION ALL {man.RANGE_HITS}")
    + f"""SELECT e.file, e.line, o.severity, 'Vulnerable Dependency — ' || e.pkg || ' ' || e.ver || ' (' || o.advisory_id || ')' AS title,
        'Upgrade ' || e.pkg || ' to >= ' || o.fix_version || '. See: https://osv.dev/vulnerability/' || o.advisory_id AS fix,
        'OSVScanner' AS scanner FROM eco e JOIN osv o USING (ecosystem, pkg, ver)
        UNION ALL SELECT file, line, asev, 'Vulnerable Dependency — ' || pkg || ' ' || ver || ' (' || cve || ')', afix,
        'DependencyScanner(bundled)' FROM eco JOIN {PARTS} ON apkg = pkg_key AND {_key('ver')} <= {_key('max_version')}
        WHERE NOT EXISTS (SELECT 1 FROM osv o WHERE o.ecosystem = eco.ecosystem AND o.pkg = eco.pkg AND o.ver = eco.ver)""",
    "advisory_feed": f"""SELECT a.advisory_id, count(*) AS pins, count(DISTINCT d.ver_key) AS versions FROM ({man.FEED_PINS_SQL}) d
        JOIN ({man.FEED_SQL}) a ON a.pkg_key = d.pkg_key AND d.ver_key <= a.max_key GROUP BY a.advisory_id""",
    "severity_threshold": _with(**CODE) + f"SELECT {OUT} FROM ({hits(_rules(*FAMILIES))}) WHERE sev_weight >= 5",
    "inline_suppress": _with(**RAW) + f"SELECT file, line, title, scanner, {SUPPRESSED} AS suppressed FROM raw",
    "inline_suppress_by_join": _with(**CODE, raw=hits(_rules(*FAMILIES))) + f"SELECT file, line, title, scanner, {SUPPRESSED} AS suppressed FROM raw",
    "persisted_suppress": _with(**LINE_FOUND) + """SELECT file, line, title, severity FROM found
        WHERE title || '::' || file NOT IN (SELECT title || '::' || file FROM found WHERE severity = 'MEDIUM')""",
    "dedup_findings": _with(**RAW) + f"SELECT {OUT} FROM ({DEDUP.format(source='raw')})",
    "remediate": _with(**FOUND) + "SELECT file, line, title, fix FROM found",
    "multiline_fixes": _with(**FOUND) + f"""SELECT file, line, title, {_part('Before')} AS before, {_part('After')} AS after
        FROM found WHERE contains(fix, chr(10))""",
    "baseline_new": _with(**DIFF) + "SELECT file, line, title, severity FROM marked WHERE NOT known",
    "baseline_known": _with(**DIFF) + "SELECT file, line, title, severity FROM marked WHERE known",
    "baseline_expanded": _with(**DIFF) + "SELECT file, line, title, known FROM marked",
    "baseline_saved": _with(**LINE_FOUND) + "SELECT severity, count(*) AS known FROM found GROUP BY severity",
    "severity_counts": _with(**FOUND) + BY_MODULE,
    "verdict": _with(**FOUND, counts=BY_MODULE) + """SELECT module,
        CASE WHEN critical > 0 THEN 'REQUEST_CHANGES' WHEN total > 0 THEN 'COMMENT' ELSE 'APPROVE' END AS verdict,
        CASE WHEN critical > 0 THEN 'REQUEST CHANGES' WHEN high > 0 THEN 'NEEDS REVIEW' WHEN total > 0 THEN 'MINOR ISSUES'
             ELSE 'APPROVED' END AS report_verdict, critical > 0 OR high > 0 AS security_issues_found FROM counts""",
    "ci_gate": _with(**DIFF, modules=f"SELECT DISTINCT {MODULE} AS module FROM (SELECT path AS file FROM files)",
                     fresh=f"SELECT {MODULE} AS module, severity FROM marked WHERE NOT known")
    + """SELECT module, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(severity) AS total,
        CAST(count(*) FILTER (WHERE severity = 'CRITICAL') > 0 AS INTEGER) AS gate
        FROM modules LEFT JOIN fresh USING (module) GROUP BY module""",
    "suppressed_counts": _with(**RAW) + f"""SELECT scanner, count(*) FILTER (WHERE {SUPPRESSED}) AS suppressed_inline,
        count(*) FILTER (WHERE NOT {SUPPRESSED}) AS kept FROM raw GROUP BY scanner""",
    "scanner_listing": _listing(),
    "findings_search": _with(**FOUND) + """SELECT file, line, title, scanner FROM found WHERE severity = 'CRITICAL' AND (
        title ILIKE '%injection%' OR file ILIKE '%injection%' OR description ILIKE '%injection%' OR cwe_id ILIKE '%injection%'
        OR scanner ILIKE '%injection%')""",
    "findings_sorted": _with(**FOUND) + "SELECT scanner, file, line, title, severity FROM found ORDER BY ALL",
    "diagnostics_by_file": _with(**FOUND, rows=f"""SELECT file, greatest(0, line - 1) AS l, {EDITOR} AS level, title, description,
        coalesce(nullif(cwe_id, ''), scanner) AS code FROM found""")
    + """SELECT file, string_agg(concat_ws('|', CAST(l AS VARCHAR), level, code, title), ';'
        ORDER BY l, level, title || chr(10) || description, code) AS diagnostics, count(*) AS n, count(*) AS total FROM rows GROUP BY file""",
    "sarif_rules": _with(**FOUND) + f"""SELECT module, rule_id, title AS name, {LEVEL} AS level, {SCORE} AS score, cwe_id FROM (
        SELECT *, row_number() OVER (PARTITION BY module, rule_id ORDER BY sev_weight DESC, file, line, title) AS rn
        FROM (SELECT *, {MODULE} AS module, {SARIF_ID} AS rule_id FROM found)) WHERE rn = 1""",
    "sarif_results": _with(**FOUND) + f"""SELECT {SARIF_ID} AS rule_id, {LEVEL} AS level, {RELATIVE} AS uri, line AS start_line,
        nullif(code_snippet, '') AS snippet, severity, scanner FROM found""",
    "sarif_metrics": _with(**FOUND, counts=BY_MODULE) + "SELECT module, critical, high, medium, low, total FROM counts",
    "sarif_documents": _with(**FOUND, placed=f"""SELECT *, (row_number() OVER (PARTITION BY scan_id ORDER BY sev_weight DESC, file, line, title) - 1) AS spot
        FROM (SELECT *, {MODULE} AS scan_id, {SARIF_ID} AS rule_id FROM found)""",
        named=f"SELECT scan_id, spot // {CHUNK} AS chunk, rule_id, min(spot) AS first_at FROM placed GROUP BY ALL",
        ruled="SELECT scan_id, chunk, string_agg(rule_id, ';' ORDER BY first_at) AS rules FROM named GROUP BY ALL")
    + f"""SELECT scan_id, spot // {CHUNK} AS chunk, count(*) AS results, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS errors, any_value(rules) AS rules,
        arg_min(rule_id || '@' || file || ':' || line, spot) AS first FROM placed JOIN ruled ON ruled.scan_id = placed.scan_id AND ruled.chunk = spot // {CHUNK} GROUP BY ALL""".replace("SELECT scan_id,", "SELECT placed.scan_id,"),
    "findings_documents": _with(**FOUND, placed=f"""SELECT *, (row_number() OVER (PARTITION BY scan_id ORDER BY sev_weight DESC, file, line, title) - 1) AS spot,
        count(*) OVER (PARTITION BY scan_id) AS total FROM (SELECT *, {MODULE} AS scan_id FROM found)""")
    + f"""SELECT scan_id, spot // {CHUNK} AS chunk, count(*) AS listed, any_value(total) AS total, arg_min(severity || '@' || file || ':' || line, spot) AS first,
        arg_max(severity || '@' || file || ':' || line, spot) AS last FROM placed GROUP BY 1, 2""",
    "snippet_context": _with(**CODE, spots=f"SELECT DISTINCT file, line FROM ({hits(_rules('sql_injection'))})")
    + r"""SELECT s.file, s.line, regexp_replace(string_agg(l.text, chr(10) ORDER BY l.line), '\s+$', '') AS context_snippet
        FROM spots s JOIN lines l ON l.path = s.file AND l.line BETWEEN s.line - 2 AND s.line + 2 GROUP BY s.file, s.line""",
    "daily_trend": _with(**HISTORY) + f"""SELECT CAST(scanned_at AS DATE) AS date, {SUMS}, count(*) AS scan_count FROM scans
        WHERE scanned_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY 1""",
    "history_stats": _with(**HISTORY) + """SELECT count(*) AS total_scans, count(DISTINCT target_path) AS total_projects,
        CAST(sum(total) AS BIGINT) AS total_findings, CAST(sum(critical) AS BIGINT) AS total_critical, max(scanned_at) AS last_scan FROM scans""",
    "top_titles": _with(**HISTORY) + """SELECT title, count(*) AS count FROM child WHERE scan_id IN (
        SELECT scan_id FROM scans ORDER BY scanned_at DESC, scan_id DESC LIMIT 200) GROUP BY title ORDER BY 2 DESC, 1 LIMIT 10""",
    "severity_breakdown": _with(**HISTORY) + f"SELECT {SUMS} FROM scans",
    "distinct_targets": _with(**HISTORY) + "SELECT DISTINCT target_path FROM scans ORDER BY 1",
    "recent_scans": _with(**HISTORY) + "SELECT * FROM scans ORDER BY scanned_at DESC, scan_id DESC LIMIT 100",
    "scan_by_id": _with(**HISTORY) + """SELECT s.scan_id, s.target_path, s.total, c.severity, c.file, c.title
        FROM scans s LEFT JOIN child c USING (scan_id) WHERE s.scan_id = (SELECT min(scan_id) FROM scans)""",
    "history_filter": _with(**HISTORY) + """SELECT scan_id, target_path, critical, total FROM scans
        WHERE contains(lower(target_path), 'proj/1') AND critical > 0""",
    "history_store": _with(**LINE_FOUND) + f"""SELECT 'first' AS scan_id, 'code' AS target_path, 1.235::DOUBLE AS scan_duration,
        count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'HIGH') AS high,
        count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low,
        count(*) AS total, count(*) AS findings FROM found""",
    "suppression_insert": """SELECT finding_hash, title, reason, created_at FROM (SELECT event_type || '::' || CAST(user_id AS VARCHAR) AS finding_hash,
        event_type AS title, CAST(event_id AS VARCHAR) AS reason, ts AS created_at,
        row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS rn
        FROM events WHERE event_type <> 'view') WHERE rn = 1""",
    "full_scan": _with(**LINE_FOUND) + "SELECT scanner, severity, count(*) AS findings FROM found GROUP BY ALL",
    "scan_with_baseline": _with(**LINE_FOUND, base=BASE + " WHERE line % 2 = 0",
        marked=f"""SELECT *, title || '::' || file IN (SELECT title || '::' || file FROM found WHERE severity = 'MEDIUM') AS persisted, {LISTED} AS known FROM found""")
    + f"""SELECT 'suppressed_inline' AS what, (SELECT count(*) FROM raw WHERE {SUPPRESSED}) AS n
        UNION ALL SELECT 'suppressed_persisted', count(*) FILTER (WHERE persisted) FROM marked
        UNION ALL SELECT 'suppressed_by_baseline', count(*) FILTER (WHERE NOT persisted AND known) FROM marked
        UNION ALL SELECT 'reported', count(*) FILTER (WHERE NOT persisted AND NOT known) FROM marked
        UNION ALL SELECT 'new ' || severity, count(*) FROM marked WHERE NOT persisted AND NOT known GROUP BY severity""",
    "tree_files": f"""SELECT lang || '/' || (doc_id % 7) || '/_' || (doc_id % 11) || '/.' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.py' ELSE '.txt' END AS path,
        CAST(octet_length(encode(text)) AS BIGINT) AS length, CASE WHEN octet_length(encode(text)) > {SIZE_LIMIT} THEN 'oversize' END AS skip_reason,
        CASE WHEN octet_length(encode(text)) <= {SIZE_LIMIT} THEN sha256(text) END AS digest FROM documents WHERE doc_id % 3 < 2 AND doc_id % 50 <> 0""",
    "stream_files": _with(kinds=DOC_LINES, raw=hits(_rules("secrets"))) + f"SELECT {OUT} FROM raw WHERE NOT {SUPPRESSED}",
    "flagship": _with(**FOUND) + "SELECT severity, title, count(*) AS findings, count(DISTINCT file) AS files FROM found GROUP BY ALL",
    "stream_scan": _with(kinds=DOC_LINES, raw=hits(_rules("secrets"))) + f"SELECT {OUT} FROM raw WHERE NOT {SUPPRESSED}",
    "stream_dedup": _with(lines=lines_sql("(SELECT DISTINCT l_orderkey FROM lineitem)", "l_orderkey"),
                          kinds="SELECT *, CAST(NULL AS VARCHAR) AS kind FROM lines")
    + f"SELECT file, line, title, severity FROM ({hits(_rules('deserialization'))})",
    "stream_trend": f"SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, {FLAGS}, count(*) AS total, count(*) AS scan_count FROM events GROUP BY 1",
    "stream_trend_sliding": f"""SELECT date_trunc('day', ts)::TIMESTAMP - to_days(CAST(back AS INTEGER)) AS window_start, {FLAGS},
        count(*) AS total, count(*) AS scan_count FROM events, range(7) AS r(back) GROUP BY 1""",
    "stream_precedence": _with(**LINE_FOUND) + f"""SELECT {OUT} FROM ({DEDUP.format(source='raw')}) UNION ALL SELECT {OUT} FROM advised""",
    "stream_baseline": _with(**LINE_RAW) + f"SELECT file, line, title FROM found WHERE NOT {LISTED}",
    "stream_known": _with(**LINE_RAW) + f"SELECT file, line, title FROM found WHERE {LISTED}",
    "history_retry": _with(**HISTORY) + "SELECT s.scan_id, s.total, count(*) AS findings FROM scans s JOIN child c USING (scan_id) GROUP BY ALL",
    "scan_many_rules": _with(kinds=PAGE_LINES, rules="SELECT * FROM (VALUES " + ", ".join(
        f"({q(r.title)}, {q(r.severity)}, {q(r.pattern)}, {q(','.join(r.exts))})" for r in user_rules(many_rules())) + ") AS t(title, severity, pattern, exts)")
    + "SELECT path AS file, line, title, severity FROM kinds JOIN rules ON (exts = '' OR suffix(path, exts)) AND regexp_matches(text, pattern)",
    "cwe_links": _with(**FOUND) + """SELECT cwe_id, count(*) AS findings, max(sev_weight) AS worst,
        'https://cwe.mitre.org/data/definitions/' || split_part(cwe_id, '-', -1) || '.html' AS link
        FROM found WHERE cwe_id IS NOT NULL GROUP BY cwe_id""",
}

ORACLES["history_rollup"] = f"""
    SELECT 'total on ' || date AS what, total AS n FROM ({ORACLES["daily_trend"]}) UNION ALL SELECT 'scans on ' || date, scan_count FROM ({ORACLES["daily_trend"]})
    UNION ALL SELECT 'total_scans', total_scans FROM ({ORACLES["history_stats"]}) UNION ALL SELECT 'total_findings', total_findings FROM ({ORACLES["history_stats"]})
    UNION ALL SELECT 'total_critical', total_critical FROM ({ORACLES["history_stats"]}) UNION ALL SELECT 'projects within 3 %', 1
    UNION ALL SELECT 'title ' || title, "count" FROM ({ORACLES["top_titles"]})"""
