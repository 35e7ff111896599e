"""Table contracts, as DDL text."""

#: One row per file. ``content`` is null where ``skip_reason`` is set.
FILES = "path string, length bigint, content string, skip_reason string"

FINDINGS = (
    "file string, line int, severity string, sev_weight int, title string, description string, "
    "code_snippet string, cwe_id string, fix string, scanner string, rule_ord bigint")

#: Findings before suppression and de-duplication. ``source_line`` is the text of the
#: finding's own line (null if there is none), so suppression needs no join.
RAW_FINDINGS = FINDINGS + ", emit_seq bigint, source_line string"

#: ``emit_seq`` is an order times this, plus the number of the prose that belongs to the finding within its ``rule_ord``.
NOTES = 1000

FINDING_COLUMNS = [part.split()[0] for part in FINDINGS.split(", ")]
RAW_COLUMNS = [part.split()[0] for part in RAW_FINDINGS.split(", ")]

RULES = (
    "rule_ord bigint, rule_id string, scanner string, label string, exts array<string>, kind string, "
    "pattern string, not_pattern string, severity string, sev_weight int, title string, "
    "cwe_id string, description string, fix string, enabled boolean")

ADVISORIES = (
    "pkg_key string, max_version string, advisory_id string, severity string, "
    "description string, fix string, adv_ord int")

OSV_RECORD = (
    "id string, summary string, details string, severity array<struct<score string>>, "
    "affected array<struct<package struct<name string, ecosystem string>, versions array<string>, "
    "ranges array<struct<type string, events array<struct<introduced string, fixed string, last_affected string, `limit` string>>>>>>")

BASELINE_ENTRY = "file string, line int, title string, severity string, scanner string"

SUPPRESSIONS = (
    "finding_hash string, title string, file_pattern string, reason string, created_at timestamp")
