"""Pinned dependencies: extraction from six manifest formats, matching with advisories.

Extraction works inside one row: a manifest is one file, and its state (which package a
version line belongs to) is resolved with array functions. So all six formats take one pass
over the corpus without shuffle or window, and a row is bounded by the size limit for files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import severity as sev
from ..functions.osv import osv_fix_version, osv_intervals, osv_severity
from ..functions.text import SPACES, basename, sql_text, unicode_pattern
from ..functions.versions import SEMANTIC, ordered_version, version_key
from ..rules import SEVERITY_WEIGHTS, scanner_base
from ..rules.advisories import ADVISORIES as BUNDLED
from ..schemas import ADVISORIES, NOTES, RAW_COLUMNS
from ..session import dimension
from .intervals import interval_join, running_totals, stored
from .joins import blocked_join, salted_join
from .lines import drop_last_empty, split_lines

# Manifest file names (lower case) and the registry their packages live in.
ECOSYSTEMS = {"requirements.txt": "PyPI", "poetry.lock": "PyPI", "pipfile.lock": "PyPI",
              "package.json": "npm", "yarn.lock": "npm", "package-lock.json": "npm"}

# How the formats write a pin.
REQUIREMENT = r"^\s*([A-Za-z0-9_\-]+)\s*(?:==|>=|<=|~=|!=)\s*([^\s;#]+)"
POETRY_NAME = r'name\s*=\s*"([^"]+)"'
POETRY_VERSION = r'version\s*=\s*"([^"]+)"'
YARN_NAME = r'^"?([^@"]+)@'
YARN_VERSION = r'^\s+version\s+"([^"]+)"'
RANGE_PREFIX = r"^[\^~>=<\s]+"

DEPENDENCY_CWE = "CWE-1035"
COLUMNS = ["file", "manifest", "pkg", "pkg_key", "ver", "line", "code_snippet", "source_line", "dep_seq"]


def is_manifest(path: Column) -> Column:
    """The suffix test is case-sensitive while the name test is not."""
    suffix = reduce(lambda a, b: a | b, [path.endswith(s) for s in (".txt", ".json", ".lock")])
    return suffix & F.lower(basename(path)).isin(*ECOSYSTEMS)


def _capture(text: str, pattern: str, index: int = 1) -> str:
    return f"regexp_extract({text}, {sql_text(unicode_pattern(pattern))}, {index})"


def _stripped(text: str, side: str = "BOTH") -> str:
    return f"trim({side} {sql_text(SPACES)} FROM {text})"


def _pin(pkg: str, ver: str, line: str, snippet: str, source: str, seq: str) -> str:
    return (f"named_struct('pkg', {pkg}, 'ver', {ver}, 'line', CAST({line} AS INT), 'code_snippet', {snippet}, "
            f"'source_line', {source}, 'dep_seq', CAST({seq} AS BIGINT))")


def _events(name_pattern: str, version_pattern: str, name_index: int = 1, version_index: int = 1) -> str:
    """Array of the lines that carry a name or a version; '' stands for "not on this line"."""
    event = (f"named_struct('line', i + 1, 'text', t, 'name', {_capture('t', name_pattern, name_index)}, "
             f"'ver', {_capture('t', version_pattern, version_index)})")
    return f"filter(transform(_lines, (t, i) -> {event}), e -> e.name <> '' OR e.ver <> '')"


def _owned(pkg: str, glue: str) -> str:
    """Pins of a lock file. A version takes the name of its own line, else that of the event
    right before it, unless a version has used that name up."""
    before = "get(_events, i - 1)"
    owner = f"IF(e.name <> '', e, IF(i > 0 AND {before}.ver = '', {before}, NULL))"
    paired = f"transform(_events, (e, i) -> named_struct('o', {owner}, 'ver', e.ver, 'at', e.line))"
    pin = _pin(pkg, "p.ver", "p.o.line", f"concat({pkg}, '{glue}', p.ver)", "p.o.text", "p.at")
    return f"transform(filter({paired}, p -> p.o IS NOT NULL AND p.ver <> ''), p -> {pin})"


_VERSIONED = "MAP<STRING, STRUCT<version: STRING>>"
_NO_ENTRIES = "CAST(array() AS ARRAY<STRUCT<key: STRING, value: STRUCT<version: STRING>>>)"


def _json(fields: str) -> str:
    options = "map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_malformed', 'allowSingleQuotes', 'false')"
    return f"from_json(content, '{fields}, _malformed STRING', {options})"


# Parsed documents per manifest; the others stay null without being parsed.
_DOCUMENTS = {
    "package.json": ("_package", _json("dependencies MAP<STRING, STRING>, devDependencies MAP<STRING, STRING>")),
    "pipfile.lock": ("_pipfile", _json(f"default {_VERSIONED}, develop {_VERSIONED}")),
    "package-lock.json": ("_locked", _json(f"packages {_VERSIONED}, dependencies {_VERSIONED}")),
}

_SPEC_VERSION = _stripped(f"regexp_replace(e.value, {sql_text(unicode_pattern(RANGE_PREFIX))}, '')")
_LOCKED_NAME = "element_at(split(e.key, 'node_modules/'), -1)"
_PIPFILE_VERSION = _stripped("regexp_replace(coalesce(e.value.version, ''), '^==', '')")


def _last_wins(document: str) -> str:
    """Entries of a parsed map in document order; a repeated key keeps its first place and its last value.

    Repeated keys become neighbours by sorting, so the work grows little faster than the entries.
    """
    numbered = f"array_sort(transform(map_entries({document}), (e, i) -> named_struct('key', e.key, 'i', i, 'value', e.value)))"
    firsts = "filter(s, (x, j) -> j = 0 OR get(s, j - 1).key <> x.key)"
    lasts = "filter(s, (x, j) -> j = size(s) - 1 OR get(s, j + 1).key <> x.key)"
    kept = f"array_sort(zip_with({firsts}, {lasts}, (a, b) -> named_struct('i', a.i, 'key', a.key, 'value', b.value)))"
    return f"transform(flatten(transform(array({numbered}), s -> {kept})), x -> named_struct('key', x.key, 'value', x.value))"


def _entries(array: str, keep: str, pin: str) -> str:
    """Pins of map entries, numbered in document order."""
    return f"filter(transform({array}, (e, i) -> IF({keep}, {pin}, NULL)), p -> p IS NOT NULL)"


# One array of pins per format. A development entry replaces the normal one in package.json,
# Pipfile.lock lists a package of both sections twice, package-lock.json prefers ``packages``.
_PINS = {
    "requirements.txt": "transform(filter(_events, e -> e.name <> ''), e -> " + _pin(
        "lower(e.name)", "e.ver", "e.line", _stripped("e.text", "TRAILING"), "e.text", "e.line") + ")",
    "poetry.lock": _owned("lower(p.o.name)", "=="),
    "yarn.lock": _owned(_stripped("p.o.name"), "@"),
    "package.json": _entries(
        f"concat(filter({_last_wins('coalesce(_package.dependencies, map())')}, e -> NOT array_contains("
        f"map_keys(coalesce(_package.devDependencies, map())), e.key)), {_last_wins('coalesce(_package.devDependencies, map())')})",
        "e.value IS NOT NULL",
        _pin("e.key", _SPEC_VERSION, "1", "concat('\"', e.key, '\": \"', e.value, '\"')", "_lines[0]", "i")),
    "pipfile.lock": _entries(
        f"concat(coalesce({_last_wins('_pipfile.default')}, {_NO_ENTRIES}), coalesce({_last_wins('_pipfile.develop')}, {_NO_ENTRIES}))",
        f"{_PIPFILE_VERSION} <> ''",
        _pin("e.key", _PIPFILE_VERSION, "1", f"concat(e.key, '==', {_PIPFILE_VERSION})", "_lines[0]", "i")),
    "package-lock.json": _entries(
        f"coalesce({_last_wins("IF(array_contains(json_object_keys(content), 'packages'), _locked.packages, _locked.dependencies)")}, {_NO_ENTRIES})",
        f"{_LOCKED_NAME} <> '' AND coalesce(e.value.version, '') <> ''",
        _pin(_LOCKED_NAME, "e.value.version", "1", f"concat({_LOCKED_NAME}, '@', e.value.version)", "_lines[0]", "i")),
}
_EVENTS = {
    "requirements.txt": _events(REQUIREMENT, REQUIREMENT, 1, 2),
    "poetry.lock": _events(POETRY_NAME, POETRY_VERSION),
    "yarn.lock": _events(YARN_NAME, YARN_VERSION),
}


def _by_manifest(branches: dict[str, str]) -> str:
    return "CASE manifest " + " ".join(f"WHEN '{m}' THEN {e}" for m, e in branches.items()) + " END"


def extract_dependencies(files: DataFrame, manifest: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Pins of all manifest formats, or of one, in one narrow pass over the corpus.

    The format of a row picks the branch that is evaluated. A JSON manifest that is malformed
    or no object gives no rows.
    """
    chosen = files.filter(is_manifest(F.col("path")) & F.col("content").isNotNull())
    rows = chosen.select("path", "content", *keep, F.lower(basename(F.col("path"))).alias("manifest"))
    if manifest:
        rows = rows.filter(F.col("manifest") == manifest)
    lines = rows.select("*", split_lines(F.col("content")).alias("_parts"))
    lines = lines.select("path", "content", "manifest", *keep, drop_last_empty(F.col("_parts")).alias("_lines"))
    parsed = [f"CASE WHEN manifest = '{m}' AND content RLIKE '^[ \\\\t\\\\r\\\\n]*[{{]' THEN {parse} END AS {name}"
              for m, (name, parse) in _DOCUMENTS.items()]
    read = lines.selectExpr("*", f"{_by_manifest(_EVENTS)} AS _events", *parsed)
    usable = " AND ".join(f"{name}._malformed IS NULL" for name, _ in _DOCUMENTS.values())
    pins = f"IF({usable}, {_by_manifest(_PINS)}, NULL)"
    out = read.selectExpr("path AS file", "manifest", *keep, f"inline({pins})")
    return out.withColumn("pkg_key", F.lower("pkg")).select(*COLUMNS, *keep)


# ------------------------------------------------------------------ advisories

def _bundled() -> list[dict]:
    return [{"pkg_key": pkg, "max_version": top, "advisory_id": cve, "severity": severity,
             "description": f"{problem} Affected up to {top}.", "fix": f"Move to {pkg} {fixed} or later.", "adv_ord": i}
            for i, (pkg, top, cve, severity, problem, fixed) in enumerate(BUNDLED)]


def advisories(spark: SparkSession) -> DataFrame:
    """The bundled advisory table with its comparable version bound."""
    table = dimension(spark, _bundled(), StructType.fromDDL(ADVISORIES))
    return table.withColumn("max_key", version_key(F.col("max_version")))


def bundled_prose(rule_ord: int) -> list[dict]:
    """What the findings of the bundled table say, by the place of the advisory."""
    label = {r["adv_ord"]: r["severity"].upper() if r["severity"].upper() in SEVERITY_WEIGHTS else "MEDIUM" for r in _bundled()}
    return [{"rule_ord": rule_ord, "note": r["adv_ord"], "severity": label[r["adv_ord"]], "sev_weight": SEVERITY_WEIGHTS[label[r["adv_ord"]]],
             "description": r["description"], "cwe_id": DEPENDENCY_CWE, "fix": r["fix"], "scanner": "DependencyScanner"} for r in _bundled()]


def match_advisories(deps: DataFrame, table: DataFrame) -> DataFrame:
    """Pins joined to every advisory whose bound they do not exceed.

    The planner broadcasts the advisory table while it is small. A large table is met by the
    distinct (package, version) pairs instead, see :func:`resolve`.
    """
    pins = deps.withColumn("ver_key", version_key(F.col("ver")))
    notes = table.withColumnsRenamed({"severity": "adv_severity", "pkg_key": "_pkg"})
    condition = (F.col("pkg_key") == F.col("_pkg")) & (F.col("ver_key") <= F.col("max_key"))
    return pins.join(notes, condition, "inner").drop("_pkg")


def match_advisory_feed(deps: DataFrame, table: DataFrame) -> DataFrame:
    """What ``match_advisories`` gives, for advisory tables that are no small dimension.

    Distinct (package, version key) pairs meet the bounds in bins of version prefixes; the pins come back by a salted join,
    since one pin may own a large share of all rows.
    """
    pins = deps.withColumn("ver_key", version_key(F.col("ver")))
    notes = table.withColumnRenamed("severity", "adv_severity")
    bounds = notes.withColumns({"low": F.lit(None).cast("array<bigint>"), "high": F.col("max_key"), "high_included": F.lit(True)})
    found = interval_join(pins.select("pkg_key", F.col("ver_key").alias("key")), bounds, ["pkg_key"])
    found = found.withColumnRenamed("key", "ver_key").drop("low", "high", "high_included")
    return salted_join(pins, found, ["pkg_key", "ver_key"], "inner", F.struct("file", "line"))


def count_advisory_feed(deps: DataFrame, table: DataFrame) -> DataFrame:
    """Per advisory of a feed with any, the ``pins`` and the distinct ``versions`` that ``match_advisories`` pairs it with, without the pairs.

    Pins and advisories of a package multiply, so the pairs outgrow both tables. Counts need none: pins are added up per distinct version, and
    a bound is answered by the running totals of its package up to it. Rows of the feed are told apart by ``advisory_id``, ``pkg_key`` and ``max_key``.
    """
    known = "pkg_key is not null and key is not null"
    pins = deps.select("pkg_key", version_key(F.col("ver")).alias("key"), F.lit(1).cast("bigint").alias("pins"), F.lit(False).alias("asked"))
    bounds = table.select("pkg_key", F.col("max_key").alias("key"), F.lit(0).cast("bigint").alias("pins"), F.lit(True).alias("asked"))
    places = pins.unionByName(bounds).where(known).groupBy("pkg_key", "key").agg(F.sum("pins").alias("pins"), F.max("asked").alias("asked"))
    places = places.withColumn("versions", (F.col("pins") > 0).cast("bigint"))
    totals = running_totals(places, ["pkg_key"], "key", ["pins", "versions"]).where("asked and pins > 0").drop("asked")
    # One bound of a popular package may stand in a large share of the feed.
    notes = table.withColumnRenamed("max_key", "key")
    return salted_join(notes, totals, ["pkg_key", "key"], "inner", F.col("advisory_id")).withColumnRenamed("key", "max_key").select(*table.columns, "pins", "versions")


def _vulnerable_title(advisory: Column) -> Column:
    return F.concat(F.lit("Vulnerable Dependency — "), F.col("pkg"), F.lit(" "), F.col("ver"),
                    F.lit(" ("), advisory, F.lit(")"))


def dependency_findings(deps: DataFrame, table: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Raw findings of the bundled table."""
    hits = match_advisories(deps, table)
    severity = sev.normalise(F.col("adv_severity"))
    return hits.select(
        "file", "line", severity.alias("severity"), sev.weight(severity).alias("sev_weight"),
        _vulnerable_title(F.col("advisory_id")).alias("title"), "description", "code_snippet",
        F.lit(DEPENDENCY_CWE).alias("cwe_id"), "fix", F.lit("DependencyScanner").alias("scanner"),
        F.lit(scanner_base("dependencies")).cast("bigint").alias("rule_ord"),
        (F.col("dep_seq") * NOTES + F.col("adv_ord")).cast("bigint").alias("emit_seq"), "source_line", *keep,
    ).select(*RAW_COLUMNS, *keep)


def osv_index(records: DataFrame) -> DataFrame:
    """Vulnerability records per exact (ecosystem, package, version)."""
    text = F.coalesce("summary", F.lit(None).cast("string"))
    flat = records.select(
        F.coalesce("id", F.lit("UNKNOWN")).alias("advisory_id"), text.alias("summary"), "details",
        osv_severity(F.col("severity")).alias("adv_severity"), osv_fix_version(F.col("affected")).alias("fix_version"),
        F.explode("affected").alias("a"))
    return flat.select(
        F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("pkg"),
        F.explode("a.versions").alias("ver"), "advisory_id", "summary", "details", "adv_severity", "fix_version",
    ).distinct()


def osv_ranges(records: DataFrame) -> DataFrame:
    """Affected intervals per (ecosystem, package, semantic): see ``osv_intervals``. Ranges over commits have no versions and are left out.

    Versions of a range of type SEMVER are semantic versions, and so are all of some ecosystems; the others compare by the general rule.
    """
    flat = records.select(
        F.coalesce("id", F.lit("UNKNOWN")).alias("advisory_id"), "summary", "details", osv_severity(F.col("severity")).alias("adv_severity"),
        osv_fix_version(F.col("affected")).alias("fix_version"), F.explode("affected").alias("a"))
    flat = flat.select("*", F.explode("a.ranges").alias("r")).where("coalesce(upper(r.type), '') <> 'GIT'")
    semantic = F.coalesce(F.upper("r.type") == "SEMVER", F.lit(False)) | F.coalesce(F.col("a.package.ecosystem").isin(*SEMANTIC), F.lit(False))
    flat = flat.withColumn("semantic", semantic)
    return flat.select(
        F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("pkg"), "semantic", *_RECORD,
        F.inline(osv_intervals(F.col("r.events"), F.col("semantic")))).distinct()


_KEY = ["ecosystem", "pkg", "ver"]
_RECORD = ["advisory_id", "summary", "details", "adv_severity", "fix_version"]

# Fixed value: how much of an advisory's text a finding shows.
SHOWN = 300


def _in_ranges(wanted: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows like those of ``osv_index`` for pins that lie in an affected interval; a record may come once per interval.

    A popular package with thousands of records is met in bins of its versions, not as one group.
    """
    group = ["ecosystem", "pkg", "semantic"]
    keyed = wanted.withColumn("semantic", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "key", ordered_version(F.col("ver"), F.col("semantic")))
    found = interval_join(keyed, ranges, group)
    return keyed.join(found, [*group, "key"]).select(*wanted.columns, *_RECORD)


def _shortened(text: Column) -> Column:
    """The part of a text that findings show; a longer text is followed by its fingerprint, which tells records apart."""
    return F.when(F.length(text) > SHOWN, F.concat(F.substring(text, 1, SHOWN), F.md5(text))).otherwise(text)


def _wanted(deps: DataFrame) -> DataFrame:
    """The distinct (ecosystem, package, version) with the number of their ``pins``, stored, so that the manifests are read for them once."""
    return stored(deps.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("pins")), "wanted")


def resolve(deps: DataFrame, osv: DataFrame, table: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Advisories per distinct (ecosystem, package, version).

    Records win, by exact version or by an affected range; the bundled ranges count only
    where there is none. Each key is looked up once, however often it is pinned: the distinct keys are stored first, so
    the manifests are read for them once.
    """
    return _resolved(_wanted(deps).select(*_KEY), osv, table, ranges)


def _resolved(wanted: DataFrame, osv: DataFrame, table: DataFrame, ranges: DataFrame | None) -> DataFrame:
    # A key meets as many records as its package has, so texts are cut before.
    cut = {c: _shortened(F.col(c)) for c in ("summary", "details")}
    exact = wanted.join(osv.select(*_KEY, *_RECORD).withColumns(cut), _KEY)
    if ranges is not None:
        exact = exact.unionByName(_in_ranges(wanted, ranges.withColumns(cut))).distinct()
    exact = stored(exact, "resolved")
    rest = wanted.join(exact.select(*_KEY).distinct(), _KEY, "left_anti").withColumn("pkg_key", F.lower("pkg"))
    summary = F.coalesce("summary", F.concat(F.lit("Vulnerability in "), F.col("pkg"), F.lit(" "), F.col("ver")))
    exact = exact.select(
        *_KEY, "advisory_id", F.col("adv_severity").alias("severity"),
        F.substring(F.coalesce("details", summary), 1, SHOWN).alias("description"),
        F.concat(F.lit("Upgrade "), F.col("pkg"), F.lit(" to >= "), F.col("fix_version"),
                 F.lit(". See: https://osv.dev/vulnerability/"), F.col("advisory_id")).alias("fix"),
        F.lit("OSVScanner").alias("scanner"), F.lit(0).alias("adv_ord"))
    ranged = match_advisories(rest, table).select(
        *_KEY, "advisory_id", sev.normalise(F.col("adv_severity")).alias("severity"), "description", "fix",
        F.lit("DependencyScanner(bundled)").alias("scanner"), "adv_ord")
    return exact.unionByName(ranged)


def with_ecosystem(deps: DataFrame) -> DataFrame:
    choice = None
    for manifest, ecosystem in ECOSYSTEMS.items():
        test = F.col("manifest") == manifest
        choice = F.when(test, ecosystem) if choice is None else choice.when(test, ecosystem)
    return deps.withColumn("ecosystem", choice)


def osv_findings(deps: DataFrame, osv: DataFrame, table: DataFrame, ranges: DataFrame | None = None, keep: list[str] = ()) -> DataFrame:
    """Raw findings where records (see ``osv_index`` and ``osv_ranges``) take precedence over the bundled ranges.

    Looking up the distinct keys runs at once (see ``resolve``); the findings themselves are lazy.

    A popular pin may own a large share of all rows and has up to as many records as its package, so findings grow with the product: on the way
    back from the distinct keys both sides meet in blocks (see ``blocked_join``), and what a finding says is put together once per key and record.
    """
    pins = with_ecosystem(deps)
    wanted = _wanted(pins)
    resolved = _resolved(wanted.select(*_KEY), osv, table, ranges).withColumn("_title", _vulnerable_title(F.col("advisory_id")))
    found = resolved.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("lefts"))
    sizes = stored(wanted.withColumnRenamed("pins", "rights").join(found, _KEY, "left").fillna(0, "lefts"), "sizes")
    hits = blocked_join(resolved, pins, _KEY, sizes, F.struct("advisory_id", "fix", "severity"), F.struct("file", "line", "dep_seq"))
    return hits.select(
        "file", "line", "severity", sev.weight(F.col("severity")).alias("sev_weight"),
        F.col("_title").alias("title"), "description", "code_snippet",
        F.lit(DEPENDENCY_CWE).alias("cwe_id"), "fix", "scanner",
        F.lit(scanner_base("dependencies")).cast("bigint").alias("rule_ord"),
        (F.col("dep_seq") * NOTES + F.col("adv_ord")).cast("bigint").alias("emit_seq"), "source_line", *keep,
    ).select(*RAW_COLUMNS, *keep)
