"""Dependency manifests, an advisory feed and a scan history derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftguard.rules.advisories import ADVISORIES

from .derived import load

PER_FILE = 20
PACKAGES = [*dict.fromkeys(a[0] for a in ADVISORIES), "Flask-Login", "numpy", "React", "left-pad"]
MANIFESTS = ["requirements.txt", "package.json", "poetry.lock", "Pipfile.lock", "yarn.lock", "package-lock.json"]
EVENT_SEVERITY = {"error": "critical", "purchase": "high", "signup": "medium", "click": "low", "view": "info"}

# One statement for both engines: integer division is written with floor.
_VERSION = "CAST(p_size % 6 AS {s}) || '.' || CAST(p_partkey % 30 AS {s}) || '.' || CAST(p_size % 10 AS {s})"


def _pins_sql(string: str) -> str:
    names = ", ".join(f"'{p}'" for p in PACKAGES)
    array = f"element_at(array({names}), CAST(p_partkey % {PER_FILE} + 1 AS INT))" if string == "STRING" \
        else f"(ARRAY[{names}])[CAST(p_partkey % {PER_FILE} + 1 AS INT)]"
    return f"""
    SELECT p_partkey, CAST(floor(p_partkey / {PER_FILE}) AS BIGINT) AS f, CAST(p_partkey % {PER_FILE} AS INT) AS i,
           {array} AS pkg, {_VERSION.format(s=string)} AS ver,
           CAST(floor(p_partkey / {PER_FILE}) AS BIGINT) % {len(MANIFESTS)} AS form
    FROM part"""


PINS_SQL = _pins_sql("VARCHAR")


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    return spark.sql(_pins_sql("STRING").replace("FROM part", "FROM {part}"), part=part)


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per 20 parts, in one of six formats by file number."""
    rows = pins(spark, sf_dir)
    pkg, ver = F.col("pkg"), F.col("ver")

    def join(entry, sep, keep=None):
        value = entry if keep is None else F.when(keep, entry)
        parts = F.sort_array(F.collect_list(F.when(value.isNotNull(), F.struct(F.col("i"), value.alias("t")))))
        return F.array_join(F.transform(parts, lambda p: p["t"]), sep)

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    even, odd = F.col("i") % 2 == 0, F.col("i") % 2 == 1
    spec = text('"', pkg, '": "^', ver, '"')
    spec2 = text('"', pkg, '": "~', ver, '"')
    pinned = text('"', pkg, '": {"version": "==', ver, '"}')
    nested = text('"node_modules/a/node_modules/', pkg, '": {"version": "', ver, '"}')
    flat = text('"', pkg, '": {"version": "', ver, '"}')
    form = F.col("form")
    content = (
        F.when(form == 0, join(text(pkg, "==", ver), "\n"))
        .when(form == 1, text('{"dependencies": {', join(spec, ", ", even), '}, "devDependencies": {', join(spec2, ", ", odd), "}}"))
        .when(form == 2, join(text('[[package]]\nname = "', pkg, '"\nversion = "', ver, '"\n'), "\n"))
        .when(form == 3, text('{"default": {', join(pinned, ", ", even), '}, "develop": {', join(pinned, ", ", odd), "}}"))
        .when(form == 4, join(text(pkg, "@^1.0:\n  version \"", ver, "\"\n"), "\n"))
        .when(F.col("f") % 4 < 2, text('{"packages": {"": {"version": "1.0.0"}, ', join(nested, ", "), "}}"))
        .otherwise(text('{"dependencies": {', join(flat, ", "), "}}")))
    names = F.element_at(F.array(*[F.lit(m) for m in MANIFESTS]), (form + 1).cast("int"))
    grouped = rows.groupBy("f", "form").agg(content.alias("content"))
    return grouped.select(
        F.concat(F.lit("proj/p"), F.col("f").cast("string"), F.lit("/"), names).alias("path"),
        F.octet_length("content").cast("bigint").alias("length"), "content",
        F.lit(None).cast("string").alias("skip_reason"))


#: What each format must yield, told from the construction rather than from the text.
EXPECTED_DEPS = f"""
    SELECT 'proj/p' || CAST(f AS VARCHAR) || '/' || (ARRAY[{', '.join(f"'{m}'" for m in MANIFESTS)}])[CAST(form + 1 AS INT)] AS file,
           lower((ARRAY[{', '.join(f"'{m}'" for m in MANIFESTS)}])[CAST(form + 1 AS INT)]) AS manifest,
           CASE WHEN form IN (0, 2) THEN lower(pkg) ELSE pkg END AS pkg, lower(pkg) AS pkg_key, ver,
           CAST(CASE form WHEN 0 THEN i + 1 WHEN 2 THEN 4 * i + 2 WHEN 4 THEN 3 * i + 1 ELSE 1 END AS INT) AS line,
           CASE form WHEN 0 THEN pkg || '==' || ver
                     WHEN 1 THEN '"' || pkg || '": "' || CASE WHEN i % 2 = 0 THEN '^' ELSE '~' END || ver || '"'
                     WHEN 2 THEN lower(pkg) || '==' || ver WHEN 3 THEN pkg || '==' || ver
                     ELSE pkg || '@' || ver END AS code_snippet, form, i, p_partkey
    FROM pins"""


def osv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OSV record per part as JSON text."""
    statement = _osv_sql("STRING").replace("{", "{{").replace("}", "}}").replace("FROM pins", "FROM {pins}")
    return spark.sql(statement, pins=osv_pins(spark, sf_dir))


def osv_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    return spark.sql(_osv_pins_sql("STRING").replace("FROM part", "FROM {part}"), part=part)


def _osv_pins_sql(string: str) -> str:
    shifted = f"CAST(p_size % 6 AS {string}) || '.' || CAST(p_partkey % 30 AS {string}) || '.' || CAST((p_size + p_partkey % 2) % 10 AS {string})"
    return _pins_sql(string).replace(_VERSION.format(s=string), shifted)


def _osv_sql(string: str) -> str:
    return f"""
    SELECT p_partkey, pkg, ver, CASE WHEN form IN (0, 2, 3) THEN 'PyPI' ELSE 'npm' END AS ecosystem,
      '{{"id": "OSV-' || CAST(p_partkey AS {string}) || '", "summary": "problem ' || CAST(p_partkey AS {string}) || '", "severity": ['
      || CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '{{"score": "9.8"}}, {{"score": "1.0"}}' WHEN 2 THEN '{{"score": "7.0"}}'
         WHEN 3 THEN '{{"score": "5.5"}}' WHEN 4 THEN '{{"score": "2.1"}}' WHEN 5 THEN '{{"score": "CVSS high"}}'
         ELSE '{{"score": "unknown"}}' END
      || '], "affected": [{{"package": {{"name": "' || pkg || '", "ecosystem": "' || CASE WHEN form IN (0, 2, 3) THEN 'PyPI' ELSE 'npm' END
      || '"}}, "versions": ["' || ver || '"], "ranges": ['
      || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '{{"type": "GIT", "events": [{{"introduced": "0"}}, {{"fixed": "8.1"}}, {{"fixed": "8.2"}}]}}'
         ELSE '{{"events": [{{"fixed": "9.1"}}]}}, {{"events": [{{"fixed": "9.2"}}, {{"fixed": "9.3"}}]}}, {{"type": "GIT", "events": [{{"introduced": "1"}}]}}' END
      || ']}}]}}' AS record
    FROM pins"""


#: Expected reading of each record, told from the construction.
EXPECTED_OSV = f"""
    SELECT 'OSV-' || CAST(p_partkey AS VARCHAR) AS advisory_id,
           CASE WHEN form IN (0, 2, 3) THEN 'PyPI' ELSE 'npm' END AS ecosystem, pkg, ver,
           CASE p_partkey % 7 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM'
                WHEN 5 THEN 'HIGH' ELSE 'LOW' END AS severity,
           CASE p_partkey % 3 WHEN 0 THEN 'latest' WHEN 1 THEN '8.1' ELSE '9.2' END AS fix_version,
           'problem ' || CAST(p_partkey AS VARCHAR) AS summary
    FROM ({_osv_pins_sql("VARCHAR")})"""


#: Range-only records by p_partkey % 8: ranges of a type, each with its events (kind, version, its sort key of four numbers) in the
#: order listed. A pre-release has -1 as its last number; a and b are the first two parts of the pin's version.
_A, _B = "p_size % 6", "p_partkey % 30"
_FROM_ZERO = ("introduced", "'0'", "[-1, 0, 0, 0]")


def _at(kind: str, a: str, b: str, c: str | None = None, tail: str = "") -> tuple[str, str, str]:
    parts = [f"CAST(({x}) AS STRING)" for x in (a, b, c) if x is not None]
    version = " || '.' || ".join(parts) + (f" || '{tail}'" if tail else "")
    return kind, version, f"[{a}, {b}, {c or 0}, {-1 if tail else 0}]"


RANGES = [
    [("ECOSYSTEM", [_at("introduced", _A, _B, "0"), _at("fixed", _A, f"{_B} + 1", "0")])],
    [("SEMVER", [_at("introduced", "5", f"{_B} + 25")])],
    [("ECOSYSTEM", [_FROM_ZERO, _at("fixed", "0", "p_partkey % 3"), _at("introduced", _A, _B), _at("last_affected", _A, _B, "5")])],
    [("GIT", [_FROM_ZERO]), ("ECOSYSTEM", [_at("introduced", _A, _B, "3"), _at("fixed", _A, _B, "4")])],
    [("SEMVER", [_at("fixed", "0", "p_partkey % 3"), _FROM_ZERO])],
    [("ECOSYSTEM", [_at("last_affected", _A, _B, "7"), _at("fixed", "0", "2"), _at("introduced", _A, _B, "5"), _FROM_ZERO])],
    [("SEMVER", [_at("introduced", _A, _B, "0", "-alpha"), _at("fixed", _A, _B, "1", "-rc.1")])],
    [("ECOSYSTEM", [_FROM_ZERO, _at("limit", "0", "p_partkey % 4")])],
]


def _ranges_json(ranges) -> str:
    shown = []
    for kind, events in ranges:
        listed = " || ', ' || ".join(f"""'{{"{name}": "' || {version} || '"}}'""" for name, version, _ in events)
        shown.append(f"""'{{"type": "{kind}", "events": [' || {listed} || ']}}'""")
    return " || ', ' || ".join(shown)


def range_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OSV record per part that lists no versions, only ranges."""
    choice = " ".join(f"WHEN {k} THEN {_ranges_json(r)}" for k, r in enumerate(RANGES))
    part = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = spark.sql(_pins_sql("STRING").replace("FROM part", "FROM {part}").replace("SELECT p_partkey", "SELECT p_size, p_partkey"), part=part)
    return rows.selectExpr("p_partkey", f"""'{{"id": "RNG-' || CAST(p_partkey AS STRING) || '", "summary": "range", "affected": [{{"package": {{"name": "' || pkg
        || '", "ecosystem": "' || CASE WHEN form IN (0, 2, 3) THEN 'PyPI' ELSE 'npm' END || '"}}, "ranges": [' || CASE p_partkey % {len(RANGES)} {choice} END || ']}}]}}' AS record""")


def _events_sql() -> str:
    """Every event of every versioned range as a row; the fix is the first fixed one of a range, of the last range that has one."""
    rows = []
    for k, ranges in enumerate(RANGES):
        fixes = [next((v for name, v, _ in events if name == "fixed"), None) for _, events in ranges]
        fix = next((f for f in reversed(fixes) if f), "'latest'")
        for n, (kind, events) in enumerate(ranges):
            for at, (name, _, key) in enumerate(events if kind != "GIT" else []):
                rows.append(f"SELECT p_partkey, pkg, form, {n} AS n, {at} AS at, '{name}' AS event, {key} AS key, {fix} AS fix_version FROM sized WHERE p_partkey % {len(RANGES)} = {k}")
    return " UNION ALL ".join(rows).replace("STRING", "VARCHAR")


#: Range records that hit a pin, judged by the rule itself: the latest event at or before the version opens, and every limit is beyond it, or one at least.
#: A last affected version takes effect right after itself.
RANGE_HITS = f"""
    SELECT DISTINCT ecosystem, pkg, ver, 'RNG-' || CAST(p_partkey AS VARCHAR) AS advisory_id, 'HIGH' AS severity, fix_version FROM (
      SELECT e.p_partkey, d.ecosystem, d.pkg, d.ver, e.n, any_value(e.fix_version) AS fix_version,
        arg_max(e.event, [e.key, [CASE e.event WHEN 'last_affected' THEN 1 ELSE 0 END, e.at]]) FILTER (
          e.event <> 'limit' AND (e.key < d.key OR (e.key = d.key AND e.event <> 'last_affected'))) AS latest,
        coalesce(bool_or(d.key < e.key) FILTER (e.event = 'limit'), true) AS within
      FROM (SELECT DISTINCT ecosystem, pkg, ver, list_transform(string_split(ver, '.'), lambda x: x::BIGINT) || [0] AS key FROM eco) d
      JOIN ({_events_sql().replace("FROM sized", f"FROM ({PINS_SQL.replace('SELECT p_partkey', 'SELECT p_size, p_partkey')})")}) e
        ON e.pkg = d.pkg AND d.ecosystem = CASE WHEN e.form IN (0, 2, 3) THEN 'PyPI' ELSE 'npm' END
      GROUP BY ALL) WHERE latest = 'introduced' AND within"""


# ------------------------------------------------------------------ advisories at the scale of a feed

#: Every line item is a pin and every order an advisory. A tenth of the pins name one package, whose versions lie apart so that its
#: advisories, bounded low, meet few of them.
_FEED_PKG = "CASE WHEN {0} % 10 = 0 THEN 'hot' ELSE 'p' || CAST({0} % 211 AS {s}) END"
FEED_PINS_SQL = f"""SELECT {_FEED_PKG.format("l_partkey", s="VARCHAR")} AS pkg_key, [l_orderkey % 40, l_partkey % 50, l_linenumber, 0] AS ver_key FROM lineitem"""
FEED_SQL = f"""SELECT {_FEED_PKG.format("o_orderkey", s="VARCHAR")} AS pkg_key, 'ADV-' || CAST(o_orderkey AS VARCHAR) AS advisory_id,
    [0, o_custkey % 60, 9, 0] AS max_key FROM orders"""


def feed_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = "concat_ws('.', l_orderkey % 40, l_partkey % 50, l_linenumber)"
    return load(spark, sf_dir, "lineitem").selectExpr(
        "concat('f', l_orderkey) AS file", "CAST(l_linenumber AS INT) AS line", f"{_FEED_PKG.format('l_partkey', s='STRING')} AS pkg_key", f"{version} AS ver")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(
        f"{_FEED_PKG.format('o_orderkey', s='STRING')} AS pkg_key", "concat('ADV-', o_orderkey) AS advisory_id", "'HIGH' AS severity",
        "array(0L, CAST(o_custkey % 60 AS BIGINT), 9L, 0L) AS max_key")


# ------------------------------------------------------------------ scan history

def history_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per user and day of ``events``; the event type stands for the severity."""
    events = load(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    day = F.to_date("ts")
    counts = [F.count_if(F.col("event_type") == kind).alias(label) for kind, label in EVENT_SEVERITY.items()]
    grouped = events.groupBy("user_id", day.alias("day")).agg(
        F.max("ts").alias("scanned_at"), *counts, F.count(F.lit(1)).alias("total"))
    return grouped.select(
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"), F.col("day").cast("string")).alias("scan_id"),
        F.concat(F.lit("proj/"), F.col("user_id").cast("string")).alias("target_path"), "scanned_at",
        F.col("total").alias("files_scanned"), F.lit(0).cast("bigint").alias("files_skipped"),
        (F.col("total") / 8).alias("scan_duration"), *EVENT_SEVERITY.values(), "total")


def history_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child table: one finding per event."""
    events = load(spark, sf_dir, "events")
    severity = None
    for kind, label in EVENT_SEVERITY.items():
        test = F.col("event_type") == kind
        severity = F.when(test, label.upper()) if severity is None else severity.when(test, label.upper())
    weight = {label: 5 - i for i, label in enumerate(EVENT_SEVERITY.values())}
    sev_weight = F.element_at(F.create_map(*[x for k, v in weight.items() for x in (F.lit(k.upper()), F.lit(v))]), "severity")
    user, day = F.col("user_id").cast("string"), F.to_date("ts").cast("string")
    return events.select(
        F.concat(F.lit("s"), user, F.lit("-"), day).alias("scan_id"), F.concat(F.lit("e"), "event_id").alias("file"),
        F.lit(1).alias("line"), severity.alias("severity"), F.col("event_type").alias("title"),
    ).withColumn("sev_weight", sev_weight)


HISTORY_SQL = f"""
    SELECT 's' || CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS scan_id,
           'proj/' || CAST(user_id AS VARCHAR) AS target_path, max(ts) AS scanned_at, count(*) AS files_scanned,
           CAST(0 AS BIGINT) AS files_skipped, count(*) / 8.0::DOUBLE AS scan_duration,
           {', '.join(f"count(*) FILTER (WHERE event_type = '{k}') AS {v}" for k, v in EVENT_SEVERITY.items())},
           count(*) AS total
    FROM events GROUP BY user_id, CAST(ts AS DATE)"""

HISTORY_FINDINGS_SQL = f"""
    SELECT 's' || CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS scan_id,
           'e' || CAST(event_id AS VARCHAR) AS file, 1 AS line,
           CASE event_type {' '.join(f"WHEN '{k}' THEN '{v.upper()}'" for k, v in EVENT_SEVERITY.items())} END AS severity,
           event_type AS title,
           CASE event_type {' '.join(f"WHEN '{k}' THEN {5 - i}" for i, k in enumerate(EVENT_SEVERITY))} END AS sev_weight
    FROM events"""
