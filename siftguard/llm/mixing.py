"""Mixing sources to target weights by hierarchical budgeting.

*Tree.* Documents lie in the leaves of a tree of domain, language and source. Each node's weight is
relative to its siblings (1 where none is given).

*Budgets.* The token budget flows from the root. A node's share is split among its children by
water-filling: each gets its weight's share of the node's budget, but no more than the tokens below it times the
number of epochs allowed; what a full child cannot take goes to its siblings. As a child's
limit counts all leaves below it, a shortage is made good among siblings first and only then by
the siblings of an ancestor. Water-filling is closed-form: children are ranked by limit per
weight, and running sums say which of them are full.

*Selection.* Each leaf takes whole epochs while its budget lasts, then a prefix of one further
epoch: documents in the order of a seeded hash of that epoch, until the budget is spent; the
last one is cut to the tokens left. Prefix sums are taken in two steps, over a fixed number of
hash ranges and then inside the one range where the budget ends, so no leaf is sorted whole.

Texts never move: the decision per leaf is one small row, joined to the documents.

A token is a run of non-space characters. Everything is built of SQL functions. Defined cases:
documents without tokens are selected with whatever their place selects and take none; a null
domain, language or source is called ``(none)``; rows that share a doc_id share a place, and where
the budget ends there each of them is cut alike; an empty table gives an empty result; a budget
beyond all limits takes every epoch of everything; a node of weight 0 takes nothing, and its tokens count for no limit above it;
input columns named epoch or take_tokens give way to those of the selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftguard.llm.common import dropped, saved, table

#: Tokens to select as a share of all tokens, passes over a document at most, seed of the orders.
SHARE, EPOCHS, SEED = 0.5, 3, 17
#: Target weights by path; a key names one node below its parent's path. Others weigh 1.
WEIGHTS = {"web": 5.0, "reference": 3.0, "code": 2.0, "web/en": 4.0, "web/de": 2.0, "reference/en": 3.0, "code/en": 3.0}
#: Hash ranges that the first step of a prefix sum looks at.
RANGES = 4096

LEVELS = ["domain", "lang_leaf", "source_leaf"]


def domain_of(source: Column) -> Column:
    """Default domain of a source: by the number that ends its name."""
    number = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)) % 10
    return F.when(number < 5, "web").when(number < 8, "reference").otherwise("code")


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(seed: int, epoch: Column) -> Column:
    """Where a document stands in the order of an epoch: 32 hash characters, then its id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _range_of(place: Column) -> Column:
    return F.conv(F.substring(place, 1, 3), 16, 10).cast("int")


def _leaved(docs: DataFrame, domain: Column) -> DataFrame:
    name = lambda c: F.coalesce(c.cast("string"), F.lit("(none)"))
    return docs.withColumns({"domain": name(domain), "lang_leaf": name(F.col("lang")), "source_leaf": name(F.col("source"))})


def _weight(path: list[str], weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    given = F.create_map(*(F.lit(x) for pair in sorted(weights.items()) for x in (pair[0], float(pair[1]))))
    return F.coalesce(F.try_element_at(given, F.concat_ws("/", *path)), F.lit(1.0))


def _filled(nodes: DataFrame, path: list[str], weights: dict[str, float]) -> DataFrame:
    """Split ``given`` of each parent among its children, of ``limit`` tokens each."""
    rated = nodes.withColumn("w", _weight(path, weights)).withColumn("ratio", F.when(F.col("w") > 0, F.col("limit") / F.col("w")).otherwise(float("inf")))
    order = Window.partitionBy(*path[:-1]).orderBy("ratio", path[-1])
    fuller = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shared = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # The water level if all children of smaller ratio are full; the first child above its level is open, and so are all after it.
    rated = rated.withColumn("level", F.when(F.col("w") > 0, (F.col("given") - fuller) / shared))
    opened = F.first(F.when(F.col("level") < F.col("ratio"), F.col("level")), ignorenulls=True)
    water = opened.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = F.when(F.col("w") <= 0, 0.0).when(water.isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), water * F.col("w")))
    return rated.select(*path, share.alias("given"))


def budgets(leaves: DataFrame, total: float, weights: dict[str, float]) -> DataFrame:
    """Add ``budget`` to the leaves, which hold the level columns and ``limit``."""
    given = None
    # What lies below a node of weight 0 is nobody's to take, at any level.
    open_path = F.lit(True)
    for depth in range(1, len(LEVELS) + 1):
        open_path = open_path & (_weight(LEVELS[:depth], weights) > 0)
    leaves = leaves.withColumn("limit", F.when(open_path, F.col("limit")).otherwise(0))
    for depth in range(1, len(LEVELS) + 1):
        path = LEVELS[:depth]
        nodes = leaves.groupBy(*path).agg(F.sum("limit").alias("limit"))
        nodes = nodes.withColumn("given", F.lit(total)) if given is None else nodes.join(given, path[:-1])
        given = _filled(nodes, path, weights)
    return leaves.join(given, LEVELS).withColumn("budget", F.floor(F.col("given") + 1e-6).cast("long")).drop("given")


def decisions(counted: DataFrame, weights: dict[str, float], share: float, epochs: int, seed: int) -> DataFrame:
    """One row per leaf: its budget, whole epochs, tokens of the prefix, and where the prefix ends.

    ``counted`` is a stored table of doc_id, level columns and n_tokens.
    """
    leaves = counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumn("limit", F.col("tokens") * epochs)
    leaves = saved(leaves, "leaves")
    total = float(leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] * share)
    given = budgets(leaves, total, weights)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    given = given.withColumn("whole", F.least(whole, F.lit(epochs)))
    given = saved(given.withColumn("rest", F.when(F.col("whole") < epochs, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0)), "budgets")
    placed = counted.join(given.where("rest > 0").select(*LEVELS, "whole", "rest"), LEVELS).withColumn("place", _place(seed, F.col("whole")))
    sums = placed.groupBy(*LEVELS, "rest", _range_of(F.col("place")).alias("range")).agg(F.sum("n_tokens").alias("tokens"))
    so_far = Window.partitionBy(*LEVELS)
    upto = F.sum("tokens").over(so_far.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = sums.withColumn("upto", upto).where(F.col("upto") >= F.col("rest")).groupBy(*LEVELS).agg(
        F.min("range").alias("range"), F.min_by(F.col("upto") - F.col("tokens"), "range").alias("before"))
    inside = placed.withColumn("range", _range_of(F.col("place"))).join(last, [*LEVELS, "range"])
    inside = inside.groupBy(*LEVELS, "rest", "before", "place").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.col("before") + F.sum("tokens").over(so_far.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = inside.withColumn("upto", upto).where(F.col("upto") >= F.col("rest")).groupBy(*LEVELS).agg(
        F.min("place").alias("cut_place"), F.min_by(F.col("upto") - F.col("tokens"), "place").alias("cut_before"))
    out = saved(given.join(cut, LEVELS, "left"), "decisions")
    dropped(leaves, given)
    return out


def _selected(rows: DataFrame, leaf_rows: DataFrame, seed: int) -> DataFrame:
    """One row per document and epoch that its leaf's decision takes: adds budget, epoch, take_tokens."""
    rows = rows.join(leaf_rows.select(*LEVELS, "budget", "whole", "rest", "cut_place", "cut_before"), LEVELS)
    place = _place(seed, F.col("whole"))
    part = F.when(place < F.col("cut_place"), F.col("n_tokens")).when(place == F.col("cut_place"), F.least("n_tokens", F.col("rest") - F.col("cut_before")))
    takes = F.when(F.col("whole") > 0, F.transform(F.sequence(F.lit(0), F.col("whole") - 1), lambda e: F.struct(e.alias("epoch"), F.col("n_tokens").alias("take_tokens"))))
    takes = F.concat(F.coalesce(takes, F.array().cast("array<struct<epoch:int,take_tokens:bigint>>")),
                     F.when(part.isNotNull(), F.array(F.struct(F.col("whole").alias("epoch"), part.alias("take_tokens")))).otherwise(
                         F.array().cast("array<struct<epoch:int,take_tokens:bigint>>")))
    return rows.withColumn("__take", F.explode(takes)).select("*", "__take.epoch", "__take.take_tokens").drop("__take", "whole", "rest", "cut_place", "cut_before")


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED,
            domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, budget of the leaf, epoch, take_tokens per selection."""
    counted = _leaved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", count_tokens(F.col("text")).alias("n_tokens")),
                      domain_of(F.col("source")) if domain is None else domain)
    counted = saved(counted.select("doc_id", *LEVELS, "n_tokens"), "counted")
    leaf_rows = decisions(counted, WEIGHTS if weights is None else weights, share, epochs, seed)
    return _selected(counted, leaf_rows, seed).select(
        "doc_id", "domain", F.col("lang_leaf").alias("lang"), F.col("source_leaf").alias("source"), "n_tokens", "budget", "epoch", "take_tokens")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The selected documents with all their columns, and epoch and take_tokens besides; a cut text ends after its last token taken."""
    weights, share, epochs, seed = (settings.get(k, v) for k, v in (("weights", WEIGHTS), ("share", SHARE), ("epochs", EPOCHS), ("seed", SEED)))
    domain = settings.get("domain", domain_of(F.col("source")))
    own = docs.select(F.struct(*docs.columns).alias("__doc"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", count_tokens(F.col("text")).alias("n_tokens"))
    leaved = _leaved(own, domain)
    counted = saved(leaved.select("doc_id", *LEVELS, "n_tokens"), "counted")
    picked = _selected(leaved, decisions(counted, weights, share, epochs, seed), seed)
    text = F.when(F.col("take_tokens") < F.col("n_tokens"), F.array_join(F.slice(F.regexp_extract_all(
        "__doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("take_tokens").cast("int")), "")).otherwise(F.col("__doc.text"))
    kept = [c for c in docs.columns if c not in ("epoch", "take_tokens")]
    out = {"text": text.alias("text"), "n_chars": F.length(text).cast("long").alias("n_chars")}
    return picked.select(*(out[c] if c in out else F.col(f"__doc.`{c}`").alias(c) for c in kept), "epoch", "take_tokens")


def op3_mixing_sources_to_target_weights(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


#: The query in SQL: the tree's levels one by one, then prefix sums over whole leaves.
ORACLE = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
         coalesce(CASE WHEN regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' THEN 0 ELSE regexp_extract(source, '([0-9]{{1,9}})$', 1)::INT END, 0) % 10 AS num,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n_tokens FROM documents),
d AS (SELECT CASE WHEN source = '(none)' THEN 'code' WHEN num < 5 THEN 'web' WHEN num < 8 THEN 'reference' ELSE 'code' END AS domain, * EXCLUDE (num) FROM t),
weights(path, w) AS (VALUES {", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in sorted(WEIGHTS.items()))}),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {EPOCHS} AS lim FROM d GROUP BY ALL),
"""


def _oracle_level(depth: int) -> str:
    names = ["domain", "lang", "source"]
    path, parent = names[:depth], names[:depth - 1]
    given = f"g{depth - 1}.given" if parent else f"(SELECT sum(tokens) * {SHARE}::DOUBLE FROM leaf)"
    join = f"JOIN g{depth - 1} USING ({', '.join(parent)})" if parent else ""
    over = f"PARTITION BY {', '.join(parent)} " if parent else ""
    key = " || '/' || ".join(path)
    return f"""
n{depth} AS (SELECT {", ".join(path)}, sum(lim) AS lim FROM leaf GROUP BY ALL),
r{depth} AS (SELECT n.*, {given} AS above, coalesce(weights.w, 1.0) AS w FROM n{depth} n {join} LEFT JOIN weights ON weights.path = {key}),
l{depth} AS (SELECT *, lim / w AS ratio, (above - coalesce(sum(lim) OVER ({over}ORDER BY lim / w, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER ({over}ORDER BY lim / w, {path[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r{depth}),
g{depth} AS (SELECT {", ".join(path)}, coalesce(least(lim::DOUBLE, w * first(CASE WHEN level < ratio THEN level END IGNORE NULLS)
   OVER ({over}ORDER BY ratio, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), lim::DOUBLE) AS given FROM l{depth}),"""


ORACLE += "".join(map(_oracle_level, (1, 2, 3))) + rf"""
b AS (SELECT leaf.*, floor(given + 1e-6)::BIGINT AS budget FROM leaf JOIN g3 USING (domain, lang, source)),
e AS (SELECT *, CASE WHEN tokens > 0 THEN least(budget // tokens, {EPOCHS}) ELSE 0 END::INT AS whole FROM b),
x AS (SELECT d.*, budget, whole, CASE WHEN whole < {EPOCHS} THEN budget - whole * tokens ELSE 0 END AS rest,
        md5('{SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM d JOIN e USING (domain, lang, source)),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        - sum(n_tokens) OVER (PARTITION BY domain, lang, source, place) AS before FROM x)
SELECT doc_id, domain, lang, source, n_tokens, budget, epoch, n_tokens AS take_tokens FROM p, unnest(range(whole)) AS r(epoch)
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, budget, whole, least(n_tokens, rest - before)::BIGINT FROM p WHERE before < rest
"""
