"""Thousands of user rules against one filter per rule."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.registry import many_rules
from siftguard.operators.lines import explode_lines, with_file_facts
from siftguard.operators.rule_index import GRAM, index_of, keys_of, mandatory_literal, match_many, search_pattern, ways_of
from siftguard.operators.rulescan import match_rules
from siftguard.plans.scan import lines_of
from siftguard.rules import Rule
from siftguard.sources.rule_files import user_rules


@pytest.mark.parametrize("pattern, literal", [
    ("password\\s*=", "password"), ("(?i)API_Key", "api_key"), ("a|b", ""), ("(?:alpha|beta)gamma", "gamma"), ("x?secret{2}", "secre"), ("(token)+", "token"), ("(token)*abcd", "abcd"),
    ("[a]bcde", "abcde"), ("[ab]cde", "cde"), ("^import os", "import os"), ("", ""), ("(", ""), ("caféteria", "teria"), ("(?<name>value)=(\\k<name>)", ""), ("(?!nope)yes!", "yes!"), ("(?<=before)after", "after")])
def test_mandatory_literals(pattern, literal):
    assert mandatory_literal(pattern) == literal


PARTS = st.sampled_from(["ab", "cd+", "(?:ef|gh)", "[ij]k", "l{2}", "m?", "(no)", ".", "\\s", "pq*", "(?i:r)", "xyz1", "\\.", "(?:st){1,2}"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=6).map("".join), st.integers(0, 10**6))
def test_every_match_holds_the_literal(pattern, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["ab", "cd", "cdd", "ef", "gh", "ik", "jk", "ll", "m", "no", " ", "p", "pqq", "R", "r", "xyz1", ".", "st"]) for _ in range(12))
    if re.search(pattern, text):
        assert mandatory_literal(pattern) in text.lower()


def _lines(spark, texts):
    rows = [(path, len(t.encode()), t, None) for path, t in texts.items()]
    files = spark.createDataFrame(rows, "path string, length bigint, content string, skip_reason string")
    return explode_lines(with_file_facts(files), ["path", "ext", "kind"])


def test_index_equals_one_filter_per_rule(spark):
    rng = random.Random(5)
    words = ["password", "secret", "token", "apikey", "ab", "x", "café", "ſecret", "toKen", "PASSWORD", "=", "'", "<div>", "  ", "éü", "\U0001F600"]
    texts = {f"f{i}.{'py' if i % 2 else 'js'}": "\n".join("".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(30)) for i in range(20)}
    items = [{"id": f"r{i}", "pattern": p} for i, p in enumerate(
        ["password", "(?i)secret", "(?i)token=", "apikey'", "<div>\\s+", "x", "(ab){2}", "^token", "secret$", "(?i)k", "éü", "pass|tok", "[a-z]{6,}=", "cafe", "password\\Z", "(?P<q>')x(?P=q)"])]
    items += [{"id": "gated", "pattern": "password", "file_extensions": [".py"]}, {"id": "dot", "pattern": "secret.token"}]
    rules = user_rules(items)
    lines = _lines(spark, texts)
    got = sorted((r.path, r.line, r.rule_ord) for r in match_many(lines, rules).collect())
    want = sorted((r.path, r.line, r.rule_ord) for r in match_rules(lines, rules).collect())
    assert got == want and len(got) > 200


def test_five_thousand_rules(spark, files):
    rules = user_rules(many_rules())
    indexed, others = index_of(rules)
    assert len(rules) > 5000 and len(others) < 200 and all(len(g) == GRAM for g, _ in indexed)
    content = "\n".join(f"<div class=\"r{i}\"> data-row {i} <p>{i} Alpha{i}9 alpha{i} </p>" for i in range(200))
    lines = lines_of(files({"a.html": content, "b.txt": content}))
    frame = match_many(lines, rules)
    # Compiled as a whole: no expression is left to the interpreter.
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    got = {(r.path, r.line, r.rule_ord) for r in frame.collect()}
    compiled = [(r.rule_ord, re.compile(r.pattern), r.exts) for r in rules]
    want = {(path, n, o) for path in ("a.html", "b.txt") for n, text in enumerate(content.split("\n"), 1) for o, p, exts in compiled
            if (not exts or path.endswith(exts)) and p.search(text)}
    assert got == want and len(got) > 800


def test_more_rules_than_a_plan_carries(spark):
    rules = [Rule(f"r{i}", "user", "LOW", None, f"t{i}", f"needle{i:05d}", rule_ord=10**6 + i) for i in range(21_000)]
    lines = _lines(spark, {"a.py": "x needle00007 y\nneedle20999"})
    assert sorted(r.rule_ord - 10**6 for r in match_many(lines, rules).collect()) == [7, 20_999]


def test_lines_of_any_length(spark):
    rules = user_rules([{"id": "n", "pattern": "needle"}])
    got = match_many(_lines(spark, {"a.py": "h" * 500_000 + "needle\nabc\n\n"}), rules).select("line", F.length("text").alias("n")).collect()
    assert [(r.line, r.n) for r in got] == [(1, 500_006)]


@pytest.mark.parametrize("pattern, ways", [
    ("a|b", []), ("(?:alpha|beta)12|[a-z]12{3}", [["12", "alpha"], ["12", "beta"], ["1222"]]), ("pass|tok", [["pass"], ["tok"]]), ("[a-z]0{3}", [["000"]]),
    ("x(?:ab|)y", [["x", "y"]]), ("(?:ab|cde){1,2}f", [["f", "ab"], ["f", "cde"]]), ("ab{2,5}c", [["abb", "c"]]), ("(?:ab|cd)?ef", [["ef"]])])
def test_ways_of_a_pattern(pattern, ways):
    assert ways_of(pattern) == ways


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, min_size=1, max_size=4).map("".join), min_size=1, max_size=3).map("|".join), st.integers(0, 10**6))
def test_every_match_holds_one_way(pattern, seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["ab", "cd", "cdd", "ef", "gh", "ik", "jk", "ll", "m", "no", " ", "p", "pqq", "R", "r", "xyz1", ".", "st"]) for _ in range(12))
    ways = ways_of(pattern)
    if ways and re.search(pattern, text):
        assert any(all(literal in text.lower() for literal in way) for way in ways)


@given(st.sets(st.text("ab01", min_size=1, max_size=GRAM), min_size=1, max_size=12), st.text("ab01 ", max_size=20))
def test_search_finds_every_key(keys, text):
    found = re.compile(search_pattern(keys)).findall(text)
    assert {t[:n] for t in found for n in range(1, GRAM + 1)} >= {k for k in keys if k in text}


def test_lines_meet_few_rules(spark, files):
    """Five hundred rules share ``<div``; a line is read once and meets those whose number it holds, in any spelling of its letters."""
    rules = user_rules(many_rules())
    keyed, others = keys_of(rules)
    shared = Counter(way for _, ways in keyed for way in ways)
    assert others == [] and max(shared.values()) <= 8
    frame = match_many(lines_of(files({"a.html": "<div class=\"x\"> 998 ſ K İ ı\n<DIV 998\nalpha12 beta12 a1222\nDATAROW 61"})), rules)
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    title = {r.rule_ord: r.title for r in rules}
    assert sorted((r.line, title[r.rule_ord]) for r in frame.collect()) == [(3, "either-12"), (4, "word-datarow-61")]
    folded = match_many(lines_of(files({"a.html": "<div 998 K\nlinKrow-7\nlİstrow-7\nLıſtrow-7"})), rules).collect()
    want = match_rules(lines_of(files({"a.html": "<div 998 K\nlinKrow-7\nlİstrow-7\nLıſtrow-7"})), [r for r in rules if r.title in ("word-linkrow-7", "word-listrow-7") or r.title.startswith("tag-div-")][:60]).collect()
    assert {(r.line, title[r.rule_ord]) for r in want} <= {(r.line, title[r.rule_ord]) for r in folded} and len({r.line for r in folded}) >= 2
