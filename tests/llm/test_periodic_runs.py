"""Runs by automaton and access, against trying every period."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siftguard.llm.common import text_arrays
from siftguard.llm.periodic_runs import (
    SuffixAutomaton,
    candidate_stretches,
    op11_periodic_run_detection,
    periodic_runs,
    periodic_stretches,
)
from tests.llm import brute
from tests.llm.conftest import ODD

#: Words over a small alphabet in which a stretch is repeated several times.
SPIKED = st.tuples(st.lists(st.integers(0, 2), max_size=25), st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 8),
                   st.lists(st.integers(0, 2), max_size=25)).map(lambda x: x[0] + x[1] * x[2] + x[3])


@settings(max_examples=600, deadline=None)
@given(SPIKED)
def test_runs_equal_trying_every_period(words):
    assert periodic_stretches(words) == sorted(brute.runs(words), key=lambda r: (r[0], r[2]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=30))
def test_the_automaton_has_a_state_per_class_of_ends(words):
    automaton = SuffixAutomaton(words)
    ends = {}
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            ends.setdefault(tuple(words[i:j]), []).append(j)
    assert len(automaton.length) == len({tuple(e) for e in ends.values()}) + 1
    assert [automaton.length[s] for s in automaton.prefix] == list(range(1, len(words) + 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(SPIKED, max_size=4))
def test_candidates_hold_every_run(texts):
    data, offsets = text_arrays(pa.array([" ".join(f"w{x}" for x in t) for t in texts], pa.string()))
    _, text, first, stop = candidate_stretches(data, offsets)
    for k, words in enumerate(texts):
        for start, size, _ in brute.runs(words):
            assert np.any((text == k) & (first <= start) & (stop >= start + size))


def test_query_equals_brute_force(spark, documents, tmp_path):
    texts = {
        10: "a b c " * 4 + "x " + "q " * 9, 11: "p " * 5, 12: "p " * 6, 13: "a a b a a b a a b a a b a a", 14: " ".join(f"u{i}" for i in range(200)),
        15: "x y z w " * 3 + "x y z", 16: "x y\tz\nw " * 4, 17: "é ü " * 5 + "中 文 " * 5, 18: "a b " * 4 + "c d " * 4 + "e " * 8,
        19: "A a " * 4, 20: " ".join("abc"[i % 3] + "x" * (i == 50) for i in range(100))}
    rows = ODD + [(i, t) for i, t in texts.items()] + [(18, texts[18]), (10, texts[10])] + [(i, f"{texts[18]} {texts[13]} tail {i}") for i in range(100, 300)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = op11_periodic_run_detection(spark, str(tmp_path)).collect()
    assert sorted((str(r[0]), tuple(r)[1:]) for r in out) == sorted((str(d), brute.periodic(d, t)) for d, t in rows)
    assert sum(r.n_runs > 0 for r in out) > 200


def test_operator_returns_runs_and_collapsed_text(spark, documents):
    out = {r.doc_id: r for r in periodic_runs(documents([(1, "go  on on on on on on stop\n"), (2, None)])).collect()}
    assert [tuple(r) for r in out[1].runs] == [(1, 6, 1)] and out[1].collapsed == "go on stop" and out[1].n_words == 8
    assert out[2].runs == [] and out[2].collapsed == "" and out[2].n_words == 0
    assert periodic_runs(documents([])).collect() == []


def test_a_text_that_is_one_long_run(spark, documents):
    words = [f"w{i}" for i in range(5000)] * 40
    found = periodic_runs(documents([(1, " ".join(words)), (2, "a " * 300_000)])).orderBy("doc_id").select("runs").collect()
    assert [[tuple(x) for x in r.runs] for r in found] == [[(0, 200_000, 5000)], [(0, 300_000, 1)]]
