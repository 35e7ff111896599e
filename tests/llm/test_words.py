"""Word hashing against regular expressions."""

import numpy as np
import pyarrow as pa
from hypothesis import example, given, settings
from hypothesis import strategies as st

from siftguard.llm.common import slices, text_arrays
from siftguard.llm.words import ALPHANUMERIC, SPACED, SPACED_FOLDED, Runs, tokenize
from tests.llm.brute import ALNUM, LOWER
from tests.llm.brute import SPACED as SPACED_RE

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbZ09 \t\n\x0b\x1c\x00.,éß中😀"), max_size=40)), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
@example(["A"])
def test_words_match_the_patterns(texts):
    data, offsets = text_arrays(pa.array(texts, pa.string()))
    for rule, pattern, fold in ((SPACED, SPACED_RE, False), (SPACED_FOLDED, SPACED_RE, True), (ALPHANUMERIC, ALNUM, True)):
        words = tokenize(data, offsets, rule)
        plain = [pattern.findall((t or "").translate(LOWER) if fold else t or "") for t in texts]
        got = [[data[words.starts[i]:words.ends[i]].tobytes().decode() for i in range(a, b)] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        assert [[x.translate(LOWER) if fold else x for x in t] for t in got] == plain
        code = {}
        for word, value in zip([w for t in plain for w in t], words.hashes.tolist(), strict=True):
            assert code.setdefault(word, value) == value
        assert len(set(code.values())) == len(code)


def test_runs_depend_on_their_words_only():
    data = np.frombuffer(b"x a b c y a b c a c b", np.uint8)
    words = tokenize(data, np.array([0, len(data)]), SPACED)
    three = Runs(words.hashes).all_of(3)
    assert three[1] == three[5] and three[1] != three[6] and three[8] != three[1]
    assert Runs(words.hashes).of(np.array([1, 5]), np.array([4, 8])).tolist() == three[[1, 5]].tolist()


def test_slices_cover_everything_once():
    offsets = np.array([0, 0, 5, 5, 50, 51, 60])
    assert [list(range(*s)) for s in slices(offsets, 10)] == [[0, 1, 2], [3], [4, 5]]
    assert list(slices(np.array([0]))) == []
