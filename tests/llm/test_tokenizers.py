"""Token counts and alignments against the libraries on whole texts."""

import collections
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftguard.llm.alignment import Aligner, aligned, group_listing, link_scores, op13_cross_tokenizer_alignment, pair_counts
from siftguard.llm.common import saved
from siftguard.llm.token_counts import _json_counter, _piece_counter, counted, op12_token_counts, with_token_counts
from siftguard.llm.vocabularies import entry_bytes, json_tokenizer, neighbours, piece_bytes, piece_cuts, piece_model, public_vocabulary, word_cuts
from tests.llm import brute
from tests.llm.conftest import ODD

pytest.importorskip("public_tokenizers")
RAW = {name: open(public_vocabulary(name), "rb").read() for name in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json")}
MODEL, BYTES, WORDS = piece_model(RAW["piece_bpe_32k.model"]), json_tokenizer(RAW["byte_bpe_50k.json"]), json_tokenizer(RAW["word_bpe_49k.json"])
LOOSE = json_tokenizer(RAW["byte_bpe_50k.json"])
LOOSE.encode_special_tokens = True
INSIDE = neighbours(MODEL)
TEXTS = st.text(st.sampled_from("abcxyzABZ   019.,'-\n\t\r\x00éß中文ﬁ😀▁　<>|/s"), max_size=120) | st.lists(
    st.sampled_from(["the", "and", " ", "  ", "\n", "don't", "<s>", "</s>", "<0x0A>", "<|endoftext|>", "hello", "ing", "world.", "1234", "中文", "▁", " a", "é"]), max_size=40).map("".join)
MANY = [t * 3 for t in ("plain words in a row, and more of them; ", "no_space_anywhere", "中文字符没有空格", "a  b   c\n\nd\te ", "<|endoftext|>x <s> </s> <unk> ", "¿que? ß\x00 ﬁ ")]


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_piece_cuts_keep_the_tokens(text, most):
    parts = list(piece_cuts(text, INSIDE, most))
    assert sum(len(MODEL.encode(part)) - extra for part, extra in parts) == len(MODEL.encode(text))


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_word_cuts_keep_the_tokens_of_byte_level_vocabularies(text, most):
    parts = [" " + p if k else p for k, p in enumerate(word_cuts(text, most))]
    for tokenizer in (BYTES, LOOSE):
        assert [i for p in parts for i in tokenizer.encode(p, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut():
    assert len(list(piece_cuts("word " * 100, INSIDE, 50))) == 10 and len(list(word_cuts("word " * 100, 50))) > 8
    assert len(list(piece_cuts("中文字符没有空格" * 50, INSIDE, 50))) > 4


@pytest.mark.parametrize("name", RAW)
def test_counts_equal_whole_texts(name):
    counter, whole = (_piece_counter, lambda t: MODEL.encode(t)) if name.endswith(".model") else (
        _json_counter, lambda t: (WORDS if name.startswith("word") else BYTES).encode(t, add_special_tokens=False).ids)
    texts = [None, "", *MANY, "word " * 5000, *MANY, "中文 " * 3000, "x"]
    assert counted(texts, *counter(RAW[name], 7)) == [len(whole(t)) if t else 0 for t in texts]


def test_count_query(spark, documents, tmp_path):
    rows = ODD + list(enumerate(MANY, 10)) + [(10, MANY[0]), (30, "word " * 5000)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = op12_token_counts(spark, str(tmp_path)).collect()
    expected = [(d, len((t or "").encode()), len(MODEL.encode(t or ""))) for d, t in rows]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out) == sorted((str(d), b, n, n > 4096) for d, b, n in expected)


def test_counts_keep_extra_columns(spark, documents):
    docs = documents([(1, "some words"), (2, None)]).withColumn("n_bytes", F.lit("mine"))
    out = with_token_counts(docs, public_vocabulary("piece_bpe_32k.model"), into=("size", "tokens"))
    assert {r.doc_id: (r.n_bytes, r.size, r.tokens, r.node) for r in out.collect()} == {1: ("mine", 10, len(MODEL.encode("some words")), "x"), 2: ("mine", 0, 0, "x")}
    assert with_token_counts(documents([]), public_vocabulary("piece_bpe_32k.model")).collect() == []


A_BYTES, B_BYTES = entry_bytes(LOOSE), piece_bytes(MODEL)


def plain_alignment(text):
    """Ids, groups and links of a whole text without the operator's ways."""
    if not text:
        return [], [], [], []
    a, b = LOOSE.encode(" " + text, add_special_tokens=False).ids, MODEL.encode(text)
    a_bytes, b_bytes = [A_BYTES[i] for i in a], [B_BYTES[i] for i in b]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return [], [], [], []
    groups, links = brute.overlaps(a_bytes, b_bytes)
    return a, b, [([a[i] for i in x], [b[j] for j in y]) for x, y in groups], [(a[i], b[j]) for i, j in links]


def shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from(list("012")))
def test_alignment_of_a_text(text, which):
    a, b, groups, links = plain_alignment(text)
    got = ALIGNERS[which].align(["x y z1 yes", text, "", text])
    first, tokens_a, tokens_b = got.n_groups[0], got.n_a[0], got.n_b[0]
    assert got.n_a.tolist() == [tokens_a, len(a), 0, len(a)] and got.n_groups.tolist() == [first, len(groups), 0, len(groups)]
    assert (got.a_ids[tokens_a:].tolist(), got.b_ids[tokens_b:].tolist()) == (a * 2, b * 2)
    a_cuts, b_cuts = got.a_cuts[first - 1:].tolist(), got.b_cuts[first - 1:].tolist()
    assert [(got.a_ids[x:y].tolist(), got.b_ids[u:v].tolist()) for x, y, u, v in zip(a_cuts, a_cuts[1:], b_cuts, b_cuts[1:])] == groups * 2
    assert sorted(got.link[got.link_row == 1].tolist()) == sorted(x << 32 | y for x, y in links) == sorted(got.link[got.link_row == 3].tolist())
    assert got.listing()[1:] == [shown(groups), "", shown(groups)]
    assert got.n_links.tolist()[1:] == [len(links), 0, len(links)] and len(links) == max(len(a) + len(b) - len(groups), 0)


#: Aligners that forget their units after every call, now and then, and never.
ALIGNERS = {k: Aligner(RAW["byte_bpe_50k.json"], RAW["piece_bpe_32k.model"], most) for k, most in zip("012", (0, 300, 10**9))}


def expected_rows(rows):
    found = [(d, plain_alignment(t)) for d, t in rows]
    counts = collections.Counter(p for _, x in found for p in set(x[3]))
    highest = {}
    for (a, _), n in counts.items():
        highest[a] = max(highest.get(a, 0), n)
    out = []
    for d, (a, b, groups, links) in found:
        listing = shown(groups)
        out.append((str(d), len(a), len(b), len(groups), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(listing.encode()).hexdigest() if a else ""))
    return sorted(out)


ROWS = ODD[:-1] + [(5, "long " * 2000)] + list(enumerate(MANY, 10)) + [(10, MANY[0]), (31, "words of a row and more"), (32, "Words, of a row: and more"), (33, "blank ▁ lost")]


def test_alignment_query(spark, documents, tmp_path):
    documents(ROWS).write.parquet(str(tmp_path / "documents.parquet"))
    out = op13_cross_tokenizer_alignment(spark, str(tmp_path)).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in out) == expected_rows(ROWS)


@pytest.mark.parametrize("hot_pairs", [0, 5, 1000])
def test_scores_do_not_depend_on_how_many_pairs_are_broadcast(spark, documents, hot_pairs):
    found = aligned(documents(ROWS), public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model"), 40)
    texts = {r.doc_id: r.groups for r in aligned(documents(ROWS), public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model"), as_text=True).collect()}
    assert {r.doc_id: r.t for r in found.select("doc_id", group_listing(F.col("groups")).alias("t")).collect()} == texts
    stage = saved(found.withColumn("row", F.monotonically_increasing_id()), "alignments")
    scores = link_scores(stage, pair_counts(stage), "row", hot_pairs)
    got = stage.join(scores, "row", "left").fillna(0, ["n_best", "count_sum"]).select("doc_id", "n_best", "count_sum").collect()
    assert sorted((str(r.doc_id), r.n_best, r.count_sum) for r in got) == sorted((r[0], r[5], r[6]) for r in expected_rows(ROWS))
    assert aligned(documents([]), public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model")).collect() == []
