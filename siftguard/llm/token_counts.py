"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts arrive in Arrow batches. Those longer than ``CUT_CHARS`` are split at safe boundaries, where no merge can
cross (:func:`~siftguard.llm.vocabularies.piece_cuts`, :func:`~siftguard.llm.vocabularies.word_cuts`), and all parts
are dealt into calls of about ``CALL_CHARS`` characters, so a call holds a few megabytes of ids however long a
text is. Only a number per text leaves the function; no other column goes to Python.

The kind of file picks the library: ``.model`` sentence pieces, ``.json`` tokenizers. Special strings inside texts are
handled as the library does by default. A ``.json`` tokenizer that normalises, or splits otherwise than at byte level, gets its texts whole.

Defined cases: null and empty texts have no bytes and no tokens; a text without a safe boundary is encoded whole; repeated
rows repeat; extra columns, whatever their names, are kept by ``with_token_counts`` unless it is told to write to them; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftguard.llm.common import ship, table
from siftguard.llm.vocabularies import (
    CUT_CHARS,
    broadcast_file,
    is_plain_byte_level,
    json_tokenizer,
    neighbours,
    piece_cuts,
    piece_model,
    public_vocabulary,
    word_cuts,
)

#: Characters per call of the library.
CALL_CHARS = 1 << 18
VOCABULARY, LIMIT = "piece_bpe_32k.model", 4096


def _piece_counter(raw: bytes, most: int) -> tuple[Callable, Callable]:
    model = piece_model(raw)
    inside = neighbours(model)
    return lambda text: piece_cuts(text, inside, most), lambda parts: map(len, model.encode(parts, num_threads=1))


def _json_counter(raw: bytes, most: int) -> tuple[Callable, Callable]:
    model = json_tokenizer(raw)
    plain = is_plain_byte_level(model)

    def cut(text: str) -> Iterator[tuple[str, int]]:
        # A part after a cut takes its space back: the space belongs to the word after it.
        for k, part in enumerate(word_cuts(text, most) if plain else [text]):
            yield (" " + part if k else part), 0

    return cut, lambda parts: map(len, model.encode_batch_fast(parts, add_special_tokens=False))


def counted(texts: list[str | None], cut: Callable, lengths: Callable) -> list[int]:
    """Tokens per text, in calls of balanced size."""
    out = [0] * len(texts)
    owners, parts, size = [], [], 0

    def call() -> None:
        for owner, n in zip(owners, lengths(parts), strict=True):
            out[owner] += n
        owners.clear()
        parts.clear()

    for owner, text in enumerate(texts):
        if not text:
            continue
        for part, extra in cut(text):
            out[owner] -= extra
            owners.append(owner)
            parts.append(part)
            size += len(part)
            if size >= CALL_CHARS:
                call()
                size = 0
    call()
    return out


def token_count(spark: SparkSession, text: Column, path: str, cut_chars: int = CUT_CHARS) -> Column:
    """Number of tokens of ``text`` by the vocabulary file at ``path``."""
    ship(spark)
    held = broadcast_file(spark, path)
    counter = _piece_counter if path.endswith(".model") else _json_counter

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cut, lengths = counter(held.value, cut_chars)
        for batch in batches:
            yield pa.array(counted(batch.to_pylist(), cut, lengths), pa.int64())

    return F.arrow_udf(count, "long")(F.coalesce(text, F.lit("")))


def with_token_counts(docs: DataFrame, path: str, text: str = "text", into: tuple[str, str] = ("n_bytes", "n_tokens")) -> DataFrame:
    """The documents with the size of their text in bytes and in tokens."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return docs.withColumns({into[0]: size, into[1]: token_count(docs.sparkSession, F.col(text), path)})


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = with_token_counts(docs, public_vocabulary(VOCABULARY))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
