"""Tokenizer files on the driver, tokenizers in the workers, and places where a long text may be cut.

A file is read on the driver and its bytes (a few megabytes at most, whatever the corpus) are broadcast, so an
executor needs the library but not the file.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession

#: A vocabulary file is no larger than this; a larger one is refused before it is broadcast.
MOST_BYTES = 64 << 20
#: Text characters after which a long text is cut at the next safe place.
CUT_CHARS = 1 << 15
#: U+2581, which stands for a space in pieces.
BLANK = "▁"

#: Byte-level vocabularies put a space with the letters after it, so no token crosses the place before such a space.
_BEFORE_WORD = re.compile("(?<=[A-Za-z0-9]) (?=[A-Za-z])")
#: The same for whatever prints in ASCII and the Latin letters beyond it: a space between two such characters goes with the second.
_BETWEEN = re.compile("(?<=[!-~\u00c0-\u024f]) (?=[!-~\u00c0-\u024f])")
BESIDE_CUT = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x250)]))


def public_vocabulary(name: str) -> str:
    """Place of a vocabulary file of the installed collection."""
    import public_tokenizers
    return public_tokenizers.path(name)


def broadcast_file(spark: SparkSession, path: str) -> Broadcast:
    raw = Path(path).read_bytes()
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} has {len(raw)} bytes, which is no vocabulary")
    return spark.sparkContext.broadcast(raw)


def piece_model(raw: bytes):
    """A sentence piece processor."""
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=raw)


def json_tokenizer(raw: bytes):
    """A tokenizer of the JSON format. A task has one core, so the library starts no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_buffer(raw)


def neighbours(model) -> set[str]:
    """Pairs of neighbouring characters inside any piece: only between such two can a merge join anything."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i))
    return {piece[k:k + 2] for piece in pieces for k in range(len(piece) - 1)}


def piece_cuts(text: str, inside: set[str], most: int = CUT_CHARS) -> Iterator[tuple[str, int]]:
    """Parts of a text whose tokens are those of the whole, and the tokens each has too many.

    Merges work on neighbouring symbols, so a place between two characters that no piece holds side by side is
    crossed by none, and both sides come out as if alone. The processor puts a blank before each part: it
    replaces the part's own leading space, or it is one token too many where nothing joins it with what follows.
    A text without such a place stays whole.
    """
    start, extra = 0, 0
    while len(text) - start > most:
        for at in range(start + most, len(text) - 1):
            before, here = (BLANK if c == " " else c for c in text[at - 1:at + 1])
            if before + here not in inside and (text[at] == " " or BLANK + here not in inside and here != BLANK):
                break
        else:
            break
        yield text[start:at], extra
        start, extra = (at + 1, 0) if text[at] == " " else (at, 1)
    yield text[start:], extra


def word_cuts(text: str, most: int = CUT_CHARS) -> Iterator[str]:
    """Parts of a text that were separated by the single spaces left out, each before a word."""
    start = 0
    while len(text) - start > most:
        place = _BEFORE_WORD.search(text, start + most)
        if place is None:
            break
        yield text[start:place.start()]
        start = place.end()
    yield text[start:]


def word_units(text: str) -> list[str]:
    """The text cut at every single space between two printing characters (ASCII or Latin letters), without those spaces."""
    return _BETWEEN.split(text)


def is_plain_byte_level(tokenizer) -> bool:
    """Whether a tokenizer splits text by the usual byte-level pattern and changes nothing before."""
    return (tokenizer.normalizer is None and type(tokenizer.pre_tokenizer).__name__ == "ByteLevel"
            and not tokenizer.pre_tokenizer.add_prefix_space and getattr(tokenizer.pre_tokenizer, "use_regex", True))


def byte_values() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


def entry_bytes(tokenizer) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary; none for added tokens, which ordinary text never gets."""
    vocabulary, value = tokenizer.get_vocab(with_added_tokens=False), byte_values()
    table = [b""] * (max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
    for entry, i in vocabulary.items():
        table[i] = bytes(value.get(c, 0) for c in entry)
    return table


def piece_bytes(model) -> list[bytes]:
    """Bytes of every id of a piece vocabulary."""
    def read(i: int) -> bytes:
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(BLANK, " ").encode()
    return [read(i) for i in range(model.get_piece_size())]
