"""Secret scans: fixed formats, and high-entropy strings found by a sliding window.

*Formats.* Assignments to a secret-like name, access keys and long hexadecimal runs are found
everywhere and always stay.

*Entropy.* Candidate strings are runs of at least ``WINDOW`` characters of the base64 alphabets.
A window slides over each candidate. The counts of its characters are kept in a few long numbers, six bits each, and the sum of
n * log2(n) over them is updated from the counts of the one character that leaves and the one that enters. Where the
Shannon entropy reaches the threshold of the candidate's character class, the stretch from
the first to the last such window is a span. Windows that overlap a match of the allow list do not count (the rest of their
candidate does), and spans inside a format's span are suppressed.

Everything is built of SQL functions. Work per document is linear in its length, and all but the
gates run only on documents with matches.

Defined cases: null and empty texts have no spans; a null doc_id is carried through; repeated
rows repeat; other columns never matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftguard.llm import spans as S
from siftguard.llm.common import table, unused

KINDS = ["assign", "access", "hex", "entropy"]
WINDOW = 20
#: Bits per character that a window must reach, by character class (the most are 4.0 and 4.32).
THRESHOLDS = {"hex": 3.3, "base64": 3.8}
#: Stretches that look random but are no secrets, each with a cheap test: segments with a placeholder word, identifiers, rows of one
#: character, counting. Everything is linear: a segment is entered at its first character only.
ALLOWED = [
    (r"(?i)example|sample|placeholder|dummy|changeme|your[_-]",
     r"(?i)(?<![A-Za-z0-9+=])(?=[A-Za-z0-9+=]*?(?:example|sample|placeholder|dummy|changeme|your[_-]))[A-Za-z0-9+=]++"),
    ("-", r"(?i)(?<![0-9a-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])"),
    (r"(.)\1{7}", r"(.)\1{7,}+"),
    (r"(?i)abcdefgh|01234567|12345678", r"(?i)abcdefgh|01234567|12345678")]
#: What takes the place of allowed characters; it is in no alphabet.
_MASK = "!"
#: Bits of a count, symbols per number, numbers: 67 symbols.
_BITS, _PER, _NUMBERS = 6, 10, 7

_NAME = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN = _NAME + r"""["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
_VALUE = r"""^[A-Za-z_]++["']?\x20*+[:=]\x20*+["']?(.*)$"""
_ACCESS = "AKIA[A-Z0-9]+"
_HEX = "[0-9a-f]{32,}"
_CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}"


def _masked(found: Column) -> Column:
    """The candidate with allowed stretches masked, character for character."""
    for gate, pattern in ALLOWED:
        def cover(x: Column) -> Column:
            rows = F.transform(x.m, lambda m: F.repeat(F.lit(_MASK), F.length(m)))
            return F.array_join(F.zip_with(x.gaps, rows, lambda gap, row: F.concat(gap, F.coalesce(row, F.lit("")))), "")

        parts = F.struct(F.regexp_extract_all(found, F.lit(pattern), F.lit(0)).alias("m"), F.split(found, pattern).alias("gaps"))
        found = F.when(found.rlike(gate), S.once(parts, cover)).otherwise(found)
    return found


def _symbol(char: Column) -> Column:
    """Which number holds the character's count, and at which bit; -1 for masked ones."""
    a = F.ascii(char)
    code = F.when(a.between(97, 122), a - 97).when(a.between(65, 90), a - 39).when(a.between(48, 57), a + 4)
    for k, sign in enumerate("+/_=-"):
        code = code.when(char == sign, F.lit(62 + k))
    code = code.otherwise(-1)
    return F.struct(F.floor(code / _PER).cast("int").alias("word"), (F.pmod(code, F.lit(_PER)) * _BITS).alias("bit"))


def _most_entropy(found: Column, window: int) -> Column:
    """First start and last end of the windows that reach the threshold: struct(first, last)."""
    least = F.when(found.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(THRESHOLDS["hex"])).otherwise(F.lit(THRESHOLDS["base64"]))
    # Entropy of a full window is log2(window) - sum / window.
    most = (F.log2(F.lit(float(window))) - least) * window + F.lit(1e-9)
    weights = F.array(*(F.lit(n * math.log2(n) if n > 1 else 0.0) for n in range(window + 1)))
    names = [f"w{k}" for k in range(_NUMBERS)]

    def slid(x: Column) -> Column:
        def step(state: Column, at: Column) -> Column:
            return S.once(F.struct(F.when(at >= window, F.get(x.symbols, at - window)).alias("out"), F.get(x.symbols, at).alias("into")), lambda c: moved(state, at, c))

        def count(state: Column, symbol: Column) -> Column:
            held = F.lit(0).cast("long")
            for k, name in enumerate(names):
                held = F.when(symbol.word == k, state[name]).otherwise(held)
            return F.call_function("shiftrightunsigned", held, symbol.bit).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int")

        def one(symbol: Column, k: int) -> Column:
            return F.when(symbol.word == k, F.call_function("shiftleft", F.lit(1).cast("long"), symbol.bit)).otherwise(F.lit(0).cast("long"))

        def moved(state: Column, at: Column, c: Column) -> Column:
            leaves, enters = F.coalesce(c.out.word >= 0, F.lit(False)), c.into.word >= 0
            before = F.when(leaves, count(state, c.out)).otherwise(0)
            # The same symbol may leave and enter.
            rest = F.when(enters, count(state, c.into) - F.when(leaves & (c.out == c.into), 1).otherwise(0)).otherwise(0)
            total = (state.total + F.when(leaves, F.get(weights, before - 1) - F.get(weights, before)).otherwise(0.0)
                     + F.when(enters, F.get(weights, rest + 1) - F.get(weights, rest)).otherwise(0.0))
            shut = F.when(enters, state.shut).otherwise(at)
            hit = (at >= window - 1) & (at - shut >= window) & (total <= x.most)
            kept = [(state[n] - F.when(leaves, one(c.out, k)).otherwise(0) + F.when(enters, one(c.into, k)).otherwise(0)).alias(n) for k, n in enumerate(names)]
            return F.struct(total.alias("total"), F.when(hit & (state.first < 0), at - window + 1).otherwise(state.first).alias("first"),
                            F.when(hit, at + 1).otherwise(state.last).alias("last"), shut.alias("shut"), *kept)

        empty = F.struct(F.lit(0.0).alias("total"), F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(-window).alias("shut"),
                         *(F.lit(0).cast("long").alias(n) for n in names))
        return F.aggregate(F.sequence(F.lit(0), F.size(x.symbols) - 1), empty, step)

    return S.once(F.struct(F.transform(F.split(_masked(found), ""), _symbol).alias("symbols"), most.alias("most")), slid)


def _entropy_spans(text: Column, base: Column, window: int) -> Column:
    candidate = _CANDIDATE % window
    # A plain word holds no digit, a number no letter.
    spans = F.filter(S.found(text, candidate, "entropy"), lambda s: s.found.rlike("[0-9]") & s.found.rlike("[A-Za-z]"))
    scored = F.transform(spans, lambda s: F.struct(s.alias("s"), _most_entropy(s.found, window).alias("w")))
    hits = F.transform(F.filter(scored, lambda x: x.w.first >= 0), lambda x: F.struct(
        x.s.kind.alias("kind"), (x.s.start + x.w.first).alias("start"), (x.s.start + x.w.last).alias("end"), x.s.found.alias("found")))
    return S.not_within(hits, base)


def with_secret_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, into: tuple[str, str] = ("__base", "__secrets")) -> DataFrame:
    """Add the format spans and all spans, sorted by place, as two columns named by ``into``."""
    if not 0 < window < 1 << _BITS:
        raise ValueError("the window must hold fewer characters than a count can tell")
    base, secrets = into
    body = F.coalesce(F.col(text), F.lit(""))
    assign = F.filter(S.found(body, _ASSIGN, "assign", gate=_NAME), lambda s: F.length(F.regexp_extract(s.found, _VALUE, 1)) >= 8)
    access = F.filter(S.found(body, _ACCESS, "access", gate="AKIA"), lambda s: F.length(s.found) >= 16)
    rows = docs.withColumn(base, S.by_start(F.concat(assign, access, S.found(body, _HEX, "hex")), KINDS))
    rows = rows.withColumn(secrets, _entropy_spans(body, F.col(base), window))
    return rows.withColumn(secrets, F.when(F.size(secrets) > 0, S.by_start(F.concat(base, secrets), KINDS)).otherwise(F.col(base)))


def secret_report(docs: DataFrame) -> DataFrame:
    rows = with_secret_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", *(S.count_kind(F.col("__base"), k).alias(f"n_{k}") for k in KINDS[:3]),
                       S.digest(S.listing(F.col("__base"))).alias("base_sha256"), S.listing(F.col("__secrets")).alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every secret replaced; n_chars, where present, follows the new text."""
    base, secrets = unused("__base", docs), unused("__secrets", docs)
    rows = with_secret_spans(docs, into=(base, secrets))
    hit = F.size(secrets) > 0
    rows = rows.withColumn("text", F.when(hit, S.blanked(F.col("text"), F.col(secrets), mark)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))
