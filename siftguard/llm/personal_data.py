"""Personal data: high-recall generators, boosted trees over format and context, calibrated cut-offs.

*Generators* propose spans that may overlap: the four base formats, and written-out addresses, local
phone numbers, social security numbers, account numbers and long addresses of hosts. Base formats that pass
their own test (octets, Luhn, digit count) always stay.

*Trees.* The other proposals are judged by gradient-boosted trees over format and context: lengths, groups, neighbouring characters, words before
the span that announce the kind or something that only looks like it, and whether the format's own test holds, which is a feature like the others. The trees
decide: a well-formed number after "order" is left alone, an announced one is taken. They learn from labelled sentences made by rule
(``personal_examples``), described by the same expressions as any text, so what is selected does not depend on the table.

*Calibration.* Scores of a held-out fifth of the sentences are mapped to probabilities by a logistic
fit, and each kind gets the lowest cut-off that keeps a precision of ``PRECISION`` there.

The fitted trees become one SQL expression; texts are scanned once, in one narrow pass, and never meet Python.

Defined cases: null and empty texts have no spans; a null doc_id is carried through; repeated
rows repeat; an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftguard.llm import personal_examples
from siftguard.llm import spans as S
from siftguard.llm.common import table, unused

BASE = ["email", "ip", "card", "phone"]
MORE = ["email_words", "phone_local", "ssn", "iban", "ip6"]
KINDS = BASE + MORE
#: Sentences the trees are fitted on and their seed, trees, depth, step, and the precision a cut-off must keep.
SENTENCES, SEED, TREES, DEPTH, STEP, PRECISION = 3000, 11, 24, 3, 0.3, 0.97

#: Kind: pattern, cheap gate. Possessive where nothing could be given back; \G allows a start right after a match.
_PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?[0-9])++", "[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
    "email_words": (r"(?i)\b[a-z0-9][a-z0-9._-]{0,40} ?[(\[]at[)\]] ?[a-z0-9-]{1,40}(?: ?[(\[]dot[)\]] ?[a-z0-9-]{2,20})++", r"(?i)[(\[]at[)\]]"),
    "phone_local": (r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"[0-9]{3}[ .-][0-9]{4}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]{2}-[0-9]"),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", "[A-Z]{2}[0-9]{2}"),
    "ip6": (r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])", "(?i)[0-9a-f]:[0-9a-f]{1,4}:"),
}
#: Words that announce a kind.
_CUES = {"email": "mail|contact|write", "ip": "ip|host|server|addr", "card": "card|visa|master|credit|payment", "phone": "phone|tel|call|mobile|fax",
         "email_words": "mail|contact|write", "phone_local": "phone|tel|call|mobile|fax", "ssn": "ssn|social|security", "iban": "iban|account|konto|bank", "ip6": "ip|host|server|addr"}

#: Words after which the same formats mean something else, and ends of host names.
_DECOYS = ("order|ticket|part|lot|ref|version|model|invoice|hash|digest|fingerprint|serial|mac|tracking|item|sku|build|score|price|key|meet|open|loop|isbn|case|id")
_HOST_ENDS = r"(?i)(com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|co|eu|ch|at)[)\]]*$"

FEATURES = ["valid", "decoy", "host_end", "bare", "kind", "length", "digits", "letters", "groups", "distinct", "cue", "any_cue", "joined_left", "joined_right", "upper", "signs", "first"]


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).try_cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(found: Column) -> Column:
    plain = F.replace(found, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, c: F.when(
        c.rlike("[0-9]"), (rest * 10 + c.try_cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)) == 1


def valid(kind: str, found: Column) -> Column:
    """The test of a kind: whether a match of its pattern counts."""
    if kind == "ip":
        return F.forall(F.split(found, "[.]"), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    if kind == "phone_local":
        return _digits(found).rlike("^[2-9][0-9]{2}[2-9]")
    if kind == "ssn":
        return ~found.rlike("^(000|666|9)|-00-|-0000$")
    if kind == "iban":
        return _mod97(found)
    return F.lit(True)


def proposals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__base`` (valid base spans by kind) and ``__more`` (all proposals with their features)."""
    body = F.coalesce(F.col(text), F.lit(""))
    raw = {k: S.in_context(body, p, k, gate) for k, (p, gate) in _PATTERNS.items()}
    rows = docs.withColumns({f"__{k}": v for k, v in raw.items()})
    plain = lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"), s.found.alias("found"))
    base = F.concat(*(F.transform(_kept(k), plain) for k in BASE))
    more = F.concat(*(F.transform(f"__{k}", _described(k)) for k in MORE))
    return rows.withColumns({"__base": base, "__more": more}).drop(*(f"__{k}" for k in raw))


def _kept(kind: str) -> Column:
    def test(s: Column) -> Column:
        return valid(kind, s.found)
    return F.filter(f"__{kind}", test)


def _described(kind: str):
    """Features of a proposal, whether its test holds, and its place."""
    cue, any_cue = f"(?i){_CUES[kind]}", "(?i)" + "|".join(sorted(set("|".join(_CUES.values()).split("|"))))

    def describe(s: Column) -> Column:
        number = lambda c: c.cast("double")
        left = F.right(s.before, F.lit(1))
        holds = valid(kind, s.found)
        values = {
            "valid": number(holds.cast("int")), "decoy": number(s.before.rlike(rf"(?i)\b({_DECOYS})\b").cast("int")), "host_end": number(s.found.rlike(_HOST_ENDS).cast("int")),
            "bare": number(F.regexp_replace(s.before, r"[^A-Za-z]+", "").eqNullSafe("").cast("int")), "kind": F.lit(float(KINDS.index(kind))), "length": number(F.length(s.found)), "digits": number(F.length(_digits(s.found))),
            "letters": number(F.length(F.regexp_replace(s.found, "[^A-Za-z]", ""))), "groups": number(F.size(F.split(s.found, "[^A-Za-z0-9]+"))),
            "distinct": number(F.size(F.array_distinct(F.split(s.found, "")))), "cue": number(s.before.rlike(cue).cast("int")),
            "any_cue": number(s.before.rlike(any_cue).cast("int")), "joined_left": number(left.rlike("[A-Za-z0-9]").cast("int")),
            "joined_right": number(s.after.rlike("[A-Za-z0-9]").cast("int")), "upper": number(F.length(F.regexp_replace(s.found, "[^A-Z]", ""))),
            "signs": number(F.length(F.regexp_replace(s.found, "[A-Za-z0-9 ]", ""))), "first": number(F.ascii(F.left(F.regexp_replace(s.found, "^[^A-Za-z0-9]+", ""), F.lit(1))))}
        return F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"),
                        *(values[f].alias(f"f_{f}") for f in FEATURES))
    return describe


class BoostedTrees:
    """Gradient boosting of small regression trees for the logistic loss."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, step: float = STEP) -> None:
        self.trees, self.depth, self.step, self.start, self.roots = trees, depth, step, 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            root = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.roots.append(root)
            score += self._apply(root, x)
        return self

    def _grow(self, x, gradient, curve, rows, depth):
        g, h = gradient[rows].sum(), curve[rows].sum()
        leaf = float(np.clip(self.step * g / (h + 1.0), -2, 2))
        best = (1e-6, None, None)
        if depth:
            for f in range(x.shape[1]):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                value, gs, hs = x[order, f], gradient[order].cumsum(), curve[order].cumsum()
                cut = np.flatnonzero(value[1:] > value[:-1])
                if len(cut):
                    gain = gs[cut] ** 2 / (hs[cut] + 1) + (g - gs[cut]) ** 2 / (h - hs[cut] + 1) - g * g / (h + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, float(value[cut[k]] + value[cut[k] + 1]) / 2)
        if best[1] is None:
            return leaf
        below = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, gradient, curve, rows[below], depth - 1), self._grow(x, gradient, curve, rows[~below], depth - 1)

    def _apply(self, node, x):
        if isinstance(node, float):
            return np.full(len(x), node)
        return np.where(x[:, node[0]] <= node[1], self._apply(node[2], x), self._apply(node[3], x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((self._apply(r, x) for r in self.roots), np.zeros(len(x)))

    def expression(self, fields: list[Column]) -> Column:
        def column(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            return F.when(fields[node[0]] <= node[1], column(node[2])).otherwise(column(node[3]))
        total = F.lit(self.start)
        for root in self.roots:
            total = total + column(root)
        return total


def _logistic(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that map scores to probabilities."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * score + b)))
        w = p * (1 - p) + 1e-6
        hessian = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
        delta = np.linalg.solve(hessian, np.array([((y - p) * score).sum() - 1e-3 * (a - 1), (y - p).sum()]))
        a, b = a + delta[0], b + delta[1]
    return float(a), float(b)


Selector = tuple[BoostedTrees, float, float, dict[str, float]]


def fit_selector(x: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> Selector:
    """Trees, calibration and cut-offs. A cut-off is the chance that a proposal of the kind has to exceed."""
    kind = x[:, FEATURES.index("kind")]
    held = np.zeros(len(y), bool)
    for k in range(len(KINDS)):
        held[np.flatnonzero(kind == k)[::5]] = True
    trees = BoostedTrees().fit(x[~held], y[~held])
    score = trees.score(x[held])
    a, b = _logistic(score, y[held])
    chance, cuts = 1 / (1 + np.exp(-np.clip(a * score + b, -500, 500))), {}
    for name in MORE:
        own = kind[held] == KINDS.index(name)
        order = np.argsort(-chance[own])
        ranked = chance[own][order]
        good = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        # Equal chances stand or fall together.
        below = np.append(ranked[1:], 0.0)
        enough = np.flatnonzero((good >= precision) & (below < ranked))
        # Halfway to the first chance that is no longer good enough.
        cuts[name] = float((ranked[enough[-1]] + below[enough[-1]]) / 2) if len(enough) else 1.0
    return trees, a, b, cuts


@functools.cache
def _selector_key(sentences: int, seed: int) -> list[Selector]:
    return []


def selector(spark: SparkSession, sentences: int = SENTENCES, seed: int = SEED) -> Selector:
    """The selector that every table is judged by; fitted once per process."""
    kept = _selector_key(sentences, seed)
    if not kept:
        rows = personal_examples.sentences(sentences, seed)
        docs = spark.createDataFrame([(i, text) for i, text, *_ in rows], "doc_id long, text string")
        found = proposals(docs).select("doc_id", F.explode("__more").alias("p")).select("doc_id", "p.*").collect()
        truth = {i: (kind, start, end, real) for i, _, kind, start, end, real in rows}
        found = sorted(found, key=lambda r: (r.doc_id, r.kind, r.start))
        x = np.array([[r[f"f_{f}"] for f in FEATURES] for r in found])
        y = np.array([float(truth[r.doc_id][3] and r.kind == truth[r.doc_id][0] and abs(r.start - truth[r.doc_id][1]) <= 1 and abs(r.end - truth[r.doc_id][2]) <= 1) for r in found])
        kept.append(fit_selector(x, y))
    return kept[0]


def with_personal_spans(docs: DataFrame, keep: list[str], into: tuple[str, str] = ("__base", "__spans")) -> DataFrame:
    """``keep`` columns, the base spans, and base and selected spans, both by kind."""
    trees, a, b, cuts = selector(docs.sparkSession)
    rows = proposals(docs).select(*keep, "__base", "__more")

    def pick(p: Column) -> Column:
        least = F.lit(1.0)
        for kind, cut in cuts.items():
            least = F.when(p.kind == kind, F.lit(cut)).otherwise(least)
        return 1 / (1 + F.exp(-(trees.expression([p[f"f_{f}"] for f in FEATURES]) * a + b))) > least

    chosen = F.transform(F.filter("__more", pick), lambda p: F.struct(p.kind.alias("kind"), p.start.alias("start"), p.end.alias("end"), F.lit("").alias("found")))
    rows = rows.withColumn("__chosen", S.clear_of(chosen, F.col("__base")))
    return rows.select(*keep, S.by_kind(F.col("__base"), KINDS).alias(into[0]), S.by_kind(F.concat("__base", "__chosen"), KINDS).alias(into[1]))


def personal_data_report(docs: DataFrame) -> DataFrame:
    rows = with_personal_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    return rows.select("doc_id", *(S.count_kind(F.col("__base"), k).alias(f"n_{k}") for k in BASE),
                       S.digest(S.listing(F.col("__base"))).alias("base_sha256"), S.listing(F.col("__spans")).alias("spans"))


def redact_personal_data(docs: DataFrame, mark: str = "[PII]") -> DataFrame:
    """The documents with all spans replaced."""
    base, spans = unused("__base_spans", docs), unused("__all_spans", docs)
    rows = with_personal_spans(docs, docs.columns, (base, spans))
    return rows.withColumn("text", F.when(F.size(spans) > 0, S.blanked(F.col("text"), F.col(spans), mark)).otherwise(F.col("text"))).select(*docs.columns)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data_report(table(spark, sf_dir, "documents"))
