"""License scans: ordered signature rules with a keyword gate and interval suppression.

Text is normalised to lower-case words with single blanks between them. Rules are regexes over
that form; they are written out per license family and per way of naming it (permission
sentences, notices, titles with version, identifiers), which gives a few hundred. A rule runs
only on documents that hold one of its keywords (each alternative of a name has one), and all rules only on documents that hold any
keyword. Every match is an interval of words with the priority of its rule; an interval that
lies inside one of higher priority, or of equal priority and greater length, is suppressed.

The base phrases are found apart from the rules; their places and labels always stay.

Score: the confidence of the best detection that is kept (base phrases 0.9), 0 without any.

Everything is built of SQL functions. Defined cases: null and empty texts have no words,
labels or places and score 0; a null doc_id is carried through; repeated rows repeat; other
columns never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftguard.llm import spans as S
from siftguard.llm.common import ascii_lower, table

#: Fixed phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Label, keywords of all alternatives (split by |), and the family's name as a regex over normalised words; a version follows in ``_VERSIONED``.
_NAMED = [
    ("mit", "mit", "mit"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib(?: libpng)?"), ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl|do what the fuck", "wtfpl|do what the fuck you want to public"), ("0bsd", "0bsd|zero clause", "0bsd|zero clause bsd"),
    ("bsd-2-clause", "bsd|freebsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"), ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)"), ("bsd", "bsd", "bsd"), ("python-2", "python|psf", "(?:python software foundation|psf)"),
    ("openssl", "openssl", "openssl"), ("postgresql", "postgresql", "postgresql"), ("ruby", "ruby", "ruby"), ("php-3", "php", "php"),
    ("curl", "curl", "curl"), ("libpng", "libpng", "libpng"), ("x11", "x11", "x11"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("vim", "vim", "vim"), ("beerware", "beer", "beer ?ware"), ("ofl-1-1", "font", "(?:sil )?open font"), ("odbl-1", "database", "open database"),
    ("odc-by-1", "commons", "open data commons attribution"), ("pddl-1", "public domain", "public domain dedication and"), ("ms-pl", "microsoft", "microsoft public"),
    ("ms-rl", "microsoft", "microsoft reciprocal"), ("upl-1", "universal", "universal permissive"), ("blueoak-1", "blue oak", "blue oak model"), ("w3c", "w3c", "w3c(?: software)?"),
]
#: Label stem, keyword, name, versions.
_VERSIONED = [
    ("apache", "apache", "apache(?: software)?", ["1 0", "1 1", "2 0", "2"]), ("gpl", "general public", "(?:gnu )?general public", ["1", "2", "3", "1 0", "2 0", "3 0"]),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public", ["2 1", "3", "3 0"]), ("lgpl", "library general", "(?:gnu )?library general public", ["2", "2 0"]),
    ("agpl", "affero", "(?:gnu )?affero general public", ["1", "3", "3 0"]), ("gfdl", "free documentation", "(?:gnu )?free documentation", ["1 1", "1 2", "1 3"]),
    ("mpl", "mozilla", "mozilla public", ["1 0", "1 1", "2 0"]), ("epl", "eclipse", "eclipse public", ["1 0", "2 0"]), ("eupl", "european union", "european union public", ["1 1", "1 2"]),
    ("cddl", "common development", "common development and distribution", ["1 0", "1 1"]), ("cpl", "common public", "common public", ["0 5", "1 0"]),
    ("artistic", "artistic", "artistic", ["1 0", "2 0"]), ("boost", "boost", "boost software", ["1 0"]), ("afl", "academic free", "academic free", ["2 1", "3 0"]),
    ("osl", "open software", "open software", ["2 1", "3 0"]), ("ecl", "educational community", "educational community", ["1 0", "2 0"]),
    ("qpl", "q public", "q public", ["1 0"]), ("zpl", "zope", "zope public", ["2 0", "2 1"]), ("cecill", "cecill", "cecill(?: free software)?", ["1 0", "2 0", "2 1"]),
]
_SHORT = {"gpl": ["1", "2", "3"], "lgpl": ["2", "2 1", "3"], "agpl": ["1", "3"], "mpl": ["1 0", "1 1", "2 0"], "epl": ["1 0", "2 0"], "gfdl": ["1 1", "1 2", "1 3"],
          "cddl": ["1 0", "1 1"], "eupl": ["1 1", "1 2"], "apache": ["1 0", "1 1", "2 0"], "artistic": ["1 0", "2 0"], "bsl": ["1 0", "1 1"]}
_CC = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderiv(?:atives|s)",
       "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderiv(?:atives|s)"}
#: Sentences that name no license but identify one: label, keyword, words.
_SENTENCES = [
    ("mit", "free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("isc", "with or without fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "source and binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2", "limitations under", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2", "compliance with", "you may not use this file except in compliance with the license"),
    ("gpl", "redistribute it and", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("zlib", "as is without any", "this software is provided as is without any express or implied warranty"),
    ("mpl-2", "source code form", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1", "cc0", "cc0 1 0 universal"), ("public-domain", "public domain", "(?:dedicated|released) (?:in)?to the public domain"),
    ("proprietary", "all rights", "all rights reserved"), ("proprietary", "confidential", "proprietary and confidential"),
    ("wtfpl", "what the fuck", "you just do what the fuck you want to"), ("beerware", "buy me a beer", "you can buy me a beer in return"),
]


def signature_rules() -> list[tuple[str, str, str, int, float]]:
    """Label, keywords, pattern over normalised words, priority, confidence; in rule order."""
    rules = [(label, key, words, 90, 1.0) for label, key, words in _SENTENCES]
    for stem, key, name, versions in _VERSIONED:
        for version in versions:
            label = f"{stem}-{version.removesuffix(' 0').replace(' ', '-')}"
            rules.append((label, key, f"{name} licen[sc]e (?:version |v ?)?{version}", 80, 0.95))
            rules.append((label, key, f"{name} licen[sc]e (?:version |v ?)?{version} or (?:any|at your option any) later(?: version)?", 85, 0.95))
        rules.append((stem, key, f"(?:under|terms of|conditions of) the {name} licen[sc]e", 60, 0.8))
        rules.append((stem, key, f"{name} licen[sc]e", 40, 0.6))
    for label, key, name in _NAMED:
        rules.append((label, key, f"(?:under|terms of|conditions of) (?:the |an? )?(?:{name}) (?:style )?licen[sc]e", 75, 0.9))
        rules.append((label, key, f"(?:{name}) licen[sc]e", 55, 0.7))
        rules.append((label, key, f"licen[sc]e (?:is |the )?(?:{name})", 50, 0.6))
        rules.append((label, key, f"licen[sc]ed (?:under|as) (?:{name})", 70, 0.8))
    for stem, versions in _SHORT.items():
        for version in versions:
            label = f"{stem}-{version.removesuffix(' 0').replace(' ', '-')}"
            rules.append((label, stem, f"(?:{stem} v?{version}|{stem}v{version})(?: only| or later)?", 65, 0.8))
            rules.append((label, stem, f"spdx license identifier {stem} {version}(?: only| or later)?", 95, 1.0))
    for code, name in _CC.items():
        label = "cc-" + code.replace(" ", "-")
        rules.append((label, f"cc {code}", f"cc {code}", 64 + len(code), 0.8))
        rules.append((label, f"cc {code}", f"spdx license identifier cc {code} [1-4] 0", 95, 1.0))
        rules.append((label, "creative commons", f"creative commons {name}", 60 + len(code), 0.9))
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            rules.append((f"{label}-{version.removesuffix(' 0').replace(' ', '-')}", f"cc {code}", f"cc {code} {version}", 80 + len(code), 0.95))
            rules.append((f"{label}-{version.removesuffix(' 0').replace(' ', '-')}", "creative commons",
                          f"creative commons {name}(?: licen[sc]e)? {version}(?: international)?", 80 + len(code), 0.95))
    return rules


def _names_license(pattern: str) -> bool:
    return "licen[sc]e" in pattern.replace("(?: licen[sc]e)?", "")


def _gate(rules: list[tuple]) -> str:
    """One regex of all keywords; those that another one begins are left out.

    Rules whose pattern names a license need that word, which is rarer than their own keyword.
    """
    keys = sorted({k for r in rules for k in (["licen"] if _names_license(r[2]) else r[1].split("|"))} | {"cc by"})
    keys = [k for k in keys if not any(k != o and k.startswith(o) for o in keys)]
    return " (?:" + "|".join(keys) + ")"


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(norm: Column, pattern: Column) -> Column:
    """First and end word of every match of a pattern between blanks."""
    bounded = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))

    def placed(x: Column) -> Column:
        # A match ends where its words do; the blank after it begins the next gap.
        ends = S.running(F.zip_with(x.gap, x.m, lambda gap, m: _blanks(gap) + _blanks(m)), "int", lambda a, b: a + b)
        return F.zip_with(x.m, ends, lambda m, end: F.struct((end - 1 - _blanks(m)).alias("first"), end.alias("end")))

    return S.once(S.matches(norm, bounded), placed)


def _kept(matched: Column, levels: list[int]) -> Column:
    """Matches inside no other of higher priority, nor of equal priority and greater length (equal length: earlier rule).

    In the order of first words, longer ones first, whatever may hold a match comes before it. What is carried along is the farthest end per
    priority or higher, so one pass decides.
    """
    place = F.array(*map(F.lit, levels))
    ordered = F.array_sort(F.transform(matched, lambda m: F.struct(
        m.first.alias("first"), (-m.end).alias("back"), m.order.alias("order"), m.rank.alias("rank"), m.alias("m"), F.array_position(place, m.order).cast("int").alias("level"))))

    def chosen(x: Column) -> Column:
        far = S.running(F.transform(x, lambda e: F.transform(place, lambda order: F.when(order >= e.order, e.m.end).otherwise(-1))), "array<int>",
                        lambda a, b: F.zip_with(a, b, lambda u, v: F.greatest(u, v)))
        before = F.concat(F.array(F.lit(None).cast("array<int>")), F.slice(far, F.lit(1), F.size(far) - 1))
        own = lambda e, b: b.isNull() | (F.element_at(b, e.level) < e.m.end)
        return F.array_sort(F.array_compact(F.zip_with(x, before, lambda e, b: F.when(own(e, b), e.m))))

    return F.when(F.size(matched) > 1, S.once(ordered, chosen)).otherwise(matched)


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: words, base places and labels, labels of the rules, score, and the kept detections."""
    rules = signature_rules()
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), _NOT_WORD, " ")), F.lit(" "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"))
    n_words = F.when(F.col("norm") == "  ", F.lit(0)).otherwise(_blanks(F.col("norm")) - 1).cast("long")
    rows = rows.select("doc_id", n_words.alias("n_words"), F.when(F.col("norm").rlike(_gate(rules)), F.col("norm")).alias("norm"))

    base = [_places(F.col("norm"), F.lit(phrase)) for phrase in PHRASES]
    labels = [F.when(F.size(places) > 0, F.lit(label)) for places, label in zip(base, PHRASES.values(), strict=True)]
    firsts = F.flatten(F.array(*(F.transform(b, lambda p: p.first) for b in base)))
    rows = rows.withColumns({"firsts": F.when(F.col("norm").isNotNull(), firsts), "base": F.when(F.col("norm").isNotNull(), F.array_compact(F.array(*labels)))})

    shape = "struct<rank:int,label:string,keys:array<string>,word:string,pattern:string,priority:int,score:double>"
    catalogue = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(label).alias("label"), F.array(*(F.lit(" " + k) for k in key.split("|"))).alias("keys"),
                                   F.lit(" licen" if _names_license(pattern) else " ").alias("word"), F.lit(pattern).alias("pattern"),
                                   F.lit(priority).alias("priority"), F.lit(score).alias("score")) for i, (label, key, pattern, priority, score) in enumerate(rules))).cast(f"array<{shape}>")
    gated = F.filter(catalogue, lambda r: F.col("norm").contains(r.word) & F.exists(r["keys"], lambda k: F.col("norm").contains(k)))
    matched = F.flatten(F.transform(gated, lambda r: F.transform(_places(F.col("norm"), r.pattern), lambda p: F.struct(
        (-r.priority).alias("order"), (p.first - p.end).alias("shorter"), r.rank.alias("rank"), p.first.alias("first"), p.end.alias("end"), r.label.alias("label"), r.score.alias("score")))))
    empty = F.array().cast("array<struct<order:int,shorter:int,rank:int,first:int,end:int,label:string,score:double>>")
    kept = S.once(matched, lambda x: _kept(x, sorted({-r[3] for r in rules})))
    rows = rows.withColumn("detections", F.when(F.col("norm").isNotNull(), kept))

    none = F.array().cast("array<string>")
    base_labels = F.coalesce("base", none)
    found = F.coalesce("detections", empty)
    best = F.aggregate(found, F.when(F.size(base_labels) > 0, F.lit(0.9)).otherwise(F.lit(0.0)), lambda s, d: F.greatest(s, d.score))
    return rows.select(
        "doc_id", "n_words", F.coalesce(F.size(F.coalesce("firsts", F.array().cast("array<int>"))), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("firsts").cast("long").alias("first_word"), F.array_max("firsts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, F.transform(found, lambda d: d.label)))), ",").alias("labels"),
        best.alias("score"), F.transform(found, lambda d: F.struct(d.label.alias("label"), d.first.alias("first"), d.end.alias("end"))).alias("detections"))


def op10_license_scans(spark, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents")).drop("detections")
