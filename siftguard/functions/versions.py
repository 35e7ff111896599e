"""Version keys that compare with ``<=``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """First four numeric parts, split at dots and dashes; anything else counts as 0."""
    parts = F.slice(F.split(version, r"[.\-]"), 1, 4)
    numbers = F.transform(parts, lambda p: F.coalesce(p.try_cast("bigint"), F.lit(0).cast("bigint")))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("bigint"), 4)), 1, 4)


#: Places of the words of a version relative to its plain release, which is 4.
_WORDS = {"dev": 0, "a": 1, "alpha": 1, "b": 2, "beta": 2, "c": 3, "rc": 3, "pre": 3, "preview": 3}
_RELEASE, _AFTER, _NUMBER = 4, 5, 6
#: Ecosystems whose versions are semantic versions.
SEMANTIC = ["npm", "crates.io", "Go", "Hex", "Pub", "SwiftURL"]


def _part(place, number=None, text=None) -> Column:
    place = place if isinstance(place, Column) else F.lit(place)
    number = F.lit(0) if number is None else number
    return F.struct(place.cast("int").alias("place"), number.cast("bigint").alias("number"), (F.lit("") if text is None else text).alias("text"))


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("bigint"), F.lit(2**63 - 1))


def ordered_version(version: Column, semantic: Column) -> Column:
    """An array that sorts as versions do, pre-releases before and post-releases after their release.

    Zeros at the end of the release do not count, build and local parts neither. In semantic versions the identifiers
    of a pre-release compare one by one, numbers before words. Elsewhere words have their usual places, and unknown
    words come after the release.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(version)), "^v(?=[0-9])", ""), r"[+].*$", "")
    epoch = _number(F.coalesce(F.nullif(F.regexp_extract(plain, "^([0-9]+)!", 1), F.lit("")), F.lit("0")))
    body = F.regexp_replace(plain, "^[0-9]+!", "")
    release = F.regexp_extract(body, r"^[0-9]+(?:\.[0-9]+)*", 0)
    rest = F.substr(body, F.length(release) + 1)
    numbers = F.when(release == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(release, r"(?:\.0+)+$", ""), "[.]"))
    head = F.concat(F.array(_part(_NUMBER, epoch)), F.transform(numbers, lambda n: _part(_NUMBER, _number(n))))

    def identifier(x: Column) -> Column:
        return F.when(x.rlike("^[0-9]+$"), _part(1, _number(x))).otherwise(_part(2, None, x))

    def word(x: Column) -> Column:
        place = F.lit(_AFTER)
        for name, value in _WORDS.items():
            place = F.when(x == name, value).otherwise(place)
        known = x.isin(*_WORDS, "post", "rev", "r")
        return F.when(x.rlike("^[0-9]"), _part(_AFTER, _number(x))).otherwise(_part(place, None, F.when(known, F.lit("")).otherwise(x)))

    identifiers = F.concat(F.transform(F.split(F.substr(rest, F.lit(2)), "[.]"), identifier), F.array(_part(0)))
    words = F.concat(F.transform(F.regexp_extract_all(rest, F.lit("[0-9]+|[a-z]+"), F.lit(0)), word), F.array(_part(_RELEASE)))
    return F.concat(head, F.when(semantic & rest.startswith("-"), identifiers).otherwise(words))
