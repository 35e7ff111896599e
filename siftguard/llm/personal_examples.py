"""Labelled sentences from which the span selector learns: personal data and things that look like it, in context.

Everything is made by rule from a seed, so the selector is the same for every table. A sentence is filler, perhaps a cue, an item, filler. The same
formats occur as order numbers, versions or hashes after other words, and with broken checksums or impossible ranges.
"""

from __future__ import annotations

import random
import string

_FILL = "the a of we our in on was and to for new old please see note with today last year list team about this that from".split()
_NAMES = "anna ben carla dev erik fatima george hana ivan jo kim lena max nina omar".split()
_HOSTS = "example acme globex initech umbrella hooli stark wayne mailbox post".split()
_ENDS = ["com", "org", "net", "de", "io", "co uk", "info", "edu"]
_WORDS = "noon ten five left right top row index value time place work home".split()

#: Kind: words before real items, words before things that only look alike.
CONTEXT = {
    "email_words": (["mail me:", "write to", "contact", "email:", "reach me under"], ["meet", "price", "open", "see item", "loop"]),
    "phone_local": (["call", "tel", "phone:", "mobile", "fax", "telephone number"], ["order", "part no", "ticket", "score", "sku", "tracking", "invoice"]),
    "ssn": (["ssn", "social security number", "my ssn is", "social:"], ["order", "lot", "ticket", "item", "ref", "serial", "build"]),
    "iban": (["iban", "account", "bank account:", "konto", "pay to"], ["serial", "model", "key", "sku", "tracking", "version"]),
    "ip6": (["server", "host", "ip", "address", "connect to"], ["fingerprint", "hash", "digest", "mac", "key id"]),
}


def _digits(rng: random.Random, n: int, first: str = string.digits) -> str:
    return rng.choice(first) + "".join(rng.choices(string.digits, k=n - 1))


def iban(rng: random.Random, good: bool) -> str:
    country, account = rng.choice(["DE", "GB", "FR", "ES", "NL"]), "".join(rng.choices(string.digits, k=rng.choice([14, 16, 18])))
    turned = "".join(str(int(c, 36)) for c in account + country + "00")
    check = 98 - int(turned) % 97
    if not good:
        check = (check + rng.randint(1, 95)) % 97
    text = f"{country}{check:02d}{account}"
    return " ".join(text[i:i + 4] for i in range(0, len(text), 4)) if rng.random() < 0.5 else text


def item(rng: random.Random, kind: str, real: bool) -> str:
    """One item of a kind. What is not real may still be well-formed."""
    formed = real or rng.random() < 0.6
    if kind == "email_words":
        at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] ")])
        who, host, end = (rng.choice(_NAMES), rng.choice(_HOSTS), rng.choice(_ENDS).split()[0]) if real else rng.choices(_WORDS, k=3)
        return f"{who}{at}{host}{dot}{end}"
    if kind == "phone_local":
        area = _digits(rng, 3, "23456789" if formed else "01")
        form = rng.choice(["{0}-{1}-{2}", "({0}) {1}-{2}", "{0} {1} {2}", "{0}.{1}.{2}"] if real else ["{0}-{1}-{2}", "{0} {1} {2}", "{0}.{1}.{2}"])
        return form.format(area, _digits(rng, 3, "23456789" if formed else "01"), _digits(rng, 4)).replace("(", "(", 1)
    if kind == "ssn":
        return f"{rng.randint(1, 899):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" if formed else rng.choice(["000", "9" + _digits(rng, 2)]) + f"-{_digits(rng, 2)}-{_digits(rng, 4)}"
    if kind == "iban":
        return iban(rng, formed) if real or rng.random() < 0.5 else "".join(rng.choices(string.ascii_uppercase, k=2)) + _digits(rng, 2) + "".join(rng.choices(string.ascii_uppercase + string.digits, k=12))
    if real:
        return ":".join(["2001", "db8", *("%x" % rng.randint(0, 65535) for _ in range(6))])
    return ":".join("%02x" % rng.randint(0, 255) for _ in range(8))


def sentences(n: int, seed: int) -> list[tuple[int, str, str, int, int, bool]]:
    """(number, text, kind, start, end, real) of ``n`` sentences with one item each, a third of them real."""
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.choice(list(CONTEXT))
        real = rng.random() < 0.4
        before = rng.choices(_FILL, k=rng.randint(0, 9))
        cued = rng.random() < 0.8
        if cued:
            before.append(rng.choice(CONTEXT[kind][0 if real else 1]))
        elif not real and rng.random() < 0.5:
            # A broken item right after a cue is no more than that.
            before.append(rng.choice(CONTEXT[kind][0]))
        text = " ".join(before)
        what = item(rng, kind, real)
        if not real and not cued:
            what = _broken(rng, kind)
        text = f"{text} " if text else ""
        start = len(text)
        out.append((i, f"{text}{what} {' '.join(rng.choices(_FILL, k=rng.randint(0, 6)))}".rstrip(), kind, start, start + len(what), real))
    return out


def _broken(rng: random.Random, kind: str) -> str:
    """An item that no context makes real."""
    if kind == "ssn":
        return f"000-{_digits(rng, 2)}-{_digits(rng, 4)}"
    if kind == "iban":
        return iban(rng, False)
    if kind == "phone_local":
        return f"{_digits(rng, 3, '01')}-{_digits(rng, 3, '01')}-{_digits(rng, 4)}"
    return item(rng, kind, False)
