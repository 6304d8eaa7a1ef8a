"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs,
schemes and identifier cues.  A local parser for each kind expands from its
anchor to the left and right, validates what it finds (octets of addresses,
Luhn and mod-97 check digits, digit counts) and settles the boundaries.  No
parser looks at text that has no anchor, so prose costs one automaton step a
character.

Base kinds (as a leftmost non-overlapping match of the kind's pattern would
give them): ``email``, ``ip``, ``card``, ``phone``.  Added by cues and schemes:
``account`` (the identifier after a cue such as "IBAN" or "account no."; IBANs
must pass mod 97, numbers need 6 digits, and of capitals and digits mixed 5 of 6
to 20 characters must be digits) and ``login`` (user and password before
the host of a URL).  Added spans never remove base spans.

Defined cases: null texts count as empty; texts without findings have zero
counts, the SHA-256 of the empty string and an empty ``spans``.  Spans are code
points, end exclusive.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("account", "login")
DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
# Cues before an identifier, matched as written, in upper case and with one or all words capitalised.
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "konto", "compte", "cuenta")
# Words that may stand between a cue and its identifier, the longer of two first.
LINKS = ("number", "nummer", "numéro", "número", "no.", "no", "nr.", "nr", "n°", "id")
GAP = frozenset(" \t:#=.")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://", "amqp://", "mongodb://")


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for s in SCHEMES:
        found.add_word(s, ("scheme", len(s)))
    for c in CUES:
        for form in (c, c.upper(), c.capitalize(), c.title()):
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def run_end(text: str, at: int, chars: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def run_start(text: str, at: int, chars: frozenset, least: int) -> int:
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def email_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``, not before ``least``."""
    start = run_start(text, at, LOCAL, least)
    end = run_end(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == ".":
        further = run_end(text, end + 1, LABEL)
        if further == end + 1:
            break
        end, labels = further, labels + 1
    return (start, end) if labels else None


def phone_at(text: str, at: int) -> tuple[int, int] | None:
    """What follows the plus sign at ``at``: a digit, then at least two more characters ending with a digit."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_end(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end > at + 3 and text[end - 1] in DIGITS else None


def digit_chain(text: str, at: int, joins: str) -> list[tuple[int, int]]:
    """Digit runs from ``at`` on, each parted from the last by one character of ``joins``."""
    runs = []
    while True:
        end = run_end(text, at, DIGITS)
        runs.append((at, end))
        if end + 1 < len(text) and text[end] in joins and text[end + 1] in DIGITS:
            at = end + 1
        else:
            return runs


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def octet(digits: str) -> bool:
    kept = digits.lstrip("0")
    return len(kept) <= 3 and int(kept or "0") <= 255


def iban(text: str) -> bool:
    """Country, check digits, account: mod 97 of the rearranged number is 1."""
    if not (15 <= len(text) <= 34 and text[:2].isalpha() and text[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """The longest valid number from ``at`` on, whose characters may be parted by single spaces or dashes.

    A number has 34 characters at most, so that what is looked at is bounded.
    """
    if not (text[at : at + 2].isalpha() and text[at : at + 2].isascii() and run_end(text, at + 2, DIGITS) >= at + 4):
        return None
    value, end, best = "", at, None
    while end < len(text) and len(value) < 34:
        if text[end] in ALNUM:
            value += text[end]
            end += 1
            # it ends where no letter or digit follows
            if (end == len(text) or text[end] not in ALNUM) and iban(value.upper()):
                best = end
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in ALNUM:
            end += 1
        else:
            break
    return None if best is None else (at, best)


def mixed_at(text: str, at: int) -> tuple[int, int] | None:
    """A word of 6 to 20 capitals and digits, of which 5 or more are digits, as passports have."""
    end = run_end(text, at, ALNUM)
    word = text[at:end]
    return (at, end) if 6 <= end - at <= 20 and word == word.upper() and sum(c in DIGITS for c in word) >= 5 else None


def account_after(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The identifier behind a cue that ends at ``at``: an IBAN, 6 digits or more parted by spaces or dashes, or (but for IBANs) capitals and digits mixed."""
    i, n = at, len(text)
    for word in LINKS:
        j = i + 1 if i < n and text[i] in " -" else i
        if text[j : j + len(word)].lower() == word:
            i = j + len(word)
            break
    i = run_end(text, i, GAP)
    if text[i : i + 3] == "is ":
        i = run_end(text, i + 3, GAP)
    if i < n and text[i] not in DIGITS:
        return iban_at(text, i) or (None if cue == "iban" else mixed_at(text, i))
    end = i
    while end < n and (text[end] in DIGITS or text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS):
        end += 1
    if end < n and text[end] in ALNUM:
        return None if cue == "iban" else mixed_at(text, i)
    return (i, end) if sum(c in DIGITS for c in text[i:end]) >= 6 else None


def login_after(text: str, at: int) -> tuple[int, int] | None:
    """``user:password`` between a scheme that ends at ``at`` and the host's at-sign."""
    end, colon = at, 0
    while end < len(text) and text[end] not in " \t\r\n/@\"'<>":
        colon += text[end] == ":"
        end += 1
    return (at, end) if end < len(text) and text[end] == "@" and end > at and colon else None


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end): base kinds as listed, then added kinds, each by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS + MORE_KINDS}
    email_end = phone_end = ip_end = card_end = 0
    for end, (anchor, size) in anchors().iter(text):
        at = end - size + 1
        if anchor == "digit":
            if at >= card_end:
                runs = digit_chain(text, at, " -")
                card_end = runs[-1][1]
                digits = "".join(text[a:b] for a, b in runs)
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((at, card_end))
            if at >= ip_end:
                runs = digit_chain(text, at, ".")
                ip_end = runs[-1][1]
                for i in range(0, len(runs) - 3, 4):
                    if all(octet(text[a:b]) for a, b in runs[i : i + 4]):
                        out["ip"].append((runs[i][0], runs[i + 3][1]))
        elif anchor == "at":
            if (span := email_at(text, at, email_end)) is not None:
                out["email"].append(span)
                email_end = span[1]
        elif anchor == "plus":
            if at >= phone_end and (span := phone_at(text, at)) is not None:
                phone_end = span[1]
                if 8 <= sum(c in DIGITS for c in text[span[0] : span[1]]) <= 15:
                    out["phone"].append(span)
        elif anchor == "cue":
            if (at == 0 or text[at - 1] not in ALNUM) and (span := account_after(text, end + 1, text[at : end + 1].lower())) is not None and (not out["account"] or span[0] >= out["account"][-1][1]):
                out["account"].append(span)
        elif (span := login_after(text, end + 1)) is not None and (not out["login"] or span[0] >= out["login"][-1][1]):
            out["login"].append(span)
    return [(k, a, b) for k in KINDS + MORE_KINDS for a, b in out[k]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, counts of the base kinds, ``base_sha256``, ``spans``, ``n_account``, ``n_login``.

    A narrow transformation without a shuffle.
    """
    kind = dict(docs.dtypes)[id_col]
    counted = KINDS + MORE_KINDS

    def make(keys: list, texts: list) -> dict:
        out: dict = {id_col: keys, "base_sha256": [], "spans": []} | {f"n_{k}": [] for k in counted}
        for text in texts:
            spans = find(text or "")
            kinds = [s[0] for s in spans]
            for k in counted:
                out[f"n_{k}"].append(kinds.count(k))
            base = spans[: sum(map(kinds.count, KINDS))]
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return out

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_batches(docs, [id_col, text_col], make, f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string, n_account long, n_login long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns, with each span of the text replaced by its kind in brackets; null stays null."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in find(text)):
            if b > at:
                out += [text[at : max(a, at)], f"[{k}]" if a >= at else ""]
                at = b
        return "".join([*out, text[at:]])

    cleaned = F.udf(clean, "string", useArrow=True)
    return docs.withColumn(text_col, cleaned(F.col(f"`{text_col}`")))
