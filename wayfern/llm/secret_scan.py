"""Secret scans.

Two parts.  Fixed patterns find assignments, access keys and hexadecimal
strings.  The entropy part takes candidate strings (runs of 20 or more base64 or
hexadecimal characters), slides a window over each, keeps the window's counts
and its sum of n*log2(n) up to date as one character enters and one leaves, and
reports candidates of which a window reaches the limit of the class of the
window's own characters; the limit is highest where most characters can occur,
and windows of digits alone have none.  An allow-list suppresses entropy findings, words and dates among them;
letters in mixed case are no words.  Pattern findings always stay.

Defined cases: null texts count as empty; texts without findings have zero
counts, the SHA-256 of the empty string and an empty ``spans``.  Whole texts
are scanned, whatever their length.  Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_batches

# The patterns of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile(HEX)
_candidate = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

#: n * log2(n) for the counts a window can hold.
_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, 257)]


@dataclass(frozen=True)
class EntropyRule:
    """Limits of the entropy part; bits a character over a window of ``window`` (2 to 256)."""

    window: int = 20
    limits: tuple[tuple[str, float], ...] = (("hex", 2.9), ("alnum", 3.6), ("base64", 3.7))
    #: Full matches of a candidate that are no secrets: dates and numbers, words (in one case or with an initial capital) joined by dashes, paths of
    #: such words (with a number of one or two digits behind), ids of public form, and what has a part that says so.  No entry goes back over what it has read.
    allow: tuple[str, ...] = (
        r"[0-9]++(-[0-9]++)*+",
        r"[-_/+]*+(?>[A-Z]?[a-z]++|[A-Z]++)?+(?:[-_/+]++(?>[A-Z]?[a-z]++|[A-Z]++))*+[-_/+]*+=*+",
        r"(?=[^/]*+/)/*+(?>[A-Z]?[a-z]{3,}+[0-9]{1,2}+|[A-Z]?[a-z]++|[A-Z]++)(?:[-_/]++(?>[A-Z]?[a-z]{3,}+[0-9]{1,2}+|[A-Z]?[a-z]++|[A-Z]++))*+/*+",
        r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}",
        r"(?i:(?:[a-z0-9]*+[-_/+]++)*?(?:example|sample|dummy|placeholder)(?:[-_/+=].*)?)",
    )

    def allowed(self, text: str) -> bool:
        return _allow_list(self.allow).fullmatch(text) is not None


@lru_cache(maxsize=8)
def _allow_list(entries: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{e})" for e in entries) if entries else r"(?!)")


_KIND = dict.fromkeys("0123456789", 0) | dict.fromkeys("abcdefABCDEF", 1) | dict.fromkeys("ghijklmnopqrstuvwxyzGHIJKLMNOPQRSTUVWXYZ", 2)


def _class(kinds: list[int]) -> str | None:
    """The narrowest class, from the numbers of digits, letters A to F, other letters and other characters."""
    if kinds[3]:
        return "base64"
    if kinds[2]:
        return "alnum"
    return "hex" if kinds[1] else None


def hot_class(text: str, rule: EntropyRule) -> str | None:
    """The class of the first window that reaches its class's limit, null if none does.

    A window's entropy is log2(w) - (1/w) * sum n*log2(n); as one character
    enters and one leaves, the sum and the counts of kinds change by two terms.
    """
    w = min(rule.window, len(text))
    if not w:
        return None
    full, limits = math.log2(w), dict(rule.limits)
    counts: dict[str, int] = {}
    kinds = [0] * 4
    total = 0.0
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        kinds[_KIND.get(c, 3)] += 1
        if i >= w:
            old = text[i - w]
            n = counts[old]
            total += _NLOGN[n - 1] - _NLOGN[n]
            counts[old] = n - 1
            kinds[_KIND.get(old, 3)] -= 1
        if i >= w - 1 and (found := _class(kinds)) is not None and full - total / w >= limits[found]:
            return found
    return None


def window_entropy(text: str, window: int) -> float:
    """The highest Shannon entropy (bits a character) of any window of the text.

    H = log2(w) - (1/w) * sum n*log2(n); the sum changes by two terms a step.
    """
    w = min(window, len(text))
    if not w:
        return 0.0
    counts: dict[str, int] = {}
    total = 0.0
    best = math.inf
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _NLOGN[n + 1] - _NLOGN[n]
        counts[c] = n + 1
        if i >= w:
            old = text[i - w]
            n = counts[old]
            total += _NLOGN[n - 1] - _NLOGN[n]
            counts[old] = n - 1
        if i >= w - 1:
            best = min(best, total)
    return math.log2(w) - best / w


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def entropy_spans(text: str, rule: EntropyRule) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates over their class's limit; the kind is ``entropy_`` and the class of the window that reached it."""
    out = []
    for m in _candidate.finditer(text):
        s = m.group()
        if rule.allowed(s):
            continue
        if (kind := hot_class(s.rstrip("="), rule)) is not None:
            out.append((m.start(), m.end(), f"entropy_{kind}"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: EntropyRule | None = None) -> DataFrame:
    """One row per document: id, counts of each base kind, ``base_sha256``, ``spans``, ``n_entropy``.

    A narrow transformation without a shuffle.
    """
    rule = rule or EntropyRule()
    kind = dict(docs.dtypes)[id_col]
    order = {k: i for i, k in enumerate(KINDS)}

    def make(keys: list, texts: list) -> dict:
        out: dict = {id_col: keys, "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_entropy": []}
        for text in texts:
            base = base_spans(text or "")
            more = entropy_spans(text or "", rule)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted(base + more, key=lambda s: (s[0], order.get(s[2], 9), s[1], s[2]))))
            out["n_entropy"].append(len(more))
        return out

    return map_batches(docs, [id_col, text_col], make, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def redact(docs: DataFrame, text_col: str = "text", rule: EntropyRule | None = None, mark: str = "[secret]") -> DataFrame:
    """All columns, with every found span of the text replaced; null stays null."""
    from pyspark.sql import functions as F

    rule = rule or EntropyRule()

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, b, _ in sorted(base_spans(text) + entropy_spans(text, rule)):
            if b > at:
                out += [text[at : max(a, at)], mark if a >= at else ""]
                at = b
        return "".join([*out, text[at:]])

    cleaned = F.udf(clean, "string", useArrow=True)
    return docs.withColumn(text_col, cleaned(F.col(f"`{text_col}`")))
