"""Text normalisers as column expressions.

Spark has no Unicode normalisation, so NFKC is one vectorised UDF, which sees
only texts with a character that it may change; everything else stays in the
JVM.  White space means the Unicode-wide class plus U+FEFF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\p{Z}\x{FEFF}\x{85}\x{0B}]"
#: Texts of these characters alone are NFKC already: ASCII, composed Latin letters, Hangul syllables and some signs.
STABLE = r"^[\x00-\x7F\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{2010}\x{2013}\x{2014}\x{2018}-\x{201D}\x{AC00}-\x{D7A3}]*$"
_latin = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x10000) if len(unicodedata.normalize("NFD", chr(c))) > 1 and "LATIN" in unicodedata.name(unicodedata.normalize("NFD", chr(c))[0], "")]


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.str.normalize("NFKC")


def let(x: Column, use) -> Column:
    """``use(x)`` with ``x`` evaluated once, however often it is used."""
    return F.transform(F.array(x), use)[0]


def nfkc(x: Column) -> Column:
    stable = x.rlike(STABLE)
    return F.when(stable, x).otherwise(_nfkc(F.when(~stable, x)))


def fold_diacritics(x: Column) -> Column:
    """Latin letters without their marks; other scripts stay composed."""
    return F.translate(x, "".join(c for c, _ in _latin), "".join(b for _, b in _latin))


def collapse(x: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def search_text(x: Column, normal: bool = False) -> Column:
    """NFKC, lower case, controls, punctuation and symbols to spaces, collapsed.  ``normal``: the input is NFKC already."""
    x = x if normal else nfkc(x)
    return collapse(F.regexp_replace(F.lower(x), r"[\p{Cc}\p{Cf}\p{P}\p{S}]+", " "))


def compact_key(x: Column) -> Column:
    """Letters and digits of a normalised text."""
    return F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")


def review_text(x: Column, normal: bool = False) -> Column:
    """NFKC, lower case, ASCII controls to spaces, collapsed; punctuation stays."""
    x = x if normal else nfkc(x)
    return collapse(F.regexp_replace(F.lower(x), r"[\x00-\x1F\x7F]+", " "))


def address(x: Column) -> Column:
    """struct(display_address, normalized_address, district), null unless within Seoul."""
    # fixed values: dashes, and the city's names
    t = collapse(F.regexp_replace(nfkc(F.coalesce(x, F.lit(""))), r"[\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2212}\x{FF0D}]", "-"))
    t = F.regexp_replace(t, rf"^서울(?:특별시|시)?(?={SPACE})", "서울특별시")
    t = collapse(F.regexp_replace(t, "[,·]", " "))
    district = F.regexp_extract(t, r"^서울특별시\s+([가-힣]+구)(?:\s|$)", 1)
    return F.when(district != "", F.struct(t.alias("display_address"), t.alias("normalized_address"), district.alias("district")))


def phone_digits(x: Column) -> Column:
    """A domestic number of 9 to 11 digits, or null for placeholders and other numbers; full-width digits count."""
    x = nfkc(x)
    raw = F.regexp_replace(x, r"[^0-9]", "")
    digits = F.when(F.startswith(F.trim(x), F.lit("+82")) & F.startswith(raw, F.lit("82")), F.concat(F.lit("0"), F.substring(raw, 3, 40))).otherwise(raw)
    good = digits.rlike(r"^0\d{8,10}$") & ~digits.rlike("0{6,}") & ~digits.rlike(r"^(\d)\1+$")
    return F.when(good, digits)


def store_name(x: Column) -> Column:
    """struct(display_name, normalized_name, normalized_brand_name, branch_name)."""
    # fixed values: how a company is marked
    mark = r"(?:\(\s*주\s*\)|㈜|주식회사)"
    t = nfkc(F.regexp_replace(F.regexp_replace(collapse(x), "㈜", "(주)"), "^$", ""))
    t = collapse(F.regexp_replace(F.regexp_replace(t, rf"^(?:{mark}\s*)+", ""), rf"\s*{mark}$", ""))
    words = F.filter(F.split(t, " "), lambda w: w != "")
    last = F.try_element_at(words, F.lit(-1))
    # fixed values: words ending like a branch that name a kind of shop
    branch = F.when((last == "본점") | (F.endswith(last, F.lit("점")) & ~last.isin("제과점", "빵집", "베이커리", "카페")), last)
    brand = F.when(branch.isNull(), words).otherwise(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))
    key = lambda ws: F.regexp_replace(F.lower(F.array_join(ws, "")), r"[^\p{L}\p{N}]", "")
    return F.struct(t.alias("display_name"), key(words).alias("normalized_name"), key(brand).alias("normalized_brand_name"), branch.alias("branch_name"))


def bigrams(x: Column) -> Column:
    """Distinct pairs of neighbouring characters; a shorter string is its own."""
    n = F.length(x)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2)))
    return F.when(n < 2, F.array(x)).otherwise(F.array_distinct(pairs))


def category_tag(x: Column) -> Column:
    """The last part of a category path, with single spaces and none before commas."""
    return F.regexp_replace(collapse(F.element_at(F.split(x, ">"), -1)), r"\s*,\s*", ",")


# What reviews are refused or redacted for, in this order.
NAMED_PERSON = r"(?:사장|직원|알바|손님)\s*[가-힣]{2,4}(?:씨|님)"
SENSITIVE = "주민등록|계좌번호|카드번호|병원|진단|약물|성폭력|고소|분쟁|신고"
IDENTIFIERS = (
    r"(?i)(?:https?://|www\.)[^\s]+",
    r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}",
    r"(?<![A-Za-z0-9_])\d(?:[\s-]?\d){11,}(?![A-Za-z0-9_])",
    r"(?:\+?82[-\s]?)?(?:0?1[016789]|0?2|0?[3-6][1-5])[-\s]?\d{3,4}[-\s]?\d{4}",
    r"\+\d[\d\s().-]{7,}\d",
    r"(?<![\p{L}\p{N}])@[A-Za-z0-9._]{2,}",
)


def deidentify(x: Column, normal: bool = False, patterns: tuple[str, ...] = IDENTIFIERS) -> Column:
    """struct(accepted, text, reason_code): identifiers redacted, sensitive or empty reviews refused."""


    def redacted(t: Column, left: tuple[str, ...] = patterns) -> Column:
        if not left:
            return collapse(t)
        p = left[0]
        # a pattern is tried only where a character that it needs is there
        needs = F.contains(t, F.lit("@")) if "@" in p else t.rlike(r"(?i)://|www\.") if "www" in p else t.rlike("[0-9]")
        return let(F.when(needs, F.regexp_replace(t, p, "[redacted]")).otherwise(t), lambda r: redacted(r, left[1:]))

    def judged(t: Column, r: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(r, r"\[redacted\]", ""), r"[\p{P}\p{S}\s]", "")
        reason = F.when(F.coalesce(t, F.lit("")) == "", "REJECTED_EMPTY").when(t.rlike(NAMED_PERSON) | t.rlike(SENSITIVE), "REJECTED_PII").when(rest == "", "REJECTED_EMPTY")
        return let(reason, lambda c: F.struct(c.isNull().alias("accepted"), F.when(c.isNull(), r).alias("text"), c.alias("reason_code")))

    return let(collapse(x if normal else nfkc(x)), lambda t: let(redacted(t), lambda r: judged(t, r)))


# Words that mean the same item, in group order.
SYNONYMS = (
    ("사워도우", "sourdough", "천연발효빵"),
    ("크루아상", "크로와상", "croissant"),
    ("페이스트리", "패스트리", "pastry"),
    ("소금빵", "시오빵"),
    ("바게트", "baguette"),
    ("식빵", "loaf"),
)


def plain_search_text(x: str) -> tuple[str, str]:
    """(normalised text, compact key) of one string, on the driver."""
    t = unicodedata.normalize("NFKC", x).lower()
    t = "".join(" " if unicodedata.category(c)[0] in "PS" or unicodedata.category(c) in ("Cc", "Cf") or c.isspace() else c for c in t)
    t = " ".join(t.split())
    return t, "".join(c for c in t if unicodedata.category(c)[0] in "LN")


def expand_terms(x: str, groups=SYNONYMS) -> list[str]:
    """Compact keys of the term's synonym group in group order, or of the term itself."""
    key = plain_search_text(x)[1]
    for group in groups:
        keys = list(dict.fromkeys(plain_search_text(g)[1] for g in group))
        if key in keys:
            return keys
    return [key]


def truncate(x: Column, n: int) -> Column:
    """The first ``n`` UTF-16 units, without half of a pair at the end."""
    units = F.substring(F.encode(x, "UTF-16BE"), 1, 2 * n)
    halved = F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB")
    cut = F.decode(F.when(halved, F.substring(units, 1, 2 * n - 2)).otherwise(units), "UTF-16BE")
    return F.when(F.length(x) <= n // 2, x).otherwise(cut)
