"""Elements of HTML pages by selectors, and reviews by a selector contract.

A page is read into nested elements, so an element ends where its own closing
tag is, whatever it holds; selectors find elements by tag, id, class, attribute
and descent.  Pages are read in batches in tasks; what goes on is a page's gate,
its number of items and the items' texts.  The order of dates, the slice that
is new on a page and where reading ends follow from the pages before, which are
window expressions over a store's pages, not state in Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import dotted_date
from ..operators.tables import cut

# Elements without content, elements whose content is no text, gates in the order they are looked for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
#: Of an opening tag: elements that it ends, and those within which it looks for them.
_BLOCKS = "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = dict.fromkeys(_BLOCKS, ({"p"}, {"table", "td", "th", "button", "li"})) | {
    "li": ({"li", "p"}, {"ul", "ol"}),
    "option": ({"option"}, {"select"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
}
GATES = (("loginWall", "LOGIN_REQUIRED"), ("captcha", "CAPTCHA"), ("accessDenial", "ACCESS_DENIED"))
CHANGED = "DOM_CONTRACT_CHANGED"
#: Pages that a task's Python holds at a time.
PAGES = 64


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None = None
    content: list[Element | str] = field(default_factory=list)

    def elements(self) -> Iterator[Element]:
        """Elements below this one in document order."""
        todo = [x for x in reversed(self.content) if isinstance(x, Element)]
        while todo:
            x = todo.pop()
            yield x
            todo += [y for y in reversed(x.content) if isinstance(y, Element)]

    def text(self) -> str:
        """All text below this element but that of scripts and styles."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in SILENT:
                todo += reversed(x.content)
        return "".join(out)


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ended, within = ENDS.get(tag, ((), ()))
        x = self.at
        while ended and x.parent is not None and x.tag not in within:
            if x.tag in ended:
                self.at = x.parent
            x = x.parent
        new = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.content.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x.parent is not None and x.tag != tag:
            x = x.parent
        if x.parent is not None:  # a closing tag that nothing opened is left out
            self.at = x.parent

    def handle_data(self, data: str) -> None:
        self.at.content.append(data)


def read(html: str) -> Element:
    """The root of a page's elements; unclosed elements end with their parent."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


_part = re.compile(r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")
_attribute = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have,
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
}


class SelectorInvalid(ValueError):
    """A selector that is not of tags, ids, classes, attributes, descent and children."""


class Selector:
    """``article.review [data-x="1"] > p, li#y``: finds elements below another one, in document order."""

    def __init__(self, text: str):
        self.choices = [self._steps(x.strip()) for x in self._split(text)]

    @staticmethod
    def _split(text: str) -> list[str]:
        out, depth, quote, start = [], 0, "", 0
        for i, c in enumerate(text):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'" and depth:
                quote = c
            elif c in "[]":
                depth += 1 if c == "[" else -1
            elif c == "," and not depth:
                out.append(text[start:i])
                start = i + 1
        return [*out, text[start:]]

    @staticmethod
    def _steps(text: str) -> list[tuple[str, list[tuple]]]:
        """(how it stands to the step before, tests) of each step."""
        out: list[tuple[str, list[tuple]]] = []
        at, joint = 0, " "
        while at < len(text):
            tests = []
            while found := _part.match(text, at):
                tag, ident, name, attribute, how, *values = found.groups()
                if tag and tests:
                    raise SelectorInvalid(text)
                value = next((v for v in values if v is not None), "")
                tests.append(("tag", tag.lower()) if tag else ("=", "id", ident) if ident else ("~=", "class", name) if name else (how or "there", attribute.lower(), value))
                at = found.end()
            if not tests:
                raise SelectorInvalid(text)
            out.append((joint, tests))
            gap = re.compile(r"\s*(>)\s*|\s+").match(text, at)
            if gap:
                joint, at = gap.group(1) or " ", gap.end()
            elif at < len(text):
                raise SelectorInvalid(text)
        if not out or text.rstrip().endswith(">"):
            raise SelectorInvalid(text)
        return out

    @staticmethod
    def _fits(x: Element, tests: list[tuple]) -> bool:
        for kind, name, *value in tests:
            if kind == "tag":
                good = name in ("*", x.tag)
            elif name not in x.attributes:
                good = False
            else:
                good = kind == "there" or _attribute[kind](x.attributes[name], value[0])
            if not good:
                return False
        return True

    def _ends_in(self, x: Element, steps: list[tuple[str, list[tuple]]]) -> bool:
        joint, tests = steps[-1]
        if not self._fits(x, tests):
            return False
        if len(steps) == 1:
            return True
        above = x.parent
        while above is not None and above.parent is not None:
            if self._ends_in(above, steps[:-1]):
                return True
            if joint == ">":
                return False
            above = above.parent
        return False

    def find(self, root: Element) -> list[Element]:
        return [x for x in root.elements() if any(self._ends_in(x, steps) for steps in self.choices)]


def elements(pages: DataFrame, selector: str, html_col: str = "html") -> DataFrame:
    """One row for each element that a selector finds, in page order: ``position``, ``tag``, ``element_text``, ``attributes``, and all other columns."""
    wanted = Selector(selector)
    keep = [c for c in pages.columns if c != html_col]
    kind = "array<struct<tag:string,element_text:string,attributes:map<string,string>>>"

    @F.pandas_udf(kind)
    def found(texts: pd.Series) -> pd.Series:
        def rows(html: str | None) -> list[dict]:
            return [{"tag": x.tag, "element_text": x.text(), "attributes": x.attributes} for x in wanted.find(read(html or ""))]

        return texts.map(rows)

    return cut(pages.select(*keep, found(F.col(html_col)).alias("__e")), "page-elements", PAGES).select(*keep, F.posexplode("__e").alias("position", "__x")).select(*keep, "position", "__x.*")


ITEM = "struct<body:string,rating:string,date:string,nickname:string>"


def _one(item: Element, selector: Selector) -> tuple[int, str | None]:
    """(how many elements there are, the only one's text)."""
    found = selector.find(item)
    return len(found), unicodedata.normalize("NFKC", found[0].text()).strip() if len(found) == 1 else None


def page_facts(html: str | None, selectors: dict[str, Selector]) -> dict:
    """A page's gate, or its items' texts (null where an item is not of the contract) and whether it has a next control."""
    root = read(html or "")
    gate = next((code for name, code in GATES if selectors[name].find(root)), None)
    items: list[dict | None] = []
    if gate is None:
        for item in selectors["reviewItem"].find(root):
            body, rating, date, nickname = (_one(item, selectors[k]) for k in ("body", "rating", "publishedDate", "nickname"))
            right = body[1] and date[1] is not None and nickname[1] and rating[0] <= 1
            items.append({"body": body[1], "rating": rating[1], "date": date[1], "nickname": nickname[1]} if right else None)
    return {"gate": gate, "items": items, "has_next": bool(selectors["nextButton"].find(root))}


def extract(pages: DataFrame, contract: dict[str, str], as_of: str, key: str = "store_id", order: str = "page_no", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """(pages with ``status``, ``reason``, ``boundary``, ``n_items``, ``n_reviews``; reviews) of the pages of each store.

    Pages of a store are read in their order until one ends it: by a gate, by a
    break of the contract (an item that is not right, dates that rise or lie in
    the future, an appended page without a new item but with a next control),
    by a date a year before ``as_of`` (CUTOFF), or by the last page (DOM_END).
    In append mode a page repeats the items of the page before, and only those
    behind them count.  A page that broke the contract gives no review.
    """
    selectors = {k: Selector(v) for k, v in contract.items() if k not in ("version", "paginationMode")}
    facts = "struct<gate:string,items:array<" + ITEM + ">,has_next:boolean>"

    @F.pandas_udf(facts)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_facts(x, selectors) for x in texts], columns=["gate", "items", "has_next"])

    # written, as items and pages both come from it: pages are parsed once
    x = cut(pages.select(key, order, found(F.col(html_col)).alias("f")).select(key, order, "f.*"), "page-facts", PAGES).withColumn("n_items", F.size("items"))
    by_page = Window.partitionBy(key).orderBy(order)
    start = F.coalesce(F.lag("n_items").over(by_page), F.lit(0)) if contract["paginationMode"] == "append" else F.lit(0)
    x = x.withColumn("start", start)
    new = F.when(F.col("start") <= F.col("n_items"), F.slice("items", F.col("start") + 1, F.greatest(F.col("n_items") - F.col("start"), F.lit(0)))).otherwise(F.array().cast(f"array<{ITEM}>"))
    items = x.select(key, order, F.posexplode(new).alias("position", "item")).select(key, order, "position", F.col("item").isNull().alias("broken"), "item.*")
    value = F.col("rating").try_cast("double")
    unrated = F.coalesce(F.col("rating"), F.lit("")) == ""
    items = items.withColumns({"published_date": dotted_date(F.col("date")), "rating_bp": F.when(~unrated & value.between(0, 5), F.floor(value * 1000 + 0.5).cast("int"))})
    running = Window.partitionBy(key).orderBy(order, "position")
    wrong = F.col("broken") | F.col("published_date").isNull() | (F.col("published_date") > as_of) | (~unrated & F.col("rating_bp").isNull()) | F.coalesce(F.col("published_date") > F.lag("published_date").over(running), F.lit(False))
    cutoff = F.date_format(F.add_months(F.to_date(F.lit(as_of)), -12), "yyyy-MM-dd")
    items = items.withColumn("wrong", F.coalesce(wrong, F.lit(True))).withColumn("old", ~F.col("wrong") & (F.col("published_date") < cutoff))
    # the first item that ends its page: behind it nothing is read
    page = Window.partitionBy(key, order).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    items = items.withColumn("ended", F.bool_or(F.col("wrong") | F.col("old")).over(page))
    first = F.min(F.when(F.col("wrong") | F.col("old"), F.struct("position", "wrong")))
    ends = items.groupBy(key, order).agg(F.count(F.lit(1)).alias("n_new"), first.alias("end"), F.count_if(~F.col("ended")).alias("n_reviews"))
    y = x.join(ends, [key, order], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    changed = (F.col("start") > F.col("n_items")) | F.coalesce(F.col("end.wrong"), F.lit(False)) | ((F.col("n_new") == 0) & F.col("has_next"))
    reason = F.when(F.col("gate").isNotNull(), F.col("gate")).when(changed, CHANGED)
    boundary = F.when(reason.isNull(), F.when(F.col("end").isNotNull(), "CUTOFF").when(F.col("has_next"), "MORE").otherwise("DOM_END"))
    y = y.withColumns({"reason": reason, "boundary": boundary})
    before = by_page.rowsBetween(Window.unboundedPreceding, -1)
    over = F.coalesce(F.bool_or(F.coalesce(F.col("boundary") != "MORE", F.lit(True))).over(before), F.lit(False))
    y = y.withColumn("over", over).where(~F.col("over"))
    result = y.select(key, order, F.when(F.col("reason").isNull(), "OK").otherwise("STOP_PROVIDER").alias("status"), "reason", "boundary", "n_items", F.when(F.col("reason").isNull(), F.coalesce("n_reviews", F.lit(0))).otherwise(0).cast("long").alias("n_reviews"))
    good = result.where("status = 'OK'").select(key, order)
    reviews = items.where(~F.col("ended")).join(good, [key, order]).select(key, order, "position", "body", "rating_bp", "published_date", "nickname")
    return result, reviews
