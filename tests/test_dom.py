"""Selectors, nested elements, and reviews by a contract."""

import json

import pytest

from wayfern.sources import dom, html

NAMES = {"reviewItem": "article[data-item]", "body": "[data-body]", "rating": "[data-rating]", "publishedDate": "time.date", "nickname": "[data-nick]", "nextButton": "[data-next]", "loginWall": "[data-login]", "captcha": "[data-captcha]", "accessDenial": "[data-denied]"}


def contract(mode="append"):
    return html.selector_contract(json.dumps({"version": html.CONTRACT_VERSION, "paginationMode": mode} | NAMES))


def review(body="good", rating="4.0", date="2026-07-20", nickname="n"):
    part = lambda tag, name, x: "" if x is None else f"<{tag} {name}>{x}</{tag}>"
    return f"<article data-item>{part('p', 'data-body', body)}{part('span', 'data-rating', rating)}{part('time', 'class="x date"', date)}{part('i', 'data-nick', nickname)}</article>"


NEXT = "<button data-next></button>"


def run(spark, pages, mode="append", as_of="2026-07-26"):
    rows = [("s", i + 1, p) for i, p in enumerate(pages)] if isinstance(pages, list) else [(k, i + 1, p) for k, ps in pages.items() for i, p in enumerate(ps)]
    found, reviews = dom.extract(spark.createDataFrame(rows, "store_id string, page_no int, html string"), contract(mode), as_of)
    return [(r.page_no, r.reason or r.boundary, r.n_items, r.n_reviews) for r in found.orderBy("store_id", "page_no").collect()], reviews.orderBy("store_id", "page_no", "position").collect()


def texts(selector, page):
    return [x.text().strip() for x in dom.Selector(selector).find(dom.read(page))]


def test_nested_elements_of_one_name_come_out_whole():
    page = '<div id=a class="box big">one<div class=box>two<div>three</div>four</div>five</div><DIV data-k="x, ]y">six</DIV>'
    assert texts("div", page) == ["onetwothreefourfive", "twothreefour", "three", "six"]
    assert texts("div.box", page) == ["onetwothreefourfive", "twothreefour"]
    assert texts("#a > div", page) == ["twothreefour"] and texts("#a div", page) == ["twothreefour", "three"]
    assert texts('div[data-k="x, ]y"], .big', page) == ["onetwothreefourfive", "six"]
    assert texts("div .box div", page) == ["three"] and texts("body div", page) == []
    assert texts("[data-k^=x]", page) == texts("[data-k$=y]", page) == texts("[data-k*=' ]']", page) == ["six"] and texts("[data-k=x]", page) == []


@pytest.mark.parametrize(("page", "want"), [("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "bc", "c", "d"]), ("<li>a</p></b><br>b<img>c</li>", ["abc"]), ("<li>a &amp; &#44608;<script>if (a < b) '<li>'</script></li>", ["a & 김"]), ("<!-- <li>x</li> --><li/>y", ["y"]), ("<li", []), ("", [])])
def test_pages_that_are_not_tidy(page, want):
    assert texts("li", page) == want


def test_unclosed_paragraphs_and_cells_end_where_the_next_begins():
    assert texts("p", "<p>a<b>b<br><p>c</b><div>d<p>e</div>f") == ["ab", "c", "e"]
    assert texts("td", "<table><tr><td>a<td>b<table><tr><td>c</table><tr><td>d</table>") == ["a", "bc", "c", "d"]
    assert texts("tr > td", "<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"] and texts("dd", "<dl><dt>x<dd>a<p>b<dd>c</dl>") == ["ab", "c"]


@pytest.mark.parametrize("text", ["", "a,", "> a", "a >", "a..b", "a:hover", "a[x", "[1=]", "a + b", ".aspan#"])
def test_selectors_that_are_none_are_refused(text):
    with pytest.raises(dom.SelectorInvalid):
        dom.Selector(text)


def test_elements_as_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a<b>c</b></p><p class=x>d</p>"), (2, None), (3, "none")], "id int, html string")
    got = dom.elements(pages, "p").collect()
    assert sorted((r.id, r.position, r.tag, r.element_text, r.attributes) for r in got) == [(1, 0, "p", "ac", {}), (1, 1, "p", "d", {"class": "x"})]


def test_every_item_and_the_dotted_date(spark):
    states, found = run(spark, ["".join(review(f"review {i}", "5.0", "2026. 7. 2.") for i in range(25)) + NEXT, ""])
    assert states[0] == (1, "MORE", 25, 25) and {(r.published_date, r.rating_bp) for r in found} == {("2026-07-02", 5000)}


def test_only_appended_items_count_and_replace_reads_each_page(spark):
    one, two, three = review("a", "5", "2026-07-20"), review("b", None, "2026-07-19"), review("c", "3.5", "2026-07-18")
    states, found = run(spark, [one + two + NEXT, one + two + three])
    assert states == [(1, "MORE", 2, 2), (2, "DOM_END", 3, 1)]
    assert [(r.body, r.rating_bp, r.published_date) for r in found] == [("a", 5000, "2026-07-20"), ("b", None, "2026-07-19"), ("c", 3500, "2026-07-18")]
    states, found = run(spark, [one + two + NEXT, three + NEXT, ""], "replace")
    assert states == [(1, "MORE", 2, 2), (2, "MORE", 1, 1), (3, "DOM_END", 0, 0)] and [r.body for r in found] == ["a", "b", "c"]


def test_cutoff_ends_a_store_and_later_pages_are_not_read(spark):
    page = review("new", "4", "2026-07-01") + review("old", "3", "2025-06-25") + review("never", "5", "2025-06-20") + NEXT
    states, found = run(spark, {"a": [page, page + review()], "b": [review(date="2025-07-26"), "x"]})
    assert states == [(1, "CUTOFF", 3, 1), (1, "DOM_END", 1, 1)] and [r.body for r in found] == ["new", "good"]
    assert run(spark, ["<main></main>"])[0] == [(1, "DOM_END", 0, 0)]


@pytest.mark.parametrize(("gate", "code"), [("login", "LOGIN_REQUIRED"), ("captcha", "CAPTCHA"), ("denied", "ACCESS_DENIED")])
def test_gates_stop(spark, gate, code):
    assert run(spark, [review() + f"<div data-{gate}></div>", review()]) == ([(1, code, 0, 0)], [])


def test_breaks_of_the_contract_stop_without_a_review(spark):
    broken = [
        [review(body=None)], [review(body=" ")], [review(date=None)], [review(nickname=None)], [review(rating="6")], [review(rating="five")], [review(date="2026-02-30")], [review(date="2026-07-27")],
        [review().replace("</article>", "<p data-body>twice</p></article>")], [review(date="2026-07-01") + review(date="2026-07-02")], [review() + NEXT, review() + NEXT],
        [review(date="2026-07-19") + NEXT, review(date="2026-07-19") + review(date="2026-07-20")], [review() * 2 + NEXT, review()], [NEXT],
    ]
    states, found = run(spark, {f"s{i:02}": pages for i, pages in enumerate(broken)})
    assert [s for s in states if s[1] != "MORE"] == [(len(p), dom.CHANGED, s[2], 0) for p, s in zip(broken, [x for x in states if x[1] != "MORE"], strict=True)]
    assert len(found) == 4  # of the first pages that were right


def test_pages_are_parsed_once_in_bounded_batches(spark):
    rows = [("s", i + 1, review() + NEXT) for i in range(dom.PAGES * 3)]
    pages = spark.createDataFrame(rows, "store_id string, page_no int, html string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found, reviews = dom.extract(pages, contract("replace"), "2026-07-26")
    links = dom.elements(pages, "article")
    # what follows reads written rows, so that no page is parsed for each of its uses
    assert all("EvalPython" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (found, reviews, links))
    assert found.count() == reviews.count() == links.count() == len(rows)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
