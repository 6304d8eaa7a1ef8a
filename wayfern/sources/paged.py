"""A data source for numbered JSON pages of an endpoint or a folder, read in parallel.

``spark.read.format("ledger_pages").option("endpoint", ...).option("size", 500).load()``

The first page is asked for when the scan is planned, as it names the total;
the other pages are then dealt to tasks in ranges.  Every page gives a row, a
refused one with its error and without a text, so that one page does not end a
scan of thousands.  Errors are codes: neither the key, nor an address with it,
nor a response's body is in a row, a message or an exception's chain.

Options: ``endpoint`` (http, https, or a folder's URI with ``page-<n>.json``),
``size`` (rows of a page), ``serviceKey``, ``pagesPerTask``, ``attempts`` (for
failed connections, 429 and 5xx), ``waitMs`` (doubles with each attempt),
``timeoutMs``.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Errors of a page, and the result code of a good one.
ERRORS = ("NETWORK_ERROR", "HTTP_ERROR", "RESPONSE_INVALID", "PAGE_MISMATCH", "PAGINATION_INVALID")
GOOD = "00"
SCHEMA = "page_no long, rows_asked long, total long, n_rows long, attempts int, error string, json string"


class PageError(RuntimeError):
    """A scan that is not whole: the error's code, and the page if it is one page's."""

    def __init__(self, code: str, page: int | None = None):
        super().__init__(code if page is None else f"{code} (page {page})")
        self.code, self.page = code, page


@dataclass
class Pages(InputPartition):
    first: int
    last: int
    known: tuple | None = None  # the first page's row, which has been asked for


def _whole(value, least: int) -> int | None:
    """A whole number that JSON gives as a number or as digits."""
    if isinstance(value, str) and value.isascii() and value.isdigit():
        value = int(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and value >= least else None


def facts(text: str, page: int, size: int) -> tuple[int | None, int | None, str | None]:
    """(total, rows, error) of a page's text."""
    try:
        response = json.loads(text)["response"]
        body = response["body"]
        items = body["items"]["item"] if isinstance(body["items"], dict) else body["items"]
        numbers = _whole(body["pageNo"], 1), _whole(body["numOfRows"], 1), _whole(body["totalCount"], 0)
        if response["header"]["resultCode"] != GOOD or not isinstance(items, list) or None in numbers:
            return None, None, "RESPONSE_INVALID"
    except (ValueError, KeyError, TypeError):
        return None, None, "RESPONSE_INVALID"
    if numbers[0] != page:
        return None, None, "PAGE_MISMATCH"
    if numbers[1] != size or len(items) > size:
        return None, None, "PAGINATION_INVALID"
    return numbers[2], len(items), None


class LedgerPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ledger_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LedgerPagesReader(self.options)


class LedgerPagesReader(DataSourceReader):
    def __init__(self, options):
        self.endpoint, self.size = options["endpoint"].rstrip("/"), int(options.get("size", 500))
        self.key = options.get("serviceKey", "").strip()
        self.each, self.attempts = int(options.get("pagesPerTask", 20)), int(options.get("attempts", 3))
        self.wait, self.timeout = int(options.get("waitMs", 200)) / 1000, int(options.get("timeoutMs", 30_000)) / 1000
        if self.size < 1 or self.each < 1 or self.attempts < 1:
            raise ValueError("size, pagesPerTask and attempts are at least 1")

    def partitions(self) -> list[Pages]:
        first = self._page(1)
        pages = 1 if first[5] else max(1, -(-first[2] // self.size))
        return [Pages(low, min(low + self.each - 1, pages), first if low == 1 else None) for low in range(1, pages + 1, self.each)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            yield partition.known if partition.known and page == 1 else self._page(page)

    def _page(self, page: int) -> tuple:
        for attempt in range(1, self.attempts + 1):
            status, text = self._get(page)
            if not (status is None or status == 429 or status >= 500):
                break
            if attempt < self.attempts:
                time.sleep(self.wait * 2 ** (attempt - 1))
        total = n_rows = None
        if status is None:
            error = "NETWORK_ERROR"
        elif not 200 <= status < 300:
            error = "HTTP_ERROR"
        else:
            total, n_rows, error = facts(text, page, self.size)
        return page, self.size, total, n_rows, attempt, error, None if error else text

    def _get(self, page: int) -> tuple[int | None, str]:
        """(status, text); no status where there was no answer."""
        if not self.endpoint.startswith(("http://", "https://")):
            return self._file(page)
        asked = urllib.parse.urlencode({"serviceKey": self.key, "pageNo": page, "numOfRows": self.size, "returnType": "json"})
        try:
            with urllib.request.urlopen(f"{self.endpoint}?{asked}", timeout=self.timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, ""
        except (OSError, ValueError):
            return None, ""

    def _file(self, page: int) -> tuple[int | None, str]:
        from pyarrow import fs

        try:
            system, path = fs.FileSystem.from_uri(self.endpoint if "://" in self.endpoint or self.endpoint.startswith("file:") else f"file://{self.endpoint}")
            with system.open_input_stream(f"{path}/page-{page}.json") as f:
                return 200, f.read().decode("utf-8", "replace")
        except FileNotFoundError:
            return 404, ""
        except OSError:
            return None, ""


def read_pages(spark: SparkSession, endpoint: str, size: int, **options) -> DataFrame:
    """All pages of an endpoint or folder as rows of ``SCHEMA``."""
    spark.dataSource.register(LedgerPages)
    reader = spark.read.format("ledger_pages").option("endpoint", endpoint).option("size", size)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def whole(pages: DataFrame) -> DataFrame:
    """The pages, if all are right, agree on the total and reach it; else ``PageError``.

    Pages are asked for once: give it written pages, not the scan itself.
    """
    found = pages.agg(
        F.min(F.when(F.col("error").isNotNull(), F.struct("page_no", "error"))).alias("bad"), F.min("total").alias("least"), F.max("total").alias("most"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")
    ).first()
    if found.bad is not None:
        raise PageError(found.bad.error, found.bad.page_no)
    if found.least is None or found.least != found.most or found.n != found.most:
        raise PageError("PAGINATION_INVALID")
    return pages
