"""An adaptive scan of an area: tiles whose result is cut off by the source's page limit are split and asked again.

Each round asks for the first page of every tile of the frontier, and for the
other pages of those that are not saturated; saturated tiles give the next
frontier.  So a round is one batch of requests for all tiles of a depth, and
there are as many rounds as depths.  A round's pages and tiles are written
before the next one, so no request is made twice and a lost executor costs a
round at most.

A tile is DONE, SATURATED (split), PARTIAL (saturated at the last depth, or
with more pages than may be asked for) or REFUSED.  A refused access or a broken
answer ends the scan; what was found until then stays.
"""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import cut
from . import keyword

#: Depth at which a saturated tile stays as it is.
MAX_DEPTH = 8
REQUEST = "tile string, depth int, west double, south double, east double, north double, page int"
REQUEST_COLUMNS = [c.split()[0] for c in REQUEST.split(", ")]
# How a scan ends for the errors of its pages, the gravest first.
COMPLETE, PARTIAL, STOPPED, FAILED = "COMPLETE", "PARTIAL", "STOPPED_ACCESS", "FAILED_FINAL"


def split(tiles: DataFrame) -> DataFrame:
    """The four quarters of each tile: south-west, south-east, north-west, north-east."""
    middle = F.struct(((F.col("west") + F.col("east")) / 2).alias("x"), ((F.col("south") + F.col("north")) / 2).alias("y"))
    x = tiles.withColumn("m", middle).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(3))))
    right, up = F.col("q") % 2 == 1, F.col("q") >= 2
    return x.select(
        F.concat_ws(".", "tile", F.col("q").cast("string")).alias("tile"),
        (F.col("depth") + 1).alias("depth"),
        F.when(right, F.col("m.x")).otherwise(F.col("west")).alias("west"),
        F.when(up, F.col("m.y")).otherwise(F.col("south")).alias("south"),
        F.when(right, F.col("east")).otherwise(F.col("m.x")).alias("east"),
        F.when(up, F.col("north")).otherwise(F.col("m.y")).alias("north"),
    )


def scan(spark: SparkSession, ask: Callable[[DataFrame], DataFrame], root: tuple[float, float, float, float], max_depth: int = MAX_DEPTH, size: int = keyword.SIZE, last_page: int = keyword.LAST_PAGE, depth: int = 0, tile: str = "0") -> tuple[str, DataFrame, DataFrame]:
    """(status, tiles with ``state`` and ``n_pages``, checked pages of a scan).

    ``ask`` turns requests (``REQUEST``) into the same rows with ``status`` and
    ``json``; ``root`` is west, south, east, north.
    """
    frontier = spark.createDataFrame([(tile, depth, *map(float, root))], REQUEST.rpartition(",")[0])
    tiles, pages, status = [], [], COMPLETE
    while depth <= max_depth:
        first = cut(keyword.checked(ask(frontier.withColumn("page", F.lit(1)).select(*REQUEST_COLUMNS)), size=size, last_page=last_page), "frontier")
        pageable = F.col("body.meta.pageable_count")
        full = F.col("error").isNull() & (pageable >= size * last_page) & ~F.col("body.meta.is_end")
        needed = F.least(F.ceil(pageable / size), F.lit(last_page)).cast("int")
        rest = first.where(F.col("error").isNull() & ~full & (needed > 1)).withColumn("page", F.explode(F.sequence(F.lit(2), needed)))
        rest = cut(keyword.checked(ask(rest.select(*REQUEST_COLUMNS)), size=size, last_page=last_page), "frontier-rest")
        both = first.unionByName(rest)
        pages.append(both)
        # the last page that may be asked for is not the end: there is more than was read
        more = (F.col("page") == last_page) & ~F.col("body.meta.is_end")
        of = both.groupBy("tile", "depth").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("error").isNotNull()).alias("bad"), F.count_if(full).alias("full"), F.count_if(more).alias("more"))
        state = F.when(F.col("bad") > 0, "REFUSED").when((F.col("full") > 0) & (F.col("depth") < max_depth), "SATURATED").when((F.col("full") > 0) | (F.col("more") > 0), "PARTIAL").otherwise("DONE")
        of = cut(of.select("tile", "depth", "n_pages", state.alias("state")), "tiles")
        tiles.append(of)
        said = both.agg(F.count_if(F.col("error") == "ACCESS_DENIED").alias("denied"), F.count_if(F.col("error") == "NETWORK_ERROR").alias("network"), F.count("error").alias("bad")).first()
        states = {r.state: r.n for r in of.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a state
        if said.bad:
            status = STOPPED if said.denied else PARTIAL if said.network == said.bad else FAILED
            break
        if "PARTIAL" in states:
            status = PARTIAL
        if "SATURATED" not in states:
            break
        frontier = split(first.join(of.where("state = 'SATURATED'").select("tile"), "tile", "left_semi").select(*REQUEST_COLUMNS[:-1]))
        depth += 1
    return status, reduce(DataFrame.unionByName, tiles), reduce(DataFrame.unionByName, pages)


def observations(pages: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row for each place of the right pages of tiles that were not split, its first by depth, tile and page."""
    rows = pages.join(tiles.where("state <> 'SATURATED'").select("tile"), "tile", "left_semi").where(F.col("error").isNull()).select("depth", "tile", "page", F.posexplode("body.documents").alias("position", "d")).select("depth", "tile", "page", "position", "d.*")
    return rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns), F.struct("depth", "tile", "page", "position")).alias("r")).select("r.*")


def client(endpoint: str, query: str, key: str, timeout_s: float = 10) -> Callable[[DataFrame], DataFrame]:
    """``ask`` for an endpoint: requests run in tasks; an answer that is not good keeps its status only, and the key is in no row."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_answer(endpoint, query, key, timeout_s, r) for r in batch.itertuples(index=False)]
            yield batch.assign(status=pd.array([f[0] for f in found], "Int32"), json=[f[1] for f in found])

    return lambda requests: requests.repartition("tile", "page").mapInPandas(get, f"{REQUEST}, status int, json string")


def _answer(endpoint: str, query: str, key: str, timeout_s: float, r) -> tuple[int | None, str | None]:
    asked = urllib.parse.urlencode({"query": query, "rect": f"{r.west},{r.south},{r.east},{r.north}", "page": r.page, "size": keyword.SIZE})
    request = urllib.request.Request(f"{endpoint}?{asked}", headers={"Authorization": key})
    try:
        with urllib.request.urlopen(request, timeout=timeout_s) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None
    except (OSError, ValueError):
        return None, None
