"""Structured search and store detail end to end over one version of the tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timeutil
from ..functions.ids import digest
from ..operators import candidates as C
from ..operators import fulltext
from ..operators.tables import cut, page


class VersionMismatch(RuntimeError):
    pass


class StoreNotFound(LookupError):
    pass


class DataUnavailable(RuntimeError):
    pass


@dataclass(frozen=True)
class Snapshot:
    """Nested candidates, review documents and whether the text index can be used."""

    candidates: DataFrame
    documents: DataFrame
    components: tuple[str, ...]
    fts_available: bool = True
    basis_date: str | None = None
    mean: DataFrame | None = None

    @property
    def version(self) -> str:
        parts = self.components if self.fts_available else (*self.components, "NONE", "NONE", "NONE")
        return "search-data_" + digest(list(parts))


@dataclass(frozen=True)
class Result:
    items: DataFrame
    reason_counts: dict[str, int]
    n_results: int
    status: str
    degraded: tuple[str, ...]
    relaxations: tuple[str, ...]
    version: str


def load(public: DataFrame, stores: DataFrame, facts: dict[str, DataFrame], documents: DataFrame, components: tuple[str, ...], fts_available: bool, basis_date: str) -> Snapshot:
    """A snapshot of the public stores; facts of a store that does not exist make the data unusable.

    ``facts``: menus, menu_aliases, aliases, hours and reviews.
    """
    lost = None
    for name in ("menus", "aliases", "hours"):
        part = C.orphans(facts[name].select("store_id"), stores)
        lost = part if lost is None else lost.unionByName(part)
    if not lost.isEmpty():
        raise DataUnavailable("facts of unknown stores")
    aggregates = C.review_aggregates(facts["reviews"])
    candidates = C.nest(public, facts["menus"], facts["menu_aliases"], facts["aliases"], facts["hours"], aggregates)
    rated = public.select("store_id").join(aggregates.select("store_id", "rated_count", "rating_sum_bp"), "store_id")
    return Snapshot(candidates, documents, components, fts_available, basis_date, C.global_mean(rated))


def fresh(snapshot: Snapshot, request_ms: int) -> str | None:
    """FRESH or WARNING; data that are older, or from days ahead, cannot be used."""
    if snapshot.basis_date is None:
        return None
    spark = snapshot.candidates.sparkSession
    found = spark.range(1).select(timeutil.freshness(F.lit(snapshot.basis_date), F.lit(request_ms))).first()[0]
    if found == "STALE" or found is None:
        raise DataUnavailable("stale")
    return found


def assert_result(result: Result, n_candidates: int) -> None:
    """A result must agree with itself."""
    good = (
        result.n_results + sum(result.reason_counts.values()) == n_candidates
        and set(result.reason_counts) == set(C.REASONS)
        and result.status == ("PARTIAL" if result.degraded else "COMPLETE")
        and not (result.relaxations and result.n_results)
    )
    if not good:
        raise DataUnavailable("result")


def marked(snapshot: Snapshot, q: C.Query) -> DataFrame:
    """Candidates with flags and removal reasons."""
    evidence = fulltext.best_evidence(snapshot.documents, list(q.terms)) if q.terms and snapshot.fts_available else None
    return C.mark(C.derive(snapshot.candidates, q, snapshot.mean), q, evidence, snapshot.fts_available)


def search(snapshot: Snapshot, q: C.Query, version: str | None = None) -> Result:
    """All results in rank order, how many candidates each filter removed, and what could be loosened."""
    if version is not None and version != snapshot.version:
        raise VersionMismatch(version)
    fresh(snapshot, q.request_ms)
    rows = cut(marked(snapshot, q), "marked")
    counts = {r["reason"]: r["n"] for r in C.reason_counts(rows).collect()}  # eight rows
    every, n = rows.agg(F.count(F.lit(1)), F.count_if(F.col("removal_reason").isNull())).first()
    items = C.public_items(C.ranked(rows, q), q, snapshot.fts_available).orderBy("rank")
    degraded = ("FTS_UNAVAILABLE",) if q.terms and not snapshot.fts_available else ()
    result = Result(items, counts, n, "PARTIAL" if degraded else "COMPLETE", degraded, tuple(C.relaxations(q, n)), snapshot.version)
    assert_result(result, every)
    return result


def detail_rows(candidates: DataFrame, request_ms: int, review_limit: int, mean: DataFrame | None = None) -> DataFrame:
    """Every store's head of its page: state, average rating and pages of reviews."""
    rows = C.derive(candidates, C.Query.make(request_ms=request_ms), mean)
    average = F.when(F.col("rated_count") > 0, F.floor(F.col("rating_sum_bp") / F.col("rated_count") + 0.5).cast("long"))
    return rows.withColumns({"average_rating_bp": average, "total_pages": F.ceil(F.col("review_count") / review_limit).cast("long")})


def detail(snapshot: Snapshot, store_id: str, version: str, request_ms: int, review_page: int = 1, review_limit: int = 10) -> dict[str, DataFrame | int]:
    """A store that the unfiltered search holds: row, menus, hours, average rating and a page of reviews."""
    if version != snapshot.version:
        raise VersionMismatch(version)
    freshness = fresh(snapshot, request_ms)
    store = detail_rows(snapshot.candidates, request_ms, review_limit, snapshot.mean).where(F.col("store_id") == store_id)
    if store.isEmpty():
        raise StoreNotFound(store_id)
    mine = snapshot.documents.where(F.col("store_id") == store_id)
    n = mine.count()
    return {
        "store": store.select("store_id", "display_name", "district", "opening_state", "review_status", "review_count", "average_rating_bp", F.lit(freshness).alias("freshness")),
        "menus": store.select(F.inline("menus")),
        "hours": store.select(F.inline("hours")),
        "reviews": page(mine, [F.desc("published_date"), F.col("review_id")], review_page, review_limit),
        "total_pages": math.ceil(n / review_limit),
    }
