"""Publishing the catalog, search evidence and reviews: each a plan of tables that a new version is written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text, timeutil
from ..functions.ids import stable_id
from ..operators import candidates as C
from ..operators import eligibility, resolve, tables
from ..sources.versions import Slot, StaleSource, Versions

# Catalog states by decision.
STATES = {"eligible": "published", "excluded": "excluded", "admin_review": "admin_review"}


class PublishRefused(ValueError):
    """Nothing was published; the code says why."""


def catalog(candidates: DataFrame, evidence: DataFrame, existing: DataFrame, old_stores: DataFrame, queue: DataFrame, snapshot: str, version: str = "v1") -> dict[str, DataFrame]:
    """All tables of a catalog version: deduplicated, reconciled, assigned, classified, demoted.

    ``existing``: management_number, old_store_id.  ``old_stores``: store_id,
    bakery_id, catalog_status, business_status.  ``queue``: the manual reviews
    (manual_review_id, snapshot_id, store_id, status, decision, evidence_refs).
    """
    matches = tables.cut(resolve.decide(candidates), "matches")
    found = resolve.reconcile(resolve.canonical_stores(candidates, matches, version), existing)
    # an id conflict holds the new store and the old ones back
    found = found.withColumns({"store_id": F.coalesce("old_store_id", "store_id"), "merge_status": F.when(F.col("id_conflict"), "admin_review").otherwise(F.col("merge_status"))})
    stores = tables.cut(eligibility.assign(found, evidence), "stores")
    decisions = tables.cut(eligibility.classify(stores, evidence, version), "decisions")
    status = eligibility.coded(F.col("status"), STATES)
    placed = stores.join(decisions.select("bakery_id", "decision_id", "classification", "status", "reasons"), "bakery_id").withColumn("catalog_status", status)
    held = existing.join(stores.where("id_conflict").select(F.explode("management_numbers").alias("management_number")), "management_number", "left_semi").select(F.col("old_store_id").alias("store_id")).distinct().withColumn("held", F.lit(True))
    old = old_stores.join(placed.select("store_id"), "store_id", "left_anti").join(held, "store_id", "left")
    demoted = F.when(F.col("held"), "admin_review").when(F.col("catalog_status") == "published", "excluded").otherwise(F.col("catalog_status"))
    columns = ["store_id", "bakery_id", "catalog_status", "business_status"]
    every = placed.select(*columns).unionByName(old.withColumn("catalog_status", demoted).select(*columns))
    live = every.where((F.col("catalog_status") == "published") & (F.col("business_status") == "active"))
    bakeries = every.select("bakery_id").distinct().join(live.select("bakery_id").distinct().withColumn("live", F.lit(True)), "bakery_id", "left")
    return {
        "matches": matches,
        "decisions": decisions,
        "stores": every,
        "placed": placed,
        "links": placed.select("store_id", F.explode("source_record_ids").alias("source_record_id")).withColumn("snapshot_id", F.lit(snapshot)),
        "bakeries": bakeries.select("bakery_id", F.when(F.col("live"), "published").otherwise("excluded").alias("catalog_status")),
        "queue": review_queue(queue, placed, snapshot, version),
        "counts": eligibility.decision_counts(decisions),
    }


def review_queue(queue: DataFrame, placed: DataFrame, snapshot: str, version: str = "v1") -> DataFrame:
    """The manual reviews after a publish: stores in review are open, others of this snapshot get their decision."""
    key = stable_id("manual_review", F.concat_ws(":", F.lit(snapshot), "store_id", F.lit(version)))
    now = placed.select(key.alias("manual_review_id"), F.lit(snapshot).alias("snapshot_id"), "store_id", F.col("status").alias("outcome"), evidence_refs(F.col("reasons")).alias("refs"))
    opened = now.where(F.col("outcome") == "admin_review").select("manual_review_id", "snapshot_id", "store_id", F.lit("open").alias("status"), F.lit(None).cast("string").alias("decision"), F.col("refs").alias("evidence_refs"))
    decided = now.where(F.col("outcome") != "admin_review").select("manual_review_id", "outcome")
    out = tables.upsert(queue, opened.select(*queue.columns), ["manual_review_id"]).join(decided, "manual_review_id", "left")
    state = F.when(F.col("outcome") == "eligible", "approved").when(F.col("outcome").isNotNull(), "rejected").otherwise(F.col("status"))
    return out.withColumns({"status": state, "decision": F.coalesce("outcome", "decision")}).select(*queue.columns)


def evidence_refs(lists: Column) -> Column:
    """Different references of some lists, or of one list, in order."""
    return F.array_sort(F.array_distinct(lists))


def publish_catalog(versions: Versions, candidates: DataFrame, evidence: DataFrame, existing: DataFrame, old_stores: DataFrame, queue: DataFrame, source: dict, version: str = "v1") -> dict:
    """Publish a catalog; the source's order is checked before and again when the manifest is swapped.

    Search evidence of the manifest's slot (``evidence_slot``) that does not
    fit the catalog is superseded in the same swap: readers see the old catalog
    with its evidence or the new one without.
    """
    versions.guard(source)
    if not candidates.where(F.col("reject_code").isNotNull()).isEmpty():
        raise PublishRefused("CATALOG_INPUT_REJECTED")
    if not eligibility.assignment_errors(candidates, evidence).isEmpty():
        raise PublishRefused("CATALOG_EVIDENCE_INVALID")
    spark = candidates.sparkSession
    return versions.publish(catalog(candidates, evidence, existing, old_stores, queue, source["snapshot_id"], version), source, beside=lambda entry, state: _without_old_evidence(spark, versions, entry, state))


def evidence_slot(versions: Versions) -> Slot:
    """Where the search evidence for a catalog is published."""
    return versions.slot("evidence")


def public_of(spark: SparkSession, versions: Versions, entry: dict) -> DataFrame:
    """The public stores of a catalog's entry: those that a search may show."""
    t = versions.tables(spark, entry)
    return C.public_stores(t["placed"], t["bakeries"], t["links"])


def _without_old_evidence(spark: SparkSession, versions: Versions, entry: dict, state: dict) -> dict:
    slot = evidence_slot(versions)
    own = state.get("slots", {}).get(slot.name)
    if not own or not own["active"]:
        return {}
    fits = own["active"]["source"].get("for_version") == entry["version"]
    if not superseded(slot.tables(spark, own["active"]), public_of(spark, versions, entry), fits):
        return {}
    last = {"version": own["active"]["version"], "by": entry["version"]}
    return {"slots": slot.put(state, own | {"active": None, "superseded": [*own.get("superseded", []), last]})}


def superseded(evidence: dict[str, DataFrame], public: DataFrame, same_publish: bool) -> bool:
    """Whether active evidence no longer fits: made for another catalog, or of a store that is not public."""
    stores = None
    for df in (df for df in evidence.values() if "store_id" in df.columns):
        stores = df.select("store_id") if stores is None else stores.union(df.select("store_id"))
    return not same_publish or not stores.distinct().join(public.select("store_id"), "store_id", "left_anti").isEmpty()


# -- search evidence --------------------------------------------------------


def evidence_text(x: Column) -> Column:
    """struct(display, compact), null unless 1 to 200 UTF-16 units are left and a letter or digit among them."""
    def keyed(display: Column) -> Column:
        compact = text.compact_key(text.search_text(display, normal=True))
        return F.when(display.isNotNull() & (F.octet_length(F.encode(display, "UTF-16BE")).between(2, 400)) & (compact != ""), F.struct(display.alias("display"), compact.alias("compact")))

    return text.let(text.collapse(text.nfkc(x)), keyed)


def evidence(menus: DataFrame, menu_aliases: DataFrame, store_aliases: DataFrame, hours: DataFrame) -> dict[str, DataFrame]:
    """The four tables with normalised names.

    ``menus``: store_id, menu_key, name, category.  ``menu_aliases``: menu_key,
    alias.  ``store_aliases``: store_id, alias_type, alias.
    """
    return {
        "menus": menus.withColumn("t", evidence_text(F.col("name"))).select("store_id", "menu_key", "category", F.col("t.display").alias("name"), F.col("t.compact").alias("normalized_name")),
        "menu_aliases": menu_aliases.withColumn("t", evidence_text(F.col("alias"))).select("menu_key", F.col("t.display").alias("alias"), F.col("t.compact").alias("normalized_alias")),
        "store_aliases": store_aliases.withColumn("t", evidence_text(F.col("alias"))).select("store_id", "alias_type", F.col("t.display").alias("alias"), F.col("t.compact").alias("normalized_alias")),
        "hours": hours,
    }


def _repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1").select(F.concat_ws("|", *keys).alias("key"))


def evidence_violations(e: dict[str, DataFrame], public: DataFrame) -> DataFrame:
    """``violation``, ``key``: everything that keeps evidence (see ``evidence``) from being published."""
    names = e["menus"].select("menu_key", F.col("normalized_name").alias("normalized_alias"))
    bad = timeutil.hours_violations(e["hours"])
    stores = e["menus"].select("store_id").union(e["store_aliases"].select("store_id")).union(e["hours"].select("store_id")).distinct()
    parts = {
        "INPUT_INVALID": e["menus"].where(F.col("normalized_name").isNull()).select(F.col("menu_key").alias("key"))
        .unionByName(e["menu_aliases"].where(F.col("normalized_alias").isNull()).select(F.col("menu_key").alias("key")))
        .unionByName(e["store_aliases"].where(F.col("normalized_alias").isNull()).select(F.col("store_id").alias("key")))
        .unionByName(bad.where(F.col("violation") == "RANGE").select(F.col("store_id").alias("key"))),
        "DUPLICATE": _repeated(e["menus"].where(F.col("normalized_name").isNotNull()), "store_id", "normalized_name")
        .unionByName(_repeated(e["menu_aliases"].where(F.col("normalized_alias").isNotNull()).select("menu_key", "normalized_alias").unionByName(names.where(F.col("normalized_alias").isNotNull())), "menu_key", "normalized_alias"))
        .unionByName(_repeated(e["store_aliases"].where(F.col("normalized_alias").isNotNull()), "store_id", "alias_type", "normalized_alias"))
        .unionByName(_repeated(e["hours"], "store_id", "weekday", "sequence")),
        "HOURS_OVERLAP": bad.where(F.col("violation") == "OVERLAP").select(F.col("store_id").alias("key")),
        "STORE_NOT_ACTIVE": stores.join(public.select("store_id"), "store_id", "left_anti").select(F.col("store_id").alias("key")),
    }
    out = None
    for name, df in parts.items():
        df = df.distinct().select(F.lit(name).alias("violation"), "key")
        out = df if out is None else out.unionByName(df)
    return out


def publish_evidence(versions: Versions, e: dict[str, DataFrame], public: DataFrame | None, source: dict) -> dict:
    """Publish evidence under an id of its content: the same content gives the same version, another one replaces it.

    In a catalog's slot (``evidence_slot``), evidence is for the catalog that
    is active now and its public stores, and refused if that is replaced before
    the swap.
    """
    if isinstance(versions, Slot):
        first = versions.of.state()["active"]
        source = source | {"for_version": first and first["version"]}
        versions.guard(source)
        public = public_of(e["menus"].sparkSession, versions.of, first)
    broken = sorted({r["violation"] for r in evidence_violations(e, public).select("violation").distinct().collect()})  # a row a kind
    if broken:
        raise PublishRefused(", ".join(broken))
    content = {name: ids.table_digest(df).first()["digest"] for name, df in e.items()}
    return versions.publish(e, source | {"content": ids.digest(content)})


# -- reviews -----------------------------------------------------------------

AAD = "review-aad-v1"


def lineage(raw: DataFrame, observations: DataFrame, run: dict, now_ms: int, provider: str) -> DataFrame:
    """Raw reviews of a run with ``reason_code``: the first rule of their lineage that they break, null if none.

    ``raw``: review_id, run_id, observation_id, store_id, provider, key_version,
    aad_version, collected_at_ms, retention_until_ms.  ``observations``:
    observation_id, run_id, match_status, matched_store_id, expires_at_ms.
    ``run``: run_id, discovery_run_id, key_version.
    """
    o = observations.select("observation_id", F.col("run_id").alias("o_run"), "match_status", "matched_store_id", "expires_at_ms")
    x = raw.where(F.col("run_id") == run["run_id"]).join(o, "observation_id")
    fits = (F.col("o_run") == run["discovery_run_id"]) & (F.col("match_status") == "MATCHED_ELIGIBLE") & (F.col("matched_store_id") == F.col("store_id"))
    valid = (F.col("provider") == provider) & (F.col("aad_version") == AAD) & (F.col("review_id") != "") & (F.col("store_id") != "") & (F.col("collected_at_ms") >= 0)
    reason = (
        F.when(~F.coalesce(fits, F.lit(False)), "INPUT_NOT_ELIGIBLE")
        .when((F.col("retention_until_ms") <= now_ms) | (F.col("expires_at_ms") <= now_ms), "INPUT_EXPIRED")
        .when(~F.col("key_version").eqNullSafe(F.lit(run["key_version"])), "INPUT_KEY_VERSION_MISMATCH")
        .when(~F.coalesce(valid, F.lit(False)), "INPUT_INVALID")
    )
    return x.withColumn("reason_code", reason).drop("o_run", "match_status", "matched_store_id", "expires_at_ms")


def opened(rows: DataFrame, key: bytes, as_of: str) -> DataFrame:
    """Accepted raw rows with their payload: body, normalized_body, rating_bp and published_date, or the ``reason_code`` that refuses them.

    ``rows`` also have ``encrypted``: struct(ciphertext, nonce, auth_tag).
    """
    aad = F.to_json(F.struct("review_id", "store_id", "provider", F.lit(1).alias("schema_version")))
    payload = F.from_json(ids.decrypt(F.col("encrypted"), F.lit(bytearray(key)), aad), "provider string, body string, rating_bp int, published_date string")
    x = rows.withColumn("p", F.when(F.col("reason_code").isNull(), payload))
    x = x.withColumns({"body": F.col("p.body"), "normalized_body": text.review_text(F.col("p.body")), "rating_bp": F.col("p.rating_bp"), "published_date": F.col("p.published_date")})
    date = F.try_to_date("published_date", "yyyy-MM-dd")
    good = date.isNotNull() & (F.col("published_date") <= as_of) & (F.coalesce("normalized_body", F.lit("")) != "") & (F.col("p.provider") == F.col("provider"))
    reason = F.coalesce("reason_code", F.when(F.col("p").isNull(), "DECRYPT_FAILED").when(~F.coalesce(good, F.lit(False)), "INPUT_INVALID"))
    return x.withColumn("reason_code", reason).drop("p", "encrypted")


def publish_reviews(versions: Versions, old: DataFrame | None, rows: DataFrame, public: DataFrame, cutoff: str, source: dict) -> dict:
    """Publish a run's reviews: one bad row refuses the run; ids replace, rows before the cutoff go.

    The same run again gives what was published, after its digests are checked;
    once another run is active it is refused.
    """
    spark, state = rows.sparkSession, versions.state()
    past = [e for e in state["history"] if e["source"] == source]
    if past:
        if state["active"] != past[-1]:
            raise StaleSource("REVIEW_PUBLISH_STALE_REPLAY")
        if not all(versions.verify(spark).values()):
            raise PublishRefused("REVIEW_PUBLISH_INCONSISTENT")
        return past[-1] | {"replayed": True}
    first = rows.where(F.col("reason_code").isNotNull()).agg(F.min("reason_code")).first()[0]
    if first is not None:
        raise PublishRefused(f"REVIEW_PUBLISH_{first}")
    columns = ["review_id", "store_id", "body", "normalized_body", "rating_bp", "published_date", "collected_at_ms"]
    new = rows.select(*columns)
    if not new.join(public.select("store_id"), "store_id", "left_anti").isEmpty():
        raise PublishRefused("REVIEW_PUBLISH_STORE_NOT_PUBLIC")
    every = new if old is None else tables.upsert(old.select(*columns), new, ["review_id"])
    kept = every.where(F.col("published_date") >= cutoff).join(public.select("store_id"), "store_id", "left_semi")
    return versions.publish({"documents": kept.withColumn("source_run_id", F.lit(source["snapshot_id"]))}, source)


# -- state --------------------------------------------------------------------


def active_state(state: DataFrame, publishes: DataFrame, snapshots: DataFrame, evidence: DataFrame, versions: DataFrame, indexes: DataFrame) -> DataFrame:
    """The active publish with its snapshot (it must match in both ids), and active evidence, review version and index beside it, where there are any."""
    x = state.join(publishes, ["publish_id", "snapshot_id"]).join(snapshots, "snapshot_id")
    live = lambda df, key: df.where((F.col("status") == "ACTIVE") & (F.col("active_slot") == 1)).drop("status", "active_slot").withColumnRenamed("publish_id", key)
    x = x.join(live(evidence, "publish_id"), "publish_id", "left").join(live(versions, "publish_id"), "publish_id", "left")
    return x.join(live(indexes, "publish_id"), "version_id", "left")
