"""Entity resolution: blocked candidate pairs, evidence, classes, canonical rows.

A pair is a candidate if addresses or phones are equal, points are within
100 m, or names are similar by 7,500 basis points.  Each of these has a block
that every such pair shares: the address, the phone, the name, neighbouring
cells wider than 100 m, and two similar brand names, which are found among the
distinct names.  A pair comes from the first of its blocks only, so that pairs
are neither shuffled nor made distinct; blocks are cut into chunks that meet two
by two, so that a large one is dealt over tasks.

``matched_pairs``, ``candidate_pairs`` and ``evaluate_pairs`` give evidence pair by pair, so their
rows grow with the square of a name's, phone's or address's stores.  What a
catalog needs of all those pairs is less: which candidates merge, and which are
in any pair under review.  ``decide`` finds just that from classes of equal
candidates and from the two extremes of each group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.ids import stable_id
from ..functions.text import bigrams
from .tables import cut

NEAR_M, MATCH_M = 100, 50
SIMILAR, MERGE, REVIEW = 7500, 9200, 7500
#: Cell width in 1e-7 degrees: over 101 m of latitude, and of longitude up to 60 degrees.
CELL_LAT, CELL_LON = 9_200, 18_400
#: Words of 64 bits in which two sets of bigrams without a common bit have no common bigram.
WORDS = 4
#: Members of a block that meet those of another chunk in one place, at most on average; pairs that a task makes.
CHUNK, PAIRS_A_TASK = 256, 4_000_000


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{side}_{c}") for c in df.columns))


def similar_names(names: DataFrame) -> DataFrame:
    """``n``, ``m``: each two of the names ``n`` that are similar by their bigrams, both ways round and a name with itself.

    Names are compared once each, however many candidates have them.  Both
    sizes bound the overlap: 2 * shared >= 0.75 * (m + n) means that after the
    rarest-first order of bigrams the two prefixes of n - ceil(0.6 n) + 1
    bigrams meet, as each side must share at least 60 % of its own.
    """
    grams = names.distinct().select("n", F.explode(bigrams(F.col("n"))).alias("g"))
    often = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ordered = grams.join(often, "g").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs"))
    prefix = ordered.select("n", F.transform("gs", lambda x: x["g"]).alias("all"), F.explode(F.slice("gs", F.lit(1), (F.size("gs") - F.ceil(F.size("gs") * F.lit(3) / F.lit(5)) + 1).cast("int"))).alias("p")).select("n", "all", F.col("p.g").alias("k"))
    both = prefix.join(prefix.select(F.col("n").alias("m"), F.col("all").alias("m_all"), "k"), "k").where(F.col("n") <= F.col("m"))
    found = both.where(_dice("all", "m_all") >= SIMILAR).select("n", "m").distinct()
    return found.unionByName(found.where(F.col("n") < F.col("m")).select(F.col("m").alias("n"), F.col("n").alias("m")))


def _meet(blocks: dict[str, tuple[DataFrame, DataFrame | None, Column]]) -> DataFrame:
    """Each two members, once, of what meets and passes the test; ``l_*`` and ``r_*``, in no order of ids.

    ``blocks``: by name, candidates with their block ``k``; blocks (k, m) that
    meet, or None if each meets itself only; the test.  A block is cut into
    chunks, which meet each other and themselves, and tasks get more with the
    pairs that are to be made.
    """
    every = reduce(DataFrame.unionByName, (keyed.select(F.lit(name).alias("block"), "k") for name, (keyed, _, _) in blocks.items()))
    sizes = cut(every.groupBy("block", "k").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.ceil(F.col("n") / CHUNK).cast("int")), "blocks")
    same = F.col("k") == F.col("m")
    meets = []
    for name, (_, others, _) in blocks.items():
        size = sizes.where(F.col("block") == name)
        if others is None:
            found = size.where(F.col("n") > 1).select("block", "k", F.col("k").alias("m"), "n", F.col("n").alias("o"), "g", F.col("g").alias("h"))
        else:
            found = others.join(size, "k").join(size.select(F.col("k").alias("m"), F.col("n").alias("o"), F.col("g").alias("h")), "m").where(~same | (F.col("n") > 1))
        meets.append(found)
    meets = cut(reduce(DataFrame.unionByName, meets), "meets")
    made = dict(meets.groupBy("block").agg(F.sum(F.col("n") * F.col("o") / F.when(same, 2).otherwise(1))).collect())
    out = [_meeting(keyed, sizes.where(F.col("block") == name).drop("block"), meets.where(F.col("block") == name), int(made.get(name, 0) // PAIRS_A_TASK) + 1, test) for name, (keyed, _, test) in blocks.items()]
    return reduce(DataFrame.unionByName, out)


def _meeting(keyed: DataFrame, sizes: DataFrame, meets: DataFrame, tasks: int, test: Column) -> DataFrame:
    dealt = F.pmod(F.xxhash64("candidate_id"), F.coalesce("g", F.lit(1))).cast("int")
    members = keyed.join(sizes.where(F.col("g") > 1).select("k", "g"), "k", "left").withColumn("i", dealt).drop("g")
    same = F.col("k") == F.col("m")
    # of one block, the chunks from its own on; of two, all
    meets = meets.select("k", "m", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i"), "h").select("k", "i", "m", F.explode(F.sequence(F.when(same, F.col("i")).otherwise(0), F.col("h") - 1)).alias("j"))
    left = _side(members, "l").join(meets, (F.col("l_k") == F.col("k")) & (F.col("l_i") == F.col("i"))).withColumn("own", same & (F.col("i") == F.col("j"))).drop("k", "i", "l_k", "l_i")
    right = _side(members, "r")
    if tasks > 1:
        left, right = left.repartition(tasks, "m", "j"), right.repartition(tasks, "r_k", "r_i")
    once = ~F.col("own") | (F.col("l_candidate_id") < F.col("r_candidate_id"))
    return left.join(right, (F.col("m") == F.col("r_k")) & (F.col("j") == F.col("r_i")) & once & test).drop("m", "j", "own", "r_k", "r_i")


def _same(column: str) -> Column:
    return F.coalesce(F.col(f"l_{column}") == F.col(f"r_{column}"), F.lit(False))


def _cell(dy: int = 0, dx: int = 0) -> Column:
    """The cell of a point, or one beside it; null without a point."""
    return F.concat_ws(":", F.floor(F.col("latitude_e7") / CELL_LAT) + dy, F.floor(F.col("longitude_e7") / CELL_LON) + dx)


def _met(candidates: DataFrame) -> DataFrame:
    """``a``, ``b`` (a < b) and both sides (``l_*``, ``r_*``, in no order) of each pair that passes the candidate test, once.

    A pair comes from the first that it shares of name, address, phone, place and
    similar brand; a later block refuses what an earlier one has.
    """
    rows = cut(_prepared(candidates.select("candidate_id", *EVIDENCE).repartition("candidate_id")), "candidates")
    name, phone = _same("normalized_name"), _same("normalized_phone")
    street = _same("normalized_address") & (F.col("l_normalized_address") != "")
    # as a lambda's argument the long distance stays out of the join's generated code, which the JVM compiles up to 8,000 bytes
    # only; with it there, each pair that was tested took some 20 microseconds
    near = _within(NEAR_M, F.get(F.transform(F.array(_distance()), lambda m: m), F.lit(0)))
    block = lambda key, known: rows.where(known).withColumn("k", key)
    # a cell meets itself and half of those around it, the others meet it
    placed = block(_cell(), F.col("latitude_e7").isNotNull() & F.col("longitude_e7").isNotNull())
    around = placed.select("k", F.array(*(_cell(dy, dx) for dy, dx in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)))).alias("m")).distinct().withColumn("m", F.explode("m"))
    # kinds are the different (brand, name); two of one name share the block of it
    kinds = block(F.to_json(F.struct("normalized_brand_name", "normalized_name")), F.col("normalized_brand_name").isNotNull())
    kind = kinds.select("k", F.col("normalized_brand_name").alias("n"), F.col("normalized_name").alias("name")).distinct()
    alike = kind.join(similar_names(kind.select("n")).withColumnRenamed("m", "like"), "n").drop("n").join(kind.select(F.col("k").alias("m"), F.col("n").alias("like"), F.col("name").alias("its")), "like")
    alike = alike.where((F.col("k") <= F.col("m")) & ~F.coalesce(F.col("name") == F.col("its"), F.lit(False))).select("k", "m")
    out = _meet({
        "name": (block(F.col("normalized_name"), F.col("normalized_name").isNotNull()), None, F.lit(True)),
        "address": (block(F.col("normalized_address"), F.col("normalized_address") != ""), None, ~name),
        "phone": (block(F.col("normalized_phone"), F.col("normalized_phone").isNotNull()), None, ~name & ~street),
        "place": (placed, around, ~name & ~street & ~phone & near),
        "brand": (kinds, alike, ~name & ~street & ~phone & ~near),
    })
    return out.withColumns({"a": F.least("l_candidate_id", "r_candidate_id"), "b": F.greatest("l_candidate_id", "r_candidate_id")})


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, that pass the candidate test."""
    return _met(candidates).select("a", "b")


def matched_pairs(candidates: DataFrame, version: str = "v1") -> DataFrame:
    """Evidence, score and class of each pair that passes the candidate test: ``evaluate_pairs`` of ``candidate_pairs``, without a join of pairs."""
    return _evidence(_met(candidates), version)


def _dice(a: Column | str, b: Column | str) -> Column:
    return F.floor(F.lit(20000) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)) + 0.5).cast("int")


def _codes(x: Column) -> Column:
    """``bigrams`` as numbers, one for each two characters: comparing these takes a fraction of the time."""
    point = lambda g, i: F.when(F.length(g) >= i, F.ascii(F.substring(g, i, 1)) + 1).otherwise(0).cast("long")
    return F.transform(bigrams(x), lambda g: F.when(g.isNotNull(), point(g, 1) * 2**21 + point(g, 2)))


def _prepared(candidates: DataFrame) -> DataFrame:
    """With what every pair of a candidate needs: its brand's bigrams, these as bits, and its point on the unit sphere."""
    rows = candidates.withColumn("grams", _codes(F.col("normalized_brand_name")))
    bit = lambda g: F.pmod(F.xxhash64(g), F.lit(64 * WORDS))
    word = lambda w: F.aggregate(F.filter("grams", lambda g: F.floor(bit(g) / 64) == w), F.lit(0).cast("long"), lambda x, g: x.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (bit(g) % 64).cast("int"))))
    lat, lon = F.radians(F.col("latitude_e7") / geo.E7), F.radians(F.col("longitude_e7") / geo.E7)
    return rows.withColumns({f"g{w}": word(w) for w in range(WORDS)} | {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})


def similarity(l_name: Column, r_name: Column, l_brand: Column, r_brand: Column) -> Column:
    """Basis points of shared bigrams of the brand names; 10,000 for equal names."""
    return F.when(l_name == r_name, 10000).otherwise(_dice(bigrams(l_brand), bigrams(r_brand)))


def evaluate_pairs(pairs: DataFrame, candidates: DataFrame, version: str = "v1") -> DataFrame:
    """Evidence, score and class of each pair that passes the candidate test."""
    rows = _prepared(candidates)
    rows = _evidence(pairs.join(_side(rows, "l"), F.col("a") == F.col("l_candidate_id")).join(_side(rows, "r"), F.col("b") == F.col("r_candidate_id")), version)
    return rows.where(F.col("address_matched") | F.coalesce(F.col("distance_m") <= NEAR_M, F.lit(False)) | F.col("phone_matched") | (F.col("similarity_bp") >= SIMILAR))


def _metres() -> Column:
    return geo.haversine_m(F.col("l_latitude_e7"), F.col("l_longitude_e7"), F.col("r_latitude_e7"), F.col("r_longitude_e7"))


def _distance() -> Column:
    """Metres in hundredths, null if a place is unknown."""
    return F.floor(_metres() * 100 + 0.5) / 100


def _within(most: int, metres: Column) -> Column:
    """Whether ``metres`` are ``most`` or less: the chord, which is no longer, refuses most pairs before they are computed."""
    chord = sum(((F.col(f"l_{c}") - F.col(f"r_{c}")) * (F.col(f"l_{c}") - F.col(f"r_{c}")) for c in "xyz"), F.lit(0.0))
    return F.coalesce((chord <= ((most + 0.5) / geo.EARTH_M) ** 2) & (metres <= most), F.lit(False))


def _similarity() -> Column:
    """``similarity`` of prepared sides."""
    shared = reduce(Column.bitwiseOR, (F.col(f"l_g{w}").bitwiseAND(F.col(f"r_g{w}")) for w in range(WORDS)))
    return F.when(F.col("l_normalized_name") == F.col("r_normalized_name"), 10000).when(shared == 0, 0).otherwise(_dice("l_grams", "r_grams"))


def _evidence(rows: DataFrame, version: str) -> DataFrame:
    """Evidence, score and class of each row of two prepared sides."""
    address = (F.col("l_normalized_address") != "") & (F.col("r_normalized_address") != "")
    phone = F.col("l_normalized_phone").isNotNull() & F.col("r_normalized_phone").isNotNull()
    rows = rows.select(
        "a",
        "b",
        (address & (F.col("l_normalized_address") == F.col("r_normalized_address"))).alias("address_matched"),
        (address & (F.col("l_normalized_address") != F.col("r_normalized_address"))).alias("address_conflict"),
        _within(MATCH_M, _metres()).alias("near"),
        _distance().alias("distance_m"),
        F.coalesce(phone & (F.col("l_normalized_phone") == F.col("r_normalized_phone")), F.lit(False)).alias("phone_matched"),
        F.coalesce(phone & (F.col("l_normalized_phone") != F.col("r_normalized_phone")), F.lit(False)).alias("phone_conflict"),
        _similarity().alias("similarity_bp"),
    )
    points = lambda c, n: F.when(F.col(c), n).otherwise(0)
    score = points("address_matched", 4000) + points("near", 2500) + points("phone_matched", 2000) + F.floor(F.col("similarity_bp") * 0.15 + 0.5).cast("int")
    conflict = F.col("address_conflict") | F.col("phone_conflict")
    hard = F.col("address_matched") | F.col("near") | F.col("phone_matched")
    rows = rows.withColumn("score_bp", score.cast("int"))
    status = F.when((F.col("score_bp") >= MERGE) & ~conflict, "auto_merge").when((F.col("score_bp") >= REVIEW) | (conflict & hard), "admin_review").otherwise("separate")
    return rows.withColumn("status", status).withColumn("match_id", stable_id("match", F.concat_ws(":", F.lit(version), "a", "b")))


#: What a pair's evidence depends on.
EVIDENCE = ["normalized_name", "normalized_brand_name", "normalized_address", "normalized_phone", "latitude_e7", "longitude_e7"]


def _other(value: str, lo: str, hi: str, rule: str) -> list[Column]:
    """(witness, rule): the id beside an extreme of the group that differs from the row's value; null if the group has no other value."""
    return [F.when(F.col(f"{lo}.v") != F.col(value), F.col(f"{lo}.id")).when(F.col(f"{hi}.v") != F.col(value), F.col(f"{hi}.id")).alias("witness"), F.lit(rule).alias("rule")]


def _extremes(value: str, name: str) -> list[Column]:
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("id")))
    return [F.min(known).alias(f"{name}_lo"), F.max(known).alias(f"{name}_hi")]


def _crossed(reps: DataFrame, by: str, value: str, rule: str) -> DataFrame:
    """``id``, ``witness``, ``rule``: classes of one ``by`` and different values."""
    known = reps.where(F.col(by).isNotNull() & F.col(value).isNotNull()).select("id", by, value)
    ends = known.groupBy(by).agg(*_extremes(value, "x")).where(F.col("x_lo.v") != F.col("x_hi.v"))
    return known.join(ends, by).select("id", *_other(value, "x_lo", "x_hi", rule))


def _near_conflicts(reps: DataFrame) -> DataFrame:
    """``id``, ``witness``, ``rule``: classes within 50 m of another address or phone.  Distances are between points, not classes."""
    placed = reps.where(F.col("latitude_e7").isNotNull() & F.col("longitude_e7").isNotNull())
    points = cut(placed.groupBy("latitude_e7", "longitude_e7").agg(*_extremes("address", "a"), *_extremes("phone", "p")), "points")
    y, x = F.floor(F.col("latitude_e7") / CELL_LAT), F.floor(F.col("longitude_e7") / CELL_LON)
    here = points.select("latitude_e7", "longitude_e7", y.alias("y"), x.alias("x"))
    steps = F.array(*(F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    there = points.select(F.col("latitude_e7").alias("lat"), F.col("longitude_e7").alias("lon"), "a_lo", "a_hi", "p_lo", "p_hi", F.explode(steps).alias("s")).select("*", "s.y", "s.x").drop("s")
    metres = geo.haversine_m(F.col("latitude_e7"), F.col("longitude_e7"), F.col("lat"), F.col("lon"))
    around = here.join(there, ["y", "x"]).where(metres <= MATCH_M).groupBy("latitude_e7", "longitude_e7")
    around = around.agg(*(f(c).alias(c) for c, f in (("a_lo", F.min), ("a_hi", F.max), ("p_lo", F.min), ("p_hi", F.max))))
    around = around.where((F.col("a_lo.v") != F.col("a_hi.v")) | (F.col("p_lo.v") != F.col("p_hi.v")))
    found = placed.join(around, ["latitude_e7", "longitude_e7"])
    return found.select("id", *_other("address", "a_lo", "a_hi", "NEAR_OTHER_ADDRESS")).unionByName(found.select("id", *_other("phone", "p_lo", "p_hi", "NEAR_OTHER_PHONE")))


def decide(candidates: DataFrame) -> DataFrame:
    """``a``, ``b`` (a < b), ``status``, ``rule``: merges that connect what ``evaluate_pairs`` would merge, and for each
    candidate that it would put under review in any pair one such pair, so rows grow with the candidates.

    The scores leave few ways to either status.  A pair whose phones or addresses
    differ is under review if it shares an address, a phone or a place: any two
    different values in a group tell so for all its members, and the least and the
    greatest value are such two.  A pair without such a difference needs an equal
    address, and an equal phone or a place within 50 m, to reach either score, so
    only classes of one address and phone, or of one address and place with a phone
    missing, are compared as pairs.  Candidates that are equal in all evidence are
    one class, compared once.

    Null or empty values match nothing and differ from nothing; no candidates give no rows.
    """
    keyed = candidates.select("candidate_id", *EVIDENCE, F.sha2(F.to_json(F.struct(*EVIDENCE)), 256).alias("sig"))
    found = keyed.groupBy("sig", *EVIDENCE).agg(F.min("candidate_id").alias("id"))
    reps = cut(found.withColumns({"address": F.when(F.col("normalized_address") != "", F.col("normalized_address")), "phone": F.col("normalized_phone")}), "classes")
    address, phone = F.col("address").isNotNull(), F.col("phone").isNotNull()
    point = F.col("latitude_e7").isNotNull() & F.col("longitude_e7").isNotNull()
    members = cut(keyed.select("candidate_id", "sig").join(reps.select("sig", "id", address.alias("address"), phone.alias("phone"), point.alias("point")), "sig").drop("sig"), "class-members")
    equal = F.when(F.col("phone") & F.col("point"), "auto_merge").when(F.col("phone") | F.col("point"), "admin_review")
    copies = members.where(F.col("address") & (F.col("candidate_id") != F.col("id"))).select(F.col("id").alias("a"), F.col("candidate_id").alias("b"), equal.alias("status"), F.lit("COPY").alias("rule"))
    # one address and phone; or one address and neighbouring cells, a phone missing on one side or both
    at = reps.where(address)
    y, x = F.floor(F.col("latitude_e7") / CELL_LAT), F.floor(F.col("longitude_e7") / CELL_LON)
    steps = F.array(*(F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)))
    left, right = at.where(phone).select(F.col("id").alias("a"), "address", "phone"), at.where(phone).select(F.col("id").alias("b"), "address", "phone")
    by_phone = left.join(right, ["address", "phone"]).where(F.col("a") < F.col("b")).select("a", "b")
    open_ = at.where(point & ~phone).select(F.col("id").alias("l"), "address", F.struct(y.alias("y"), x.alias("x")).alias("cell"))
    others = at.where(point).select(F.col("id").alias("r"), "address", F.explode(steps).alias("cell"))
    by_place = open_.join(others, ["address", "cell"]).where(F.col("l") != F.col("r")).select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b")).distinct()
    pairs = evaluate_pairs(by_phone.unionByName(by_place), reps.withColumnRenamed("id", "candidate_id").select("candidate_id", *EVIDENCE)).where(F.col("status") != "separate")
    pairs = cut(pairs.select("a", "b", "status"), "class-pairs")
    sides = pairs.where(F.col("status") == "admin_review").select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("witness")), F.struct(F.col("b").alias("id"), F.col("a").alias("witness")))).alias("s")).select("s.*", F.lit("SCORE").alias("rule"))
    crossed = _crossed(reps, "phone", "address", "PHONE_OF_OTHER_ADDRESS").unionByName(_crossed(reps, "address", "phone", "ADDRESS_OF_OTHER_PHONE"))
    witnesses = sides.unionByName(crossed).unionByName(_near_conflicts(reps)).where(F.col("witness").isNotNull())
    flagged = witnesses.groupBy("id").agg(F.min(F.struct("rule", "witness")).alias("w"))
    review = members.select("candidate_id", "id").join(flagged, "id").select(F.least("candidate_id", "w.witness").alias("a"), F.greatest("candidate_id", "w.witness").alias("b"), F.lit("admin_review").alias("status"), "w.rule")
    merges = pairs.where(F.col("status") == "auto_merge").select("a", "b", "status", F.lit("SCORE").alias("rule"))
    return merges.unionByName(copies.where(F.col("status").isNotNull())).unionByName(review).groupBy("a", "b", "status").agg(F.min("rule").alias("rule"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (hi, lo), hi > lo: neighbours (``large``: larger ones, else smaller) move to the smallest one.

    A large star gives no more edges than it gets, some of them twice; a small one makes them distinct.
    """
    seen = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))) if large else edges
    centre = seen.groupBy("hi").agg(F.min("lo").alias("c")).select("hi", F.least("hi", "c").alias("c"))
    moved = seen.join(centre, "hi")
    if large:
        return moved.where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("c").alias("lo"))
    out = moved.select(F.col("lo").alias("hi"), F.col("c").alias("lo")).unionByName(centre.select("hi", F.col("c").alias("lo")))
    return out.where(F.col("hi") != F.col("lo")).distinct()


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (hi, lo) of each batch as stars: every id beside the smallest one that it reaches by the batch's edges."""
    for batch in batches:
        over: dict = {}

        def root(x):
            while x in over:
                up = over[x]
                if up in over:
                    over[x] = over[up]
                x = up
            return x

        for hi, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            hi, lo = root(hi), root(lo)
            if hi != lo:
                over[max(hi, lo)] = min(hi, lo)
        ids = list(over)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, [root(x) for x in ids]), batch.schema, strict=True)], schema=batch.schema)


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``candidate_id``, ``root``: the smallest id reachable over edges (a, b).

    Edges are first shortened where they lie, an Arrow batch at a time, so that
    paths whose edges come one behind the other are stars before any shuffle.
    Then large and small stars alternate until nothing changes, a number of
    rounds that grows with the logarithm of the longest path that is left; no
    node's neighbours meet in one task's memory.
    """
    given = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    now = cut(given.mapInArrow(_shortened, given.schema).distinct(), "edges")
    state = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == tuple(found):
            break
        state = tuple(found)
        now = cut(_star(_star(now, True), False), "edges")
    roots = now.select(F.col("hi").alias("candidate_id"), F.col("lo").alias("root"))
    return nodes.select("candidate_id").join(roots, "candidate_id", "left").select("candidate_id", F.coalesce("root", "candidate_id").alias("root"))


def canonical_stores(candidates: DataFrame, matches: DataFrame, version: str = "v1") -> DataFrame:
    """One row per component: the member of the smallest id stands for it; any member under review marks the whole."""
    roots = connected(candidates, matches.where(F.col("status") == "auto_merge"))
    review = matches.where(F.col("status") == "admin_review").select(F.explode(F.array("a", "b")).alias("candidate_id")).distinct().withColumn("under_review", F.lit(True))
    rows = candidates.join(roots, "candidate_id").join(review, "candidate_id", "left")
    keep = ["display_name", "normalized_name", "normalized_brand_name", "normalized_address", "district", "normalized_phone", "latitude_e7", "longitude_e7", "business_status"]
    first = F.min_by(F.struct(*[c for c in keep if c in candidates.columns]), F.col("candidate_id"))
    out = rows.groupBy("root").agg(
        first.alias("p"),
        F.array_sort(F.collect_list("candidate_id")).alias("source_candidate_ids"),
        F.array_sort(F.collect_list("source_record_id")).alias("source_record_ids"),
        F.array_sort(F.collect_set("management_number")).alias("management_numbers"),
        F.coalesce(F.bool_or("under_review"), F.lit(False)).alias("under_review"),
    )
    status = F.when(F.col("under_review"), "admin_review").when(F.size("source_candidate_ids") > 1, "auto_merged").otherwise("distinct")
    store_id = stable_id("store", F.concat_ws(":", F.lit(version), F.concat_ws(":", "source_record_ids")))
    return out.select(store_id.alias("store_id"), "root", "p.*", "source_candidate_ids", "source_record_ids", "management_numbers", status.alias("merge_status"))


def reconcile(stores: DataFrame, existing: DataFrame) -> DataFrame:
    """Old ids carry over where new and old stores correspond one to one.

    ``existing``: (management_number, old_store_id).  Adds ``old_store_id`` and
    ``id_conflict``.
    """
    pairs = stores.select("store_id", F.explode("management_numbers").alias("management_number")).join(existing, "management_number").select("store_id", "old_store_id").distinct()
    olds = pairs.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_old"), F.min("old_store_id").alias("old_store_id"))
    uses = pairs.groupBy("old_store_id").agg(F.count(F.lit(1)).alias("n_new"))
    found = olds.join(uses, "old_store_id", "left")
    single = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    found = found.select("store_id", F.when(single, F.col("old_store_id")).alias("old_store_id"), (~single).alias("id_conflict"))
    return stores.join(found, "store_id", "left").withColumn("id_conflict", F.coalesce("id_conflict", F.lit(False)))
