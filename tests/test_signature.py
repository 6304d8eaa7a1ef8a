"""Signatures of all tables, and changed rows located by reading only the ranges that differ."""

from pyspark.sql import functions as F

from wayfern.plans import signature as S


def tables(spark, n=300, changed=None):
    a = spark.range(n).select("id", F.concat(F.lit("name "), "id").alias("name"), F.when(F.col("id") % 7 != 0, F.col("id") * 2).alias("x"))
    if changed is not None:
        a = a.withColumn("x", F.when(F.col("id") == changed, -1).otherwise(F.col("x")))
    b = spark.range(40).select(F.lit(1).alias("same"), F.lit(None).cast("string").alias("none"))
    return {"a": S.in_ranges(a, ["id"]), "b": S.in_ranges(b), "empty": S.in_ranges(spark.createDataFrame([], "y int"))}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equal_tables_have_one_signature_whatever_their_order(spark):
    one = S.tree(spark, tables(spark))
    other = S.tree(spark, {n: df.repartition(3, F.rand(1)).select(*reversed(df.columns)) for n, df in tables(spark).items()})
    assert S.signature(one) == S.signature(other) and S.signature(one)["n"] == 340
    assert rows(S.differing(one, other)) == []
    roots = {r.table: r.n for r in one.where("node = 'r'").collect()}
    assert roots == {"a": 300, "b": 40, "empty": 0, "*": 340}


def test_nodes_above_tell_of_what_is_below(spark):
    one = {(r.table, r.node): (r.n, r.digest) for r in S.tree(spark, tables(spark)).collect()}
    for (table, node), (n, _) in one.items():
        below = [m for (t, c), (m, _) in one.items() if t == table and len(c) == len(node) + 1 and c.startswith(node)]
        assert not below or sum(below) == n
    other = {(r.table, r.node): (r.n, r.digest) for r in S.tree(spark, tables(spark, changed=41)).collect()}
    moved = {k for k in one.keys() | other.keys() if one.get(k) != other.get(k)}
    assert sorted(len(node) for table, node in moved if table == "a") == [1, 2, 3] and {t for t, _ in moved} == {"a", "*"}


def test_one_changed_row_is_located_without_the_other_ranges(spark, tmp_path):
    paths = {}
    for side, changed in (("one", None), ("other", 41)):
        for name, df in tables(spark, changed=changed).items():
            S.store(df, paths.setdefault((side, name), str(tmp_path / side / name)))
    tree = lambda side: S.tree(spark, {n: S.read(spark, paths[side, n]) for n in ("a", "b")})
    found = S.differing(tree("one"), tree("other")).collect()
    assert [(r.table, r.n_a == r.n_b) for r in found] == [("a", True)]
    for side in ("one", "other"):  # whatever is not of that range may be gone
        for folder in (tmp_path / side / "a").glob("__range=*"):
            if not folder.name.endswith(f"={found[0].node}"):
                for f in folder.iterdir():
                    f.write_bytes(b"not a table") if f.suffix == ".parquet" else f.unlink()
    located = S.located(spark, paths["one", "a"], paths["other", "a"], [found[0].node], "id long, name string, x long")
    assert rows(located) == [(41, "name 41", -1, "b"), (41, "name 41", 82, "a")]


def test_missing_added_and_repeated_rows(spark, tmp_path):
    a, b = tables(spark), tables(spark, n=301)
    b["b"] = S.in_ranges(spark.range(39).select(F.lit(1).alias("same"), F.lit(None).cast("string").alias("none")))
    del b["empty"]
    found = rows(S.differing(S.tree(spark, a), S.tree(spark, b)))
    assert [(t, y - x) for t, _, x, y in found] == [("a", 1), ("b", -1), ("empty", 0)]
    assert rows(S.changes(a["b"], b["b"])) == [(1, None, "a")]
