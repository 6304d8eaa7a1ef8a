"""A stored full-text index: postings laid out by token in blocks with bounds, and searches that read few of them.

Documents belong to blocks of ``BLOCK`` documents of like length.  A posting row
holds one token's hits in one block with the largest part of a BM25 score among
them, for the average length of its time: that bounds the part for any later
average, as a part grows no faster than the average does.  Rows are range-partitioned and sorted by
(token, block); each range is a folder, and a directory of a row a range names
its first and last token, so that a search lists the folders of its terms only.

A search reads the terms' bounds first, drops blocks that do not hold all
terms, scores the blocks of the highest bounds, and then those whose bound
reaches the k-th score so far: blocks below it are never unpacked.

An index is written once for a version: its description is written last, and
what has one is not written again.  A later version adds a segment with the
changed documents, and notes which documents of older segments are gone; older
segments are shared, not rewritten.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fulltext import K1, B, order, query_tokens, scope, term_counts
from .tables import cut

BLOCK = 128
#: Bytes of bodies for each range of tokens.
RANGE_BYTES = 1 << 24
POSTING = "token string, block long, n long, most double, average double, hits array<struct<review_id:string,store_id:string,published_date:string,tf:int,dl:int>>, range int"
_POSTING = ("review_id", "store_id", "published_date", "tf", "dl")


def part_score(tf: Column, dl: Column, idf: Column, average: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))


class TextIndex:
    """Indexes of document versions below ``root``; documents have ``review_id``, ``store_id``, ``published_date`` and ``normalized_body``."""

    def __init__(self, spark: SparkSession, root: str, folded: bool = False):
        self.spark, self.root, self.folded = spark, root.rstrip("/"), folded

    # -- writing --------------------------------------------------------------

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def facts(self, version: str) -> dict:
        return self.spark.read.parquet(f"{self.root}/{version}/facts").first().asDict(recursive=True)

    def _describe(self, version: str, segments: list[str], n_docs: int, n_texts: int, total: int) -> None:
        row = [(version, segments, n_docs, n_texts, total)]
        self.spark.createDataFrame(row, "version string, segments array<string>, n_docs long, n_texts long, total_dl long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{version}/facts")

    def _words(self, documents: DataFrame) -> DataFrame:
        """The documents' terms, cut and counted once and written."""
        return cut(term_counts(documents, folded=self.folded, keep=("store_id", "published_date")), "terms")

    def _segment(self, docs: DataFrame, path: str, ranges: int, average: float) -> None:
        # documents of like length share blocks; as many blocks a length class as its documents fill
        kind = F.floor(F.log2(F.col("dl") + 1) * 4).cast("long")
        classes = docs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        docs = docs.withColumn("kind", kind).join(F.broadcast(classes), "kind")
        block = F.shiftleft(F.col("kind"), 40) + F.pmod(F.xxhash64("review_id"), F.ceil(F.col("n") / BLOCK))
        hits = docs.where(F.size("terms") > 0).select("review_id", "store_id", "published_date", F.col("dl").cast("int").alias("dl"), block.alias("block"), F.inline("terms")).withColumn("tf", F.col("tf").cast("int"))
        # ranges of (token, block) hold each group whole, so grouping moves nothing again
        rows = hits.repartitionByRange(ranges, "token", "block").groupBy("token", "block").agg(F.count(F.lit(1)).alias("n"), F.max(part_score(F.col("tf"), F.col("dl"), F.lit(1.0), average)).alias("most"), F.lit(average).alias("average"), F.collect_list(F.struct(*_POSTING)).alias("hits"))
        rows.withColumn("range", F.spark_partition_id()).sortWithinPartitions("token", "block").write.mode("overwrite").partitionBy("range").parquet(f"{path}/postings")
        stored = self.spark.read.parquet(f"{path}/postings")
        stored.groupBy("range").agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count(F.lit(1)).alias("n_blocks")).coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")

    def _ranges(self, documents: DataFrame) -> int:
        size = documents.agg(F.coalesce(F.sum(F.octet_length("normalized_body").cast("long")), F.lit(0))).first()[0]
        return int(max(16, -(-size // RANGE_BYTES)))

    def build(self, documents: DataFrame, version: str) -> None:
        """Index all documents of a version, if it is not there."""
        if self._there(f"{self.root}/{version}/facts"):
            return
        words = self._words(documents)
        n, texts, total = self._counted(words)
        self._segment(words, f"{self.root}/{version}/segment", self._ranges(documents), max(total, 1) / max(texts, 1))
        self._describe(version, [version], n, texts, total)

    def _counted(self, words: DataFrame) -> tuple[int, int, int]:
        """(documents, those with a body, words)."""
        return tuple(words.agg(F.count(F.lit(1)), F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first())

    def extend(self, base: str, version: str, added: DataFrame, removed: DataFrame) -> None:
        """The index of a version that differs from ``base`` by ``removed`` and ``added`` documents (a changed one is in both, in its old and new form)."""
        if self._there(f"{self.root}/{version}/facts"):
            return
        old = self.facts(base)
        words, gone = self._words(added), self._words(removed)
        more, less = self._counted(words), self._counted(gone)
        n, texts, total = (old[c] + m - x for c, m, x in zip(("n_docs", "n_texts", "total_dl"), more, less, strict=True))
        self._segment(words, f"{self.root}/{version}/segment", self._ranges(added), max(total, 1) / max(texts, 1))
        gone.select("review_id").write.mode("overwrite").parquet(f"{self.root}/{version}/gone")
        terms = gone.select(F.explode("terms.token").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        terms.sort("token").write.mode("overwrite").parquet(f"{self.root}/{version}/gone_terms")
        self._describe(version, [*old["segments"], version], n, texts, total)

    # -- reading --------------------------------------------------------------

    def postings(self, version: str, terms: list[str]) -> DataFrame:
        """Posting rows of these terms with their ``segment``, from the folders that hold them."""
        parts = []
        for number, segment in enumerate(self.facts(version)["segments"]):
            path = f"{self.root}/{segment}/segment"
            mine = self.spark.read.parquet(f"{path}/directory")
            hit = F.exists(F.array(*map(F.lit, terms)), lambda t: (mine["first"] <= t) & (t <= mine["last"]))
            ranges = [r["range"] for r in mine.where(hit).select("range").collect()]  # a few for each term
            if ranges:  # no other folder is even listed
                rows = self.spark.read.option("basePath", f"{path}/postings").parquet(*(f"{path}/postings/range={r}" for r in sorted(ranges)))
                parts.append(rows.where(F.col("token").isin(*terms)).withColumn("segment", F.lit(number)))
        if not parts:
            return self.spark.createDataFrame([], f"{POSTING}, segment int")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _gone(self, version: str) -> DataFrame | None:
        """``segment``, ``review_id``: documents that a later segment has taken away; they count in segments up to ``segment`` no more."""
        segments = self.facts(version)["segments"]
        found = [self.spark.read.parquet(f"{self.root}/{s}/gone").withColumn("upto", F.lit(i - 1)) for i, s in enumerate(segments) if i]
        if not found:
            return None
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out.groupBy("review_id").agg(F.max("upto").alias("upto"))

    def _weights(self, version: str, terms: list[str], rows: DataFrame) -> dict[str, float]:
        """idf of each term that any document has."""
        df = {r.token: r.n for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # a row a term
        for segment in self.facts(version)["segments"][1:]:
            for r in self.spark.read.parquet(f"{self.root}/{segment}/gone_terms").where(F.col("token").isin(*terms)).collect():
                df[r.token] = df.get(r.token, 0) - r.n
        n = self.facts(version)["n_docs"]
        return {t: max(math.log((n - d + 0.5) / (d + 0.5)), 1e-6) for t, d in df.items() if d > 0}

    def search(self, version: str, text: str, limit: int = 20, store_ids: list[str] | None = None, digits: int | None = None) -> tuple[DataFrame, dict]:
        """(``review_id``, ``store_id``, ``published_date``, ``rank`` of the best ``limit`` (1 to 100) in the ``order`` of ``digits``; what was read).

        Documents hold all terms; of these stores, if any are named.
        """
        if not 1 <= limit <= 100:
            raise ValueError("limit")
        terms = query_tokens(text)
        if not terms:
            raise ValueError("no token")
        rows = self.postings(version, terms)
        idf = self._weights(version, terms, rows)
        facts = self.facts(version)
        average = facts["total_dl"] / max(1, facts["n_texts"])
        if len(idf) < len(terms):
            rows, idf = rows.where(F.lit(False)), dict.fromkeys(terms, 0.0)
        weight = F.create_map(*(F.lit(x) for t in terms for x in (t, idf[t])))[F.col("token")]
        bound = weight * F.col("most") * F.greatest(F.lit(1.0), F.lit(average) / F.col("average"))
        # a little above, so that the order of additions cannot lower a bound
        bounds = rows.groupBy("segment", "block").agg(F.count(F.lit(1)).alias("n_terms"), (F.sum(bound) * (1 + 1e-9)).alias("bound")).where(F.col("n_terms") == len(terms)).drop("n_terms")
        bounds = cut(bounds, "bounds")
        gone = self._gone(version)
        by = order(digits)

        def scored(blocks: DataFrame) -> DataFrame:
            hits = rows.join(blocks.select("segment", "block"), ["segment", "block"], "left_semi").select("segment", "token", F.explode("hits").alias("h")).select("segment", "token", "h.*")
            if store_ids is not None:
                hits = hits.where(F.col("store_id").isin(*scope(store_ids)))
            if gone is not None:
                hits = hits.join(gone, "review_id", "left").where(F.coalesce(F.col("segment") > F.col("upto"), F.lit(True)))
            each = part_score(F.col("tf"), F.col("dl"), weight, average)
            found = hits.groupBy("review_id", "store_id", "published_date").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.when(F.col("token") == t, each)).alias(f"s{i}") for i, t in enumerate(terms)))
            total = F.lit(0.0)
            for i in range(len(terms)):
                total = total + F.col(f"s{i}")
            return found.where(F.col("n") == len(terms)).select("review_id", "store_id", "published_date", (-total).alias("rank"))

        first = scored(bounds.orderBy(F.desc("bound"), "segment", "block").limit(max(4, limit // 4)))
        worst = [r["rank"] for r in first.orderBy(*by).limit(limit).select(by[0].alias("rank")).collect()]
        slack = 0.0 if digits is None else 10.0**-digits  # rounding moves a rank by half of that
        reach = bounds if len(worst) < limit else bounds.where(F.col("bound") >= -worst[-1] - slack)
        best = cut(scored(reach).orderBy(*by).limit(limit), "best")
        counts = {"blocks": bounds.count(), "blocks_scored": reach.count(), "files": len(rows.inputFiles())}
        return best.orderBy(*by), counts
