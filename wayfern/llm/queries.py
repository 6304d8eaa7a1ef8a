"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, hard_negatives, lang_id, length_stats, line_dedup, near_dup, pii, secret_scan, suffix_dedup, token_store, topk, whiten
from .common import table

BYTE_BPE = "byte_bpe_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
#: Context limits and quantiles that the report of token counts has beside the lengths that occur.
LIMITS = [1 << i for i in range(7, 21)]
PROBABILITIES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0]


def held_out(id_col: str = "doc_id"):
    """Documents that language models do not learn from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)
    return length_stats.report(counts, LIMITS, PROBABILITIES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(~held_out()), public_tokenizers.path(PIECES))
    return lang_id.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_classes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), every=True)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their number of lines, the deleted ones and the text that is left."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    n_removed = F.coalesce(F.size("gone"), F.lit(0))
    return found.select("doc_id", n_removed.cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed_lines"), "text")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some labels are moved on by one, so that neighbours of other labels occur."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
                FROM embeddings
                WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score
                FROM v q JOIN v e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0
            ), r AS (
                SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
            )
            SELECT * FROM r WHERE rank <= 10""",
        "op8_near_dup": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), s AS (
                SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
            ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
            e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
            u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            r(doc_id, root) AS (SELECT a, a FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id AND r.root < u.b),
            c AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
            SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
            FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
        "op9_line_dedup": r"""
            WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
            l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM x),
            t AS (SELECT doc_id, pos, len(regexp_extract_all(line, '\S+')) AS n, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l),
            span AS (
                SELECT a.doc_id, a.pos AS low, min(b.pos) AS high FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= 8 GROUP BY ALL
                UNION
                SELECT b.doc_id, max(a.pos) AS low, b.pos AS high FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= 8 GROUP BY ALL
            ), run AS (SELECT doc_id, low, high, lines[low + 1:high + 1] AS run FROM span JOIN x USING (doc_id)),
            first AS (SELECT run, min(doc_id) AS first FROM run GROUP BY run),
            gone AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS pos FROM run JOIN first USING (run) WHERE first < doc_id),
            lost AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id),
            left_over AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
            SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed_lines, CASE WHEN n IS NULL THEN text ELSE coalesce(kept, '') END AS text
            FROM documents d LEFT JOIN lost USING (doc_id) LEFT JOIN left_over USING (doc_id)""",
        "op11_suffix_dedup": """
            WITH x AS (SELECT doc_id, coalesce(strlen(text), 0) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
            c AS (SELECT doc_id, n, lo, substr(h, 2 * lo + 1, 2 * (256 + 49)) AS piece FROM (SELECT *, unnest(range(0, n, 256)) AS lo FROM x)),
            w AS (SELECT doc_id, lo + i AS p, substr(piece, 2 * i + 1, 2) AS byte, CASE WHEN n >= lo + i + 50 THEN substr(piece, 2 * i + 1, 100) END AS g FROM (SELECT *, unnest(range(least(256, n - lo))) AS i FROM c)),
            f AS (SELECT g, min(doc_id) AS first FROM w WHERE g IS NOT NULL GROUP BY g HAVING min(doc_id) < max(doc_id)),
            m AS (SELECT w.doc_id, p, byte, max(CASE WHEN first < w.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM w LEFT JOIN f ON w.g = f.g),
            s AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), 0) = 0 AS begins FROM m),
            r AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (gone = 0) AS kept FROM s GROUP BY doc_id)
            SELECT x.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
            FROM x LEFT JOIN r USING (doc_id)""",
        "op13_hard_negatives": """
            WITH v AS (
                SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
            ), s AS (
                SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
                FROM v a JOIN v e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0
            ), p AS (
                SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
                QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
            )
            SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
                n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
            FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
            QUALIFY rank <= 5""",
    }
