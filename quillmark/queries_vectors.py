"""Queries over all embeddings at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import vectors as vc
from .queries import query, table


@query("""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS key, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT query, CAST(rank AS INT) AS rank, key, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, key) AS rank FROM p) WHERE rank <= 10""")
def neighbours_of_all(spark, sf_dir):
    """[J19] The ten nearest of each vector, exactly."""
    e = table(spark, sf_dir, "embeddings")
    return vc.nearest_many(e, e, "vec_id", "embedding", exact=True).withColumn("cosine", F.round("cosine", 6))


@query("SELECT count(*) * 10 AS n_found, true AS recall_reached FROM embeddings")
def neighbours_by_lists(spark, sf_dir):
    """[J19] The same by an inverted file: ten for each vector, of which at least 0.95 are the nearest."""
    e = table(spark, sf_dir, "embeddings")
    found = vc.nearest_many(e, e, "vec_id", "embedding", lists=vc.Lists(length=64, members=24))
    right = vc.nearest_many(e, e, "vec_id", "embedding", exact=True).select("query", "key", F.lit(1).alias("hit"))
    both = found.join(right, ["query", "key"], "left")
    return both.agg(F.count("*").alias("n_found"), (F.count("hit") >= 0.95 * F.count("*")).alias("recall_reached"))
