"""Vector similarity: sparse TF-IDF weights and dense embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint


def tfidf(texts: DataFrame) -> DataFrame:
    """``(id, term, weight)`` of ``(id, text)``: (count / length) · (ln((N + 1) / (df + 1)) + 1), scaled to length 1.

    Terms are runs of three or more letters a-z. A text without terms has no rows but counts in N.
    """
    words = texts.select("id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)).alias("w"))
    tf = words.select("id", F.size("w").alias("n"), F.explode("w").alias("term")).groupBy("id", "term").agg((F.count(F.lit(1)) / F.first("n")).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = words.agg(F.count(F.lit(1)).alias("texts"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(total)).select("id", "term", (F.col("tf") * (F.log((F.col("texts") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine_pairs(weights: DataFrame, least: float) -> DataFrame:
    """``(a, b, cosine)`` of all pairs of ``(id, term, weight)`` at or above ``least``, by prefix filtering.

    Terms are ordered by how many ids have them. An id's rarest terms up to the point from which the rest of
    its vector is shorter than ``least`` are its prefix: two vectors whose prefixes share no term cannot
    reach it. Only prefixes are joined, so frequent terms never pair all their ids; candidates are then
    computed in full. Exact. Weights are kept, as prefixes, frequencies and vectors are all made from them.
    """
    weights = checkpoint(weights)
    df = weights.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    back = Window.partitionBy("id").orderBy(F.desc("df"), "term")
    rest = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    prefix = weights.join(df, "term").withColumn("rest", rest).where(F.col("rest") >= least - 1e-9).select("id", "term")
    x, y = prefix.alias("x"), prefix.alias("y")
    near = x.join(y, F.expr("x.term = y.term AND x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    vector = weights.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("v"))
    both = near.join(vector.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vector.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(F.col("vb"), e["key"]), F.lit(0.0)))
    return both.select("a", "b", F.round(dot, 6).alias("cosine")).where(F.col("cosine") >= least)


def dot(x: Column, y: Column) -> Column:
    """Inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 512) -> DataFrame:
    """``(vec_id, other_id, other_label, cosine, rank)``: the ``k`` nearest other vectors of each query vector, ties by id.

    The queries are a stated set and are sent to every task in blocks of ``block``; each task keeps its
    own best ``k`` of a query before anything is moved. Vectors have length 1; null ones match nothing.
    """
    q = queries.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding")
    blocks = max(1, -(-q.count() // block))
    parts = []
    for i in range(blocks):
        part = q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).select("vec_id", F.col("embedding").alias("e"))
        parts.append(vectors.where("embedding IS NOT NULL").select(F.col("vec_id").alias("other_id"), F.col("label").alias("other_label"), "embedding").join(F.broadcast(part), F.col("vec_id") != F.col("other_id")).select("vec_id", "other_id", "other_label", F.round(dot(F.col("e"), F.col("embedding")), 5).alias("cosine")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "other_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def label_votes(neighbours: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(a, b)``: each query's own label and the label most of its neighbours have, ties to the lesser."""
    votes = neighbours.groupBy("vec_id", "other_label").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("vec_id").orderBy(F.desc("n"), "other_label")
    won = votes.withColumn("r", F.row_number().over(order)).where("r = 1")
    return won.join(vectors.select("vec_id", "label"), "vec_id").select(F.col("label").alias("a"), F.col("other_label").alias("b"))
