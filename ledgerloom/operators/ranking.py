"""Lexical and graph ranking of nodes for a table of queries, their fusion, and keyword search over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint
from ledgerloom.operators.retrieval import ranked

#: Fixed values of the rankings: weight of a title, seeds of the graph walk and its depth.
TITLE_WEIGHT, SEEDS, DEPTH = 3, 5, 2


def query_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, term, times)``: the words of ``(query_id, text)`` in lower case; null texts have none."""
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), "")
    return queries.where("query_id IS NOT NULL AND text IS NOT NULL").select("query_id", F.explode(words).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def occurrences(text: Column, term: Column) -> Column:
    """How often ``term`` stands in ``text`` without overlaps, inside words too."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")


def field_counts(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """``(node, term, in_title, in_all)`` of the distinct terms of all queries that stand in some field of ``(node, title, text, tags)``.

    The terms of the stated query set are one array beside every node: nodes are read once whatever the
    number of queries, and only terms that occur make rows. A null field counts as empty.
    """
    wanted = F.broadcast(terms.select("term").distinct().agg(F.collect_list("term").alias("terms")))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    n = nodes.select("node", low(F.col("title")).alias("title"), low(F.col("text")).alias("text"), low(F.array_join("tags", " ")).alias("tags"), low(F.col("node")).alias("id"))
    n = n.withColumn("all", F.concat_ws("\n", "title", "text", "tags", "id"))
    held = F.filter("terms", lambda t: F.contains(F.col("all"), t))
    counts = F.transform(held, lambda t: F.struct(t.alias("term"), occurrences(F.col("title"), t).alias("in_title"), (occurrences(F.col("text"), t) + occurrences(F.col("tags"), t) + occurrences(F.col("id"), t)).alias("elsewhere")))
    out = n.crossJoin(wanted).select("node", F.explode(counts).alias("x")).select("node", "x.*")
    return out.select("node", "term", "in_title", (TITLE_WEIGHT * F.col("in_title") + F.col("elsewhere")).alias("in_all"))


def lexical_scores(terms: DataFrame, counts: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score, title_hits)``: three times the hits in the title, and those in text, tags and id."""
    return terms.join(counts, "term").groupBy("query_id", F.col("node").alias("doc_id")).agg(F.sum(F.col("times") * F.col("in_all")).cast("double").alias("score"), F.sum(F.col("times") * F.col("in_title")).cast("double").alias("title_hits"))


def graph_scores(lexical: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)``: nodes within two steps along ``(a, b)`` of the five best lexical ones: 2 / (depth + 1) and the hits in the title."""
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct().join(nodes.select(F.col("node").alias("b")).distinct(), "b", "left_semi")
    last = ranked(lexical, SEEDS).select("query_id", F.col("doc_id").alias("node"), F.lit(0).alias("depth"))
    seen = last
    for d in range(1, DEPTH + 1):
        last = last.join(e, F.col("node") == F.col("a")).select("query_id", F.col("b").alias("node"), F.lit(d).alias("depth")).distinct()
        seen = seen.unionByName(last)
    depth = seen.groupBy("query_id", F.col("node").alias("doc_id")).agg(F.min("depth").alias("depth"))
    return depth.join(lexical.select("query_id", "doc_id", "title_hits"), ["query_id", "doc_id"], "left").select("query_id", "doc_id", (2.0 / (F.col("depth") + 1) + F.coalesce("title_hits", F.lit(0.0))).alias("score"))


def node_search(nodes: DataFrame, edges: DataFrame, queries: DataFrame, k: int, of: str = "fused") -> DataFrame:
    """``(query_id, doc_id, score, rank)`` of the best ``k`` nodes ``(node, title, text, tags)`` per query: ``lexical``, ``graph`` or both ``fused`` by reciprocal rank."""
    from ledgerloom.operators.retrieval import fused

    terms = query_terms(queries)
    lexical = checkpoint(lexical_scores(terms, field_counts(nodes, terms)))
    if of == "lexical":
        return ranked(lexical.select("query_id", "doc_id", "score"), k)
    graph = graph_scores(lexical, edges, nodes)
    return ranked(graph, k) if of == "graph" else fused(lexical.select("query_id", "doc_id", "score"), graph, k)


def keyword_search(records: DataFrame, words: list[str], k: int) -> DataFrame:
    """``(id, hits)`` of the ``k`` records ``(id, text)`` that hold the given words most often, ties by id."""
    hits = sum((occurrences(F.lower("text"), F.lit(w.lower())) for w in words if w), F.lit(0).cast("bigint"))
    return records.where("id IS NOT NULL AND text IS NOT NULL").distinct().select("id", hits.alias("hits")).groupBy("id").agg(F.max("hits").alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "id").limit(k)
