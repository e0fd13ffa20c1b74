"""Keeping a knowledge base up: what a changed source makes stale, queues of work, segments and plans, memoised judgements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint
from ledgerloom.functions.skew import salted_join

#: Order of severities; tokens a summary of a child and of its parent take; budgets that warn and that refuse.
SEVERITIES = ("error", "warning", "info")
CHILD_TOKENS, PARENT_TOKENS, WARN_TOKENS, REFUSE_TOKENS = 500, 1000, 500_000, 1_000_000
#: What a section is called by words of its title, first match first.
SECTION_TYPES = (("abstract", "abstract"), ("method_section", "method|methodology|approach|implementation"), ("results", "result|evaluation|experiment|finding"), ("limitations", "limitation|discussion|future"), ("references", "reference|bibliography"), ("appendix", r"\b(?:appendix|annex)\b"), ("glossary", r"\bglossary\b"))


def stale_targets(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """``(version, source_id, target_type, target)``: what rests on a changed source ``(version, source_id)``, each once.

    ``edges`` is ``(from_type, a, to_type, b)``: b rests on a. Targets are followed layer by layer from sources to claims, from
    claims to concepts, from concepts to answers; the order of types is that of the edges, which has no cycle,
    so there are as many joins as there are types. What very many rest on is spread by the salted join.
    """
    at = changed.where("version IS NOT NULL AND source_id IS NOT NULL").select("version", "source_id", F.lit("source").alias("target_type"), F.col("source_id").alias("target")).distinct()
    found, last = None, at
    for _ in range(edges.select("from_type").distinct().count()):
        step = salted_join(edges.select(F.col("from_type").alias("target_type"), F.col("a").alias("target"), "to_type", "b").distinct(), last, ["target_type", "target"], ["b"]).select("version", "source_id", F.col("to_type").alias("target_type"), F.col("b").alias("target")).distinct()
        last, found = step, step if found is None else found.unionByName(step)
    return found.distinct() if found is not None else at.limit(0)


def stale_counts(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """``(version, source_id, target_type, n, first)``: how many targets ``stale_targets`` has of each type, and the least of them.

    Targets that rest on one node only, and on which nothing rests, are not listed: those of a node are counted
    once, whatever rests on it, and the counts of the nodes that a change reaches add up. Others are followed as
    there. So the answers of a concept are not repeated for every source that changed.
    """
    e = edges.select("from_type", "a", "to_type", "b").where("from_type IS NOT NULL AND a IS NOT NULL AND to_type IS NOT NULL AND b IS NOT NULL").distinct()
    by = ["to_type", "b"]
    inner = e.select(F.col("from_type").alias("to_type"), F.col("a").alias("b")).distinct()
    single = e.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(*by).join(inner.hint("merge"), by, "left_anti")
    marked = checkpoint(e.join(single.withColumn("leaf", F.lit(True)).hint("merge"), by, "left").withColumn("leaf", F.coalesce("leaf", F.lit(False))))
    leaves = marked.where("leaf").groupBy(F.col("from_type").alias("on_type"), F.col("a").alias("on"), F.col("to_type").alias("target_type")).agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("first"))
    followed = checkpoint(stale_targets(changed, marked.where("NOT leaf").drop("leaf")))
    start = changed.where("version IS NOT NULL AND source_id IS NOT NULL").select("version", "source_id", F.lit("source").alias("target_type"), F.col("source_id").alias("target")).distinct()
    reached = followed.unionByName(start).distinct().select("version", "source_id", F.col("target_type").alias("on_type"), F.col("target").alias("on"))
    counted = salted_join(reached, leaves, ["on_type", "on"], ["version", "source_id"]).select("version", "source_id", "target_type", "n", "first")
    listed = followed.groupBy("version", "source_id", "target_type").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("first"))
    return counted.unionByName(listed).groupBy("version", "source_id", "target_type").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def upserted(queue: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """The queue with ``entries`` in the place of those of the same key: running the same change again changes nothing."""
    return queue.join(entries.select(key).distinct(), key, "left_anti").unionByName(entries.select(queue.columns))


def not_yet_emitted(events: DataFrame, ledger: DataFrame, on: list[str]) -> DataFrame:
    """The events whose ``on`` columns no event of the ledger has, each once."""
    return events.dropDuplicates(on).join(ledger.select(on).distinct(), on, "left_anti")


def review_queue(findings: dict[str, tuple[str, DataFrame]], k: int | None = None) -> DataFrame:
    """``(rank, severity, category, ref)``: findings ``category -> (severity, rows with ref)`` once each, errors first, then by category and ref; the first ``k`` if given.

    Ranks come from counts per severity and category and a numbering within each, so no task sorts the whole queue.
    """
    rows = reduce(DataFrame.unionByName, (df.where("ref IS NOT NULL").select(F.lit(s).alias("severity"), F.lit(c).alias("category"), F.col("ref").cast("string").alias("ref")).distinct() for c, (s, df) in findings.items()))
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    counts = rows.groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("severity", "category", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(order, "category")) - F.col("n")).alias("before"))
    within = rows.withColumn("i", F.row_number().over(Window.partitionBy("severity", "category").orderBy("ref")))
    out = within.join(F.broadcast(before), ["severity", "category"]).select((F.col("before") + F.col("i")).alias("rank"), "severity", "category", "ref")
    return out.where(F.col("rank") <= k) if k else out


def section_type(title: Column) -> Column:
    """What a section is by its title."""
    low = F.lower(title)
    out = F.when(low.rlike(SECTION_TYPES[0][1]), SECTION_TYPES[0][0])
    for name, pattern in SECTION_TYPES[1:]:
        out = out.when(low.rlike(pattern), name)
    return out.otherwise("heading")


def heading_anchor(title: Column) -> Column:
    """A heading's anchor: lower case, without a ``type:`` prefix and punctuation, blanks as hyphens, 60 characters at most."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(F.lower(title)), r"^[a-z]+:\s*", ""), r"[^a-z0-9 -]", "")
    s = F.regexp_replace(F.regexp_replace(bare, r"[ -]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(s == "", "node-").otherwise(s), 1, 60)


def segment_nodes(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """``(doc_id, node_id, type, anchor, level, start, end, content_hash)``: the sections of a text as nodes; a text without sections is one node.

    ``node_id`` is the anchor, repeated ones of a document with ``-1``, ``-2`` … in order; the hash is over the section's characters.
    """
    text = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    whole = text.join(sections.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(0).alias("line_no"), F.lit(0).alias("level"), F.lit("document").alias("type"), F.lit("document").alias("anchor"), F.lit(0).alias("start"), F.length("text").alias("end"))
    parts = sections.select("doc_id", "line_no", "level", section_type(F.col("title")).alias("type"), heading_anchor(F.col("title")).alias("anchor"), "start", "end").unionByName(whole)
    n = F.row_number().over(Window.partitionBy("doc_id", "anchor").orderBy("line_no"))
    node = F.when(n == 1, F.col("anchor")).otherwise(F.concat_ws("-", "anchor", (n - 1).cast("string")))
    named = parts.withColumn("node_id", node).join(text, "doc_id")
    return named.select("doc_id", "node_id", "type", "anchor", "level", "start", "end", F.substring(F.sha2(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")), 256), 1, 10).alias("content_hash"))


def block_segments(lines: DataFrame) -> DataFrame:
    """``(doc_id, kind, first_line, last_line)``: tables (runs of lines that begin with a bar or hold two) and figures (image lines and figure captions)."""
    kind = F.when(F.col("line").rlike(r"^\s*\||\|.*\|"), "table").when(F.col("line").rlike(r"^\s*!\[|^(?i:figure|fig\.)\s+\d+"), "figure")
    marked = lines.select("doc_id", "line_no", kind.alias("kind")).where("kind IS NOT NULL")
    run = F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("line_no"))
    return marked.withColumn("run", F.when(F.col("kind") == "table", run).otherwise(F.col("line_no"))).groupBy("doc_id", "kind", "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")).drop("run")


def compile_budget(chars: Column, children: Column) -> dict[str, Column]:
    """Tokens of a text and of the summaries above its sections, and whether that warns or is refused."""
    tokens = F.greatest(F.lit(1), F.floor(chars / 4)).cast("bigint")
    parents = (CHILD_TOKENS * children + PARENT_TOKENS).cast("bigint")
    return {"tokens": tokens, "parent_tokens": parents, "budget": F.when(tokens + parents >= REFUSE_TOKENS, "refuse").when(tokens + parents >= WARN_TOKENS, "warn").otherwise("ok")}


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by line feeds; null counts as empty."""
    return F.sha2(F.concat_ws("\n", *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct requests whose fingerprint the cache lacks: only these need judging."""
    return requests.dropDuplicates(["fingerprint"]).join(cache.select("fingerprint").distinct(), "fingerprint", "left_anti")


def run_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(id, was, now, change)`` of two runs ``(id, verdict)``: changed, new or gone; equal verdicts give no row."""
    b, a = before.select("id", F.col("verdict").alias("was"), F.lit(1).alias("b")), after.select("id", F.col("verdict").alias("now"), F.lit(1).alias("a"))
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return b.join(a, "id", "full").select("id", "was", "now", change.alias("change")).where("change IS NOT NULL")


def chosen_by_hash(rows: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The first ``k`` keys of each group in the order of their hash: a choice that is the same every time and leans to nothing."""
    order = Window.partitionBy(group).orderBy(F.md5(key), key)
    return rows.where(F.col(key).isNotNull()).select(group, key).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
