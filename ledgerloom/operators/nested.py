"""Deeply nested records as flat node tables linked by interval containment.

A record is a tree: the claim, its source ids, its anchors, the spans of an anchor, the labels of a span.
A depth-first traversal numbers every node on the way down (pre) and on the way up (post); a node lies
inside another exactly if its pre is greater and its post smaller. Null elements are no nodes but keep
their place in the list; empty strings and structs of nulls are nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: One record reduced to its shape: which elements are there, and how many labels a span has.
SHAPE = "claim_id string, rec bigint, sources array<boolean>, anchors array<struct<there:boolean,spans:array<struct<there:boolean,labels:array<boolean>>>>>"

NODES = "claim_id string, rec bigint, kind string, pre int, post int, place int"

#: The scalar fields of an anchor with their types, in order.
ANCHOR = {"source_id": "string", "anchor": "string", "page": "int", "section": "string", "paragraph": "int", "quote": "string", "path": "string", "line_start": "int", "line_end": "int", "commit": "string", "extraction_confidence": "double", "segment_id": "string"}


def typed_shape(claims: DataFrame) -> DataFrame:
    """Shapes of records in typed columns ``claim_id``, ``source_ids`` and ``source_anchors``."""
    return _shaped(claims, F.col("claim_id"), *_shapes())


def _shapes() -> tuple[Column, Column]:
    there = lambda x: x.isNotNull()
    span = lambda s: F.struct(s.isNotNull().alias("there"), F.transform(s["labels"], there).alias("labels"))
    anchor = lambda a: F.struct(a.isNotNull().alias("there"), F.transform(a["spans"], span).alias("spans"))
    return F.transform("source_ids", there), F.transform("source_anchors", anchor)


def _shaped(df: DataFrame, claim: Column, sources: Column, anchors: Column) -> DataFrame:
    out = df.select(claim.alias("claim_id"), sources.alias("sources"), anchors.alias("anchors")).where("claim_id IS NOT NULL")
    return out.select("claim_id", F.xxhash64("sources", "anchors").alias("rec"), "sources", "anchors")


def _at(v: Column, path: str) -> Column:
    """The JSON value at ``path``; null where there is none or it is a JSON null."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(~F.is_variant_null(x), x)


def _list(v: Column, path: str) -> Column:
    """The JSON list at ``path``; a bare element counts as a list of one."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(_at(v, path).isNotNull(), F.array(_at(v, path))))


def feed_record(payload: Column) -> Column:
    """The claim record of a raw JSON payload, which may sit under ``record``; null for null or invalid JSON."""
    v = F.try_parse_json(payload)
    return F.coalesce(_at(v, "$.record"), v)


def _evidence(r: Column, field: str) -> Column:
    return F.coalesce(_list(r, f"$.evidence.{field}"), _list(r, f"$.{field}"))


def feed_shape(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """Shapes of the records in raw JSON payloads; the two evidence fields may sit under ``evidence``."""
    there = lambda x: x.isNotNull() & ~F.is_variant_null(x)
    span = lambda s: F.struct(there(s).alias("there"), F.transform(_list(s, "$.labels"), there).alias("labels"))
    anchor = lambda a: F.struct(there(a).alias("there"), F.transform(_list(a, "$.spans"), span).alias("spans"))
    r = feed.where(F.col(payload).isNotNull()).select(feed_record(F.col(payload)).alias("r"))
    return _shaped(r, F.try_variant_get("r", "$.claim_id", "string"), F.transform(_evidence(F.col("r"), "source_ids"), there), F.transform(_evidence(F.col("r"), "source_anchors"), anchor))


def typed_records(claims: DataFrame) -> DataFrame:
    """``(claim_id, rec, source_ids, source_anchors)`` of typed claims, whole; ``rec`` is a hash of the two lists."""
    return _recorded(claims.select("claim_id", "source_ids", F.transform("source_anchors", lambda a: F.when(a.isNotNull(), F.struct(*(a[f].cast(t).alias(f) for f, t in ANCHOR.items()), a["spans"].alias("spans")))).alias("source_anchors")))


def feed_records(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """The same of raw JSON payloads: a value of another type than its field's is null, as is a JSON null."""
    value = lambda v, f, t: F.try_variant_get(v, f"$.{f}", t).alias(f)
    there = lambda v: v.isNotNull() & ~F.is_variant_null(v)
    text = lambda v: F.when(there(v), F.try_variant_get(v, "$", "string"))
    span = lambda s: F.when(there(s), F.struct(value(s, "start_char", "bigint"), value(s, "end_char", "bigint"), F.transform(_list(s, "$.labels"), text).alias("labels")))
    anchor = lambda a: F.when(there(a), F.struct(*(value(a, f, t) for f, t in ANCHOR.items()), F.transform(_list(a, "$.spans"), span).alias("spans")))
    r = feed.where(F.col(payload).isNotNull()).select(feed_record(F.col(payload)).alias("r"))
    return _recorded(r.select(F.try_variant_get("r", "$.claim_id", "string").alias("claim_id"), F.transform(_evidence(F.col("r"), "source_ids"), text).alias("source_ids"), F.transform(_evidence(F.col("r"), "source_anchors"), anchor).alias("source_anchors")))


def _recorded(rows: DataFrame) -> DataFrame:
    """Whole records with their hash; equal ones are merged, on the map side first."""
    known = rows.where("claim_id IS NOT NULL").withColumn("rec", F.xxhash64("source_ids", "source_anchors"))
    return known.groupBy("claim_id", "rec").agg(F.first("source_ids").alias("source_ids"), F.first("source_anchors").alias("source_anchors"))


def record_shapes(records: DataFrame) -> DataFrame:
    """Shapes of whole records, under the same ``rec``."""
    sources, anchors = _shapes()
    return records.select("claim_id", "rec", sources.alias("sources"), anchors.alias("anchors"))


def _lists(a: pa.ListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Starts and lengths of the lists (0 for null ones) within their values."""
    offsets = a.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(offsets) * a.is_valid().to_numpy(zero_copy_only=False)
    return offsets[:-1], n, a.values


def _owner(starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element of the lists: its list, its 0-based place and its index in the values."""
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return of, place, starts[of] + place


def _before(x: np.ndarray, of: np.ndarray, groups: int) -> np.ndarray:
    """Sum of ``x`` over the earlier elements of the same group; ``of`` ascends."""
    run = np.cumsum(x) - x
    first = np.searchsorted(of, np.arange(groups))
    base = run[np.minimum(first, max(len(run) - 1, 0))] if len(run) else np.zeros(groups, dtype=np.int64)
    return run - base[of]


def _flags(values: pa.Array, at: np.ndarray) -> np.ndarray:
    return values.take(pa.array(at)).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def _structs(values: pa.StructArray, at: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.StructArray]:
    taken = values.take(pa.array(at))
    return taken.field("there").fill_null(False).to_numpy(zero_copy_only=False).astype(bool), taken, taken


def label_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All nodes of a batch of shapes with pre- and post-order numbers, computed column-wise.

    With 1-based pre over the nodes and as many post numbers, post = pre + (nodes below) - (nodes above).
    """
    rows = batch.num_rows
    b = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    s_of, s_place, s_at = _owner(*_lists(b["sources"])[:2])
    s_ok = _flags(_lists(b["sources"])[2], s_at)
    a_start, a_n, a_values = _lists(b["anchors"])
    a_of, a_place, a_at = _owner(a_start, a_n)
    a_ok, a_taken, _ = _structs(a_values, a_at)
    p_start, p_n, p_values = _lists(a_taken.field("spans"))
    p_n = p_n * a_ok
    p_of, p_place, p_at = _owner(p_start, p_n)
    p_ok, p_taken, _ = _structs(p_values, p_at)
    l_start, l_n, l_values = _lists(p_taken.field("labels"))
    l_n = l_n * p_ok
    l_of, l_place, l_at = _owner(l_start, l_n)
    l_ok = _flags(l_values, l_at)

    size_p = p_ok + np.bincount(l_of, l_ok, len(p_of)).astype(np.int64)
    size_a = a_ok + np.bincount(p_of, size_p, len(a_of)).astype(np.int64)
    n_sources = np.bincount(s_of, s_ok, rows).astype(np.int64)
    size_r = 1 + n_sources + np.bincount(a_of, size_a, rows).astype(np.int64)
    s_pre = 2 + _before(s_ok.astype(np.int64), s_of, rows)
    a_pre = 2 + n_sources[a_of] + _before(size_a, a_of, rows)
    p_pre = a_pre[p_of] + 1 + _before(size_p, p_of, len(a_of))
    l_pre = p_pre[l_of] + 1 + _before(l_ok.astype(np.int64), l_of, len(p_of))

    parts = [("claim", np.arange(rows), np.ones(rows, np.int64), size_r, 0, np.ones(rows, np.int64), np.ones(rows, bool)), ("source_id", s_of, s_pre, np.ones(len(s_of), np.int64), 1, s_place + 1, s_ok), ("anchor", a_of, a_pre, size_a, 1, a_place + 1, a_ok), ("span", a_of[p_of], p_pre, size_p, 2, p_place + 1, p_ok), ("label", a_of[p_of][l_of], l_pre, np.ones(len(l_of), np.int64), 3, l_place + 1, l_ok)]
    row = np.concatenate([x[1][x[6]] for x in parts])
    pre = np.concatenate([x[2][x[6]] for x in parts])
    below = np.concatenate([x[3][x[6]] - 1 for x in parts])
    depth = np.concatenate([np.full(int(x[6].sum()), x[4]) for x in parts])
    place = np.concatenate([x[5][x[6]] for x in parts])
    kind = pa.DictionaryArray.from_arrays(pa.array(np.concatenate([np.full(int(x[6].sum()), i, np.int8) for i, x in enumerate(parts)])), pa.array([x[0] for x in parts])).dictionary_decode()
    take = pa.array(row)
    return pa.RecordBatch.from_arrays([b["claim_id"].take(take), b["rec"].take(take), kind, pa.array(pre.astype(np.int32)), pa.array((pre + below - depth).astype(np.int32)), pa.array(place.astype(np.int32))], ["claim_id", "rec", "kind", "pre", "post", "place"])


def label_nodes(shapes: DataFrame) -> DataFrame:
    """Interval-labelled nodes ``(claim_id, rec, kind, pre, post, place)`` of each distinct record shape.

    ``rec`` tells records of one claim id with different shapes apart. Equal records are merged before,
    with a partial aggregation on the map side, so that a claim delivered any number of times is one tree.
    """
    once = shapes.groupBy("claim_id", "rec").agg(F.first("sources").alias("sources"), F.first("anchors").alias("anchors"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield label_batch(batch)

    return once.mapInArrow(run, NODES)


def link(nodes: DataFrame, child: str, *parents: str) -> DataFrame:
    """Each ``child`` node with the pre and place of the nodes of the ``parents`` kinds whose intervals contain it (``<kind>_pre``, ``<kind>_no``).

    Intervals of a tree nest, so in pre order the containing node of a kind is the last one of it begun; its
    post must be the greater one. One sweep per record instead of a range join; a record never exceeds a row.
    """
    order = Window.partitionBy("claim_id", "rec").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    swept = nodes.where(F.col("kind").isin(child, *parents))
    swept = swept.select("*", *(F.last(F.when(F.col("kind") == p, F.struct("pre", "post", "place")), ignorenulls=True).over(order).alias(f"up_{p}") for p in parents)).where(F.col("kind") == child)
    for p in parents:
        swept = swept.where(F.col(f"up_{p}.post") > F.col("post"))
    return swept.select("claim_id", "rec", "pre", "post", "place", *(F.col(f"up_{p}.{a}").alias(f"{p}_{b}") for p in parents for a, b in (("pre", "pre"), ("place", "no"))))


def child_elements(shapes: DataFrame) -> DataFrame:
    """``(claim_id, child, item_no, span_no)``: one row per source id, anchor and span of a claim.

    Records without claim id give nothing; repeated and re-delivered records give each row once.
    """
    nodes = label_nodes(shapes)
    top = nodes.where(F.col("kind").isin("source_id", "anchor")).select("claim_id", F.col("kind").alias("child"), F.col("place").alias("item_no"), F.lit(0).alias("span_no"))
    spans = link(nodes, "span", "anchor").select("claim_id", F.lit("span").alias("child"), F.col("anchor_no").alias("item_no"), F.col("place").alias("span_no"))
    return top.unionByName(spans).distinct()


def node_table(records: DataFrame) -> DataFrame:
    """``(claim_id, rec, kind, pre, post, place)``: every node of every whole record with its interval."""
    return label_nodes(record_shapes(records))


def _with_record(nodes: DataFrame, records: DataFrame) -> DataFrame:
    return nodes.join(records, ["claim_id", "rec"])


def source_table(records: DataFrame) -> DataFrame:
    """``(claim_id, item_no, source_id)``: the source ids with their place; a null element gives no row, an empty one does."""
    n = link(node_table(records), "source_id", "claim")
    return _with_record(n, records).select("claim_id", F.col("place").alias("item_no"), F.element_at("source_ids", F.col("place")).alias("source_id")).distinct()


def anchor_table(records: DataFrame) -> DataFrame:
    """``(claim_id, item_no, …fields)``: the anchors, found as nodes inside their claim, with all scalar fields; repeated rows once.

    A null anchor gives no row, an anchor of nulls does.
    """
    a = _with_record(link(node_table(records), "anchor", "claim"), records).select("claim_id", F.col("place").alias("item_no"), F.element_at("source_anchors", F.col("place")).alias("a"))
    return a.select("claim_id", "item_no", *(f"a.{f}" for f in ANCHOR)).distinct()


def span_table(records: DataFrame) -> DataFrame:
    """``(claim_id, item_no, span_no, start_char, end_char, n_labels)``: the spans, linked to the anchor whose interval contains theirs."""
    s = _with_record(link(node_table(records), "span", "anchor"), records).select("claim_id", F.col("anchor_no").alias("item_no"), F.col("place").alias("span_no"), F.element_at(F.element_at("source_anchors", F.col("anchor_no"))["spans"], F.col("place")).alias("s"))
    return s.select("claim_id", "item_no", "span_no", "s.start_char", "s.end_char", F.size(F.filter(F.coalesce("s.labels", F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("n_labels")).distinct()


def label_table(records: DataFrame) -> DataFrame:
    """``(claim_id, item_no, span_no, label_no, label)``: the labels, linked to span and anchor by containment."""
    n = _with_record(link(node_table(records), "label", "anchor", "span"), records)
    labels = F.element_at(F.element_at("source_anchors", F.col("anchor_no"))["spans"], F.col("span_no"))["labels"]
    return n.select("claim_id", F.col("anchor_no").alias("item_no"), "span_no", F.col("place").alias("label_no"), F.element_at(labels, F.col("place")).alias("label")).distinct()


def label_counts(records: DataFrame) -> DataFrame:
    """``(label, n_labels, n_spans)`` over the distinct labels of all records; null labels do not count."""
    labels = label_table(records).select(F.struct("claim_id", "item_no", "span_no").alias("span"), "label")
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_labels"), F.count_distinct("span").alias("n_spans"))
