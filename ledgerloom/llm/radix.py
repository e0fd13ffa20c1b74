"""Duplicates hidden by formatting: recursive radix partitioning on canonical bytes, then a counting trie per bucket."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint
from ledgerloom.functions.skew import salted_join

#: Rows that fit a bucket, whatever the table's size, and bytes by which a larger one is split.
BUCKET_ROWS, BYTES = 4096, 2
#: Bytes of the list of buckets up to which it is broadcast; a longer one is joined by shuffling.
BROADCAST = 4 << 20

_DROP = r"[^\p{L}\p{N}\p{M}]+"


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), _DROP, "")


def _unordered(c: Column, mark: str) -> Column:
    """The marked-off parts of a value in plain form, sorted, without empty ones."""
    parts = F.filter(F.transform(F.split(c, mark), _plain), lambda x: x != "")
    return F.array_join(F.array_sort(parts), "\x1f")


def canonical(source: Column, title: Column) -> Column:
    """Canonical bytes of a record: whitespace, letter case and punctuation left out, unordered parts sorted.

    Unordered are the ``&``-separated parameters after ``?`` in ``source`` and the ``|``-separated parts
    of ``title``. A null title differs from an empty one; a null source gives null.
    """
    address, query = F.split(source, r"\?", 2)[0], F.coalesce(F.get(F.split(source, r"\?", 2), F.lit(1)), F.lit(""))
    name = F.coalesce(F.concat(F.lit("\x1d"), _unordered(title, r"\|")), F.lit("\x1c"))
    return F.encode(F.concat(_plain(address), F.lit("\x1e"), _unordered(query, "&"), name), "UTF-8")


class Trie:
    """A path-compressed byte trie with a counter and the least id at each terminal."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [{}, None]

    def add(self, key: bytes, ident: str, n: int) -> None:
        node, at = self.root, 0
        while at < len(key):
            edge = node[0].get(key[at])
            if edge is None:
                leaf = [{}, None]
                node[0][key[at]] = [key[at:], leaf]
                node, at = leaf, len(key)
                continue
            label, child = edge
            same = _common(label, key, at)
            if same < len(label):
                middle = [{label[same]: [label[same:], child]}, None]
                edge[0], edge[1] = label[:same], middle
                child = middle
            node, at = child, at + same
        if node[1] is None:
            node[1] = [0, 0, ident]
        end = node[1]
        end[0] += 1
        end[1] += n
        if ident < end[2]:
            end[2] = ident

    def terminals(self) -> Iterator[tuple[bytes, int, int, str]]:
        """``(key, ids, rows, least id)`` of every terminal."""
        stack = [(b"", self.root)]
        while stack:
            prefix, (edges, end) = stack.pop()
            if end is not None:
                yield prefix, *end
            stack += [(prefix + label, child) for label, child in edges.values()]


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``."""
    if key.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


def _split(bucket_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What becomes of each bucket ``(bucket, n, low, high)``: ``cut`` is how many bytes its rows are told apart by next (0: it stays), ``parts`` over how many parts it is spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut, parts = [], []
            for n, low, high in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                cut.append(0 if n <= bucket_rows or low == high else _common(low, high, 0) + BYTES)
                parts.append(-(-n // bucket_rows) if low == high else 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cut, pa.int32()), pa.array(parts, pa.int32())], ["bucket", "cut", "parts"])

    return run


def radix_buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``bucket`` (a prefix of ``canon``) and ``part``; no part of a bucket holds much more than fits.

    All rows begin in one bucket. A bucket with too many rows is split by the next bytes in which its rows
    differ (the common prefix of its least and greatest value is skipped), level by level and only where
    needed; each level is checkpointed. A bucket of a single value, which no further byte can split, is
    spread over parts by the row's id. Nothing about buckets reaches the driver but how much there is of it.
    """
    rest, done = rows.withColumn("bucket", F.lit(b"")), []
    while True:
        size = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("canon").alias("low"), F.max("canon").alias("high"))
        fate = checkpoint(size.mapInArrow(_split(bucket_rows), "bucket binary, cut int, parts int"))
        length, splits = fate.agg(F.coalesce(F.sum(F.octet_length("bucket") + 16), F.lit(0)), F.count_if(F.col("cut") > 0)).first()
        met = rest.join(F.broadcast(fate) if length <= BROADCAST else fate, "bucket")
        done.append(met.where("cut = 0").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("cut", "parts"))
        if not splits:
            return functools.reduce(DataFrame.unionByName, done)
        rest = checkpoint(met.where("cut > 0").withColumn("bucket", F.expr("substring(canon, 1, cut)")).drop("cut", "parts"))


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """A trie per bucket (and part) of the few that meet in a task."""
    tries: dict[tuple[bytes, int], Trie] = {}
    for bucket, part, canon, ident, n in zip(pdf["bucket"], pdf["part"], pdf["canon"], pdf["id"], pdf["n"]):
        tries.setdefault((bytes(bucket), part), Trie()).add(bytes(canon), ident, n)
    return pd.DataFrame([x for t in tries.values() for x in t.terminals()], columns=["canon", "n_ids", "n_rows", "keep_id"])


def _rows(records: DataFrame, key: str, source: str, title: str) -> DataFrame:
    named = records.where(F.col(key).isNotNull() & F.col(source).isNotNull()).select(F.col(key).cast("string").alias("id"), canonical(F.col(source), F.col(title)).alias("canon"))
    return checkpoint(named.groupBy("canon", "id").agg(F.count(F.lit(1)).alias("n")))


def _kept(rows: DataFrame, bucket_rows: int) -> DataFrame:
    tasks = max(1, -(-rows.count() // bucket_rows))
    placed = radix_buckets(rows, bucket_rows).withColumn("task", F.pmod(F.xxhash64("bucket", "part"), F.lit(tasks)))
    counted = placed.groupBy("task").applyInPandas(_count, "canon binary, n_ids bigint, n_rows bigint, keep_id string")
    return counted.groupBy("canon").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_rows").alias("n_rows"), F.min("keep_id").alias("keep_id"))


def collapse(records: DataFrame, key: str = "id", source: str = "source", title: str = "title", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(keep_id, n_ids, n_rows)``: one row per distinct record, with how many ids and rows it came from.

    Equal rows of an id are merged on the map side before anything is moved; buckets are counted in
    tries; the parts of a value held by very many ids are summed. A row without id or source is no
    record; an id whose rows differ in content counts for each of them.
    """
    return _kept(_rows(records, key, source, title), bucket_rows).select("keep_id", "n_ids", "n_rows")


def copies(records: DataFrame, key: str = "id", source: str = "source", title: str = "title", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(keep_id, copy_id)``: the least id of each record with each other id of it, in the sense of ``collapse``."""
    rows = _rows(records, key, source, title)
    kept = _kept(rows, bucket_rows).where("n_ids > 1").select("canon", "keep_id")
    return salted_join(rows, kept, ["canon"], ["id"]).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id")).distinct()
