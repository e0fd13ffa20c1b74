"""Profiles, audits, agreement and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of a 95 % interval.
Z = 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The Wilson interval of ``hits`` in ``n``, within 0 and 1, four decimals; null for n = 0."""
    p = F.try_divide(hits, n)
    base = 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / base, z / base * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.round(F.greatest(F.lit(0.0), middle - half), 4), F.round(F.least(F.lit(1.0), middle + half), 4)


def rates(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    """``(by, n, n_hit, rate, low, high)``: how often ``hit`` is true per group, null groups as ``unknown``, with the Wilson interval."""
    g = rows.groupBy(F.coalesce(F.col(by), F.lit("unknown")).alias(by)).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_hit"))
    low, high = wilson(F.col("n_hit"), F.col("n"))
    return g.select(by, "n", "n_hit", F.round(F.col("n_hit") / F.col("n"), 4).alias("rate"), low.alias("low"), high.alias("high"))


def confusion(pairs: DataFrame, domain: DataFrame) -> DataFrame:
    """``(a, b, n)``: all combinations of the ``label``s in ``domain``, counted in ``pairs`` with 0 where none.

    ``domain`` is a closed set of labels; the combinations are its own, not the rows'.
    """
    counted = pairs.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    labels = domain.select("label").distinct()
    grid = labels.select(F.col("label").alias("a")).join(F.broadcast(labels.agg(F.collect_set("label").alias("bs")))).select("a", F.explode("bs").alias("b"))
    return grid.join(counted, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def kappa(pairs: DataFrame) -> DataFrame:
    """One row ``(n, agreement, kappa)`` of label pairs ``(a, b)``: Cohen's kappa, 1 or 0 where chance agreement is complete, null without pairs."""
    p = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    cell = p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    marginal = cell.select(F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("n").alias("x"), F.lit(0).cast("long").alias("y")), F.struct(F.col("b").alias("label"), F.lit(0).cast("long").alias("x"), F.col("n").alias("y")))).alias("m")).groupBy("m.label").agg(F.sum("m.x").alias("x"), F.sum("m.y").alias("y"))
    chance = marginal.agg(F.sum(F.col("x") * F.col("y")).alias("e"))
    total = cell.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    k = F.when(pe >= 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return total.crossJoin(F.broadcast(chance)).select("n", F.round(po, 4).alias("agreement"), F.round(k, 4).alias("kappa"))


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of the latest ``version`` per key (an upsert read back), one per key, null versions first; null keys are dropped."""
    columns = [c for c in rows.columns if c != key]
    kept = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(version, *(c for c in columns if c != version))).alias("r"))
    return kept.select(key, *(f"r.{c}" for c in columns))


def first_written(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The earliest row per key: what an append-only ledger with first-write-wins ids holds; ties by the other columns."""
    columns = [c for c in rows.columns if c != key]
    kept = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(version, *(c for c in columns if c != version))).alias("r"))
    return kept.select(key, *(f"r.{c}" for c in columns))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """One row ``(n_rows, n_unique, ratio, n_repeated_keys)``: emitted and unique keys."""
    g = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.round(F.try_divide(F.count(F.lit(1)), F.sum("n")), 4).alias("ratio"), F.count_if(F.col("n") > 1).alias("n_repeated_keys"))


def issues(rows: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """``(table_name, record_id, issue)``: one row per record and rule that is not satisfied; a rule is a boolean column, null fails."""
    found = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.lit(table).alias("table_name"), F.coalesce(F.col(key), F.lit("unknown")).alias("record_id"), F.explode(found).alias("issue")).distinct()


def drift(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(side, …columns)``: rows only one of two tables has, as a multiset difference; empty if a regenerated table equals the stored one."""
    c = fresh.columns
    return stored.select(c).exceptAll(fresh).select(F.lit("stored").alias("side"), *c).unionByName(fresh.exceptAll(stored.select(c)).select(F.lit("fresh").alias("side"), *c))


def half_life_score(age_days: Column, half_life: Column) -> Column:
    """0.5 ^ (age / half-life), six decimals; a negative age counts as none."""
    return F.round(F.pow(F.lit(0.5), F.greatest(F.lit(0), age_days) / half_life), 6)


def metric_deltas(metrics: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """``metrics`` (one row per ``key``) with ``<value>_delta`` against the row before in key order; null for the first."""
    order = Window.partitionBy(F.lit(0)).orderBy(key)
    return metrics.select(key, *values, *((F.col(v) - F.lag(v).over(order)).alias(f"{v}_delta") for v in values))


def top_per_group(counts: DataFrame, group: str, item: str, n: str, k: int) -> DataFrame:
    """The ``k`` most frequent items of each group with their rank, ties by item."""
    order = Window.partitionBy(group).orderBy(F.desc(n), item)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
