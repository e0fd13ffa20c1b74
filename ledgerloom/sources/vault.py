"""Vault folders, JSON lines and exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Files of a vault that are no notes.
RESERVED = ("index.md", "log.md")


def read_notes(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``(path, name, head, body)`` of the Markdown notes below a folder, reserved files left out.

    ``head`` is the ``---`` block without its marks, null where there is none; ``body`` is the rest.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    t = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "value").where(~F.col("name").isin(*RESERVED))
    block = r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)"
    head = F.regexp_extract("value", block, 1)
    return t.select("path", "name", F.nullif(head, F.lit("")).alias("head"), F.when(F.col("value").rlike(block), F.regexp_replace("value", block, "")).otherwise(F.col("value")).alias("body"))


def read_ledger(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSON-lines ledger; blank and broken lines and ``_comment`` headers are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r"), F.get_json_object("value", "$._comment").alias("c"))
    return parsed.where("c IS NULL AND r IS NOT NULL").select("r.*")


def append_new(ledger: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key the ledger lacks, the first of a repeated key by the other columns: what an idempotent append adds."""
    rest = [c for c in rows.columns if c != key]
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, *(f"r.{c}" for c in rest))
    return new.join(ledger.select(key).distinct(), key, "left_anti")


def union_of_kinds(*tables: DataFrame) -> DataFrame:
    """All rows with the union of all columns; columns a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by ``;``."""
    flat = [F.array_join(c, ";").alias(c) if kind.startswith("array<") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """``(item)``: the lines of an input list without outer blanks; empty ones and those that begin with ``#`` are left out."""
    return spark.read.text(path).select(F.btrim("value", F.lit(" \t\r")).alias("item")).where("item <> '' AND NOT startswith(item, '#')")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; a reader sees the old rows or the new ones, as Spark moves the files into place when all are written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def html_facts(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``(key, candidates, author, journal, year, doi)`` of HTML pages; a null page names its own address only, a null address gives no row."""
    from ledgerloom.sources.html import bibliography, candidate_urls

    kind = pages.schema[key].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            facts = [bibliography(h or "") for h in pdf[html]]
            out = {key: pdf[key], "candidates": [candidate_urls(h or "", u) for h, u in zip(pdf[html], pdf[url])]}
            out |= {f: [x[f] for x in facts] for f in ("author", "journal", "doi")}
            yield pd.DataFrame(out | {"year": pd.array([x["year"] for x in facts], dtype="Int32")})

    return pages.where(F.col(url).isNotNull()).select(key, url, html).mapInPandas(run, f"{key} {kind}, candidates array<string>, author string, journal string, doi string, year int")


def html_text(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``(key, text)`` of HTML pages: text outside scripts, styles and navigation, blocks on lines of their own; null gives an empty text."""
    from ledgerloom.sources.html import to_text

    kind = pages.schema[key].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "text": [to_text(x or "") for x in pdf[html]]})

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, text string")
