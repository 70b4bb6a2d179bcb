"""Readers of corpora, reviews, scans and files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TSV = "level int, page int, block int, par int, line int, word int, left double, top double, width double, height double, conf double, text string"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, key: str, partition: str | None = None) -> DataFrame:
    """JSON lines of a known schema. Blank lines are skipped; malformed ones, repeated keys and mixed partitions of a file are errors.

    The checks are one aggregate job; the frame that comes back is lazy.
    """
    fields = (schema if isinstance(schema, StructType) else StructType.fromDDL(schema)).add("_bad", "string")
    rows = spark.read.schema(fields).option("columnNameOfCorruptRecord", "_bad").json(path)
    per_key = rows.groupBy(key).agg(F.count("*").alias("n"), F.count("_bad").alias("bad"))
    found = per_key.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("again")).first()
    if found["bad"]:
        raise ValueError(f"{found['bad']} malformed lines in {path}")
    if found["again"]:
        raise ValueError(f"{found['again']} repeated keys in {path}")
    if partition:
        mixed = rows.select(partition, F.input_file_name().alias("f")).groupBy("f").agg(F.countDistinct(partition).alias("n")).where("n > 1").limit(1).count()
        if mixed:
            raise ValueError(f"a file of {path} mixes values of {partition}")
    return rows.drop("_bad")


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """A review sheet: header, quoted cells over several lines, an optional byte-order mark."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    return rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])


def parse_review_markdown(texts: DataFrame) -> DataFrame:
    """review_id, decision, notes of a Markdown review (column ``value``): blocks between --- lines; exactly one box is ticked, else the decision is null."""
    block = texts.select(F.explode(F.split("value", r"(^|\n)---+[ \t]*(\n|$)")).alias("b")).where(F.trim("b") != "")
    ticked = F.regexp_extract_all("b", F.lit(r"(?m)^[-*] \[[xX]\] *([a-z_]+)"), F.lit(1))
    rows = block.select(F.regexp_extract("b", r"(?m)^#+ *([A-Za-z0-9_-]+)", 1).alias("review_id"), F.when(F.size(ticked) == 1, ticked[0]).alias("decision"), F.regexp_replace(F.regexp_extract("b", r"(?s)Notes:(.*)", 1), r"^\s+|\s+$", "").alias("notes"))
    return rows.where("review_id <> ''")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """variant and the fields of each of its questions, from multi-line JSON reports {"variant": .., "per_query": [..]}."""
    return spark.read.option("multiLine", True).json(path).select("variant", F.explode("per_query").alias("q")).select("variant", "q.*")


def read_tsv_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a scan's table: tabs separate, quotes are signs like any other."""
    return spark.read.schema(StructType.fromDDL(TSV)).option("sep", "\t").option("quote", "").option("header", True).csv(path)


def ocr_lines(words: DataFrame, scale: float = 1.0, least: float = 0.0, width: float | None = None, height: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines of recognised words: text in word order, the union of the boxes in points, mean confidence from 0 to 1.

    Words of level 5 with a text and a confidence of ``least`` or more; boxes are clamped to the page if its size is given.
    """
    kept = words.where((F.col("level") == 5) & (F.col("conf") >= least) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    top = lambda c, m: F.least(F.greatest(c, F.lit(0.0)), F.lit(m)) if m is not None else F.greatest(c, F.lit(0.0))
    x0, y0 = F.col("left") / scale, F.col("top") / scale
    x1, y1 = (F.col("left") + F.col("width")) / scale, (F.col("top") + F.col("height")) / scale
    lines = kept.groupBy(*by, "page", "block", "par", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"),
        F.min(top(x0, width)).alias("x0"), F.min(top(y0, height)).alias("y0"), F.max(top(x1, width)).alias("x1"), F.max(top(y1, height)).alias("y1"),
        F.round(F.avg("conf") / 100, 6).alias("confidence"),
    )
    return lines


def ocr_blocks(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of lines: text joined by newlines in reading order, the union of the boxes."""
    return lines.groupBy(*by, "page", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("par", "line", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.round(F.avg("confidence"), 6).alias("confidence"),
    )


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, sha256 of files, as any store that Spark reads has them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_release(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status): ok, changed, missing or unlisted; both have name and sha256."""
    both = manifest.select("name", F.col("sha256").alias("want")).join(files.select("name", F.col("sha256").alias("have")), "name", "full")
    return both.select("name", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("want") == F.col("have"), "ok").otherwise("changed").alias("status"))


def parsed_pages(files: DataFrame, parser: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Pages of binary files: ``parser`` is the plug point of a PDF or OCR engine and gives a dict a page; path is added.

    Files are parsed where they are read. A page without text stays, with method "none".
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content in zip(part["path"], part["content"]):
                for page in parser(content):
                    page = {"method": "native" if (page.get("text") or "").strip() else "none"} | page
                    out.append({"path": path, **{n: page.get(n) for n in names if n != "path"}})
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def flat_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_no, text, font_size, flags of raw pages: blocks struct<type int, lines array<struct<text, size double, flags array<int>>>>.

    Blocks that aren't text, blank lines and blocks without lines go; the largest size and the distinct flags stay.
    """
    b = pages.select("page_id", F.posexplode("blocks").alias("block_no", "b")).where("b.type = 0")
    b = b.withColumn("lines", F.filter("b.lines", lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")).where("size(lines) > 0")
    return b.select("page_id", "block_no", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"), F.array_max(F.transform("lines", lambda x: x["size"])).alias("font_size"), F.array_sort(F.array_distinct(F.flatten(F.transform("lines", lambda x: x["flags"])))).alias("flags"))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that no finished batch holds; a key that two batches hold is an error."""
    again = done.groupBy(key).count().where("count > 1").limit(1).count()
    if again:
        raise ValueError(f"{key} is in more than one batch")
    return work.join(done.select(key), key, "left_anti")
