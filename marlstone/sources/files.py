"""Listings, file contents and batch-job files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.office import file_text
from ..functions.text import first_url, main_text, reader


def listing(spark: SparkSession, path: str) -> DataFrame:
    """All files under a folder: id, name, web_url, modified_ms, n_bytes and the reader their type has (null for none)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return rows.select(F.sha2("path", 256).alias("id"), name.alias("name"), F.col("path").alias("web_url"), F.unix_millis("modificationTime").alias("modified_ms"), F.col("length").alias("n_bytes"), reader(name).alias("reader"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """name and content of text, Markdown and HTML files, one row a file; HTML as its visible text; other types are left out."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("name"), "value")
    html = F.lower("name").endswith("html")
    return rows.filter(reader(F.col("name")).isin("text")).select("name", F.when(html, main_text(F.col("value"))).otherwise(F.col("value")).alias("content"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """name, path, content and note of text files of all kinds (txt, md, html, docx, rtf, and doc where it is rich text), a row a file but for empty ones; what cannot be read has an empty content and a note that says why.

    Files are parsed in the tasks that read them, one at a time; a file is whole in one of them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, p, data in zip(b["name"], b["path"], b["content"], strict=True):
                text, note = file_text(n, data)
                yield pd.DataFrame({"name": [n], "path": [p], "content": [text], "note": [note]})

    kept = rows.filter(reader(name) == "text").select(name.alias("name"), "path", "content")
    return kept.mapInPandas(run, "name string, path string, content string, note string")


def links(spark: SparkSession, path: str) -> DataFrame:
    """name and address of web links (``.url`` files)."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("name"), "value")
    return rows.filter(reader(F.col("name")) == "link").select("name", first_url(F.col("value")).alias("url"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """name (characters that file systems refuse replaced) and content of images."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return rows.filter(reader(name) == "image").select(F.regexp_replace(name, r'[<>:"/\\|?*]', "_").alias("name"), "content")


def write_batch(rows: DataFrame, key: str, prompt: str, path: str) -> None:
    """A batch job's input: JSON lines of custom_id and body."""
    rows.select(F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), F.struct(F.col(prompt).alias("prompt")).alias("body")))).write.mode("overwrite").text(path)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """A batch job's results by custom_id; lines that are no JSON, and those whose status, if they have one, is no success (300 or over), are skipped."""
    parsed = spark.read.text(path).select(F.from_json("value", "custom_id string, response string, status int", {"mode": "PERMISSIVE"}).alias("x"))
    return parsed.filter(F.col("x.custom_id").isNotNull() & (F.coalesce("x.status", F.lit(200)) < 300)).select("x.custom_id", "x.response")


def aligned(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results in the requests' rows, whatever their order; an empty response for a missing one."""
    found = results.select(F.col("custom_id").alias("_id"), "response")
    return requests.join(found, F.col(key).cast("string") == F.col("_id"), "left").drop("_id").withColumn("response", F.coalesce("response", F.lit("")))
