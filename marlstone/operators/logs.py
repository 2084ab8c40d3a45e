"""Log rows: pruning, sampling, lifting and masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PII, located, masked


def pruned(logs: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """The next snapshot without what is older than the cutoff."""
    return logs.filter(F.col(ts) >= cutoff)


def pruned_count(logs: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    return logs.agg(F.count_if(F.col(ts) < cutoff).alias("deleted"), F.lit(0).cast("long").alias("failures"))


def sampled(logs: DataFrame, key: str, percent: float) -> DataFrame:
    """A share of the rows by the first 16 bits of the key's MD5: the same rows on every run."""
    return logs.filter(F.substring(F.md5(F.col(key).cast("string")), 1, 4) < f"{round(percent * 655.36):04x}")


def lifted(logs: DataFrame, props: str, schema: str) -> DataFrame:
    """The JSON payload's fields beside the row's own."""
    parsed = logs.withColumn("_data", F.from_json(props, schema))
    return parsed.select(*[c for c in logs.columns if c != props], "_data.*")


def masked_logs(logs: DataFrame, columns: list[str], detectors: dict[str, str] = PII) -> DataFrame:
    """Flag-and-mask: detected items masked in the named columns, the history dropped."""
    return logs.select(*[masked(F.col(c), detectors).alias(c) if c in columns else F.col(c) for c in logs.columns if c != "history"], F.lit(None).cast("string").alias("history"))


def flagged_logs(logs: DataFrame, columns: list[str], detectors: dict[str, str] = PII) -> DataFrame:
    """Flag only: texts and history as they were, and what was detected in each named column beside it as ``<column>_pii``."""
    items = lambda c: F.flatten(F.array(*[located(F.col(c), name, p) for name, p in detectors.items()]))
    return logs.select("*", *[items(c).alias(f"{c}_pii") for c in columns])
