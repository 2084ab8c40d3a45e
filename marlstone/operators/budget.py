"""Token budgets over ranked or dated rows, and ordered concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running


def word_tokens(text: Column) -> Column:
    """Offline stand-in for a tokenizer: the number of space-separated words."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim(text), " +")))


#: Fixed value: what an image costs in a context.
IMAGE_TOKENS = 1000


def chunk_tokens(kind: Column, text_tokens: Column) -> Column:
    """What a chunk costs in a context: an image's fixed number, else its text's tokens (none for a null text)."""
    return F.when(kind == "image", IMAGE_TOKENS).otherwise(F.coalesce(text_tokens, F.lit(0)))


def pack_context(rows: DataFrame, group: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """Ranked rows while the running total (``running``) stays under ``budget``; the first overflow ends the list. A missing count is 0. A group
    may be of any size; rows should be narrow, see ``running``."""
    return running(rows, group, order, running=F.col(tokens)).filter(F.col("running") < budget)


def pack_hits(rows: DataFrame, group: list[str], order: list[Column], tokens: str, budget: int) -> DataFrame:
    """``pack_context`` for groups of a set size, such as the hits of a search, each in one task."""
    return running_tokens(rows, group, order, tokens).filter(F.col("running") < budget)


def running_tokens(rows: DataFrame, group: list[str], order: list[Column], tokens: str) -> DataFrame:
    """``running``: the total up to each row of a group of a set size."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(F.coalesce(F.col(tokens), F.lit(0))).over(w))


def truncate_history(rows: DataFrame, conversation: str, turn: str, tokens: str, budget: int, summary: int, per_message: int = 3, priming: int = 3) -> DataFrame:
    """Of each conversation the messages before its last, the question, that go with it: all of them if they cost no more than ``budget`` less the
    question's own cost, else the newest that cost no more than that less ``summary``, with ``summarised`` true.

    Messages cost their tokens and ``per_message`` each, and every list of them ``priming``."""
    whole = Window.partitionBy(conversation)
    newest = Window.partitionBy(conversation).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(turn).over(whole)
    own = F.col(tokens) + per_message
    is_question = F.col(turn) == F.col("_last")
    marked = rows.withColumn("_last", last)
    marked = marked.withColumn("_room", F.lit(budget) - (F.max(F.when(is_question, own)).over(whole) + priming))
    marked = marked.withColumn("cost", F.sum(F.when(is_question, 0).otherwise(own)).over(newest) + priming).withColumn("_all", F.sum(F.when(is_question, 0).otherwise(own)).over(whole) + priming)
    over = F.col("_all") > F.col("_room")
    kept = marked.withColumn("summarised", over).filter(~is_question & (~over | (F.col("cost") <= F.col("_room") - summary)))
    return kept.drop("_last", "_room", "_all")


def message_cost(rows: DataFrame, conversation: str, tokens: str, per_message: int = 3, priming: int = 3) -> DataFrame:
    return rows.groupBy(conversation).agg((F.sum(F.col(tokens) + per_message) + priming).alias("n_tokens"))


def last_message(rows: DataFrame, conversation: str, turn: str, value: str) -> DataFrame:
    """Each conversation's last message, and how many come before it."""
    return rows.groupBy(conversation).agg(F.max_by(value, turn).alias("question"), (F.count("*") - 1).alias("n_history"))


def concatenated(rows: DataFrame, group: str, order: str, value: str, separator: str) -> DataFrame:
    """A group's values in order, joined; for groups of bounded size, such as a packed context or a streamed answer."""
    parts = F.array_sort(F.array_agg(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["v"]), separator).alias("joined"))
