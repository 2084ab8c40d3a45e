"""Chats as tables: answers from a knowledge base, general replies, and few-shot answers, one plan for all conversations or queries.

No operator here runs a job before its plan is returned. A conversation's messages meet in one prompt, so they are as bounded as prompts are.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from . import budget as B
from . import vector as V
from .many import fused_many, search_many

#: The answer where nothing is found, unless the caller has its own.
CANNOT_ANSWER = "Sorry, I cannot answer your question as I could not find any relevant information in the knowledge base."
FIELDS = "thought string, answer string, challenge_verification string, sources array<string>"
#: What an answer must look like, for models that take a schema.
SCHEMA = {
    "type": "object", "required": ["thought", "answer", "challenge_verification", "sources"],
    "properties": {"thought": {"type": "string"}, "answer": {"type": "string"}, "challenge_verification": {"type": "string"}, "sources": {"type": "array", "items": {"type": "string"}}},
}
REFORMULATE = "Reformulate the follow-up as a question that stands alone."
SUMMARISE = "Summarise these messages, the oldest first."
ANSWER = "Answer from the context, as JSON."


class JsonEcho:
    """Stand-in for a model: the prompt's last line; asked for JSON, that as the answer, with the addresses in the prompt as sources."""

    def generate(self, prompts: list[str], schema: dict | None = None) -> list[str]:
        answers = models.LastLine().generate(prompts)
        if schema is None:
            return answers
        return [json.dumps({"thought": "", "answer": a, "challenge_verification": "", "sources": [x.split("</url>")[0] for x in p.split("<url>")[1:]]}) for p, a in zip(prompts, answers, strict=True)]


def _lines(rows: DataFrame, conversation: str, into: str) -> DataFrame:
    """A conversation's messages (turn, role, text) as lines in order."""
    return B.concatenated(rows.withColumn("_line", F.concat_ws(": ", "role", F.coalesce("text", F.lit("")))), conversation, "turn", "_line", "\n").withColumnRenamed("joined", into)


def retrieval_queries(messages: DataFrame, model: models.LanguageModel, embedder: models.Embedder, conversation: str = "conv_id") -> DataFrame:
    """Each conversation's ``question`` (its last message), the ``query`` that stands for it with its vector (``embedding``), and what making it cost (``prompt_tokens``,
    ``completion_tokens``): the question itself without a history, else what the model makes of both. messages: conversation, turn, role, text; rows of a null conversation are left out."""
    messages = messages.filter(F.col(conversation).isNotNull())
    last = B.last_message(messages.withColumn("text", F.coalesce("text", F.lit(""))), conversation, "turn", "text")
    ends = messages.groupBy(conversation).agg(F.max("turn").alias("_end"))
    told = _lines(messages.join(ends, conversation).filter(F.col("turn") < F.col("_end")), conversation, "_told")
    asked = last.join(told, conversation, "left").withColumn("_prompt", F.when(F.col("_told").isNotNull(), F.concat_ws("\n", F.lit(REFORMULATE), "_told", F.lit("Follow-up:"), "question")))
    made = models.generated(asked, "_prompt", "_reply", model)
    tokens = lambda c: F.when(F.col("_prompt").isNotNull(), B.word_tokens(F.col(c)).cast("long")).otherwise(0)
    found = made.select(conversation, "question", F.coalesce("_reply", "question").alias("query"), tokens("_prompt").alias("prompt_tokens"), tokens("_reply").alias("completion_tokens"))
    return models.embedded(found, "query", "embedding", embedder)


def histories(messages: DataFrame, model: models.LanguageModel, budget: int, summary: int, conversation: str = "conv_id") -> DataFrame:
    """``history``: the lines that go with each conversation's question, and the cost of making them. If not all fit the budget, the newest that do with room
    for a summary, then the model's summary of the others."""
    costed = messages.withColumn("_n", B.word_tokens(F.col("text")))
    kept = B.truncate_history(costed, conversation, "turn", "_n", budget, summary)
    oldest = kept.groupBy(conversation).agg(F.min("turn").alias("_from"))
    ends = messages.groupBy(conversation).agg(F.max("turn").alias("_end"))
    gone = messages.join(ends, conversation).join(oldest, conversation, "left").filter((F.col("turn") < F.col("_end")) & (F.col("_from").isNull() | (F.col("turn") < F.col("_from"))))
    told = _lines(gone, conversation, "_gone").withColumn("_prompt", F.concat_ws("\n", F.lit(SUMMARISE), "_gone"))
    summed = models.generated(told, "_prompt", "_summary", model).select(
        conversation, F.concat(F.lit("Summary: "), "_summary").alias("_summary"), B.word_tokens(F.col("_prompt")).cast("long").alias("prompt_tokens"), B.word_tokens(F.col("_summary")).cast("long").alias("completion_tokens")
    )
    both = _lines(kept, conversation, "_kept").join(summed, conversation, "full")
    history = F.concat_ws("\n", "_kept", "_summary")
    return both.select(conversation, history.alias("history"), F.col("_summary").isNotNull().alias("summarised"), F.coalesce("prompt_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("completion_tokens", F.lit(0)).alias("completion_tokens"))


def answered(
    messages: DataFrame, asked: DataFrame, chunks: DataFrame, model: models.LanguageModel, images: DataFrame | None = None, image_queries: DataFrame | None = None, collections: DataFrame | None = None,
    k: int = 30, threshold: float = 1.2, image_k: int = 20, image_threshold: float = 0.8, context: int = 20_000, history: int = 4_096, summary: int = 256, cannot_answer: str = CANNOT_ANSWER, conversation: str = "conv_id",
) -> DataFrame:
    """The log row of every conversation's answer: question, query, answer, thought, sources, context_ids (best first), n_context, history, summarised, prompt_tokens, completion_tokens.

    messages: conversation, turn, role, text; the last one is the question. asked: ``retrieval_queries`` of these, which the plan reads several times, so that it is better
    written to a table where the model is dear. chunks and images: vec_id, content, title, url, page, n_token, embedding and, with ``collections``
    (conversation, collection), a collection, outside of which a conversation finds nothing. image_queries: conversation and the vector (embedding) of an image that it asks with.

    The texts nearest to the question as it stands alone, and the images nearest to its image, are fused, packed into the context's budget and rendered; the
    history goes with them. Costs are those of all calls of the model for the conversation. Without hits the answer is fixed, costs nothing and
    has no sources. A reply that is no JSON with an answer is an error. A conversation of a null id is left out; an empty table gives no rows.
    """
    messages = messages.filter(F.col(conversation).isNotNull())
    scope = "collection" if collections is not None else None
    within = lambda q: q if collections is None else q.join(collections.select(conversation, "collection"), conversation)
    search = {"query_id": conversation, "collection": scope}
    found = search_many(within(asked.select(conversation, "embedding")), chunks, k, threshold, **search)
    columns = ["vec_id", "content", "title", "url", "page", "n_token"]
    texts = chunks.select(*columns)
    if image_queries is not None:
        pictures = chunks if images is None else images
        found = fused_many(found, search_many(within(image_queries), pictures, image_k, image_threshold, **search), conversation)
        if images is not None:  # a row that both tables hold is the text's
            texts = V.first_by_key(texts.withColumn("_list", F.lit(0)).unionByName(images.select(*columns).withColumn("_list", F.lit(1))), ["vec_id"], [F.asc("_list"), *[F.asc(c) for c in columns[1:]]]).drop("_list")
    hits = found.join(texts, "vec_id")
    totalled = B.running_tokens(hits, [conversation], [F.asc("rank")], "n_token")
    block = T.context_chunk(F.col("title"), F.col("url"), F.col("page"), F.col("page"), T.context_content(F.col("content"), F.col("title")))
    # What is found but not packed still counts as found: the model is asked without a context.
    parts = F.array_sort(F.array_agg(F.when(F.col("running") < context, F.struct("rank", "vec_id", block.alias("block")))))
    contexts = totalled.groupBy(conversation).agg(parts.alias("_parts"), F.lit(True).alias("_hit"))
    told = histories(messages, model, history, summary, conversation).select(conversation, "history", "summarised", F.col("prompt_tokens").alias("_p2"), F.col("completion_tokens").alias("_c2"))
    ready = asked
    if image_queries is not None:
        ready = ready.join(image_queries.filter("embedding IS NOT NULL").select(conversation, F.lit(T.USER_IMAGE).alias("_image")).distinct(), conversation, "left")
    ready = ready.join(contexts, conversation, "left").join(told, conversation, "left")
    body = F.nullif(F.array_join(F.transform("_parts", lambda x: x["block"]), "\n\n"), F.lit(""))
    image = F.col("_image") if image_queries is not None else F.lit(None).cast("string")
    prompt = F.concat_ws("\n\n", F.lit(ANSWER), image, body, F.nullif("history", F.lit("")), "question")
    made = models.generated(ready.withColumn("_prompt", F.when(F.col("_hit"), prompt)), "_prompt", "_reply", model, schema=SCHEMA)
    made = made.withColumn("_data", F.from_json(T.fenced_json(T.without_thought(F.col("_reply"))), FIELDS))
    none = F.raise_error(F.lit("the model's reply is no JSON with an answer")).cast("string")
    when = lambda value, other: F.when(F.col("_hit"), value).otherwise(other)
    total = lambda a, b, c: when(F.col(a) + F.coalesce(b, F.lit(0)) + B.word_tokens(F.col(c)), F.lit(0)).cast("long")
    return made.select(
        conversation, "question", "query", when(F.coalesce("_data.answer", none), F.lit(cannot_answer)).alias("answer"), F.col("_data.thought").alias("thought"),
        when(F.coalesce("_data.sources", F.array().cast("array<string>")), F.array().cast("array<string>")).alias("sources"),
        F.coalesce(F.transform("_parts", lambda x: x["vec_id"]), F.array().cast("array<bigint>")).alias("context_ids"), F.greatest(F.size("_parts"), F.lit(0)).cast("long").alias("n_context"),
        F.coalesce("history", F.lit("")).alias("history"), F.coalesce("summarised", F.lit(False)).alias("summarised"), total("prompt_tokens", "_p2", "_prompt").alias("prompt_tokens"), total("completion_tokens", "_c2", "_reply").alias("completion_tokens"),
    )


def replied(messages: DataFrame, conversation: str, model: models.LanguageModel) -> DataFrame:
    """The model's reply to every conversation's last message: the log row of a general chat."""
    asked = B.last_message(messages, conversation, "turn", "text")
    return models.generated(asked, "question", "answer", model)


def prompted(queries: DataFrame, found: DataFrame, shots: DataFrame, instruction: str, model: models.LanguageModel, label: str = "Answer", tagged: bool = False) -> DataFrame:
    """query_id, answer and examples (ids, best first): the model's answer to each query under the instruction and the examples found for it. queries: query_id, query.
    found: query_id, vec_id, rank. shots: vec_id, question, answer. A query without examples is asked without any."""
    block = T.few_shot_example({"Question": F.col("question"), label: F.col("answer")}, tagged)
    parts = F.array_sort(F.array_agg(F.struct("rank", "vec_id", block.alias("block"))))
    each = found.select("query_id", "vec_id", "rank").join(shots.select("vec_id", "question", "answer"), "vec_id").groupBy("query_id").agg(parts.alias("_parts"))
    ready = queries.select("query_id", "query").join(each, "query_id", "left")
    prompt = F.concat_ws("\n\n", F.lit(instruction), F.array_join(F.transform("_parts", lambda x: x["block"]), "\n\n"), F.concat(F.lit(f"{label}: "), F.coalesce("query", F.lit(""))))
    made = models.generated(ready.withColumn("_prompt", prompt), "_prompt", "_reply", model)
    return made.select("query_id", T.strip_label(F.trim("_reply"), label).alias("answer"), F.coalesce(F.transform("_parts", lambda x: x["vec_id"]), F.array().cast("array<bigint>")).alias("examples"))


def few_shot(
    queries: DataFrame, store: DataFrame, instruction: str, embedder: models.Embedder, model: models.LanguageModel, n: int = 5, label: str = "Answer", tagged: bool = False,
    added: DataFrame | None = None, removed: DataFrame | None = None, collection: str | None = None,
) -> DataFrame:
    """For every query (query_id, query) an answer in the manner of the ``n`` examples (vec_id, question, answer, embedding) nearest to it, and their ids, best first.

    Examples without a question or an answer take no part, nor do those that a query ``excluded``. With ``added`` rows or ``removed`` ids it is a preview, and nothing is stored:
    of equal questions an added row wins, else the smaller id. A query without words finds none."""
    rows = store
    if added is not None or removed is not None:
        left = store if removed is None else store.join(removed.select("vec_id"), "vec_id", "left_anti")
        both = left.withColumn("_source", F.lit(1))
        if added is not None:
            both = both.unionByName(added.withColumn("_source", F.lit(0)))
        rows = V.first_by_key(both, ["question"], [F.asc("_source"), F.asc("vec_id")]).drop("_source")
    rows = rows.filter("question IS NOT NULL AND answer IS NOT NULL")
    found = search_many(models.embedded(queries, "query", "embedding", embedder), rows, n, collection=collection)
    return prompted(queries, found, rows, instruction, model, label, tagged)
