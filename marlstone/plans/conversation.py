"""Budget, prompt and answer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget as B
from ..operators.prefix import numbered
from ..session import shaped, table


def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", B.word_tokens(F.col("text")).alias("n_token"))
    return B.pack_context(rows, ["source"], [F.asc("doc_id")], "n_token", 1000)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("n", B.word_tokens(F.col("text")))


def history_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.truncate_history(_turns(spark, sf_dir), "conv_id", "turn", "n", 120, 30).select("conv_id", "turn", "role", "n", "cost", "summarised")


def message_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.message_cost(_turns(spark, sf_dir), "conv_id", "n")


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chunk costs in a context, where every fourth stands for an image."""
    rows = shaped(spark, sf_dir, "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'image' WHEN doc_id % 4 = 2 THEN 'text' END AS kind, text FROM {documents}", "documents")
    return rows.select("doc_id", B.chunk_tokens(F.col("kind"), B.word_tokens(F.col("text"))).alias("n_token"))


def last_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.last_message(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def concat_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.concatenated(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", "\n\n")


def rank_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return numbered(rows, ["source"], [F.desc("n_chars"), F.asc("doc_id")], "rank").withColumn("rank", F.col("rank").cast("int"))


def context_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, "SELECT page_id, CASE WHEN page_id % 3 != 0 THEN url END AS u, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS INT) END AS p, CASE WHEN page_id % 5 = 4 THEN concat('data:image/png;base64,', md5(html)) ELSE html END AS c FROM {pages}", "pages")
    return rows.select("page_id", T.context_chunk(T.title(F.col("u")), F.col("u"), F.col("p"), F.col("p") + 1, T.context_content(F.col("c"), T.title(F.col("u")))).alias("chunk"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(
        spark, sf_dir,
        """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('<think>', event_type, '</think> ', props) WHEN 1 THEN concat(event_type, '</think>', props)
           WHEN 2 THEN concat('```json', props, '```') ELSE concat('Answer: ', event_type) END AS answer FROM {events}""", "events",
    )


def think_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("event_id", T.thought(F.col("answer")).alias("thought"), T.without_thought(F.col("answer")).alias("rest"))


def json_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("event_id", T.fenced_json(F.col("answer")).alias("body"))


def answer_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("event_id", T.strip_label(F.col("answer"), "Answer").alias("answer"))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few-shot prompt for each conversation: its turns as examples, in order, under an instruction."""
    rows = table(spark, sf_dir, "conversations").withColumn("block", F.concat(F.lit("## Example\n"), F.col("role"), F.lit(": "), F.col("text")))
    joined = B.concatenated(rows, "conv_id", "turn", "block", "\n\n")
    return joined.select("conv_id", F.concat_ws("\n\n", F.lit("Answer in the manner of the examples."), F.col("joined"), F.lit("Answer:")).alias("prompt"))


def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exp of the sum of a user's log probabilities; none if they add up to zero."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(-F.abs("value") / 10000).alias("s"))
    return rows.select("user_id", F.round(F.exp(F.nullif(F.col("s"), F.lit(0.0))), 9).alias("confidence"))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("tokens"))


_N = "(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), ' +')) END)::INTEGER"
_ANSWERS = """a AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('<think>', event_type, '</think> ', props) WHEN 1 THEN concat('<think>', event_type, '</think>', props)
  WHEN 2 THEN concat('```json', props, '```') ELSE concat('Answer: ', event_type) END AS whole, CASE event_id % 4 WHEN 0 THEN concat('<think>', event_type, '</think> ', props) WHEN 1 THEN concat(event_type, '</think>', props)
  WHEN 2 THEN concat('```json', props, '```') ELSE concat('Answer: ', event_type) END AS answer FROM events)"""

QUERIES = {f.__name__: f for f in (context_pack, history_truncate, message_tokens, chunk_tokens, last_question, concat_chunks, rank_assign, context_render, think_extract, json_fence, answer_strip, prompt_render, confidence, usage_rollup)}
ORACLE_SQL = {
    "context_pack": f"SELECT source, doc_id, n_token, running FROM (SELECT source, doc_id, n_token, sum(n_token) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM (SELECT source, doc_id, {_N} AS n_token FROM documents)) WHERE running < 1000",
    "history_truncate": f"""WITH m AS (SELECT conv_id, turn, role, n, turn = max(turn) OVER (PARTITION BY conv_id) AS asks FROM (SELECT *, {_N} AS n FROM conversations)),
      q AS (SELECT conv_id, 120 - max(n + 3 + 3) AS room FROM m WHERE asks GROUP BY conv_id), h AS (SELECT conv_id, sum(n + 3) + 3 AS every FROM m WHERE NOT asks GROUP BY conv_id),
      k AS (SELECT a.conv_id, a.turn, a.role, a.n, (SELECT sum(b.n + 3) + 3 FROM m b WHERE b.conv_id = a.conv_id AND NOT b.asks AND b.turn >= a.turn)::BIGINT AS cost FROM m a WHERE NOT a.asks)
      SELECT conv_id, turn, role, n, cost, every > room AS summarised FROM k JOIN q USING (conv_id) JOIN h USING (conv_id) WHERE every <= room OR cost <= room - 30""",
    "message_tokens": f"SELECT conv_id, (sum({_N} + 3) + 3)::BIGINT AS n_tokens FROM conversations GROUP BY conv_id",
    "chunk_tokens": f"SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 1000 ELSE {_N} END::INTEGER AS n_token FROM documents",
    "last_question": "SELECT conv_id, arg_max(text, turn) AS question, count(*) - 1 AS n_history FROM conversations GROUP BY conv_id",
    "concat_chunks": "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS joined FROM conversations GROUP BY conv_id",
    "rank_assign": "SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INTEGER AS rank FROM documents",
    "context_render": f"""SELECT page_id, '<ContextChunk><title>' || coalesce(t, 'Unknown') || '</title><url>' || coalesce(u, '') || '</url><startPage>' || coalesce(p::VARCHAR, '') || '</startPage><endPage>' || coalesce((p + 1)::VARCHAR, '')
      || '</endPage><content>' || CASE WHEN page_id % 5 = 4 THEN '{T.KNOWLEDGE_IMAGE[0]}' || coalesce(t, 'Unknown') || '{T.KNOWLEDGE_IMAGE[1]}' ELSE html END || '</content></ContextChunk>' AS chunk
      FROM (SELECT *, list_extract(string_split(u, '/'), -1) AS t FROM (SELECT page_id, html, CASE WHEN page_id % 3 <> 0 THEN url END AS u, CASE WHEN page_id % 2 = 0 THEN page_id END AS p FROM pages))""",
    "think_extract": f"WITH {_ANSWERS} SELECT event_id, trim(coalesce(regexp_extract(whole, '(?s)<think>(.*?)</think>', 1), '')) AS thought, trim(regexp_replace(whole, '(?s)<think>.*?</think>', '', 'g')) AS rest FROM a",
    "json_fence": f"WITH {_ANSWERS} SELECT event_id, trim(regexp_replace(answer, '```json|```', '', 'g')) AS body FROM a",
    "answer_strip": f"WITH {_ANSWERS} SELECT event_id, regexp_replace(regexp_replace(answer, '^Answer', ''), '^[: ]+', '') AS answer FROM a",
    "prompt_render": "SELECT conv_id, 'Answer in the manner of the examples.' || chr(10) || chr(10) || string_agg('## Example' || chr(10) || role || ': ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'Answer:' AS prompt FROM conversations GROUP BY conv_id",
    "confidence": "SELECT user_id, round(exp(nullif(sum(-abs(value) / 10000), 0)), 9) AS confidence FROM events GROUP BY user_id",
    "usage_rollup": "SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS tokens FROM events GROUP BY user_id, event_type",
}
