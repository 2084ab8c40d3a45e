"""Queries made of several operators: chats over a knowledge base, few-shot answers, messages, stores that change, personal data on ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as T
from ..operators import budget as B
from ..operators import chats, examples, logs, pii
from ..operators import vector as V
from ..session import cut, shaped, table
from .vectors_sql import all_near_sql, near_sql, vector_sql, vectors_sql

#: The chunks of the offline knowledge base: whole messages of conversations, in the collection of their role, embedded offline.
_CHUNKS = "SELECT conv_id * 1000 + turn AS vec_id, conv_id, text AS content, role AS title, role AS collection, concat('https://s/', conv_id) AS url, CAST(turn AS INT) AS page FROM {conversations} WHERE role <> 'user'"
#: In which collection a conversation asks, and which messages stand for images.
_SCOPE = "CASE WHEN conv_id % 4 = 3 THEN 'system' ELSE 'assistant' END"
_HISTORY, _SUMMARY, _CONTEXT = 60, 20, 150


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, _CHUNKS, "conversations").withColumn("n_token", B.word_tokens(F.col("content")))
    return models.embedded(rows, "content", "embedding", models.HashingEmbedder())


def _chats(spark: SparkSession, sf_dir: str, threshold: float, images: bool = False) -> DataFrame:
    chunks, told = _chunks(spark, sf_dir), table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = {}
    if images:  # every third conversation asks with an image, whose vector is that of its first message
        first = models.embedded(told.filter("conv_id % 3 = 0 AND turn = 0"), "text", "embedding", models.HashingEmbedder())
        more = {"images": chunks.filter("page % 2 = 1"), "image_queries": first.select("conv_id", "embedding"), "image_threshold": 1.05}
    scopes = told.select("conv_id", F.expr(_SCOPE).alias("collection")).distinct()
    asked = cut(chats.retrieval_queries(told, chats.JsonEcho(), models.HashingEmbedder()))
    found = chats.answered(told, asked, chunks, chats.JsonEcho(), collections=scopes, threshold=threshold, context=_CONTEXT, history=_HISTORY, summary=_SUMMARY, **more)
    return found.select("conv_id", "question", "query", "answer", F.array_join("sources", " ").alias("sources"), F.array_join("context_ids", ",").alias("context_ids"), "n_context", "history", "summarised", "prompt_tokens", "completion_tokens")


def rag_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to every conversation's last message, from what its collection has on it; some find nothing near enough."""
    return _chats(spark, sf_dir, 1.2)


def rag_chat_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where some conversations ask with an image too."""
    return _chats(spark, sf_dir, 1.2, images=True)


def rag_chat_without_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed answer where no chunk is near enough."""
    return _chats(spark, sf_dir, 9.0)


def general_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's reply to every conversation, and the log row of each."""
    return chats.replied(table(spark, sf_dir, "conversations"), "conv_id", models.LastLine())


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, "SELECT conv_id * 1000 + turn AS vec_id, text AS question, concat('about ', role) AS answer FROM {conversations}", "conversations")
    return models.embedded(rows, "question", "embedding", models.HashingEmbedder())


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each conversation: its last message, which it leaves out as an example."""
    last = B.last_message(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return last.select(F.col("conv_id").alias("query_id"), F.col("question").alias("query"), F.array(F.col("conv_id") * 1000 + F.col("n_history")).alias("excluded"))


def few_shot_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer to every conversation's last message in the manner of the store's nearest examples, and these."""
    found = chats.few_shot(_asked(spark, sf_dir), _shots(spark, sf_dir), "Answer in the manner of the examples.", models.HashingEmbedder(), models.LastLine())
    return found.withColumn("examples", F.array_join("examples", ","))


def few_shot_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as if some examples were new and others gone."""
    rows = _shots(spark, sf_dir)
    added, kept = rows.filter("vec_id % 3 = 0"), rows.filter("vec_id % 3 <> 0")
    found = chats.few_shot(_asked(spark, sf_dir), kept, "Answer in the manner of the examples.", models.HashingEmbedder(), models.LastLine(), added=added, removed=kept.filter("vec_id % 5 = 1").select("vec_id"))
    return found.withColumn("examples", F.array_join("examples", ","))


_MESSAGES = """SELECT conv_id, turn, concat('{{"role": "', CASE WHEN turn % 7 = 6 THEN 'robot' ELSE 'user' END, '", "parts": [',
  CASE WHEN turn % 3 = 1 THEN '{{"kind": "data", "data": "d"}}, ' ELSE '' END, CASE WHEN turn % 2 = 0 THEN concat('{{"kind": "reasoning", "reasoning": "r', turn, '"}}, ') ELSE '' END,
  '{{"kind": "text", "text": "', md5(text), '"}}, {{"kind": "text", "text": "second"}}, {{"kind": "file", "file": {{"name": "f", "mime_type": "', CASE WHEN turn % 2 = 0 THEN 'image/png' ELSE 'text/csv' END, '", "bytes": "AAAA"}}}}]}}') AS message FROM {conversations}"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaped(spark, sf_dir, _MESSAGES, "conversations").withColumn("m", T.normalised(F.col("message")))


def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [T.first_part(F.col("m"), kind).alias(f"first_{kind}") for kind in ("text", "data", "reasoning")]
    return _messages(spark, sf_dir).select("conv_id", "turn", F.col("m").isNotNull().alias("valid"), *parts)


def message_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a chat model takes them; those with data or reasoning are none."""
    plain = _messages(spark, sf_dir).filter("NOT exists(m.parts, p -> p.kind IN ('data', 'reasoning'))")
    line = F.transform(T.content_parts(F.col("m")), lambda p: F.concat_ws("=", p["type"], p["value"]))
    return plain.select("conv_id", "turn", F.array_join(line, ";").alias("content"))


def multimodal_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the image's or the text's vector stands for a message, and its length."""
    parts = _messages(spark, sf_dir).filter("m IS NOT NULL AND NOT exists(m.parts, p -> p.kind IN ('data', 'reasoning'))").withColumn("parts", T.content_parts(F.col("m")))
    found = models.multimodal_embedded(parts, "parts", "v", models.HashingEmbedder(32), models.ImageBytes(16))
    return found.select("conv_id", "turn", F.transform("v", lambda x: x.cast("long")).alias("vector"))


def example_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store gets of some new rows: invalid ones are skipped."""
    rows = shaped(spark, sf_dir, "SELECT event_type AS question, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS STRING) END AS answer, CASE WHEN event_id % 5 = 0 THEN 'x' END AS _id FROM {events}", "events")
    made = examples.created(rows, ["question", "answer"], ["question"], models.HashingEmbedder(), "2024-01-01 00:00:00")
    return made.select("question", "answer", "last_updated_time", F.transform("question_embeddings", lambda x: x.cast("long")).alias("vector"), (F.length("_id") == 64).alias("has_id"))


def publish_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All indexes' rows after a publish has copied staging's into the inactive one."""
    pages = shaped(spark, sf_dir, "SELECT concat('i', event_id % 3) AS index, event_id, event_type FROM {events}", "events")
    pointers = spark.createDataFrame([("live", "i0"), ("staging", "i1"), ("inactive", "i2")], "role string, index string")
    return examples.copied(pages, pointers)


def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections beside the texts that stand at their places."""
    texts = table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), "event_type")
    found = shaped(spark, sf_dir, "SELECT event_id AS index, props FROM {events} WHERE event_id % 4 <> 1", "events")
    return examples.zipped(texts, found)


def bulk_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's bulk call what failed, first of all, and whether it raises."""
    rows = shaped(spark, sf_dir, "SELECT user_id, event_id AS item, CAST(CASE WHEN event_id % 17 = 0 THEN 429 WHEN event_id % 23 = 0 THEN 507 ELSE 201 END AS INT) AS status FROM {events}", "events")
    return examples.bulk_outcome(rows.withColumn("error", examples.error_kind(F.col("status"))), "user_id")


def pii_on_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the detectors find in the chunks that an upsert inserts; a document without any has no row."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    found = logs.flagged_logs(rows, ["content"], {"email": T.PII["email"]})
    return found.select("doc_id", F.explode("content_pii").alias("item")).select("doc_id", F.col("item.text").alias("text"), F.col("item.location").alias("location"))


_BODY = """concat('Ask ann  lee or u', user_id, '@x.example, not U', user_id, '@x.example, about ', event_type, '; ann', chr(10), 'lee and u', user_id, '@x.example. Note:', chr(10), '  ', {base64}, ' end')"""
_NOTE = "concat('the card of p', event_id, '@y.example is here')"


def pii_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of what a model finds in each text: in plain, in base64, or nowhere as it was made up."""
    body = _BODY.format(base64=f"CAST(base64(CAST({_NOTE} AS BINARY)) AS STRING)")
    rows = shaped(spark, sf_dir, f"SELECT event_id, {body} AS body FROM {{events}}", "events")
    found = pii.detected_located(rows, "body", {"email": "an address of mail", "name": "a person"}, _detector(), context="notes")
    return found.select("event_id", "entity", "item", "location")


def _detector() -> pii.PatternTable:
    return pii.PatternTable({"NAME": r"ann\s+lee", "EMAIL": r"[A-Za-z]\d+@[a-z]+\.example"}, {"NUMBER": "555 0123"})


def pii_detect_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts with what the model finds replaced, and what finding it cost."""
    body = _BODY.format(base64="'none'")
    rows = shaped(spark, sf_dir, f"SELECT event_id, {body} AS body FROM {{events}}", "events")
    found = pii.detected_masked(rows, "body", "masked", {"email": "an address of mail"}, _detector())
    return found.select("event_id", "masked", F.size("items").alias("n_items"), "prompt_tokens", "completion_tokens")


def log_flagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with what was detected in the question beside it, nothing masked."""
    rows = shaped(spark, sf_dir, "SELECT event_id, concat('mail u', user_id, '@x.example now') AS question, props AS history FROM {events}", "events")
    found = logs.flagged_logs(rows, ["question"], {"email": T.PII["email"]})
    return found.select("event_id", "question", "history", F.array_join(F.transform("question_pii", lambda p: F.concat_ws(":", p["entity"], p["text"], p["location"])), ",").alias("items"))


def item_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every start of an item of two words, whatever stands between them."""
    rows = shaped(spark, sf_dir, "SELECT event_id, concat('ann  lee met ann lee', chr(10), 'and ', event_type, ' ann', chr(9), 'lee') AS body FROM {events}", "events")
    return rows.select("event_id", F.array_join(T.item_starts(F.col("body"), "ann lee"), ",").alias("starts"))


_LAST = "trim(regexp_extract(rtrim({}, ' ' || chr(10) || chr(13) || chr(9)), '[^\n]*$'), ' ' || chr(9) || chr(13))"
_N = "(CASE WHEN trim({0}) = '' THEN 0 ELSE len(string_split_regex(trim({0}), ' +')) END)"


def _rag_sql(threshold: float, images: bool) -> str:
    image = f"""iq AS (SELECT conv_id AS id, text AS t FROM conversations WHERE conv_id % 3 = 0 AND turn = 0), {vectors_sql("SELECT * FROM iq", "iv")},
      im AS (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY score DESC, r) AS rank, score FROM ({near_sql("iv", "cv")}) JOIN c ON c.id = r JOIN asks a ON a.conv_id = q WHERE c.collection = a.scope AND c.page % 2 = 1 AND score >= 1.05 QUALIFY rank <= 20)""" if images else "im AS (SELECT q, r, rank, score FROM tx WHERE false)"
    context = """'<ContextChunk><title>' || title || '</title><url>' || url || '</url><startPage>' || page || '</startPage><endPage>' || page || '</endPage><content>' || content || '</content></ContextChunk>'"""
    return f"""WITH last AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS end_, {_N.format("text")} AS n FROM conversations),
      base AS (SELECT conv_id, {_SCOPE} AS scope, arg_max(text, turn) AS question, string_agg(CASE WHEN turn < end_ THEN role || ': ' || text END, chr(10) ORDER BY turn) AS told FROM last GROUP BY conv_id),
      ref AS (SELECT *, '{chats.REFORMULATE}' || chr(10) || told || chr(10) || 'Follow-up:' || chr(10) || question AS asked FROM base),
      asks AS (SELECT *, CASE WHEN told IS NULL THEN question ELSE {_LAST.format("asked")} END AS query FROM ref),
      c AS (SELECT conv_id * 1000 + turn AS id, text AS content, role AS title, role AS collection, 'https://s/' || conv_id AS url, turn AS page, {_N.format("text")} AS n FROM conversations WHERE role <> 'user'),
      {vectors_sql("SELECT conv_id AS id, query AS t FROM asks", "qv")}, {vectors_sql("SELECT id, content AS t FROM c", "cv")},
      tx AS (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY score DESC, r) AS rank, score FROM ({near_sql("qv", "cv")}) JOIN c ON c.id = r JOIN asks a ON a.conv_id = q WHERE c.collection = a.scope AND score >= {threshold} QUALIFY rank <= 30),
      {image},
      bo AS (SELECT *, min(list) OVER (PARTITION BY q) <> max(list) OVER (PARTITION BY q) AS two FROM (SELECT *, 0 AS list FROM tx UNION ALL SELECT *, 1 FROM im)),
      fu AS (SELECT q, r, round(sum(CASE WHEN two THEN 1.0::DOUBLE / (60 + rank) ELSE score END), 9) AS score, min({{'l': list, 'k': rank}}) AS first FROM bo GROUP BY q, r),
      hi AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, first, r) AS rank FROM fu),
      pa AS (SELECT hi.*, c.*, sum(n) OVER (PARTITION BY q ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM hi JOIN c ON c.id = hi.r QUALIFY running < {_CONTEXT}),
      cx AS (SELECT q, string_agg({context}, chr(10) || chr(10) ORDER BY rank) AS context, string_agg(id::VARCHAR, ',' ORDER BY rank) AS context_ids, string_agg(url, ' ' ORDER BY rank) AS sources, string_agg('"' || url || '"', ', ' ORDER BY rank) AS listed, count(*) AS n_context FROM pa GROUP BY q),
      room AS (SELECT conv_id, {_HISTORY} - max(n + 6) FILTER (WHERE turn = end_) AS room, sum(n + 3) FILTER (WHERE turn < end_) + 3 AS every FROM last GROUP BY conv_id),
      cost AS (SELECT l.conv_id, l.turn, l.role, l.text, sum(n + 3) OVER (PARTITION BY l.conv_id ORDER BY l.turn DESC ROWS UNBOUNDED PRECEDING) + 3 AS cost, room, every FROM last l JOIN room USING (conv_id) WHERE turn < end_),
      hs AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE every <= room OR cost <= room - {_SUMMARY}) AS kept, string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (WHERE every > room AND cost > room - {_SUMMARY}) AS gone FROM cost GROUP BY conv_id),
      su AS (SELECT *, '{chats.SUMMARISE}' || chr(10) || gone AS told_off, {_LAST.format("gone")} AS reply FROM hs),
      hy AS (SELECT conv_id, coalesce(concat_ws(chr(10), kept, 'Summary: ' || reply), '') AS history, gone IS NOT NULL AS summarised, coalesce({_N.format("told_off")}, 0) AS p2, coalesce({_N.format("reply")}, 0) AS c2 FROM su),
      al AS (SELECT a.*, coalesce(h.history, '') AS history, coalesce(h.summarised, false) AS summarised, coalesce(p2, 0) AS p2, coalesce(c2, 0) AS c2, cx.*, hit.q IS NOT NULL AS hit,
        concat_ws(chr(10) || chr(10), '{chats.ANSWER}', {f"CASE WHEN conv_id % 3 = 0 THEN '{T.USER_IMAGE}' END" if images else "NULL"}, context, nullif(coalesce(h.history, ''), ''), question) AS prompt, {_LAST.format("question")} AS line
        FROM asks a LEFT JOIN hy h USING (conv_id) LEFT JOIN cx ON cx.q = a.conv_id LEFT JOIN (SELECT DISTINCT q FROM hi) hit ON hit.q = a.conv_id)
      SELECT conv_id, question, query, CASE WHEN hit THEN line ELSE '{chats.CANNOT_ANSWER}' END AS answer, CASE WHEN hit THEN coalesce(sources, '') ELSE '' END AS sources, coalesce(context_ids, '') AS context_ids, coalesce(n_context, 0) AS n_context, history, summarised,
        (CASE WHEN hit THEN (CASE WHEN told IS NULL THEN 0 ELSE {_N.format("asked")} END) + p2 + {_N.format("prompt")} ELSE 0 END)::BIGINT AS prompt_tokens,
        (CASE WHEN hit THEN (CASE WHEN told IS NULL THEN 0 ELSE {_N.format("query")} END) + c2 + {_N.format("""('{"thought": "", "answer": "' || line || '", "challenge_verification": "", "sources": [' || coalesce(listed, '') || ']}')""")} ELSE 0 END)::BIGINT AS completion_tokens FROM al"""


def _shots_sql(rows: str) -> str:
    """Few-shot answers over examples (id, question, answer)."""
    return f"""WITH s AS ({rows}), a AS (SELECT conv_id AS id, arg_max(text, turn) AS t, conv_id * 1000 + count(*) - 1 AS own FROM conversations GROUP BY conv_id), {vectors_sql("SELECT id, t FROM a", "qv")}, {vectors_sql("SELECT id, question AS t FROM s", "sv")},
      p AS ({all_near_sql("qv", "sv")}),
      k AS (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY score DESC, r) AS rank FROM p JOIN a ON a.id = q WHERE r <> own QUALIFY rank <= 5)
      SELECT a.id AS query_id, regexp_replace(regexp_replace(trim({_LAST.format("('Answer: ' || t)")}), '^Answer', ''), '^[: ]+', '') AS answer, coalesce((SELECT string_agg(r::VARCHAR, ',' ORDER BY rank) FROM k WHERE k.q = a.id), '') AS examples FROM a"""


_SHOTS = "SELECT conv_id * 1000 + turn AS id, text AS question, 'about ' || role AS answer FROM conversations"

QUERIES = {f.__name__: f for f in (rag_chat, rag_chat_with_images, rag_chat_without_hits, general_chat, few_shot_generate, few_shot_preview, message_parts, message_content, multimodal_embed, example_create, publish_copy, positional_zip, bulk_outcome, pii_on_ingest, pii_detect, pii_detect_mask, log_flagging, item_locations)}
ORACLE_SQL = {
    "rag_chat": _rag_sql(1.2, False),
    "rag_chat_with_images": _rag_sql(1.2, True),
    "rag_chat_without_hits": _rag_sql(9.0, False),
    "few_shot_generate": _shots_sql(_SHOTS),
    "few_shot_preview": _shots_sql(f"SELECT id, question, answer FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY id % 3 <> 0, id) AS nth FROM ({_SHOTS}) WHERE id % 3 = 0 OR id % 5 <> 1) WHERE nth = 1"),
    "general_chat": """SELECT conv_id, arg_max(text, turn) AS question, count(*) - 1 AS n_history, trim(regexp_extract(trim(arg_max(text, turn), ' ' || chr(10) || chr(13) || chr(9)), '[^\n]*$')) AS answer FROM conversations GROUP BY conv_id""",
    "message_parts": """SELECT conv_id, turn, turn % 7 <> 6 AS valid, CASE WHEN turn % 7 <> 6 THEN md5(text) END AS first_text, CASE WHEN turn % 7 <> 6 AND turn % 3 = 1 THEN 'd' END AS first_data,
      CASE WHEN turn % 7 <> 6 AND turn % 2 = 0 THEN 'r' || turn END AS first_reasoning FROM conversations""",
    "message_content": "SELECT conv_id, turn, 'text=' || md5(text) || ';text=second;file=AAAA' AS content FROM conversations WHERE turn % 2 = 1 AND turn % 3 <> 1 AND turn % 7 <> 6",
    "multimodal_embed": f"WITH {vectors_sql("SELECT conv_id * 1000 + turn AS id, md5(text) || ' second' AS t FROM conversations", "v", 32)} SELECT conv_id, turn, {vector_sql("v", "conv_id * 1000 + turn", 32, "'x'")} AS vector FROM conversations WHERE turn % 2 = 1 AND turn % 3 <> 1 AND turn % 7 <> 6",
    "example_create": f"WITH {vectors_sql("SELECT DISTINCT event_type AS id, event_type AS t FROM events", "v")} SELECT event_type AS question, event_id::VARCHAR AS answer, TIMESTAMP '2024-01-01' AS last_updated_time, {vector_sql("v", "event_type", 64, "event_type")} AS vector, true AS has_id FROM events WHERE event_type IS NOT NULL AND event_id % 3 <> 0 AND event_id % 5 <> 0",
    "publish_copy": "SELECT 'i' || (event_id % 3) AS index, event_id, event_type FROM events WHERE event_id % 3 < 2 UNION ALL SELECT 'i2', event_id, event_type FROM events WHERE event_id % 3 = 1",
    "positional_zip": "SELECT event_id AS index, event_type, props FROM events WHERE event_id % 4 <> 1",
    "bulk_outcome": """SELECT user_id, count(*) AS items, count(*) FILTER (WHERE bad) AS failed, arg_min(CASE WHEN event_id % 17 = 0 THEN 'rate limit' ELSE 'internal' END, event_id) FILTER (WHERE bad) AS first_error, bool_or(bad) AS raises
      FROM (SELECT *, event_id % 17 = 0 OR event_id % 23 = 0 AS bad FROM events) GROUP BY user_id""",
    "pii_detect": f"""WITH b AS (SELECT event_id, length('' || user_id) AS k, length(event_type) AS e, 'u' || user_id || '@x.example' AS low, 'U' || user_id || '@x.example' AS high FROM events)
      SELECT event_id, 'NAME' AS entity, 'ann lee' AS item, unnest([4, 54 + 2 * k + e])::INTEGER AS location FROM b
      UNION ALL SELECT event_id, 'EMAIL', low, unnest([16, 66 + 2 * k + e])::INTEGER FROM b
      UNION ALL SELECT event_id, 'EMAIL', high, (33 + k)::INTEGER FROM b
      UNION ALL SELECT event_id, 'EMAIL', 'p' || event_id || '@y.example', (87 + 3 * k + e)::INTEGER FROM b
      UNION ALL SELECT event_id, 'NUMBER', '555 0123', NULL FROM b""",
    "pii_detect_mask": f"""WITH b AS (SELECT event_id, event_type, 'u' || user_id || '@x.example' AS low, 'U' || user_id || '@x.example' AS high FROM events),
      c AS (SELECT *, 'Ask ann  lee or ' || low || ', not ' || high || ', about ' || event_type || '; ann' || chr(10) || 'lee and ' || low || '. Note:' || chr(10) || '  none end' AS body,
        '| entity | text |' || chr(10) || '| --- | --- |' || chr(10) || '| NAME | ann lee |' || chr(10) || '| EMAIL | ' || low || ' |' || chr(10) || '| EMAIL | ' || high || ' |' || chr(10) || '| NUMBER | 555 0123 |' AS found,
        '{{"pii": [{{"entity": "NAME", "text": "ann lee"}}, {{"entity": "EMAIL", "text": "x"}}, {{"entity": "EMAIL", "text": "x"}}, {{"entity": "NUMBER", "text": "555 0123"}}]}}' AS json FROM b),
      d AS (SELECT *, 'List the personal and sensitive data in the text as a Markdown table with the columns entity and text.' || chr(10) || 'EMAIL: an address of mail' || chr(10) || 'Text:' || chr(10) || body AS p1, 'Turn all rows of the table into JSON.' || chr(10) || 'Table:' || chr(10) || found AS p2 FROM c)
      SELECT event_id, 'Ask [NAME] or [EMAIL], not [EMAIL], about ' || event_type || '; [NAME] and [EMAIL]. Note:' || chr(10) || '  none end' AS masked, 4::INTEGER AS n_items,
      ({_N.format("p1")} + {_N.format("p2")})::BIGINT AS prompt_tokens, ({_N.format("found")} + {_N.format("json")})::BIGINT AS completion_tokens FROM d""",
    "log_flagging": "SELECT event_id, 'mail u' || user_id || '@x.example now' AS question, props AS history, 'email:u' || user_id || '@x.example:5' AS items FROM events",
    "item_locations": "SELECT event_id, '0,13,' || (26 + length(event_type)) AS starts FROM events",
    "pii_on_ingest": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      m AS (SELECT doc_id, regexp_extract_all(t, '{T.PII["email"]}') AS hits, regexp_split_to_array(t, '{T.PII["email"]}') AS gaps FROM d),
      k AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m)
      SELECT doc_id, hits[i] AS text, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::INTEGER AS location FROM k""",
}
