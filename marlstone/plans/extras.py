"""Queries that no SQL can state, or not wholly: splitters, models, stateful streams. Extensions are named ``ext_*``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import chunking, models
from ..operators import pii
from ..session import shaped, shared_folder, table
from ..sources import pages
from ..streaming import operators as S
from ..streaming import quotas, upserts
from . import store
from .vectors_sql import vector_sql, vectors_sql

#: Fixed value: characters of a page, of texts that come without pages.
PAGE = 1500


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunks(rows, "text").withColumn("n_token", F.size(F.split("content", " +")))


def word_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fragments(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text")


def find_in_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, "SELECT event_id, concat('see ', CAST(base64(CAST(concat('secret mail of user ', user_id, ' in the log') AS BINARY)) AS STRING), ' end') AS body FROM {events}", "events")
    found = pii.starts_in_base64(F.col("body"), F.lit("Of User 7 "))
    return rows.select("event_id", chunking.found_in_base64(F.col("body"), "Of User 7 ").alias("found"), F.array_join(found, ",").alias("starts"))


def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of every chunk of whole texts, cut into pages of ``PAGE`` characters."""
    count = F.ceil(F.length("text") / PAGE).cast("int")
    pages = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.substring(F.col("text"), (k - 1) * PAGE + 1, F.lit(PAGE)))).otherwise(F.array().cast("array<string>"))
    return chunking.chunk_pages(table(spark, sf_dir, "documents").select("doc_id", pages.alias("pages")), "pages")


def rounded(vector: str) -> Column:
    """A vector's components in units of 1e-5, which no summation order changes."""
    return F.transform(vector, lambda x: F.round(x.cast("double") * 100_000).cast("long")).alias("vector")


def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return models.embedded(rows, "text", "text_embeddings", models.HashingEmbedder()).select("conv_id", "turn", rounded("text_embeddings"))


def re_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array(F.lit(0.0).cast("float")).alias("text_embeddings"))
    return models.re_embedded(rows, models.HashingEmbedder(32)).select("conv_id", "turn", rounded("text_embeddings"))


def generate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return models.generated(rows, "text", "answer", models.LastLine()).select("conv_id", "turn", "answer", models.endpoint(F.col("conv_id"), 3).alias("endpoint"))


def sample_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import logs

    return logs.sampled(table(spark, sf_dir, "events"), "event_id", 25).select("event_id", "event_type")


def log_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import logs

    rows = table(spark, sf_dir, "events").select("event_id", "props")
    return logs.lifted(rows, "props", "k long")


def ext_user_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation over the star schema's tables."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def _streamed(spark: SparkSession, rows: DataFrame, run, **confs: str) -> DataFrame:
    """What a stream makes of ``rows``, replayed to its end from files in the shared folder, under session settings that hold for it alone."""
    folder = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    schema: StructType = spark.read.parquet(f"{folder}/in").schema
    made = run(spark.readStream.schema(schema).parquet(f"{folder}/in"))
    before = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).outputMode("append").start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(f"{folder}/out")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, store._requests(spark, sf_dir), lambda s: S.rate_limited(s, 150.0, store.WINDOW_MS)).select("event_id", "user_id", "admitted")


_ITEMS = """SELECT source AS folder, CAST(doc_id AS STRING) AS id, concat('d', doc_id, '.md') AS name, concat('https://s/', doc_id) AS web_url, 1700000000000 - doc_id AS modified_ms,
  CAST(CASE WHEN doc_id % 40 = 0 THEN doc_id % 7 END AS INT) AS child_count FROM {documents}"""


def _pages(spark: SparkSession, sf_dir: str) -> str:
    path = f"{shared_folder(spark).rstrip('/')}/pages-{uuid.uuid4().hex}"
    pages.write_pages(shaped(spark, sf_dir, _ITEMS, "documents"), path, 25)
    return path


def paged_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a listing that comes in pages."""
    return pages.files_of(pages.listed(spark, _pages(spark, sf_dir))).drop("child_count")


def paged_listing_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.folders_of(pages.listed(spark, _pages(spark, sf_dir)))


_FIRST = "SELECT doc_id, 1 AS version, concat('c-', source) AS collection, lang AS title, array(md5(text), concat('mail u', doc_id, '@x.example'), concat('note ', lang)) AS contents FROM {documents} WHERE doc_id % 5 <> 0"
_SECOND = """SELECT doc_id, 2 AS version, concat('c-', CASE WHEN doc_id % 9 = 0 THEN 'moved' ELSE source END) AS collection, lang AS title,
  CASE WHEN doc_id % 6 <> 0 THEN array(md5(text), concat('note ', lang), concat('note ', lang), concat('mail new', doc_id, '@x.example')) END AS contents FROM {documents} WHERE doc_id % 3 = 0"""


def _upserted(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a chunk table after two versions of the documents came in, one after the other."""
    folder = f"{shared_folder(spark).rstrip('/')}/upserts-{uuid.uuid4().hex}"
    for sql in (_FIRST, _SECOND):
        shaped(spark, sf_dir, sql, "documents").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
        upserts.upserts(stream, folder, f"{folder}/state", models.HashingEmbedder(8), upserts.PatternDetector({"email": r"[a-z]+\d+@x\.example"})).trigger(availableNow=True).start().awaitTermination()
    return folder


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks after a stream of document versions."""
    return upserts.current(upserts.changes(spark, _upserted(spark, sf_dir))).select("doc_id", "collection", "title", "content", F.size("embedding").alias("dimension"), "nth")


def stream_upsert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks each batch inserted, updated and deleted."""
    return upserts.changes(spark, _upserted(spark, sf_dir)).groupBy("batch", "action").agg(F.count("*").alias("n"))


def stream_upsert_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was detected in the chunks that batches inserted."""
    return upserts.callbacks(spark, _upserted(spark, sf_dir)).select("doc_id", "batch", F.explode("items").alias("i")).select("doc_id", "batch", "i.entity", "i.text")


_STORE = {"spark.sql.streaming.stateStore.providerClass": quotas.STORE}


def stream_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, each followed by two chunks of its answer of which the last charges its cost, under a quota of irregular windows."""
    asks = store._requests(spark, sf_dir)
    steps = F.explode(F.array(*[F.struct(F.lit(n).alias("step"), F.lit(kind).alias("kind"), F.lit(last).alias("last_chunk")) for n, kind, last in ((0, "ask", False), (1, "chunk", False), (2, "chunk", True))]))
    told = asks.select("*", steps.alias("s")).select("user_id", (F.col("event_id") * 3 + F.col("s.step")).alias("event_id"), "ms", "s.kind", F.col("event_id").alias("message_id"), F.when(F.col("s.last_chunk"), F.col("cost")).alias("tokens"), "s.last_chunk")
    found = _streamed(spark, told, lambda s: quotas.charged_requests(s, 150.0, store.CRON_REPORT), **_STORE)
    return found.filter("kind = 'ask'").select((F.col("event_id") / 3).cast("long").alias("event_id"), "user_id", F.round("balance", 4).alias("left"), "admitted")


def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of a day answers of every user's look-ups of event types; some make it forget."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_type").alias("item"), F.col("event_id").cast("string").alias("value"), (F.col("event_id") % 7 == 0).alias("forgets"))
    return _streamed(spark, rows, lambda s: quotas.cached(s, ttl_ms=86_400_000), **_STORE).select(F.col("key").cast("long").alias("user_id"), "event_id", "item", "value", "hit")


def _deltas(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """Answers with a thought, cut every five characters."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.concat(F.lit("<think>why "), F.col("role"), F.lit("</think>"), text).alias("body"))
    pieces = F.regexp_extract_all("body", F.lit("(?s).{1,5}"), F.lit(0))
    made = rows.select("message_id", F.ceil(F.length("body") / 5).alias("n"), F.posexplode(pieces).alias("nth", "delta"))
    return made.select("message_id", F.col("nth").cast("long").alias("nth"), "delta", (F.col("nth") == F.col("n") - 1).alias("last_chunk"))


def stream_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, _deltas(spark, sf_dir, F.col("text")), S.split_thoughts).groupBy("message_id", "kind").agg(F.sum(F.length("text")).alias("n_chars"))


def stream_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.assembled(_deltas(spark, sf_dir, F.col("text")).withColumn("tokens", F.lit(1)))


def ext_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, S.closing(table(spark, sf_dir, "events").select("ts", "event_type"), "ts"), lambda s: S.windowed_counts(s, "ts", "event_type"))


_TWO = """a AS (SELECT doc_id, 'c-' || source AS collection, lang AS title, unnest([md5(text), 'mail u' || doc_id || '@x.example', 'note ' || lang]) AS content FROM documents WHERE doc_id % 5 <> 0),
  b AS (SELECT doc_id, 'c-' || CASE WHEN doc_id % 9 = 0 THEN 'moved' ELSE source END AS collection, lang AS title, unnest([md5(text), 'note ' || lang, 'note ' || lang, 'mail new' || doc_id || '@x.example']) AS content FROM documents WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0),
  x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content) AS nth FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content) AS nth FROM b),
  d AS (SELECT 1 AS batch, coalesce(x.doc_id, y.doc_id) AS doc_id, coalesce(x.content, y.content) AS content, CASE WHEN x.doc_id IS NULL THEN 'insert' WHEN y.doc_id IS NULL THEN 'delete' WHEN x.collection <> y.collection THEN 'update' ELSE 'keep' END AS action
    FROM (SELECT * FROM x WHERE doc_id % 3 = 0) x FULL JOIN y ON x.doc_id = y.doc_id AND x.content = y.content AND x.nth = y.nth UNION ALL SELECT 0, doc_id, content, 'insert' FROM a)"""

QUERIES = {f.__name__: f for f in (chunk_documents, word_fragments, find_in_base64, page_range, embed_texts, re_embed, generate_answers, sample_logs, log_lift, stream_rate_limit, paged_listing, paged_listing_folders, stream_upsert, stream_upsert_changes, stream_upsert_callbacks, stream_charges, stream_cache, stream_think, stream_assembly, ext_daily_counts, ext_user_spend)}
ORACLE_SQL = {
    "log_lift": "SELECT event_id, regexp_extract(props, '\\d+')::BIGINT AS k FROM events",
    "find_in_base64": "SELECT event_id, user_id = 7 AS found, CASE WHEN user_id = 7 THEN '4' ELSE '' END AS starts FROM events",
    "stream_rate_limit": 'SELECT event_id, user_id, admitted FROM (' + store.ORACLE_SQL["rate_limit"] + ")",
    "embed_texts": f"WITH {vectors_sql("SELECT conv_id * 1000 + turn AS id, text AS t FROM conversations", "v")} SELECT conv_id, turn, list_transform({vector_sql("v", "conv_id * 1000 + turn", 64, "text")}, lambda x: 100000 * x) AS vector FROM conversations",
    "re_embed": f"WITH {vectors_sql("SELECT conv_id * 1000 + turn AS id, text AS t FROM conversations", "v", 32)} SELECT conv_id, turn, list_transform({vector_sql("v", "conv_id * 1000 + turn", 32, "text")}, lambda x: 100000 * x) AS vector FROM conversations",
    "paged_listing": "SELECT source AS folder, doc_id::VARCHAR AS id, 'd' || doc_id || '.md' AS name, 'https://s/' || doc_id AS web_url, 1700000000000 - doc_id AS modified_ms FROM documents WHERE doc_id % 40 <> 0",
    "paged_listing_folders": "SELECT source AS folder, doc_id::VARCHAR AS id, 'd' || doc_id || '.md' AS name, 'https://s/' || doc_id AS web_url, 1700000000000 - doc_id AS modified_ms, (doc_id % 7)::INTEGER AS child_count FROM documents WHERE doc_id % 40 = 0",
    "stream_upsert": f"WITH {_TWO} SELECT doc_id, collection, title, content, 8 AS dimension, nth::INTEGER AS nth FROM y UNION ALL SELECT doc_id, collection, title, content, 8, nth::INTEGER FROM x WHERE doc_id % 3 <> 0",
    "stream_upsert_changes": f"WITH {_TWO} SELECT batch::BIGINT AS batch, action, count(*) AS n FROM d WHERE action <> 'keep' GROUP BY batch, action",
    "stream_upsert_callbacks": f"WITH {_TWO} SELECT doc_id, batch::BIGINT AS batch, 'email' AS entity, content[6:] AS text FROM d WHERE action = 'insert' AND content LIKE 'mail %'",
    "stream_charges": 'SELECT event_id, user_id, "left", admitted FROM (' + store.ORACLE_SQL["cron_quota"] + ")",
    "stream_cache": """WITH RECURSIVE r AS (SELECT event_id, user_id, event_type AS item, epoch_ms(ts) AS ms, event_id % 7 = 0 AS forgets, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT *, CASE WHEN forgets THEN NULL ELSE event_id END AS held, ms AS made, false AS hit FROM r WHERE n = 1
        UNION ALL SELECT r.*, CASE WHEN r.forgets THEN NULL WHEN young THEN f.held ELSE r.event_id END, CASE WHEN young THEN f.made ELSE r.ms END, young FROM (SELECT r, f, f.held IS NOT NULL AND r.ms < f.made + 86400000 AS young FROM f JOIN r ON r.user_id = f.user_id AND r.item = f.item AND r.n = f.n + 1))
      SELECT user_id, event_id, item, held::VARCHAR AS value, hit FROM f WHERE NOT forgets""",
    "stream_think": """SELECT message_id, kind, sum(n)::BIGINT AS n_chars FROM (SELECT conv_id * 1000 + turn AS message_id, 'thought' AS kind, length('why ' || role) AS n FROM conversations
      UNION ALL SELECT conv_id * 1000 + turn, 'answer', length(text) FROM conversations WHERE text <> '') GROUP BY message_id, kind""",
    "ext_daily_counts": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sample_logs": "SELECT event_id, event_type FROM events WHERE substr(md5(event_id::VARCHAR), 1, 4) < '4000'",
    "stream_assembly": "SELECT conv_id * 1000 + turn AS message_id, '<think>why ' || role || '</think>' || text AS text, 1 AS tokens FROM conversations",
    "ext_user_spend": "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
}
