"""One synchronisation of a source, each of its next tables a query. The source, what was read and the stored tables are made from ``documents`` by SELECTs that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..operators import connector
from ..session import cut, shaped
from .store import AS_OF, LISTING

_NAME = "concat('d', doc_id, CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN '.pdf' WHEN 1 THEN '.url' WHEN 2 THEN '.png' WHEN 3 THEN '.zip' WHEN 4 THEN '.md' ELSE '.docx' END)"
FOLDERS = "SELECT DISTINCT source AS id, concat('c-', source) AS name, concat('https://s/', source) AS web_url FROM {documents}"
#: A fifth of the folders had another name, and one is gone.
FOLDER_STATES = """SELECT DISTINCT source AS id, concat(CASE WHEN source LIKE '%1' OR source LIKE '%6' THEN 'old-' ELSE 'c-' END, source) AS name, 'https://old' AS web_url, 'processing' AS status FROM {documents}
  UNION ALL SELECT 'gone' AS id, 'Gone' AS name, 'https://gone' AS web_url, 'successful' AS status"""
_PARENT = "CASE WHEN doc_id % 23 = 0 THEN 'gone' ELSE source END"
_COLLECTION = "concat(CASE WHEN source LIKE '%1' OR source LIKE '%6' THEN 'old-' ELSE 'c-' END, source)"
STATES = f"""SELECT doc_id AS id, {_PARENT} AS parent_id, {_COLLECTION} AS collection, {_NAME} AS name, concat('https://old/', source, '/', doc_id) AS web_url,
  1700000000000 - (doc_id % 30) * 3600000 AS upserted_ms, CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 1 ELSE 1700000000000 - doc_id * 60000 END AS modified_ms,
  CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 11 <> 1 THEN 'successful' END AS status, CAST(doc_id % 5 AS INT) AS retry FROM {{documents}} WHERE doc_id % 8 <> 3"""
CHUNKS = f"""SELECT doc_id, {_PARENT} AS parent_id, {_COLLECTION} AS collection, {_NAME} AS title, concat('https://old/', source, '/', doc_id) AS web_url, concat(part, ' ', md5(text)) AS content
  FROM {{documents}} CROSS JOIN (SELECT 'first' AS part UNION ALL SELECT 'second' AS part UNION ALL SELECT 'second' AS part) p WHERE doc_id % 8 <> 3"""
#: What was read: some files failed, a third changed a chunk.
_PARTS = "array('first', CASE WHEN doc_id % 3 = 0 THEN 'third' ELSE 'second' END, 'second')"


def _snapshot(spark: SparkSession, sf_dir: str) -> connector.Snapshot:
    one = lambda sql: shaped(spark, sf_dir, sql, "documents")
    read = one(f"SELECT doc_id AS id, CASE WHEN doc_id % 29 <> 0 THEN transform({_PARTS}, p -> concat(p, ' ', md5(text))) END AS contents FROM {{documents}} WHERE doc_id % 31 <> 0")
    stored = cut(models.embedded(one(CHUNKS), "content", "embedding", models.HashingEmbedder(4)).withColumn("embedding", F.array(F.lit(0.5).cast("float"))))
    return connector.synced(one(FOLDERS), one(LISTING), read, one(FOLDER_STATES), one(STATES), stored, models.HashingEmbedder(4), AS_OF)


def connector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next chunks; whether each was embedded anew shows in its vector."""
    return _snapshot(spark, sf_dir).chunks.select("doc_id", "parent_id", "collection", "title", "web_url", "content", (F.size("embedding") == 4).alias("embedded"))


def connector_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).states


def connector_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).folders


def connector_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir).results


_own = lambda sql: sql.replace("{documents}", "documents")
_EXT = "lower(regexp_extract(name, '\\.([^.]*)$', 1))"
_SQL = f"""WITH l AS (SELECT *, 'c-' || parent_id AS folder, CASE WHEN {_EXT} = 'pdf' THEN 'pdf' WHEN {_EXT} = 'url' THEN 'link' WHEN {_EXT} = 'png' THEN 'image' WHEN {_EXT} IN ('md', 'docx') THEN 'text' END AS kind FROM ({_own(LISTING)})),
  s0 AS ({_own(STATES)}), s AS (SELECT *, true AS known FROM s0 WHERE parent_id <> 'gone'),
  d AS (SELECT coalesce(l.id, s.id) AS id, coalesce(l.parent_id, s.parent_id) AS parent_id, l.folder, l.name, l.web_url, l.modified_ms, l.kind, s.known, s.collection AS s_collection, s.name AS s_name, s.web_url AS s_web_url, s.upserted_ms AS s_upserted_ms,
    s.modified_ms AS s_modified_ms, s.status AS s_status, s.retry AS s_retry, coalesce(s.modified_ms <> l.modified_ms, true) AS changed FROM l FULL JOIN s ON l.id = s.id AND l.parent_id = s.parent_id),
  a AS (SELECT *, CASE WHEN folder IS NULL THEN 'remove' WHEN kind IS NULL THEN CASE WHEN known IS NULL OR changed THEN 'unsupported' ELSE 'same' END
    WHEN known IS NULL OR s_modified_ms IS NULL THEN 'upsert' WHEN kind = 'link' THEN CASE WHEN changed OR {AS_OF} - s_upserted_ms > 43200000 THEN 'upsert' ELSE 'none' END WHEN kind = 'image' AND s_web_url <> web_url THEN 'upsert'
    WHEN changed OR (coalesce(s_status, 'successful') <> 'successful' AND s_retry < 3) THEN 'upsert' ELSE 'none' END AS action FROM d),
  t AS (SELECT *, id % 29 = 0 OR id % 31 = 0 AS bad FROM a WHERE action = 'upsert'),
  ns AS (SELECT id, parent_id, folder AS collection, name, web_url, {AS_OF} AS upserted_ms, modified_ms, CASE WHEN bad THEN 'failed' ELSE 'successful' END AS status, CASE WHEN NOT bad OR known IS NULL OR changed THEN 0 ELSE coalesce(s_retry, 0) + 1 END::INTEGER AS retry FROM t
    UNION ALL SELECT id, parent_id, folder, name, web_url, {AS_OF}, modified_ms, 'failed', 3 FROM a WHERE action = 'unsupported'
    UNION ALL SELECT id, parent_id, 'c-' || parent_id, s_name, CASE WHEN s_collection LIKE 'old%' THEN 'https://s/' || parent_id || '/' || id ELSE s_web_url END, s_upserted_ms, s_modified_ms, s_status, s_retry FROM a WHERE action IN ('none', 'same'))"""
_OLD_CHUNKS = _own(CHUNKS)

QUERIES = {f.__name__: f for f in (connector_chunks, connector_states, connector_folders, connector_results)}
ORACLE_SQL = {
    "connector_states": f"{_SQL} SELECT * FROM ns",
    "connector_folders": f"{_SQL} SELECT f.id, f.name, f.web_url, CASE WHEN coalesce(bool_or(ns.status = 'failed'), false) THEN 'failed' ELSE 'successful' END AS status FROM ({_own(FOLDERS)}) f LEFT JOIN ns ON ns.parent_id = f.id GROUP BY f.id, f.name, f.web_url",
    "connector_results": f"""{_SQL} SELECT CASE action WHEN 'none' THEN 'no change' ELSE 'upserted' END AS action, id, folder AS collection, name FROM a WHERE action IN ('none', 'upsert')
      UNION ALL SELECT 'removed', id, s_collection, s_name FROM a WHERE action = 'remove' UNION ALL SELECT 'removed', id, 'Gone', name FROM s0 WHERE parent_id = 'gone'""",
    "connector_chunks": f"""{_SQL}, o AS (SELECT * FROM ({_OLD_CHUNKS}) WHERE parent_id <> 'gone' AND doc_id NOT IN (SELECT id FROM a WHERE action = 'remove')),
      g AS (SELECT * FROM t WHERE NOT bad), n AS (SELECT g.*, unnest(['first', CASE WHEN id % 3 = 0 THEN 'third' ELSE 'second' END, 'second']) || ' ' || md5(text) AS content FROM g JOIN documents ON doc_id = id)
      SELECT doc_id, parent_id, 'c-' || parent_id AS collection, title, CASE WHEN collection LIKE 'old%' THEN 'https://s/' || parent_id || '/' || doc_id ELSE web_url END AS web_url, content, false AS embedded FROM o WHERE doc_id NOT IN (SELECT id FROM g)
      UNION ALL SELECT id, parent_id, folder, name, web_url, content, id NOT IN (SELECT doc_id FROM o) OR content LIKE 'third%' FROM n""",
}
