"""Vector search and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..operators import vector as V
from ..operators.many import search_many, word_split_many
from ..session import shaped, table
from .vectors_sql import all_near_sql, vectors_sql


def _vec(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


def kb_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = V.filtered_top_k(rows, _vec(spark, sf_dir, 0), F.col("label") == 3, 30, 1.0)
    return found.select("vec_id", F.col("label").alias("collection"), "score")


def kb_image_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every fourth vector stands for an image's.
    rows = table(spark, sf_dir, "embeddings").withColumn("chunk_type", F.expr("CASE WHEN vec_id % 4 = 1 THEN 'image' ELSE 'text' END"))
    found = V.filtered_top_k(rows, _vec(spark, sf_dir, 1), (F.col("label") == 1) & (F.col("chunk_type") == "image"), 20, 0.8)
    return found.select("vec_id", F.col("label").alias("collection"), "score")


def kb_query_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN ' ' END AS t, CASE WHEN event_id % 4 = 0 THEN props END AS i FROM {events}", "events")
    return rows.select("event_id", V.modality(F.col("t"), F.col("i")).alias("modality"))


def hybrid_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("output", F.expr("CASE WHEN vec_id % 9 != 4 THEN label END"))
    found = V.hybrid_top_k(rows, _vec(spark, sf_dir, 2), ["output"], [2, 5, 11], 20, 2)
    return found.select("vec_id", "label", "score")


def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    a = rows.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"))
    b = rows.select((F.col("vec_id") - 1).alias("a_id"), F.col("vec_id").alias("b_id"), F.col("embedding").alias("b"))
    return a.join(b, "a_id").select("a_id", "b_id", F.round(V.cosine(F.col("a"), F.col("b"), strict=True), 6).alias("cosine"))


def preview_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("identity", F.expr("vec_id % 200"))
    found = V.preview(rows.filter("vec_id < 400"), rows.filter("vec_id >= 400"), rows.filter("vec_id % 10 = 3 AND vec_id < 400").select("vec_id"), _vec(spark, sf_dir, 0), ["identity"], 25)
    return found.select("vec_id", "identity", "source", "score")


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))
    return V.first_by_key(rows, ["lang", "text_md5"], [F.asc("doc_id")])


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    text = V.filtered_top_k(rows, _vec(spark, sf_dir, 0), F.lit(True), 30, 0.0)
    image = V.filtered_top_k(rows, _vec(spark, sf_dir, 1), F.lit(True), 20, 0.0)
    return text.select("vec_id", "score"), image.select("vec_id", "score")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, image = _lists(spark, sf_dir)
    return V.reciprocal_rank_fusion(V.ranked(text), V.ranked(image))


def combined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fused list where both searches find something."""
    return V.combined(*_lists(spark, sf_dir))


def single_list_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text list by its own scores, as no image is near enough."""
    text, image = _lists(spark, sf_dir)
    return V.combined(text, image.filter("score > 5"))


def environment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hybrid search in the staging environment, with more results than near vectors."""
    rows = table(spark, sf_dir, "embeddings")
    stores = {"live": rows.filter("vec_id % 2 = 0"), "staging": rows.filter("vec_id % 2 = 1")}
    query = _vec(spark, sf_dir, 2)
    found = V.searched(stores, "staging", lambda store: V.hybrid_top_k(store, query, ["label"], [3, 7], 150, 1))
    return found.select("vec_id", "label", "score")


def word_split_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("text", F.expr("concat('t', vec_id % 300)"))
    main = V.filtered_top_k(rows, _vec(spark, sf_dir, 0), F.lit(True), 10, 0.0)
    parts = [V.filtered_top_k(rows, _vec(spark, sf_dir, q), F.lit(True), 10, 0.0).withColumn("fragment", F.lit(k)) for k, q in enumerate((1, 2))]
    return V.word_split(main, parts[0].unionByName(parts[1]), 10)


def field_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shaped(spark, sf_dir, "SELECT event_id, event_type AS question, CASE WHEN value > 50 THEN props END AS supplement FROM {events}", "events")
    return rows.filter(F.col("question").isNotNull() & F.col("supplement").isNotNull()).select("event_id", F.col("question").alias("input"), F.col("supplement").alias("supplementary"))


def top_k_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest five of its own collection for every twentieth vector."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding", F.array("vec_id").alias("excluded"))
    return search_many(queries, rows, 5, collection="label", shift=0.0)


def kb_search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector as a query of another collection than its own, with a threshold of its own and some rows left out."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.filter("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), ((F.col("label") + 1) % 10).alias("label"), "embedding", F.when(F.col("vec_id") % 40 == 0, 1.0 + F.col("label") / 100).alias("threshold"),
        F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.col("vec_id") + i).alias("excluded"),
    )
    return search_many(queries, rows, 30, threshold=1.1, collection="label")


def word_split_many_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-split searches of every conversation's first ten words among all messages of other conversations' roles."""
    told = table(spark, sf_dir, "conversations")
    store = models.embedded(told.select((F.col("conv_id") * 1000 + F.col("turn")).alias("vec_id"), F.col("text").alias("question"), "role"), "question", "embedding", models.HashingEmbedder())
    first = F.array_join(F.slice(F.split(F.trim("text"), " +"), 1, 10), " ")
    queries = told.filter("turn = 0").select(F.col("conv_id").alias("query_id"), F.regexp_replace(first, "[^ A-Za-z]", "").alias("query"), F.lit("assistant").alias("role"))
    return word_split_many(queries, store, models.HashingEmbedder(), 7, words=3, collection="role").select("query_id", "rank", "vec_id", "score")


_COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _score(where: str, query: int, shift: str = " + 1", extra: str = "") -> str:
    cos = _COS.format(a="e.embedding", b="q.embedding")
    return f"SELECT e.vec_id, e.label{extra}, round({cos}{shift}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {query}) q WHERE {where}"


_LISTS = f"""t AS (SELECT vec_id, score FROM ({_score("true", 0)}) WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 30),
i AS (SELECT vec_id, score FROM ({_score("true", 1)}) WHERE score >= 0 ORDER BY score DESC, vec_id LIMIT 20)"""

QUERIES = {f.__name__: f for f in (kb_text_search, kb_image_search, kb_query_modality, hybrid_knn, pairwise_cosine, preview_search, dedup_first, rrf_fusion, combined_results, single_list_fallback, environment_search, word_split_search, field_mapping, top_k_per_collection, kb_search_many, word_split_many_queries)}
ORACLE_SQL = {
    "kb_search_many": f"""SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, c.vec_id, round({_COS.format(a='q.embedding', b='c.embedding')} + 1, 6) AS score, CASE WHEN q.vec_id % 40 = 0 THEN 1.0 + q.label / 100 ELSE 1.1 END AS least
      FROM embeddings q JOIN embeddings c ON c.label = (q.label + 1) % 10 AND NOT c.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 30 WHERE q.vec_id % 20 = 0) WHERE score >= least) WHERE rank <= 30""",
    "word_split_many_queries": f"""WITH q AS (SELECT conv_id AS id, regexp_replace(array_to_string(string_split_regex(trim(text), ' +')[1:10], ' '), '[^ A-Za-z]', '', 'g') AS t FROM conversations WHERE turn = 0),
      w AS (SELECT id, t, list_filter(string_split_regex(t, ' +'), lambda x: x <> '') AS words FROM q),
      f AS (SELECT id, k AS nth, array_to_string(words[3 * k + 1 : 3 * k + 3], ' ') AS t FROM w, unnest(range(0, (len(words) + 2) // 3)) u(k)),
      s AS (SELECT conv_id * 1000 + turn AS id, text AS question FROM conversations WHERE role = 'assistant'),
      {vectors_sql("SELECT * FROM q", "qv")}, {vectors_sql("SELECT id * 1000 + nth AS id, t FROM f", "fv")}, {vectors_sql("SELECT id, question AS t FROM s", "sv")},
      all_q AS ({all_near_sql("qv", "sv")}), all_f AS ({all_near_sql("fv", "sv")}),
      m AS (SELECT q, r, score, question, row_number() OVER (PARTITION BY q ORDER BY score DESC, r) AS rank FROM all_q JOIN s ON s.id = r QUALIFY rank <= 7),
      p AS (SELECT q // 1000 AS q, q % 1000 AS nth, r, score, question FROM all_f JOIN s ON s.id = r QUALIFY row_number() OVER (PARTITION BY all_f.q ORDER BY score DESC, r) <= 7),
      o AS (SELECT * FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q, question ORDER BY nth DESC, score DESC, r) = 1) o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.q = o.q AND m.question = o.question)),
      b AS (SELECT q, r, score FROM m WHERE rank <= CASE WHEN q IN (SELECT q FROM p) THEN 4 ELSE 7 END UNION ALL (SELECT q, r, score FROM o WHERE q IN (SELECT q FROM m) QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, r) <= 3))
      SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, r)::INTEGER AS rank, r AS vec_id, score FROM b""",
    "kb_text_search": f"SELECT vec_id, label AS collection, score FROM ({_score('e.label = 3', 0)}) WHERE score >= 1.0 ORDER BY score DESC, vec_id LIMIT 30",
    "kb_image_search": f"SELECT vec_id, label AS collection, score FROM ({_score('e.label = 1 AND e.vec_id % 4 = 1', 1)}) WHERE score >= 0.8 ORDER BY score DESC, vec_id LIMIT 20",
    "kb_query_modality": "SELECT event_id, CASE WHEN event_id % 4 = 0 AND props IS NOT NULL THEN 'image' WHEN event_id % 3 = 0 AND trim(event_type) <> '' THEN 'text' ELSE 'none' END AS modality FROM events",
    "hybrid_knn": f"SELECT vec_id, label, round(2000.0 + 50.0 * (1.0 + score), 6) AS score FROM ({_score('e.vec_id % 9 <> 4 AND e.vec_id NOT IN (2, 5, 11)', 2, '')} ORDER BY score DESC, e.vec_id LIMIT 100) ORDER BY score DESC, vec_id LIMIT 20",
    "pairwise_cosine": f"SELECT a.vec_id AS a_id, b.vec_id AS b_id, round({_COS.format(a='a.embedding', b='b.embedding')}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "preview_search": f"""SELECT vec_id, identity, source, score FROM (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY source, vec_id) AS nth FROM (
      {_score('NOT (e.vec_id % 10 = 3 AND e.vec_id < 400)', 0, '', ', e.vec_id % 200 AS identity, CASE WHEN e.vec_id >= 400 THEN 0 ELSE 1 END AS source')}))
      WHERE nth = 1 ORDER BY score DESC, source, vec_id LIMIT 25""",
    "dedup_first": "SELECT min(doc_id) AS doc_id, lang, arg_min(source, doc_id) AS source, md5(text) AS text_md5 FROM documents GROUP BY lang, md5(text)",
    "rrf_fusion": f"""WITH {_LISTS},
      both_lists AS (SELECT vec_id, 0 AS list, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM t UNION ALL SELECT vec_id, 1, row_number() OVER (ORDER BY score DESC, vec_id) FROM i)
      SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, min(list) AS from_list, arg_min(rank, list)::INTEGER AS first_rank FROM both_lists GROUP BY vec_id""",
    "combined_results": f"""WITH {_LISTS},
      both_lists AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM t UNION ALL SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) FROM i)
      SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM both_lists GROUP BY vec_id""",
    "environment_search": f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS near FROM ({_score('e.vec_id % 2 = 1 AND e.label IS NOT NULL AND e.vec_id NOT IN (3, 7)', 2, '')}))
      (SELECT vec_id, label, round(1000.0 + 50.0 * (1.0 + score), 6) AS score FROM s WHERE near <= 100) UNION ALL (SELECT vec_id, label, 1000.0 FROM s WHERE near > 100 ORDER BY vec_id LIMIT 50)""",
    "single_list_fallback": f"WITH {_LISTS} SELECT vec_id, score FROM t",
    "word_split_search": f"""WITH m AS (SELECT vec_id, text, score FROM ({_score('true', 0, ' + 1', ", concat('t', e.vec_id % 300) AS text")}) ORDER BY score DESC, vec_id LIMIT 10),
      f AS ((SELECT vec_id, text, score, 0 AS fragment FROM ({_score('true', 1, ' + 1', ", concat('t', e.vec_id % 300) AS text")}) ORDER BY score DESC, vec_id LIMIT 10)
            UNION ALL (SELECT vec_id, text, score, 1 AS fragment FROM ({_score('true', 2, ' + 1', ", concat('t', e.vec_id % 300) AS text")}) ORDER BY score DESC, vec_id LIMIT 10)),
      o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY fragment DESC, score DESC, vec_id) AS nth FROM f) WHERE nth = 1 AND text NOT IN (SELECT text FROM m))
      (SELECT vec_id, text, score FROM m ORDER BY score DESC, vec_id LIMIT 5) UNION ALL (SELECT vec_id, text, score FROM o ORDER BY score DESC, vec_id LIMIT 5)""",
    "field_mapping": "SELECT event_id, event_type AS input, props AS supplementary FROM events WHERE event_type IS NOT NULL AND value > 50 AND props IS NOT NULL",
    "top_k_per_collection": f"""SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
      SELECT q.vec_id AS query_id, c.vec_id, round({_COS.format(a='q.embedding', b='c.embedding')}, 6) AS score FROM embeddings q JOIN embeddings c ON c.label = q.label AND c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 5""",
}
