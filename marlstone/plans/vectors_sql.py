"""SQL of the offline embedder's vectors and their cosines, for oracles."""

from __future__ import annotations


def vectors_sql(rows: str, name: str, dimension: int = 64) -> str:
    """The components of HashingEmbedder's vectors of (id, t): <name> (id, d, c) and <name>_n (id, n: the norm)."""
    return f"""{name} AS (SELECT id, d, sum(s) AS c FROM (SELECT id, (h & 2147483647) % {dimension} AS d, CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END AS s
      FROM (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT id, unnest(regexp_extract_all(lower(t), '[^\\x20\\x09-\\x0D]+')) AS w FROM ({rows})))) GROUP BY id, d HAVING sum(s) <> 0),
      {name}_n AS (SELECT id, sqrt(sum(c * c)::DOUBLE) AS n FROM {name} GROUP BY id)"""


def near_sql(queries: str, rows: str) -> str:
    """(q, r, score) of all pairs of two such sets that share a component; others have a cosine of 0."""
    return f"SELECT a.id AS q, b.id AS r, round(sum(a.c * b.c)::DOUBLE / (any_value(an.n) * any_value(bn.n)) + 1, 6) AS score FROM {queries} a JOIN {rows} b USING (d) JOIN {queries}_n an ON an.id = a.id JOIN {rows}_n bn ON bn.id = b.id GROUP BY a.id, b.id"


def all_near_sql(queries: str, rows: str) -> str:
    """``near_sql`` with the pairs that share nothing."""
    return f"SELECT q.id AS q, r.id AS r, coalesce(score, 1.0) AS score FROM {queries}_n q CROSS JOIN {rows}_n r LEFT JOIN ({near_sql(queries, rows)}) n ON n.q = q.id AND n.r = r.id"


def vector_sql(name: str, key: str, dimension: int, text: str) -> str:
    """The whole vector of the row with that key and text in ``vectors_sql``'s set, as a list of whole numbers; null for a text without words."""
    found = f"(SELECT list_transform(range({dimension}), lambda k: coalesce(map_from_entries(list((d, c)))[k], 0)::BIGINT) FROM {name} WHERE {name}.id = {key} HAVING count(*) > 0)"
    return f"CASE WHEN trim({text}) <> '' THEN coalesce({found}, list_transform(range({dimension}), lambda k: 0::BIGINT)) END"
