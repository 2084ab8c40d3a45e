"""Secret scan by a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query (an OR of ANDs) that every match
must satisfy. The postings of the trigrams that the queries name are intersected to get the candidate rows of
each rule, and candidates are verified with the regular expression itself. Rules without a mandatory
trigram are verified on every row. All of it is DataFrame functions.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if group ``group`` of it has at least ``least`` characters. Patterns use what
    Java, RE2 and Python read alike, but for groups that hold on to what they took (``)*+``), which RE2 needs not and the SQL writes ``)*``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), _either_case("api") + "_?" + _either_case("key")])

#: The kinds whose spans make up the base digest, in listed order.
BASE_RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # the runs of AKIA[A-Z0-9]+ with 20 characters or more
    Rule("hex", r"[0-9a-f]{24,}"),
)
_GAP, _LINE = r"[\x20\t\r\n\\]", r"[A-Za-z0-9+/]{16,}={0,2}"
#: From a private key's header over its body, however long, to the END line, with no other such line between; where END is missing, over
#: all lines of base64 that follow and a short last one. What repeats never has to give way to what comes after it, so it may hold on to
#: what it took (``*+``): Java's matcher then goes over it in a loop, where ``*`` would nest by the line.
_PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{_GAP}*(?:Proc-Type|DEK-Info):[^\n]{{0,80}}){{0,8}}{_GAP}*{_LINE}(?:{_GAP}+{_LINE})*+(?:{_GAP}+[A-Za-z0-9+/]{{1,15}}={{0,2}})?|)"
)
MORE_RULES = (
    Rule("private_key", _PRIVATE_KEY),
    Rule("code_host", r"gh[opsru]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES


# ---------------------------------------------------------------- trigram queries

#: OR of ANDs: a set of clauses, each a set of trigrams. ANY holds for every text.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
_MOST = 64


def _simple(clauses) -> Query:
    clauses = set(clauses)
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _and(a: Query, b: Query) -> Query:
    made = _simple(x | y for x in a for y in b)
    return made if len(made) <= _MOST else a


def _of_strings(strings: set[str]) -> Query:
    return _simple(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(items) -> tuple[set[str] | None, Query]:
    """The strings that the items match, if few and known, and the query of what else must be there."""
    query, run, exact = ANY, {""}, True

    def stop() -> None:
        nonlocal query, run, exact
        query, run, exact = _and(query, _of_strings(run)), {""}, False

    for op, arg in items:
        strings: set[str] | None = None
        inner, low, high = ANY, 1, 1
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, sub = arg
            strings, inner = _walk(sub)
        elif op is sre.LITERAL:
            strings = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            strings = {chr(c).lower() for _, c in arg}
        elif op is sre.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
            inner = _simple(c for s, q in parts for c in (q if s is None else _of_strings(s)))
        if strings is not None and (low, high) == (0, 1):
            strings = strings | {""}
        if strings is not None and high == 1 and len(run) * len(strings) <= _MOST:
            run = {a + b for a, b in product(run, strings)}
            continue
        if strings is not None and low >= 1 and len(run) * len(strings) <= _MOST:
            run = {a + b for a, b in product(run, strings)}
        stop()
        if low >= 1:
            query = _and(query, inner if strings is None else _of_strings(strings))
    if exact:
        return run, ANY
    stop()
    return None, query


def trigram_query(pattern: str) -> Query:
    """The clauses of lower-cased trigrams of which every match's text has at least one in full; ANY if none is mandatory."""
    strings, query = _walk(sre_parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


# ---------------------------------------------------------------- candidates and spans

_KEY, _TEXT, _RULES = "_secret_key", "_secret_text", "_secret_rules"


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of the named trigrams: (trigram, row key)."""
    folded = F.translate(F.col(_TEXT), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    with_folded = rows.select(_KEY, folded.alias("folded"))
    has = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in trigrams]))
    return with_folded.select(_KEY, F.explode(has).alias("trigram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(row key, kinds whose trigram query the row meets) from the intersected postings; None if no rule has a query."""
    clauses = [(r.kind, k, t, len(c)) for r in rules if (q := trigram_query(r.pattern)) != ANY for k, c in enumerate(sorted(q, key=sorted)) for t in sorted(c)]
    if not clauses:
        return None
    # As many rows as the rules have trigrams, whatever the corpus.
    asked = F.broadcast(rows.sparkSession.createDataFrame(clauses, "kind string, clause int, trigram string, size int"))
    met = postings(rows, sorted({c[2] for c in clauses})).join(asked, "trigram").groupBy(_KEY, "kind", "clause", "size").agg(F.count_distinct("trigram").alias("n")).filter("n = size")
    return met.groupBy(_KEY).agg(F.collect_set("kind").alias(_RULES))


def _spans(rule: Rule, order: int) -> Column:
    """The rule's leftmost non-overlapping matches in the text: structs of start, place in the list, end and kind, in code points."""
    text, pattern = F.col(_TEXT), F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else F.transform(hits, F.length)
    both = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), F.transform(hits, F.length).alias("hit"), counted.alias("counted"))
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["hit"], F.lit(0))
        found = F.struct(start.alias("start"), F.lit(order).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["counted"] >= max(rule.least, 1), F.concat(state["found"], F.array(found))).otherwise(state["found"]).alias("found"))

    walked = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda s: s["found"])
    return F.when(text.rlike(rule.pattern), walked).otherwise(none)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """The ``keep`` columns of every row and ``secrets``: its matches as structs of kind, start and end
    (code points, end exclusive) by start and then by the rules' order.

    Null and empty texts have no secrets; repeated rows and null ids each keep their row; columns outside ``keep`` are
    dropped, so their names do not matter. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("_kept"), text_of(docs).alias(_TEXT), F.xxhash64(docs["doc_id"], docs["text"]).alias(_KEY))
    met = candidates(rows, rules)
    if met is None:
        marked = rows.withColumn(_RULES, F.array().cast("array<string>"))
    else:
        marked = rows.join(met.hint("shuffle_hash"), _KEY, "left")
    open_kinds = {r.kind for r in rules if trigram_query(r.pattern) == ANY}
    found = [
        _spans(r, k) if r.kind in open_kinds else F.when(F.array_contains(_RULES, r.kind), _spans(r, k)).otherwise(F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>"))
        for k, r in enumerate(rules)
    ]
    spans = F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return marked.select("_kept.*", spans.alias("secrets"))


def redact(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones as one, replaced by a mark."""

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], gap, F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(x["end"], s["at"]).alias("at"), out.alias("out"))

    whole = F.aggregate(secrets, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(secrets) > 0, whole).otherwise(text)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all of ``documents``; see find_secrets."""
    base = [r.kind for r in BASE_RULES]
    found = find_secrets(read_table(spark, sf_dir, "documents"), RULES, ("doc_id",))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(line(F.filter("secrets", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"),
    )


def _oracle() -> str:
    quoted = lambda s: s.replace("'", "''").replace(r"\x20", " ").replace(")*+", ")*")
    one = "SELECT doc_id, '{kind}' AS kind, {k} AS place, {least} AS least, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS counted, regexp_split_to_array(t, '{p}') AS gaps FROM d"
    raw = " UNION ALL ".join(one.format(kind=r.kind, k=k, least=max(r.least, 1), p=quoted(r.pattern), group=r.group) for k, r in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
each AS (SELECT doc_id, kind, place, least, hits, counted, gaps, unnest(range(1, len(hits) + 1)) AS k FROM raw),
spans AS (
  SELECT doc_id, kind, place,
    (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0))::BIGINT AS s, length(hits[k]) AS n
  FROM each WHERE length(counted[k]) >= least),
lines AS (
  SELECT doc_id, {counts},
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) FILTER (WHERE place < {len(BASE_RULES)}) AS base,
    string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, place) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lines USING (doc_id)"""


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLE_SQL = {"op8_secret_scan": _oracle()}
