from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from compare import SF
from pyspark.sql import functions as F

from marlstone.llm import fingerprints as P


def weights(text):
    words = [w for w in re.split(r"[ \t-\r]+", text) if w]
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def jaccard(a, b):
    a, b = Counter(a), Counter(b)
    both = set(a) | set(b)
    return sum(min(a[x], b[x]) for x in both) / sum(max(a[x], b[x]) for x in both) if both else 1.0


def test_against_exact_similarity(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in P.op1_document_fingerprints(spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in rows}
    off, by_text = [], {}
    for k, r in enumerate(rows):
        text, after = r["text"], rows[(k + 1) % len(rows)]["text"]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        x = got[r["doc_id"]]
        assert x["n_chars"] == len(text) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, x["fingerprint"]) == x["fingerprint"]
        off.append(x["near_edited"] - jaccard(weights(text), weights(edited)))
        assert abs(x["near_next"] - jaccard(weights(text), weights(after))) < 0.3
    assert abs(sum(off)) / len(off) < 0.02 and sum(x * x for x in off) / len(off) < 0.08**2


def test_weights_count(spark):
    """Texts of the same terms and other counts: the collision rate is that of the generalised similarity."""
    rows = [(i, " ".join(f"w{i}x{k}a w{i}x{k}b w{i}x{k}c w{i}x{k}d w{i}x{k}e" for k in range(40)), "") for i in range(20)]
    lines = [(i, " ".join([t] * 3), " ".join([t] * 2)) for i, t, _ in rows]
    got = spark.createDataFrame(lines, "i int, a string, b string").select("a", "b", P.likeness(P.slots(F.col("a")), P.slots(F.col("b"))).alias("near")).collect()
    want = sum(jaccard(weights(r["a"]), weights(r["b"])) for r in got) / len(got)
    assert abs(sum(r["near"] for r in got) / len(got) - want) < 0.05


def test_uneven_weights(spark):
    """The collision rate is that of the generalised similarity when weights are from 1 to 1,000."""
    rng = random.Random(5)
    cases = []
    for kind in range(6):
        a = {f"t{kind}x{k}": rng.choice((1, 2, 5, 30, 1000)) if kind else 900 * (k == 0) + 1 for k in range(40)}
        b = {x: max(1, int(n * rng.choice((0.1, 0.5, 1, 1, 2)))) if kind else 1 + 90 * (x == "t0x0") for x, n in a.items()}
        b |= {f"t{kind}y{k}": 3 for k in range(kind)}
        cases.append((kind, a, b))
    one = [(kind, " ".join(f"{x}" for t, n in w.items() for x in [t] * n), side) for kind, a, b in cases for side, w in (("a", a), ("b", b))]
    rows = spark.createDataFrame(one, "kind int, text string, side string").withColumn("made", P.slots_of(F.transform(F.split("text", " "), lambda w: F.xxhash64(w))))
    pairs = rows.filter("side = 'a'").alias("x").join(rows.filter("side = 'b'").alias("y"), "kind").select("kind", P.likeness(F.col("x.made"), F.col("y.made")).alias("near"))
    got = {r["kind"]: r["near"] for r in pairs.collect()}
    for kind, a, b in cases:
        assert abs(got[kind] - jaccard(a, b)) < 0.16, (kind, got[kind], jaccard(a, b))
    assert abs(sum(got[k] - jaccard(a, b) for k, a, b in cases)) / len(cases) < 0.06


def test_one_line_rules(spark):
    """The same line 900 times against 90 times, among other lines; and a few others against one."""
    heavy, light = "one two three four five", [f"a{k} b{k} c{k} d{k} e{k}" for k in range(95)]
    pairs = [(" ".join([heavy] * 900 + light), " ".join([heavy] * 90 + light)), (" ".join([heavy] * 900 + light), " ".join([heavy] * 900 + [x.upper() for x in light]))]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", P.likeness(P.slots(F.col("a")), P.slots(F.col("b"))).alias("near")).collect()
    for r in got:
        assert abs(r["near"] - jaccard(weights(r["a"]), weights(r["b"]))) < 0.16


def test_odd_rows(odd, none):
    got = P.fingerprint_documents(odd).collect()
    assert len(got) == odd.count()
    seven = [r for r in got if r["doc_id"] == 7]
    assert len(seven) == 2 and seven[0] == seven[1]
    assert {r["n_chars"] for r in got if r["doc_id"] in (3, 4)} == {0}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    assert P.fingerprint_documents(none).count() == 0
    assert P.fingerprint_documents(odd.limit(1)).count() == 1
