from __future__ import annotations

from compare import SF
import corpus_pipeline as C

from marlstone.llm import near_texts, secrets


def test_stages_and_run(spark, tmp_path):
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(C.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if k == 2:
            found = near_texts.near_texts(before)
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({r["component_id"] for r in found.collect()})
        if k == 3:
            assert docs.count() == before.count()
            assert secrets.find_secrets(docs).filter("exists(secrets, s -> s.kind IN ('access', 'hex'))").count() == 0
    assert docs.select("doc_id").distinct().count() == before.count()
    assert sorted(map(str, C.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


def test_near_copies_with_nulls(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, "other words here", "en", "s", 1), (2, text, "en", "s", 1), (3, None, "en", "s", 0), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = C.keep_one_of_near_copies(spark, docs, SF)
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 3]
    assert C.redact_secrets(spark, docs, SF).count() == 6
    assert C.keep_one_of_near_copies(spark, docs.limit(0), SF).count() == 0
