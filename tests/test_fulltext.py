"""The full-text query reads the documents' own text."""

from metasieve.plans.queries import fulltext_filter


def test_a_document_without_text_has_no_full_text(spark, tmp_path):
    docs = [(1, "whole text"), (2, ""), (3, None), (6, "text")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 0) for d, _ in docs], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.study_id: (r.decision, r.reason) for r in fulltext_filter(spark, str(tmp_path)).collect()}
    none = ("include", "no full text available")
    assert got == {1: ("exclude", None), 2: none, 3: none, 6: none}
