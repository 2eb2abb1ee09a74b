import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from siftstream.llm import neardup  # noqa: E402


def test_stages_take_effect(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns
        seen.append({r.doc_id: r.text for r in docs.collect()})
    first, second, third = seen
    clean = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in first for i in clean) / len(clean) >= 0.99 and sum(i in first for i, r in labels.items() if r.quality == 0) < 0.1 * sum(r.quality == 0 for r in labels.values())
    assert set(second) == set(first) and any(second[i] != first[i] for i in first)
    assert len(set(third.values())) == len(third) < len(second)
    assert neardup.jaccard_join(docs).where("class_id <> doc_id").count() == 0


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and got.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_rows_apart(spark, tmp_path):
    """Missing and repeated ids, equal texts, null and empty texts, extra columns; and empty tables."""
    near = " ".join(f"word{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(60))
    rows = [(1, "a first text of its own", "en"), (1, "another text under that id", "en"), (None, "a text without an id", None), (None, None, "en"), (2, "", "en"), (3, near, "en"), (3, near, "en"), (4, near + " more", "en"), (None, near, "en"), (5, "x " * 4000, "xx")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash", "clash") for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string, template string")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for some in (docs, docs.limit(0)):
        texts = [r.text for r in some.collect()]
        first = corpus_pipeline.drop_low_quality(spark, some, str(tmp_path))
        assert first.columns == list(corpus_pipeline.COLUMNS) and first.where("lang = 'xx' OR lang IS NULL").count() == sum(t is not None and (t.startswith("x ") or "without" in t) for t in texts)
        second = corpus_pipeline.drop_recurring_lines(spark, some, str(tmp_path))
        assert second.count() == len(texts) and sum((r.text or "").startswith("word") for r in second.collect()) == (3 if texts else 0) and second.where("n_chars <> length(text)").count() == 0
        third = corpus_pipeline.one_of_near_duplicates(spark, some, str(tmp_path))
        kept = sorted(r.text or "" for r in third.collect())
        assert len(kept) == len(set(kept)) and ({t or "" for t in texts} - set(kept)) <= {near, near + " more"}
        last = corpus_pipeline.pack(spark, some, str(tmp_path))
        assert last.where("start = 0").count() == len(texts)
