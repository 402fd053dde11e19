"""The pipeline's stages on odd rows, and its rows against the stages' own decisions."""

import corpus_pipeline

TINY = "/root/testdata/sf0.001"


def test_names_and_columns(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "personal_data", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, TINY).columns == docs.columns
        assert stage(spark, docs.limit(0), TINY).count() == 0


def test_run_packs_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, TINY)
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
    assert len(ids) == len(set(ids)) < docs.count()
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, TINY).filter("piece = 0").collect()) == ids


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (3, "A b c d"), (3, "A b c d"), (None, "a b c d"), (None, "x y z w"), (None, "x y z w"), (None, "k l m n"), (9, None), (8, "")]
    docs = spark.createDataFrame([(*r, "key", "row", 7) for r in rows], "doc_id long, text string, key string, row string, n_chars int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, TINY)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == [("3", "A b c d"), ("8", ""), ("None", "k l m n"), ("None", "x y z w")]


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None), (2, ""), (None, None), (4, "word " * 30_000), (4, "word " * 30_000)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, TINY).collect()
        if name == "near_duplicates":  # null and empty texts share the fingerprint 0; the repeated row is one of two
            assert sorted(r.doc_id for r in got) == [1, 4]
        elif name == "personal_data":
            assert sorted(map(str, got)) == sorted(map(str, docs.selectExpr("doc_id", "text", "lang", "source", "char_length(text) n_chars").collect()))
        elif name == "packing":
            assert sum(r.piece == 0 for r in got) == len(rows)
        else:
            assert {str(r.doc_id) for r in got} <= {"1", "2", "4", "None"}
