"""Near-dedup of the pipeline on rows that share an id."""

import corpus_pipeline


def test_rows_that_share_an_id_are_decided_one_by_one(spark, small):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("c")), (3, text("c") + " end"), (4, None), (4, None), (4, ""), (None, text("d")), (None, text("d")), (5, text("d")), (6, text("e"))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup_stage(spark, docs, small)
    assert tuple(got.columns) == corpus_pipeline.COLUMNS
    kept = sorted(((r.doc_id, (r.text or "")[:2]) for r in got.collect()), key=str)
    assert kept == sorted([(1, "aw"), (2, "bw"), (3, "cw"), (4, ""), (4, ""), (4, ""), (None, "dw"), (6, "ew")], key=str)
