"""The pipeline's stages on the small tables."""

from collections import Counter

import corpus_pipeline
from edge_rows import documents, labels


def test_stages_follow_each_other(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    kept = {r[0] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, data).cache()
        counts.append(docs.count())
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert now <= kept
        kept = now
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[3] < counts[2] and counts[5] == counts[4] > 0
    assert docs.where("not decoded_ok").count() == 0


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def clean(k):
    return " ".join(f"w{k}x{i}" for i in range(30))


def counted(docs):
    return Counter((r["doc_id"], r["text"]) for r in docs.collect())


def test_row_wise_stages_keep_null_and_repeated_ids(spark, tmp_path):
    labels(spark, True).write.parquet(f"{tmp_path}/labels.parquet")
    docs = documents(spark).select(*corpus_pipeline.COLUMNS)
    assert counted(corpus_pipeline.quality(spark, docs, str(tmp_path))) == counted(docs)
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    assert ids(corpus_pipeline.encoded(spark, docs, "")) == ids(docs)
    plain = [(k, "the weather is fine and the words are plain", "en", "s", 1) for k in (1, 1, 2, 3, 4, 5, None, None)]
    plain = spark.createDataFrame(plain, DOC)
    assert counted(corpus_pipeline.languages(spark, plain, "")) == counted(plain)


def test_near_duplicates_keeps_what_is_not_linked(spark):
    rows = [(None, clean(0)), (None, clean(1)), (None, clean(0)), (7, clean(2)), (7, clean(3)), (7, clean(3)), (5, clean(3) + " more"), (8, None), (8, None), (9, clean(4)), (10, clean(4) + " more")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOC)
    want = Counter([(None, clean(0)), (None, clean(1)), (None, clean(0)), (7, clean(2)), (5, clean(3) + " more"), (8, None), (9, clean(4))])
    assert counted(corpus_pipeline.near_duplicates(spark, docs, "")) == want
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_mix_takes_null_and_repeated_ids(spark):
    """Every text is taken once, as one source is the whole mix; repeats at most three times each."""
    rows = [(None, clean(0)), (None, clean(1)), (7, clean(2)), (7, clean(3)), (7, clean(3)), *((k, clean(k)) for k in range(20, 60))]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOC)
    assert counted(corpus_pipeline.mixed(spark, docs, "")) == counted(docs)
    small = spark.createDataFrame([(k, t, "en", "a" if k == 7 else "b", 1) for k, t in rows], DOC)
    got, had = counted(corpus_pipeline.mixed(spark, small, "")), counted(small)
    assert all(n <= 3 * had[k] for k, n in got.items()) and got[(7, clean(3))] == 6 and got[(7, clean(2))] == 3
    assert corpus_pipeline.mixed(spark, docs.limit(0), "").count() == 0
