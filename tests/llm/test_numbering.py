from collections import Counter

import corpus_pipeline


def test_row_numbers_hold_when_the_scan_is_cut_anew(spark, make, tmp_path):
    make([(i, f"text {i}") for i in range(200)], parts=8).write.parquet(f"{tmp_path}/docs")
    rows = corpus_pipeline._numbered(spark.read.parquet(f"{tmp_path}/docs"))
    before = {r.c0: r.row for r in rows.select("c0", "row").collect()}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        after = {r.c0: r.row for r in rows.select("c0", "row").collect()}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert before == after


def test_mix_does_not_depend_on_where_rows_lie(spark, make, sf_small, tmp_path):
    rows = [(i, f"w{i} " * (3 + i % 2), "en", "ab"[i % 5 == 0]) for i in range(300)]
    taken = []
    for parts in (2, 7):
        make(rows, parts=parts).write.parquet(f"{tmp_path}/{parts}")
        docs = spark.read.parquet(f"{tmp_path}/{parts}")
        taken.append(Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, sf_small).collect()))
    assert taken[0] == taken[1]
