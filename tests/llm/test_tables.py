from pagelattice.llm import common


def test_only_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert common.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(common, "SMALL_TABLE", 10)
    assert common.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 1
