from lamina import streaming


def test_latest_answers(spark, tmp_path):
    spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid")], "id string, request int, answer string").write.parquet(str(tmp_path / "in"))
    s = streaming.drop_folder(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    q = streaming.latest_answers(s, "id", "request", ["answer"]).writeStream.outputMode("complete").format("memory").queryName("answers").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.request, r.answer) for r in spark.table("answers").collect()] == [(3, "new")]
