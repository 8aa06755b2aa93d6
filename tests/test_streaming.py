from bytequarry.streaming import byte_stream


def test_a_stream_of_chunks_equals_its_batch(spark, tmp_path):
    rows = [(i % 3, bytearray(bytes([i % 7, i % 5, 65]) * (i + 1))) for i in range(30)]
    chunks = spark.createDataFrame(rows, "blob_id int, data binary")
    chunks.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = byte_stream.running_histograms(stream).writeStream.outputMode("complete").format("memory").queryName("hist").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.sql("select blob_id, byte, n from hist").collect()}
    assert got == {tuple(r) for r in byte_stream.running_histograms(chunks).collect()}
    stats = byte_stream.histogram_statistics(spark.table("hist")).collect()
    assert sum(r["n_bytes"] for r in stats) == sum(len(d) for _, d in rows)
    assert all(0 < r["entropy"] <= 8 for r in stats)
