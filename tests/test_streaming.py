from storelens.streaming import changes


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name).collect()


def test_records(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("pr_id\tmerged_at\tstage\tbase\tto\n1\t2020\tpre\tm\td\n# x\n\n2\t2020\tmid\tm\td\n")
    (tmp_path / "b.tsv").write_text("3\t2020\tpost\tm\td\n4\t2020\n")
    got = sorted((r.pr_id, r.problem) for r in run(changes.records(spark, str(tmp_path)), "records", "append"))
    assert got == [("1", None), ("2", "stage must be pre or post"), ("3", None), ("4", "needs five tab-separated columns")]


def test_windows(spark, tmp_path):
    rows = [("2020-01-02 00:00:00", "a", 5), ("2020-01-03 00:00:00", "a", 5), ("2020-01-04 00:00:00", "b", 7), ("2020-06-01 00:00:00", "c", 1), ("2020-09-01 00:00:00", "d", 1)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, blob string, size bigint").selectExpr("CAST(ts AS timestamp) AS ts", "blob", "size").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("ts timestamp, blob string, size bigint").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = run(changes.introduced_by_window(stream), "windows", "append")
    assert sum(r.introduced_bytes for r in got) <= 13 and all(r.blobs >= 1 for r in got)
    assert any(r.introduced_bytes == 12 and r.blobs == 2 for r in got)
