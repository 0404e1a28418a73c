from strandloom.streaming.lines import load_lines


def test_lines_are_sorted_out_as_they_come(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    for k, text in enumerate(("1\ts\texon\t5\t9\t.\t+\t.\ta 1\n# x\n", "broken\n1\ts\texon\t0\t9\t.\t+\t.\ta 1\n")):
        (tmp_path / "in" / f"{k}.gtf").write_text(text)
        load_lines(spark, str(tmp_path / "in"), good, bad, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(good).count() == 1
    assert sorted(r["reasons"][0] for r in spark.read.parquet(bad).collect()) == ["column_count", "start"]
