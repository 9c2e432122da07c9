"""Reading scripts is stateless, so it also runs over a stream of script files."""

from lineloom.operators.parse import LIGHT, parse_scripts


def test_parse_over_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("gold/f.sql", "SELECT 1 FROM a")], "path string, content string").coalesce(1).write.mode(
        "append"
    ).parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
    q = (
        parse_scripts(stream, columns=LIGHT)
        .writeStream.format("memory")
        .queryName("lineloom_stream")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    assert [r["dependencies"] for r in spark.table("lineloom_stream").collect()] == [["a"]]
