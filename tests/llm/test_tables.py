"""Written tables of the training-text operators."""

from grainsieve.llm.tables import Workspace


def test_written_tables_are_packed(spark):
    space = Workspace(spark, "packed")
    table = space.write(spark.range(100).selectExpr("id", "repeat('some text ', 20) AS text"), "texts")
    assert table.count() == 100
    assert all(name.endswith(".zstd.parquet") for name in table.inputFiles())
