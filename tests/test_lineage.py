from pathlib import Path

from pyspark.sql import functions as F

from qaloom.operators.lineage import cut, release, scratch


def test_cut_rows_are_read_from_files_and_released(spark):
    df = spark.range(100).select("id", F.array("id").alias("a"), F.lit(None).cast("decimal(38,0)").alias("d"))
    out = cut(df)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [(f.name, f.dataType.simpleString()) for f in df.schema]
    assert out.exceptAll(df).isEmpty() and out.count() == 100
    folder = Path(out._cut_folder.removeprefix("file:"))
    assert folder.exists()
    release(out)
    release(df)  # not a cut frame
    assert not folder.exists()
    assert cut(df.limit(0)).count() == 0


def test_folders_are_fresh(spark):
    assert scratch(spark, "x") != scratch(spark, "x")
