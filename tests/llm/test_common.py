from __future__ import annotations

from pathlib import Path

from glossa.llm.common import dropped, scratch, written


def test_tables_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch(spark, "x") != scratch(spark, "x") and scratch(spark, "x").startswith(base or "file://")
    df, path = written(spark.range(5), "five")
    there = Path(path.removeprefix("file://"))
    assert df.count() == 5 and list(there.glob("*.parquet"))
    dropped(spark, path)
    assert not there.exists()
