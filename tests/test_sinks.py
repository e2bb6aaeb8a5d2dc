"""Writers under skew."""

import pytest
from pyspark.sql import functions as F

from ribeira.session import materialize, work_dir
from ribeira.sources.sinks import write_partitioned


def test_a_large_partition_value_is_split(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 20)).alias("mun"),
        F.sha2(F.col("id").cast("string"), 256).alias("value"),
    )
    spark.conf.set(key, "1MB")
    try:
        write_partitioned(rows, str(tmp_path / "out"), "mun")
    finally:
        spark.conf.unset(key)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "out").iterdir() if d.is_dir()}
    assert files.pop("mun=hot") > 2
    # A small value is split only if it shares a shuffle partition with the large one.
    assert len(files) == 10 and sorted(files.values())[5] <= 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200_000


def test_work_tables_lie_in_the_checkpoint_folder(spark):
    first, second = work_dir(spark, "t"), work_dir(spark, "t")
    assert first != second and first.startswith(spark.conf.get("spark.checkpoint.dir", "/").rstrip("/"))
    table = materialize(spark.range(3), "t")
    assert table.count() == 3 and "Parquet" in table._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("master, fine", [("local[4]", True), ("local", True), ("yarn", False), ("local-cluster[2,1,1024]", False), ("spark://h:7077", False)])
def test_only_local_sessions_take_a_folder_of_their_own(master, fine):
    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": master}.get(key, default)

    if fine:
        assert work_dir(Session, "t").startswith("/")
    else:
        with pytest.raises(ValueError):
            work_dir(Session, "t")
