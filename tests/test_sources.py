import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from acctpulse.session import materialize, materialize_dealt, parts_for, remove, shared_folder, written
from acctpulse.sources import tables


def test_csv_has_one_row_per_segment_and_a_header(spark, tmp_path):
    df = spark.createDataFrame([("x", 1.5), ("y", None)], "segment_name string, rate double")
    tables.write_csv(df, str(tmp_path / "profile"))
    back = spark.read.option("header", True).csv(str(tmp_path / "profile"))
    assert back.columns == ["segment_name", "rate"] and back.count() == 2


def test_replace_table(spark, tmp_path):
    name = "t_" + uuid.uuid4().hex
    spark.sql(f"CREATE DATABASE IF NOT EXISTS scratch LOCATION '{tmp_path}'")
    for n in (5, 3):
        tables.replace_table(spark.range(n), f"scratch.{name}", "id")
    assert tables.catalog_table(spark, f"scratch.{name}").count() == 3
    assert tables.run_query(spark, f"SELECT max(id) AS m FROM scratch.{name}").first().m == 2


def test_parquet_round_trip(spark, tmp_path):
    tables.write_parquet(spark.range(4), str(tmp_path / "p.parquet"))
    assert tables.read_table(spark, str(tmp_path), "p").count() == 4


class _Session:
    """Stands in for a session with given settings."""

    def __init__(self, master, folder=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.folder = master, folder

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" and self.folder else "file:/warehouse" if "warehouse" in key else default


def test_shared_folder_is_the_one_the_cluster_names():
    assert shared_folder(_Session("yarn", "s3a://bucket/x")) == "s3a://bucket/x"
    assert shared_folder(_Session("local[2]")) == "file:/warehouse/_acctpulse"
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(_Session(master))


def test_materialized_table_reads_back(spark):
    df = materialize(spark.range(10).withColumn("x", F.col("id") * 2), "numbers")
    assert df.filter("x > 10").count() == 4
    assert "/numbers-" in df.inputFiles()[0]
    path = lambda url: url.removeprefix("file:").lstrip("/")
    assert path(df.inputFiles()[0]).startswith(path(shared_folder(spark)) + "/")


def test_dealt_tables_are_grouped_and_joined_without_a_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 50).alias("a"), (F.col("id") % 7).alias("d"), "id")
    before = written(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, two = (materialize_dealt(rows, name, 6, "a") for name in ("one", "two"))
        days = two.groupBy("a", "d").agg(F.count("id").alias("n"))
        df = one.join(days, ["a", "d"], "left").withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("id")))
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 1000 and df.filter("n is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert all(f.startswith("file:") and "/one_" in f for f in one.inputFiles())
    tables_before = len(spark.catalog.listTables())
    remove(spark, [p for p in written(spark) if p not in before])
    assert written(spark) == before and len(spark.catalog.listTables()) == tables_before - 2


def test_parts_grow_with_the_files(spark, data):
    df = tables.read_table(spark, data, "lineitem")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts_for(df, mb=10**6) == least
    assert parts_for(df, df, mb=0.001) > least


def test_projection_and_filter_reach_the_scan(spark, data):
    df = tables.read_table(spark, data, "orders").filter("o_totalprice > 1000").select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000" in plan
    assert "o_orderpriority" not in plan
