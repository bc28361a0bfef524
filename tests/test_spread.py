"""Shuffles whose number of tasks follows the input."""

from pyspark.sql import functions as F

from mealops.functions import spread as spread_mod
from mealops.operators import quality, stock

N = 1_500_000


def _lines(spark, tmp_path):
    """Order lines over many orders, products without a pattern: their columns hardly compress."""
    path = str(tmp_path / "lines")
    spark.range(N).select(F.xxhash64("id").alias("order_id"), F.xxhash64("id", F.lit(1)).alias("product_id"),
                          F.lit(2).alias("quantity")).write.parquet(path)
    return spark.read.parquet(path)


def test_bom_tasks_follow_the_lines(spark, tmp_path):
    lines = _lines(spark, tmp_path)
    orders = lines.select("order_id", F.lit("preparing").alias("status"))
    bom = lines.select("product_id", F.col("product_id").alias("inventory_id"), F.lit("0.05").cast("decimal(3,2)").alias("qty_per_portion"))
    need = stock.bom_explosion(orders, lines, bom, lines.select(F.col("product_id").alias("inventory_id")))
    got = need.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("need").alias("s")).collect()
    assert sum(r.n for r in got) == N and sum(r.s for r in got) == N // 10
    assert max(r.n for r in got) < N / 12


def test_orphan_tasks_follow_the_references(spark, tmp_path):
    lines = _lines(spark, tmp_path)
    orders = lines.where("order_id % 2 = 0").select("order_id")
    frames = {"order_items": lines.withColumn("line_no", F.lit(1)), "orders": orders}
    [out] = quality.orphan_check(frames, [("order_items", ["order_id"], "orders", ["order_id"], ["order_id", "line_no"])])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert out.count() == lines.where("order_id % 2 <> 0").count()


def test_unique_tasks_follow_the_keys(spark, tmp_path):
    lines = _lines(spark, tmp_path)
    keys = lines.selectExpr("order_id AS order_code").unionByName(lines.selectExpr("product_id AS order_code"))
    twice = keys.unionByName(lines.selectExpr("order_id AS order_code").limit(3)).withColumn("order_id", F.col("order_code"))
    out = quality.validate_constraints({"orders": twice}, {"orders": ["order_id"]})
    assert out.where("rule = 'unique_order_code'").count() == 3
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_few_or_unknown_bytes_stay(spark):
    df = spark.range(10)
    assert spread_mod.spread(df, ["id"], [df]) is df
    made = spark.createDataFrame([(1,)], "id long")
    assert spread_mod.spread(made, ["id"], [made]) is made
