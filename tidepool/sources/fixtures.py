"""Views of the supplied TPC-H-like tables in the shape of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import shuffle_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as events: customers are users, parts are items, the return flag is the event type."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    event = (
        F.when(F.col("l_returnflag") == "N", "view").when(F.col("l_returnflag") == "A", "addtocart").otherwise("transaction")
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), event.alias("event"),
        F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("tb1"), F.col("l_linenumber").alias("tb2"),
    )


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log: the item is the number in ``props``; sign-ups and errors keep their unweighted type."""
    raw = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    event = F.when(kind == "click", "addtocart").when(kind == "purchase", "transaction").otherwise(kind)
    return raw.select(
        "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), event.alias("event"),
        "ts", F.col("event_id").alias("tb1"),
    )


def part_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part attributes as property rows without a time; ``sku`` is unique and ``active`` is everywhere.

    The file is small for its rows, so parts are dealt over tasks before each becomes seven rows.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name")
    part = part.repartition(shuffle_partitions(spark), "p_partkey")
    values = {
        "brand": F.col("p_brand"), "type": F.col("p_type"), "size": F.col("p_size").cast("string"), "name": F.col("p_name"),
        "categoryid": F.concat_ws("/", "p_type", "p_brand"), "sku": F.col("p_partkey").cast("string"), "active": F.lit("1"),
    }
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("property"), v.alias("value")) for k, v in values.items()]))
    return part.select(F.col("p_partkey").alias("item_id"), entries.alias("e")).select("item_id", "e.property", "e.value")


def line_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a property log with many versions and nulls."""
    lines = table(spark, sf_dir, "lineitem")
    entries = F.explode(
        F.array(
            F.struct(F.lit("returnflag").alias("property"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("value")),
            F.struct(F.lit("linestatus").alias("property"), F.col("l_linestatus").alias("value")),
        )
    )
    return lines.select(
        F.col("l_partkey").alias("item_id"), entries.alias("e"), F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("tb1"), F.col("l_linenumber").alias("tb2"),
    ).select("item_id", "e.property", "e.value", "ts", "tb1", "tb2")


def part_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """type/brand under type under ALL."""
    part = table(spark, sf_dir, "part")
    leaf = part.select(F.concat_ws("/", "p_type", "p_brand").alias("child"), F.col("p_type").alias("parent")).distinct()
    middle = part.select(F.col("p_type").alias("child"), F.lit("ALL").alias("parent")).distinct()
    root = part.select(F.lit("ALL").alias("child"), F.lit(None).cast("string").alias("parent")).distinct()
    return leaf.unionByName(middle).unionByName(root)


def place_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under nations under regions: several roots."""
    supplier, nation, region = (table(spark, sf_dir, name) for name in ("supplier", "nation", "region"))

    def tag(letter: str, column: str):
        return F.concat(F.lit(letter), F.col(column).cast("string"))

    low = supplier.select(tag("S", "s_suppkey").alias("child"), tag("N", "s_nationkey").alias("parent"))
    middle = nation.select(tag("N", "n_nationkey").alias("child"), tag("R", "n_regionkey").alias("parent"))
    top = region.select(tag("R", "r_regionkey").alias("child"), F.lit(None).cast("string").alias("parent"))
    return low.unionByName(middle).unionByName(top)


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings")
    return raw.select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vec"))
