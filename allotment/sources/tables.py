"""Table scans with explicit schemas, and the games defined on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allotment.operators.players import number_players
from allotment.operators.skew import Split

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan a parquet table with its declared schema (no inference pass)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def customer_orders(spark: SparkSession, folder: str) -> Split:
    """Game = customer, players = the customer's orders; cost and weight in whole thousands.

    The orders of a customer share a charge set by the dearest one (cost), and vote with
    their price for the customer's priority (weight, quota = majority).
    """
    raw = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("game_id"), "o_orderkey",
        F.floor(F.col("o_totalprice") / 1000).cast("bigint").alias("cost"),
    )
    weight = F.col("cost")
    numbered = number_players(raw, ["o_orderkey"], {"total": F.sum("cost")})
    return numbered.map(lambda df, hot: df.select(
        "game_id", "player", "n", "o_orderkey", "cost", weight.alias("weight"), "total",
        (F.floor(F.col("total") / 2) + 1).alias("quota")))


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def order_lines(spark: SparkSession, folder: str) -> Split:
    """Game = order, players = its lines; cost = extended price in cents."""
    raw = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("game_id"), *LINE_ORDER,
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cost"))
    return number_players(raw, LINE_ORDER).map(lambda df, hot: df.select("game_id", "player", "n", "cost"))


def first_bytes(name: str) -> Column:
    """A number that orders strings by their first four bytes: the leading, numeric key before the string itself."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(name, "utf-8"), 1, 4)), 8, "0"), 16, 10).cast("bigint")


def at_least(players: Split, least: int) -> Split:
    """Games inside a method's domain; the others are reported by the plan tables."""
    return players.map(lambda df, hot: df.where(F.col("n") >= least))


def customer_priorities(spark: SparkSession, folder: str) -> Split:
    """Game = customer, players = the priorities it orders with (at most five), weight = its orders there."""
    raw = table(spark, folder, "orders").groupBy(
        F.col("o_custkey").alias("game_id"), F.col("o_orderpriority").alias("priority")
    ).agg(F.count(F.lit(1)).alias("weight"), F.sum(F.floor(F.col("o_totalprice") / 1000).cast("bigint")).alias("cost"))
    numbered = number_players(raw.withColumn("code", first_bytes("priority")), ["code", "priority"], {"total": F.sum("weight")})
    return numbered.map(lambda df, hot: df.select(
        "game_id", "player", "n", "priority", "weight", "cost", "total", (F.floor(F.col("total") / 2) + 1).alias("quota")))


def daily_channels(spark: SparkSession, folder: str) -> DataFrame:
    """Event channels per user and day: (game_id = user, term_id = day, channel, part in cents)."""
    events = table(spark, folder, "events")
    return events.groupBy(F.col("user_id").alias("game_id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("term_id"),
                          F.col("event_type").alias("channel")).agg(
        F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("part"))


def channel_game(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(players, terms): game = user, player = channel by name, a term = the channels of one day."""
    from allotment.operators.interactions import terms_of
    days = daily_channels(spark, folder)
    channels = days.groupBy("game_id", "channel").agg(F.sum("part").alias("coef"))
    coded = channels.withColumn("code", first_bytes("channel"))
    players = number_players(coded, ["code", "channel"]).rows().select("game_id", "player", "n", "channel", "coef")
    pairs = days.join(players.select("game_id", "channel", "player"), ["game_id", "channel"])
    return players, terms_of(pairs.select("game_id", "term_id", "player", "part"))


def supplier_baskets(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of one game over suppliers: an order pays its revenue (cents) once all its suppliers are in."""
    from allotment.operators.interactions import terms_of
    lines = table(spark, folder, "lineitem").select(
        F.lit(0).cast("bigint").alias("game_id"), F.col("l_orderkey").alias("term_id"), F.col("l_suppkey").cast("int").alias("player"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("part"))
    return terms_of(lines.groupBy("game_id", "term_id", "player").agg(F.sum("part").alias("part")))
