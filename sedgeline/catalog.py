"""Logical relations over the star-schema test tables.

Operators take DataFrames with the columns below, so any source with these names serves; this module only renames.
Owner -> feed -> article is nation -> customer -> orders; job, usage and change events are rows of ``events``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Lazily read relations of one folder; only the columns that a query uses reach the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table's rows dealt evenly to all cores, for queries that make a page of each: its file is small, so that one task
        would read it and parse all the pages."""
        n = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return self.table(name).repartition(n)

    @property
    def users(self) -> DataFrame:
        """``user_id, name, role, banned, ban_expires``; roles are comma lists."""
        n = F.col("n_nationkey")
        return self.table("nation").select(
            n.alias("user_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"),
            F.when(n % 5 == 0, "admin").when(n % 5 == 1, "user,admin").when(n % 5 == 2, "administrator").otherwise("user").alias("role"),
            (n % 4 == 0).alias("banned"),
            F.when(n % 8 == 0, F.lit("1995-06-01 00:00:00").cast("timestamp_ntz")).alias("ban_expires"),
        )

    @property
    def feeds(self) -> DataFrame:
        """``feed_id, user_id, name, aggregator, enabled, interval_minutes, daily_limit``."""
        return self.table("customer").select(
            F.col("c_custkey").alias("feed_id"), F.col("c_nationkey").alias("user_id"), F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("aggregator"),
            (F.col("c_acctbal") >= 0).alias("enabled"), (F.col("c_custkey") % 6 * 30).alias("interval_minutes"), (F.col("c_custkey") % 100).alias("daily_limit"),
        )

    @property
    def articles(self) -> DataFrame:
        """``article_id, feed_id, name, identifier, date, read, starred, created_at, updated_at, content``."""
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("article_id"), F.col("o_custkey").alias("feed_id"), F.concat(F.lit("Article "), k.cast("string")).alias("name"), F.concat(F.lit("urn:"), k.cast("string")).alias("identifier"),
            F.col("o_orderdate").alias("date"), (F.col("o_orderstatus") == "F").alias("read"), (F.col("o_orderpriority") == "1-URGENT").alias("starred"),
            F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.make_dt_interval(days=(k % 40).cast("int"))).alias("updated_at"),
            F.concat_ws("|", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").cast("string"), "o_orderpriority").alias("content"),
        )

    @property
    def tags(self) -> DataFrame:
        """``tag_id, name, user_id``: one per brand."""
        return self.table("part").select(F.col("p_brand").alias("tag_id"), F.col("p_brand").alias("name")).distinct()

    @property
    def feed_tags(self) -> DataFrame:
        """``feed_id, tag_id`` pairs: brands that a customer ordered for a high price."""
        items = self.table("lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        parts = self.table("part").select("p_partkey", "p_brand")
        joined = items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).join(parts, items["l_partkey"] == parts["p_partkey"])
        return joined.select(F.col("o_custkey").alias("feed_id"), F.col("p_brand").alias("tag_id")).distinct()

    @property
    def jobs(self) -> DataFrame:
        """``job_id, run_id, user_id, kind, status, attempts, max_attempts, run_at, priority, payload``."""
        k = F.col("event_id")
        status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "signup", "cancelled")
        return self.table("events").select(
            k.alias("job_id"), (k % 50).alias("run_id"), F.when(k % 7 != 0, F.col("user_id") % 30).alias("user_id"), F.when(k % 3 == 0, "aggregate").when(k % 3 == 1, "retention").otherwise("reload").alias("kind"),
            status.otherwise("pending").alias("status"), (k % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.col("ts").alias("run_at"), (k % 3 * 5).cast("int").alias("priority"), F.col("props").alias("payload"),
        )

    @property
    def requests(self) -> DataFrame:
        """``request_id, user_id, created_at``: one row per metered attempt."""
        return self.table("events").select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("created_at"))

    @property
    def documents(self) -> DataFrame:
        """``doc_id, owner, name, plain_text``; the name is the first line."""
        return self.table("documents").select("doc_id", F.col("source").alias("owner"), F.substring_index("text", "\n", 1).alias("name"), F.col("text").alias("plain_text"))

    @property
    def comments(self) -> DataFrame:
        """``post_id, position, author, body, score``."""
        return self.table("conversations").select(F.col("conv_id").alias("post_id"), F.col("turn").alias("position"), F.col("role").alias("author"), F.col("text").alias("body"), F.length("text").alias("score"))
