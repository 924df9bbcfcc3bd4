"""Helpers the operators share: table access, written intermediate tables, ranks without hot groups, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipledger.session import scratch_path, setting

#: Words of a text: maximal runs without space, tab, newline, vertical tab, form feed, carriage return.
NOT_WORD = "[ \\t-\\r]+"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOW_33_BITS = (1 << 33) - 1


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def keyed(df: DataFrame, key: str, **columns: str) -> DataFrame:
    """Only the named columns, under new names if given, without rows whose key is null."""
    return df.select(F.col(key), *(F.col(c).alias(new) for new, c in columns.items())).where(F.col(key).isNotNull())


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: later jobs read it, whatever executor is lost."""
    path = scratch_path(df.sparkSession, name)
    with setting(df.sparkSession, DROP_SHUFFLES, "true"):  # nothing reads the job's shuffle files once the table is there
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z alone are changed, so the result does not hang on a locale or on Unicode tables."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, group: str, order: list[str], rank: str, name: str) -> DataFrame:
    """Adds the 0-based rank of each row within its group.

    Rows are dealt out by ranges of (group, order), so a group of any size spreads over tasks. Each
    task numbers its own rows; a table with one row for each task and group holds what came before.
    """
    spark = df.sparkSession
    placed = written(
        df.repartitionByRange(partitions(spark), group, *order)
        .sortWithinPartitions(group, *order)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(LOW_33_BITS))),
        name,
    )
    parts = placed.groupBy(group, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(
        F.col(group).alias("_group"), F.col("_task").alias("_in"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return placed.join(shift, placed[group].eqNullSafe(shift["_group"]) & (placed["_task"] == shift["_in"])).select(
        *df.columns, (F.col("_at") + F.col("_shift")).alias(rank)
    )


def _flat(edges: DataFrame) -> bool:
    """Whether no node has two smaller ones, or one that has a smaller one itself: then every edge leads to a root."""
    lower = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), "b"))
    span = lower.groupBy("a").agg(F.min("b").alias("x"), F.max("b").alias("y")).where("x <> y")
    return span.agg(F.count("*")).first()[0] == 0


def trees(links: DataFrame, name: str) -> DataFrame:
    """node, root: the smallest node reachable over links (a, b), for every node that is not this one itself. Written.

    Large-star and small-star steps in turn; each halves the depth of every tree, so rounds grow
    with the logarithm of the longest chain. Every round is written, as it is read by the next.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name
    )
    while not _flat(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        after = written(small.where("a <> b").distinct(), name)
        forget(edges)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
