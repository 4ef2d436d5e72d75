"""What several corpus operators share: tables, saved intermediates, components."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.functions.lineage import materialize
from mendframe.session import ensure_checkpoint_dir

#: The separators of words, inside the brackets of an expression: space, and tab to carriage return.
SPACE_CLASS = " \\t\\n\\x0B\\f\\r"


#: Stands for a NULL id inside Python functions, where NULL would turn ids into floats.
NO_ID = -(2**63)


def id_in(name: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NO_ID)).alias(name)


def id_out(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that `spark.checkpoint.dir` names; removed when the driver ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it from there.

    For wide or large intermediates that several steps read: columns are
    compressed and pruned, and the loss of an executor costs nothing.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As `saved`, in buckets of `key`: a join on it moves only the other side.

    The table's name leaves the catalog at once; its files stay as those of `saved`.
    """
    spark = df.sparkSession
    table_name = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", shared_folder(spark, name)).bucketBy(buckets, key).saveAsTable(table_name)
    out = spark.table(table_name)
    assert out.columns == df.columns
    spark.sql(f"DROP TABLE {table_name}")
    return out


def words(text: Column) -> Column:
    """The words of a text: runs of characters other than space and tab to carriage return."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("bigint")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected links: (node, root), root the smallest node reachable.

    Alternates large-star and small-star contraction, which needs a number of
    rounds that grows with the logarithm of the longest path. Each round is
    two aggregations and two joins keyed by node; a hub's rows are one side of
    a plain equi-join, which adaptive execution splits. Only one row of
    figures a round reaches the driver. Links with a NULL end, self links and
    repeated links change nothing. Nodes without links are absent.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    seen = _digest(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        large = materialize(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = (
            joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        edges = materialize(small)
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    """Whether two rounds hold the same links, without moving them."""
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)
