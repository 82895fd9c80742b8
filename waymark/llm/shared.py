"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts name it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
LAST = 9223372036854775807


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as it stands in expressions, dots and back quotes in it included."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns' numbers for names, since mapInArrow takes no names with dots in them; the schema that it is given names them again."""
    return df.toDF(*map(str, range(len(df.columns))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where the session names none, a local session (as
    in tests) gets a temporary one; on a cluster there is no folder that all machines see, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='waymark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, lost executors cost nothing, and the
    reader has no partitioning of its own, so that adaptive execution can split what is skewed on either side of a join.
    Results are lazy, so the table stays as long as the application; when that ends, it goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: (node, component), component the smallest node reachable.

    Each round gives every node the smallest label among its neighbours', then jumps from label to label's label, so
    that long chains halve. Each join side is a table that was cut, thus a hub's rows can be split. Nodes without an
    edge aren't returned; null ends and loops are ignored; an empty edge list gives an empty table."""
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    )
    both = cut(both.distinct())
    lower = both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("label"))
    labels = cut(
        lower.unionByName(both.select(F.col("lo").alias("node"), F.col("lo").alias("label")).distinct())
        .groupBy("node").agg(F.min("label").alias("label"))
    )
    for _ in range(rounds):
        at = labels.select(F.col("node").alias("n"), F.col("label").alias("l"))
        # an edge whose ends have different labels joins the labels: the larger label's holder learns the smaller
        ends = (
            both.join(at.select(F.col("n").alias("lo"), F.col("l").alias("l1")), "lo")
            .join(at.select(F.col("n").alias("hi"), F.col("l").alias("l2")), "hi")
            .where("l1 <> l2")
            .select(F.greatest("l1", "l2").alias("label"), F.least("l1", "l2").alias("to"))
        )
        hooks = cut(ends.groupBy("label").agg(F.min("to").alias("to")))
        if hooks.isEmpty():
            break
        moved = labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        jump = cut(moved)
        for _ in range(2):
            up = jump.where("node = label").select(F.col("node").alias("label"), F.lit(True).alias("root"))
            loose = jump.join(up, "label", "left_anti")
            if loose.isEmpty():
                break
            jump = cut(
                jump.alias("x").join(
                    jump.select(F.col("node").alias("n"), F.col("label").alias("l")), F.col("x.label") == F.col("n"), "left"
                ).select("x.node", F.coalesce("l", "x.label").alias("label"))
            )
        labels = jump
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", F.col("label").alias("component"))
