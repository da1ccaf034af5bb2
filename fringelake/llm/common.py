"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, scratch

#: What separates words, and what a word is: only ASCII white space counts.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(text, SPACE, -1), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row, however often body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of df's columns, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of a name that may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row in the column `name`, written so that the numbers stay the same."""
    return scratch(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each node of the undirected edges (a, b), the smallest node that it can reach.

    Each round points every node at its smallest neighbour, or itself, follows the pointers once more, and contracts: the
    edges between what nodes point at are all that the next round sees. So edges shrink from round to round, a dense group
    is one node after a round or two, and a path's length is divided. A hub's minimum is pre-aggregated in each task, and
    its edges are split by Spark's skew join. No edges: no rows.
    """
    now = scratch(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    for _ in range(rounds):
        if labels is not None and now.isEmpty():
            break
        ends = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("other")))
        lower = scratch(ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")), "lower")
        up = lower.select(F.col("node").alias("to"), F.col("to").alias("up"))
        step = scratch(lower.join(up, "to").select("node", "up"), "step")
        discard(lower)
        if labels is None:
            after = step.select("node", F.col("up").alias("component"))
        else:
            after = labels.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        after = scratch(after, "labels")
        one, two = (step.select(F.col("node").alias(x), F.col("up").alias(f"up_{x}")) for x in ("a", "b"))
        fewer = now.join(one, "a").join(two, "b").where("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct()
        fewer = scratch(fewer, "edges")
        discard(now, step, labels)
        now, labels = fewer, after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    discard(now)
    return labels
