"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, scratch, text_of

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Rows of one source and size that are ranked together.
RANKED = 256


def sizes_of(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size): a document's words; null text has none. row is the column of that name, or null."""
    return docs.select((F.col(row) if row else F.lit(None)).cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, n) with one row for each source.

    Sources in order of code points, null last, have the weights in turn and share `share` of all sizes. A target stops at
    `most` times its source's size; the excess goes to the others by weight. With sources ordered by limit over weight,
    those that stop are the first ones, so running sums give the level at which the others share the rest:
    it rises up to the first source that does not stop and falls after it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per = scratch(per.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn)), "sources")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    limit = most * F.col("source_size")
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(total) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    steps = per.select("source", limit.alias("limit"), "weight", level.alias("level"))
    found = steps.where(F.col("limit") > F.col("level") * F.col("weight")).agg(F.max("level")).first()[0]
    target = limit.cast("double") if found is None else F.least(limit.cast("double"), F.lit(found) * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"), "n")


def rates(cells: DataFrame, wanted: DataFrame, most: float = MOST, rounds: int = 40, close: float = 1e-7) -> DataFrame:
    """cells (source, size, n) with the rate of a document of that source and size.

    The rates minimise the bounded relative entropy to one copy each, given that each source's tokens add up to its target.
    The dual is convex, one multiplier for each source: rate = most * s(lam * size / mean size), where s is the logistic
    function, which tilts the odds of a copy exponentially and keeps a rate under `most`. Each Newton round sums gradient
    and curvature over all cells, partly in each task; steps that leave the bracket of the root are replaced by its middle.
    """
    scale = F.greatest(F.col("source_size") / F.col("n"), F.lit(1e-9))
    now = wanted.select("source", "target", "source_size", scale.alias("scale"), F.lit(0.0).alias("lam"), F.lit(-1e5).alias("low"), F.lit(1e5).alias("high"), F.lit(False).alias("done"))
    now = now.withColumn("lam", F.when(F.col("target") >= most * F.col("source_size"), F.lit(float("inf"))).when(F.col("target") <= 0, F.lit(float("-inf"))).otherwise(F.col("lam")))
    now = scratch(now.withColumn("done", F.abs("lam") == float("inf")), "dual")
    cells = cells.withColumnRenamed("source", "cell_source")

    def rate(size):
        return most / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("lam") * size / F.col("scale")))))

    for _ in range(rounds):
        if now.where("not done").isEmpty():
            break
        open_now = now.where("not done")
        both = cells.join(open_now.select("source", "lam", "scale"), F.col("cell_source").eqNullSafe(F.col("source")))
        tokens = F.col("n") * F.col("size")
        sums = both.select(F.col("source").alias("of"), (tokens * rate(F.col("size"))).alias("mass"), (tokens * rate(F.col("size")) * (1 - rate(F.col("size")) / most) * F.col("size") / F.col("scale")).alias("bend")).groupBy("of").agg(F.sum("mass").alias("mass"), F.sum("bend").alias("bend"))
        all_rows = now.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        off = F.col("mass") - F.col("target")
        low, high = F.when(off <= 0, F.col("lam")).otherwise(F.col("low")), F.when(off > 0, F.col("lam")).otherwise(F.col("high"))
        step = F.col("lam") - off / F.greatest(F.col("bend"), F.lit(1e-12))
        step = F.round(F.when((step > low) & (step < high), step).otherwise((low + high) / 2), 10)
        settled = F.col("done") | F.col("mass").isNull() | (F.abs(off) <= close * F.col("target"))
        after = all_rows.select("source", "target", "source_size", "scale", F.when(settled, F.col("lam")).otherwise(step).alias("lam"), F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"), settled.alias("done"))
        after = scratch(after, "dual")
        discard(now)
        now = after
    out = cells.join(now, F.col("cell_source").eqNullSafe(F.col("source")))
    value = F.when(F.col("lam") == float("inf"), F.lit(most)).when(F.col("lam") == float("-inf"), F.lit(0.0)).otherwise(rate(F.col("size")))
    return out.select("source", "size", "n", "target", "source_size", F.round(value, 9).alias("rate"))


def _copies(cells: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies for each size of a source, from the largest: what rounding has left open goes on to smaller sizes."""
    cells = cells.sort_values("size", ascending=False, kind="stable")
    left, out = 0.0, []
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist()):
        left += n * size * rate
        k = int(min(max(np.rint(left / size), 0), most * n))
        left -= k * size
        out.append(k)
    return cells.assign(copies=np.array(out, dtype=np.int64))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = int(MOST), row: str | None = None) -> DataFrame:
    """For each row of docs (doc_id, text, source): row, doc_id, source, size, source_size, target, rate, copies, taken; row is
    the column of docs of that name, a number that tells rows of one doc_id apart, or null.

    Documents of one source and size have one rate, so Newton's rounds and the rounding work on counts by source and size,
    not on documents. A size's copies are dealt by rank of a hash of doc_id, in groups of some hundred rows, so copies of
    one text in any number don't meet in one task. Reruns agree. A null source is a source, the last; documents without
    words (null or empty text) have no copies and take nothing; rows with one doc_id are ranked next to each other, each
    with its own copies; an empty table gives an empty result; other columns are ignored.
    """
    sizes = scratch(sizes_of(docs, row), "sizes")
    wanted = scratch(targets(sizes, weights, share, float(most)), "targets")
    cells = scratch(sizes.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    dealt = rates(cells, wanted, float(most)).groupBy("source").applyInPandas(lambda x: _copies(x, most), "source string, size long, n long, target double, source_size long, rate double, copies long")
    dealt = scratch(dealt, "copies").withColumnRenamed("source", "c_source").withColumnRenamed("size", "c_size")
    # one Python group holds the distinct sizes of a source, not its documents
    own = sizes.join(dealt, (F.col("size") == F.col("c_size")) & F.col("source").eqNullSafe(F.col("c_source")))
    group = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.ceil(F.col("n") / RANKED))
    own = scratch(own.select("row", "doc_id", "source", "size", "n", "target", "source_size", "rate", "copies", group.alias("part")), "ranked")
    per = own.groupBy("source", "size", "part", "n", "copies").agg(F.count(F.lit(1)).alias("here"))
    upto = F.sum("here").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    extra = F.pmod(F.col("copies"), F.col("n"))
    share_of = F.floor(extra * F.col("upto") / F.col("n")) - F.floor(extra * (F.col("upto") - F.col("here")) / F.col("n"))
    per = per.withColumn("upto", upto).select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), F.col("part").alias("p_part"), share_of.alias("extra"))
    rank = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "row"))
    own = own.withColumn("rank", rank).join(per, (F.col("size") == F.col("p_size")) & (F.col("part") == F.col("p_part")) & F.col("source").eqNullSafe(F.col("p_source")))
    copies = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    some = own.select("row", "doc_id", "source", "size", "source_size", "target", "rate", copies.cast("long").alias("copies"))
    bare = sizes.where("size = 0").join(wanted.select(F.col("source").alias("w_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("w_source"))).select("row", "doc_id", "source", "size", "source_size", "target", F.lit(0.0).alias("rate"), F.lit(0).cast("long").alias("copies"))
    return some.unionByName(bare).withColumn("taken", F.col("copies") * F.col("size"))
