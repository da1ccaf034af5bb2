"""Temporal networks: pairs of images. An acquisition table has one row for each image, so it is always small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _done(pairs: DataFrame, acq: DataFrame) -> DataFrame:
    """Distinct ordered pairs with their temporal baseline in years."""
    t = lambda x: acq.select(F.col("idx").alias(x), F.col("tbase").alias(f"t_{x}"))
    out = pairs.select("i", "j").where("i <> j").distinct()
    out = out.join(F.broadcast(t("i")), "i").join(F.broadcast(t("j")), "j")
    return out.select(F.col("i").alias("first"), F.col("j").alias("second"), ((F.col("t_j") - F.col("t_i")) / 365.25).alias("tbase_ifg"))


def star(acq: DataFrame, reference: int | None = None) -> DataFrame:
    """Every image with the reference image (default: the middle one)."""
    n = acq.agg(F.count(F.lit(1)).alias("n"))
    ref = n.select(F.lit(reference).alias("i")) if reference is not None else n.select(F.floor(F.col("n") / 2).cast("int").alias("i"))
    return _done(acq.select(F.col("idx").alias("j")).join(F.broadcast(ref), F.expr("i <> j")), acq)


def small_temporal(acq: DataFrame, links: int) -> DataFrame:
    """Each image with the next `links` images."""
    return _done(_following(acq, links), acq)


def _following(acq: DataFrame, links: int) -> DataFrame:
    """(i, j): each image with the next `links` images, as an equi-join."""
    steps = acq.select(F.col("idx").alias("i"), F.explode(F.expr(f"transform(sequence(1, {links}), n -> int(idx + n))")).alias("j"))
    return steps.join(acq.select(F.col("idx").alias("j")), "j", "left_semi").select("i", "j")


def nearest_after(acq: DataFrame, days: float) -> DataFrame:
    """(i, j): the image nearest to `days` after each image; the first of equally near ones. Images and what is looked for are put in
    one order, in which the nearest image is the last one before or the first one after; images are few, so one task has them all."""
    images = acq.select(F.col("tbase").alias("t"), F.lit(0).alias("kind"), F.col("idx").alias("n"))
    wanted = acq.select((F.col("tbase") + days).alias("t"), F.lit(1).alias("kind"), F.col("idx").alias("n"))
    every = images.unionByName(wanted)
    image = F.col("kind") == 0
    before = F.max(F.when(image, F.struct("t", (-F.col("n")).alias("m")))).over(Window.orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(image, F.struct("t", F.col("n").alias("m")))).over(Window.orderBy("t", F.desc("kind")).rowsBetween(0, Window.unboundedFollowing))
    rows = every.select("t", "kind", "n", before.alias("b"), after.alias("a")).where("kind = 1")
    # times of the images themselves, so distances are as exact as they were given
    at = rows.select(F.col("n").alias("i"), F.explode(F.array(F.struct(F.col("b.t").alias("t"), (-F.col("b.m")).alias("j")), F.struct(F.col("a.t").alias("t"), F.col("a.m").alias("j")))).alias("c"))
    own = acq.select(F.col("idx").alias("i"), F.col("tbase").alias("ti"))
    off = at.where("c.j is not null").join(F.broadcast(own), "i").select("i", F.abs(F.col("c.t") - F.col("ti") - days).alias("off"), F.col("c.j").alias("j"))
    return off.groupBy("i").agg(F.min(F.struct("off", "j")).alias("m")).select("i", F.col("m.j").alias("j"))


def small_temporal_yearly(acq: DataFrame, links: int) -> DataFrame:
    """As small_temporal, and each image with the one nearest to a year later unless that is the last image."""
    last = acq.agg(F.max("idx").alias("last"))
    year = nearest_after(acq, 365.25).join(F.broadcast(last), F.expr("j <> last")).select("i", "j")
    return _done(_following(acq, links).unionByName(year), acq)


def small_baseline(acq: DataFrame, links: int, max_days: float) -> DataFrame:
    """Each image with the next one, with the one nearest to max_days later, and with evenly spaced ones between."""
    far = nearest_after(acq, max_days).where("j > i").select("i", F.col("j").alias("far"))
    last = acq.agg(F.max("idx").alias("last"))
    # the two images before the end have the next image only
    base = acq.select(F.col("idx").alias("i")).join(F.broadcast(last), F.expr("i < last"))
    spaced = base.join(far, "i").where("i < last - 1").withColumn("step", (F.col("far") - F.col("i")) / F.lit(float(max(links - 1, 1))))
    picked = spaced.where("step > 0").select("i", F.explode(F.expr(f"transform(sequence(1, {max(links - 1, 1)}), n -> int(floor(i + n * step)))")).alias("j"))
    return _done(base.select("i", (F.col("i") + 1).alias("j")).unionByName(picked), acq)


def design_matrix(network: DataFrame) -> DataFrame:
    """(ifg, img, sign): +1 at the first image, -1 at the second."""
    ifg = network.withColumn("ifg", F.expr("row_number() over (order by first, second) - 1"))
    return ifg.select("ifg", F.explode(F.array(F.struct(F.col("first").alias("img"), F.lit(1).alias("sign")), F.struct(F.col("second").alias("img"), F.lit(-1).alias("sign")))).alias("e")).select("ifg", "e.img", "e.sign")


def with_baselines(network: DataFrame, acq: DataFrame) -> DataFrame:
    """network (first, second) with tbase_ifg in years and pbase_ifg in metres, second less first, by acquisitions (idx, tbase
    in days, pbase)."""
    one, two = (acq.select(F.col("idx").alias(e), F.col("tbase").alias(f"t_{e}"), F.col("pbase").alias(f"p_{e}")) for e in ("first", "second"))
    both = network.select("first", "second").join(F.broadcast(one), "first").join(F.broadcast(two), "second")
    return both.select("first", "second", ((F.col("t_second") - F.col("t_first")) / 365.25).alias("tbase_ifg"), (F.col("p_second") - F.col("p_first")).alias("pbase_ifg"))


def of_type(kind: str, acq: DataFrame, links: int = 3, max_days: float = 100.0) -> DataFrame:
    """The network of a type by its name; other names raise ValueError."""
    kinds = {"star": lambda: star(acq), "sb": lambda: small_baseline(acq, links, max_days), "stb": lambda: small_temporal(acq, links), "stb_year": lambda: small_temporal_yearly(acq, links)}
    if kind not in kinds:
        raise ValueError(f"no network of type {kind!r}: {', '.join(kinds)}")
    return kinds[kind]()


def to_interferograms(series: DataFrame, network: DataFrame) -> DataFrame:
    """(point_id, first, second, phase): the series (point_id, img, phase) at the first image less that at the second."""
    one, two = (series.select("point_id", F.col("img").alias(e), F.col("phase").alias(f"p_{e}")) for e in ("first", "second"))
    both = one.join(F.broadcast(network.select("first", "second")), "first").join(two, ["point_id", "second"])
    return both.select("point_id", "first", "second", (F.col("p_first") - F.col("p_second")).alias("phase"))
