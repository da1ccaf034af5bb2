"""Near-duplicates of embeddings by NN-descent."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, scratch

THRESHOLD = 0.93
#: Neighbours in a list, random tables that the first lists come from, rows compared at once in a table, rounds.
LIST, TABLES, BLOCK, ROUNDS = 8, 4, 32, 3
#: Vectors of the audit, at most, the recall that it asks for, the one without which there is no result, and turns at most.
AUDIT, RECALL, LEAST, TURNS = 1000, 0.97, 0.9, 12
#: Members of a component compared at once, at most, and both bounds. No result depends on them.
SMALL = 16384
MEMBERS = (256, SMALL)


def _matrix(column, kind) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind).reshape(len(rows), -1) if rows else np.zeros((0, 1), kind)


def _runs(batches, keys: int):
    """Tables of the rows with equal values in the first `keys` columns; the rows must come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, dtype=bool)
        for i in range(keys):
            c = b.column(i).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        first = tuple(b.column(i)[0].as_py() for i in range(keys))
        edge = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for a, z in zip(edge, edge[1:]):
            if held and (a > 0 or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
        last = tuple(b.column(i)[b.num_rows - 1].as_py() for i in range(keys))
    if held:
        yield pa.Table.from_batches(held)


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, grp, vec): valid vectors of length one, as bytes of doubles; only those of one grp (label and dimension)
    are compared. Left out: null ids, labels and vectors, zero vectors, null, infinite and NaN components."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids, groups, out = [], [], []
                for i, label, v in zip(*(part.column(c).to_pylist() for c in range(3))):
                    if i is None or label is None or not v or None in v:
                        continue
                    x = np.array(v, dtype=np.float64)
                    top = np.abs(x).max()
                    if not np.isfinite(top) or top == 0 or np.isnan(x).any():
                        continue
                    x = x / top
                    ids.append(i)
                    groups.append(f"{label}/{len(x)}")
                    out.append((x / np.sqrt((x * x).sum())).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(groups, pa.string()), pa.array(out, pa.binary())], names=["vec_id", "grp", "vec"])

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, grp string, vec binary")


def _planes(dim: int, count: int, table: int) -> np.ndarray:
    return np.random.default_rng([7, table, dim]).standard_normal((dim, count)).astype(np.float32)


def first_lists(vectors: DataFrame, size: int, tables: int, block: int, after: int = 0) -> DataFrame:
    """(src, dst, sim) to start from: in each table, vectors with equal signs on random hyperplanes, sorted by one more
    random projection, are compared with those near them in that order. The number of hyperplanes follows the vector's own
    group, so that cells hold two blocks or more on average; a crowded cell costs no more for each of its vectors than any other. `after` is the number of tables
    that were there before. Vectors of one value of home, where there is such a column, are not compared."""
    if "home" not in vectors.columns:
        vectors = vectors.withColumn("home", F.col("rep"))
    sizes = vectors.groupBy("grp").agg(F.count(F.lit(1)).alias("members"))

    def place(batches):
        for b in batches:
            dims = np.array([len(x) for x in b.column(2).to_pylist()], dtype=np.int64) // 8
            planes = np.array([max(0, math.floor(math.log2(n / (2 * block)))) for n in b.column(3).to_pylist()], dtype=np.int64)
            for dim, bits in sorted(set(zip(dims.tolist(), planes.tolist()))):
                part = b.filter(pa.array((dims == dim) & (planes == bits)))
                x = _matrix(part.column(2), np.float64).astype(np.float32)
                small = [r.tobytes() for r in x.astype(np.float16)]
                for t in range(tables):
                    p = x @ _planes(dim, bits + 1, after + t)
                    code = ((p[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), part.column(1), pa.array(code), pa.array(p[:, bits].astype(np.float64)), part.column(0), pa.array(small, pa.binary()), part.column(4)], names=["t", "grp", "code", "at", "rep", "small", "home"])

    def near(batches):
        def best(ids, other, sims):
            k = min(size, sims.shape[1])
            top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            src, dst, sim = np.repeat(ids, k), other[top].ravel(), np.take_along_axis(sims, top, 1).ravel()
            keep = (src != dst) & (sim > -2)
            return src[keep], dst[keep], sim[keep]

        before = None
        for run in _blocks(batches, block):
            key, ids, x, home = run
            out = []
            if before is not None and before[0] == key:
                cross = x @ before[2].T
                cross[home[:, None] == before[3][None, :]] = -9
                own = x @ x.T
                own[home[:, None] == home[None, :]] = -9
                out.append(best(ids, np.concatenate([before[1], ids]), np.concatenate([cross, own], axis=1)))
                out.append(best(before[1], ids, cross.T))
            elif len(ids) > 1:
                own = x @ x.T
                own[home[:, None] == home[None, :]] = -9
                out.append(best(ids, ids, own))
            before = run
            if out:
                yield _list_batch(*(np.concatenate(c) for c in zip(*out)))

    placed = vectors.select("rep", "grp", "vec", "home").join(sizes, "grp").select("rep", "grp", "vec", "members", "home").mapInArrow(place, "t int, grp string, code long, at double, rep long, small binary, home long")
    # by ranges of the whole order, so that a crowded cell is dealt over tasks
    return placed.repartitionByRange("t", "grp", "code", "at", "rep").sortWithinPartitions("t", "grp", "code", "at", "rep").mapInArrow(near, "src long, dst long, sim double")


def _blocks(batches, block: int):
    """(key, ids, matrix, homes) of `block` rows at most, in order, each with one key."""
    for b in batches:
        keys = list(zip(*(b.column(i).to_pylist() for i in range(3))))
        ids = b.column(4).to_numpy()
        small = b.column(5).to_pylist()
        home = b.column(6).to_numpy()
        at = 0
        while at < len(keys):
            end = at
            while end < len(keys) and end - at < block and keys[end] == keys[at]:
                end += 1
            yield keys[at], ids[at:end], np.frombuffer(b"".join(small[at:end]), np.float16).reshape(end - at, -1).astype(np.float32), home[at:end]
            at = end


def _list_batch(src, dst, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim.astype(np.float64))], names=["src", "dst", "sim"])


def _shortened(found: DataFrame, size: int) -> DataFrame:
    """The best `size` of each list; new is true if none of a pair's rows is old. A list has a part for vectors of the same
    home (own) and one for others, so that many copies do not fill the places of what is not linked yet."""
    one = found.groupBy("src", "dst", "own").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("src", "own").orderBy(F.desc("sim"), "dst"))
    return one.withColumn("rank", rank).where(F.col("rank") <= size)


def descend(lists: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """One round: the neighbours of each vector, either way, are compared with each other where one of the two is new, and
    what beats the end of a list goes into it. Those of one home are not compared, but lead to others."""
    back = F.row_number().over(Window.partitionBy("dst", "own").orderBy(F.desc("sim"), "src"))
    ahead = lists.select(F.col("src").alias("v"), F.col("dst").alias("u"), "new")
    behind = lists.withColumn("rank", back).where(F.col("rank") <= size).select(F.col("dst").alias("v"), F.col("src").alias("u"), "new")
    around = ahead.unionByName(behind).groupBy("v", "u").agg(F.max("new").alias("new"))
    worst = lists.where("not own").groupBy("src").agg(F.when(F.count(F.lit(1)) >= size, F.min("sim")).otherwise(-2.0).alias("worst"))
    known = vectors.join(worst, vectors.rep == worst.src, "left").select("rep", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "small", "home")
    sent = around.join(known, around.u == known.rep).select("v", "u", "new", "worst", "small", "home").repartition("v").sortWithinPartitions("v", "u")

    def meet(batches):
        out = []
        for t in _runs(batches, 1):
            u, new, worst = (t.column(i).to_numpy() for i in (1, 2, 3))
            x = _matrix(t.column(4), np.float16).astype(np.float32)
            sims = x @ x.T
            fresh = (new[:, None] | new[None, :]) & (sims > worst[:, None])
            home = t.column(5).to_numpy()
            fresh &= home[:, None] != home[None, :]
            i, j = np.nonzero(fresh)
            out.append((u[i], u[j], sims[i, j]))
            if len(out) >= 500:
                yield _list_batch(*(np.concatenate(c) for c in zip(*out)))
                out = []
        if out:
            yield _list_batch(*(np.concatenate(c) for c in zip(*out)))

    found = sent.mapInArrow(meet, "src long, dst long, sim double").withColumn("new", F.lit(True)).withColumn("own", F.lit(False))
    return _shortened(lists.select("src", "dst", "sim", F.lit(False).alias("new"), "own").unionByName(found), size)


def _exact(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs in the lists whose cosine in double precision reaches the threshold."""
    near = lists.where(F.col("sim") >= threshold - 0.01).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    left = vectors.select(F.col("rep").alias("a"), F.col("vec").alias("va"))
    right = vectors.select(F.col("rep").alias("b"), F.col("vec").alias("vb"))

    def check(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x, y = (part.column(i).to_pylist() for i in (2, 3))
                fine = [float(np.frombuffer(p) @ np.frombuffer(q)) >= threshold for p, q in zip(x, y)]
                yield part.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return near.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(check, "a long, b long")


def link_counts(members: DataFrame, threshold: float, block: tuple[int, int] = MEMBERS) -> DataFrame:
    """(rep, links) for the members (rep, component, n, vec, ask) of which ask is true: how many vectors of other classes of
    its component a class is linked to. Products grow with the square of a component, rows do not.

    The list of each member that asks is enlarged to its whole component, in which all its partners are. Members are dealt
    to blocks, those that ask to the first ones; only pairs of blocks of which one asks meet in a task, which returns one
    sum for each member; no pair of members becomes a row. Blocks grow with the component, so a member is sent to 16 blocks
    as long as these are not at their largest.
    """
    share = lambda n: F.ceil(n / F.col("most")).cast("int")
    sizes = members.groupBy("component").agg(F.sum(F.col("ask").cast("long")).alias("asking"), F.count(F.lit(1)).alias("all"))
    sizes = sizes.where("asking > 0").withColumn("most", F.least(F.greatest(F.floor(F.col("all") / 16), F.lit(block[0])), F.lit(block[1])))
    sizes = sizes.select("component", share(F.col("asking")).alias("first"), share(F.col("all") - F.col("asking")).alias("rest"))
    place = lambda count: F.pmod(F.xxhash64("rep"), F.greatest(count, F.lit(1))).cast("int")
    dealt = members.join(sizes, "component").withColumn("own", F.when(F.col("ask"), place(F.col("first"))).otherwise(F.col("first") + place(F.col("rest"))))
    last = F.when(F.col("ask"), F.col("first") + F.col("rest")).otherwise(F.col("first")) - 1
    pairs = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    sent = dealt.select("component", F.explode(pairs).alias("p"), "own", "rep", "n", "vec", "ask")
    sent = sent.select("component", "p.i", "p.j", "own", "rep", "n", "vec", "ask").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def count(batches):
        for t in _runs(batches, 3):
            i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            own, rep, n = (t.column(c).to_numpy() for c in (3, 4, 5))
            x = _matrix(t.column(6), np.float64)
            ask = t.column(7).to_numpy(zero_copy_only=False)
            a, links = np.flatnonzero(own == i), np.zeros(len(rep), dtype=np.int64)
            other = a if i == j else np.flatnonzero(own == j)
            for at in range(0, len(a), 512):
                rows = a[at : at + 512]
                near = x[rows] @ x[other].T >= threshold
                if i == j:
                    near[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
                else:
                    links[other] += n[rows] @ near
                links[rows] += near @ n[other]
            yield pa.RecordBatch.from_arrays([pa.array(rep[ask], pa.int64()), pa.array(links[ask])], names=["rep", "links"])

    return sent.mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def _listed_counts(lists: DataFrame, classes: DataFrame, some: DataFrame, threshold: float) -> DataFrame:
    """(rep, links) of the classes some (rep), by lists alone, for a comparison with link_counts(): the vectors of the classes in their lists that reach the threshold."""
    pairs = _exact(lists.join(some.withColumnRenamed("rep", "src"), "src", "left_semi"), classes, threshold)
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    weight = classes.select(F.col("rep").alias("other"), "n")
    return ends.join(some, "rep", "left_semi").join(weight, "other").groupBy("rep").agg(F.sum("n").alias("links"))


def _asked(vectors: DataFrame, sample: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(reps, vectors) by group of `sample` vectors at most, taken from all groups in turn by a hash of their ids."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.xxhash64("rep", F.lit(3)), "rep"))
    rows = vectors.select("rep", "grp", "vec").withColumn("rank", rank).where(F.col("rank") <= sample).orderBy("rank", F.xxhash64("rep", F.lit(3)), "rep").limit(sample).collect()
    of: dict[str, list] = {}
    for r in rows:
        of.setdefault(r.grp, []).append(r)
    return {g: (np.array([r.rep for r in x]), np.array([np.frombuffer(r.vec) for r in x])) for g, x in of.items()}


def _true_links(vectors: DataFrame, by: dict[str, tuple[np.ndarray, np.ndarray]], threshold: float) -> DataFrame:
    """(q, r, n): the vectors r, of n rows each, that the asked q are linked to, by comparing these with all others."""
    shared = vectors.sparkSession.sparkContext.broadcast(by)

    def search(batches):
        for b in batches:
            groups = np.array(b.column(1).to_pylist(), dtype=object)
            for g, (ids, q) in shared.value.items():
                part = b.filter(pa.array(groups == g))
                if part.num_rows:
                    rep, n = part.column(0).to_numpy(), part.column(3).to_numpy()
                    i, j = np.nonzero(q @ _matrix(part.column(2), np.float64).T >= threshold)
                    keep = ids[i] != rep[j]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i][keep]), pa.array(rep[j][keep]), pa.array(n[j][keep])], names=["q", "r", "n"])

    return vectors.select("rep", "grp", "vec", "n").mapInArrow(search, "q long, r long, n long")


def _mean_recall(got: list, by: dict[str, tuple[np.ndarray, np.ndarray]]) -> float:
    """Of (q, found): the mean over the vectors, or over the means of the groups where that is less; 1 if there are none."""
    if not got:
        return 1.0
    of, groups = {int(i): g for g, (ids, _) in by.items() for i in ids}, {}
    for r in got:
        groups.setdefault(of[r.q], []).append(r.found)
    return float(min(np.mean([r.found for r in got]), np.mean([np.mean(x) for x in groups.values()])))


def audit(vectors: DataFrame, labels: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """Recall of links of `sample` vectors, taken from all groups in turn by a hash of their ids, against all others. A vector's
    recall is the share of its true links whose ends have come into one component; the result is the mean over the vectors
    that have links, or over the means of the groups where that is less. 1 if none has any."""
    by = _asked(vectors, sample)
    if not by:
        return 1.0
    one, two = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")) for x in ("q", "r"))
    pairs = _true_links(vectors, by, threshold).join(one, "q", "left").join(two, "r", "left")
    got = pairs.groupBy("q").agg(F.avg(F.coalesce((F.col("c_q") == F.col("c_r")).cast("int"), F.lit(0))).alias("found")).collect()
    return _mean_recall(got, by)


def audit_counts(vectors: DataFrame, counts: DataFrame, some: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """Recall of the numbers of links in counts (rep, links) of `sample` of the vectors some (rep), against all others."""
    by = _asked(vectors.join(some, "rep", "left_semi"), sample)
    if not by:
        return 1.0
    true = _true_links(vectors, by, threshold).groupBy("q").agg(F.sum("n").alias("true"))
    found = F.least(F.coalesce("links", F.lit(0)), "true") / F.col("true")
    return _mean_recall(true.join(counts, F.col("q") == F.col("rep"), "left").select("q", found.alias("found")).collect(), by)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, size: int = LIST, tables: int = TABLES, rounds: int = ROUNDS, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows (vec_id, label, embedding).

    Equal vectors of a label are one class. Lists of `size` neighbours are refined by rounds of NN-descent until few change;
    pairs that reach the threshold in double precision make components. An audit after each turn compares some vectors with
    all others. As long as it finds too few links in components, or a list is saturated, that is full of links, new random
    tables and rounds follow, in which each list is enlarged by `size` places for vectors outside of the component. A recall
    under 0.9 after all turns raises RuntimeError, one under `recall` a warning. At last all lists are enlarged to the whole component, in
    blocks, whatever its size: numbers of links are those of all pairs of a component in double precision.
    Vectors that are null, zero or hold null or non-finite components, and those without a
    label or id, link with nothing: no links, a component of their own. Rows with one vec_id count one by one, each with
    its own label. An empty
    table gives an empty result; other columns are ignored.
    """
    valid = scratch(unit_vectors(rows), "vectors")
    # rep numbers the classes, as one vec_id may come with more than one label
    classes = valid.groupBy("grp", "vec").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))

    def halves(batches):
        for b in batches:
            tiny = [np.frombuffer(v).astype(np.float16).tobytes() for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tiny, pa.binary())], names=["grp", "vec", "low", "n", "small"])

    classes = classes.mapInArrow(halves, "grp string, vec binary, low long, n long, small binary").withColumn("rep", F.monotonically_increasing_id())
    classes = scratch(classes, "classes")
    total, lists, edges, labels, joined = classes.count(), None, None, None, 0
    # at first each vector is at home by itself, later in its component
    homes = classes.withColumn("home", F.col("rep"))
    for turn in range(TURNS):
        found = first_lists(homes, size, tables, BLOCK, turn * tables).withColumn("new", F.lit(True)).withColumn("own", F.lit(False))
        if lists is not None:
            one, two = (homes.select(F.col("rep").alias(x), F.col("home").alias(f"h_{x}")) for x in ("src", "dst"))
            before = lists.join(one, "src").join(two, "dst").select("src", "dst", "sim", F.lit(False).alias("new"), (F.col("h_src") == F.col("h_dst")).alias("own"))
            found = before.unionByName(found)
        after = scratch(_shortened(found, size), "lists")
        discard(lists)
        lists = after
        for _ in range(rounds):
            after = scratch(descend(lists, homes, size), "lists")
            discard(lists)
            lists = after
            # later turns look for further links only
            if lists.where("new").count() < 0.02 * size * total if turn == 0 else lists.where(F.col("new") & ~F.col("own") & (F.col("sim") >= threshold - 0.01)).isEmpty():
                break
        linked = _exact(lists.where("not own"), classes, threshold)
        edges = scratch(linked if edges is None else linked.unionByName(edges), "links")
        labels = components(edges)
        edges = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        got = audit(classes, labels, threshold)
        # a list that ends above the threshold may lack links to other components, unless a turn has joined nothing more
        full = lists.groupBy("src", "own").agg(F.count(F.lit(1)).alias("places"), F.min("sim").alias("least")).where((F.col("places") >= size) & (F.col("least") >= threshold - 0.01))
        before, joined = joined, edges.count()
        if got >= recall and (joined == before or full.where((~F.col("own")) & (F.col("least") >= threshold)).isEmpty()):
            break
        homes = classes.join(labels, classes.rep == labels.node, "left").select("grp", "vec", "rep", "n", "small", F.coalesce("component", "rep").alias("home"))
    if got < LEAST:
        raise RuntimeError(f"NN-descent: an audit found a recall of {got:.3f} after all its turns")
    if got < recall:
        warnings.warn(f"NN-descent: an audit found a recall of {got:.3f}, less than {recall}, after all its turns", stacklevel=2)
    # all pairs of each component, large or small
    linked = classes.join(labels, classes.rep == labels.node).select("component", "rep", "n", "vec", F.lit(True).alias("ask"))
    counts = link_counts(linked, threshold)
    least = classes.join(labels, classes.rep == labels.node).groupBy("component").agg(F.min("low").alias("least"))
    of = classes.select("grp", "vec", "rep", "low", "n").join(labels, F.col("rep") == F.col("node"), "left").drop("node").join(least, "component", "left")
    of = of.join(counts.withColumnRenamed("rep", "c_rep"), F.col("rep") == F.col("c_rep"), "left")
    of = of.select("grp", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "low").alias("component_id"))
    good = valid.join(of, ["grp", "vec"]).select("vec_id", "n_links", "component_id")
    bad = _invalid(rows).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _invalid(rows: DataFrame) -> DataFrame:
    """The rows that unit_vectors() leaves out."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(odd, F.lit(True)) & ~F.coalesce(zero, F.lit(True))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(good, F.lit(False)).alias("good")).where("not good")
