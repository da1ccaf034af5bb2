"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, fresh, numbered, scratch

SEED = 42
#: The similarity of near-duplicates, and how seldom a pair of that similarity may be missed when candidates are looked up.
SIMILAR, MISSED = 0.8, 0.04
#: The similarity down to which texts are of one family, in most cases: far below that of links, so that what is near a large
#: family is compared with it in the way that needs no pairs.
FAMILY = 0.5
#: Members of a family all of whose pairs are compared.
FEW = 8
#: Bits of a segment that a look-up flips: those that the fewest shingles decided.
FLIPPED = 3


def exact_segments(n: int) -> tuple:
    """(word, lowest bit, bits, radius) of each segment, by which all pairs of n 64-bit fingerprints at most 4 bits apart are
    found: by the pigeonhole principle that holds if the radii, each plus one, add up to 5. Of such plans the one with the
    fewest look-ups and random matches, so segments are wider and fewer the more fingerprints there are."""
    plans = [((0, 0, a, 1), (0, a, a, 1), (0, 2 * a, 64 - 2 * a, 0)) for a in range(18, 28)]
    plans += [((0, 0, a, 2), (0, a, 64 - a, 1)) for a in range(28, 37)]

    def cost(plan) -> float:
        return sum(sum(math.comb(w, k) for k in range(r + 1)) * (1 + n / 2**w) for _, _, w, r in plan)

    return min(plans, key=cost)


EXACT = exact_segments(1)


@dataclass(frozen=True)
class Plan:
    """Segments of `width` bits, `per` of them in each word of a fingerprint of `words` words. Two fingerprints are candidates
    if at most `bits` of all bits, and at most `word_bits` of the 64 of one word, differ; they are of one family if at most
    `family_bits` and `family_word_bits` do."""

    width: int
    segments: int
    per: int
    words: int
    bits: int
    word_bits: int
    family_bits: int
    family_word_bits: int


def plan(n: int, similar: float = SIMILAR, missed: float = MISSED, flipped: int = FLIPPED) -> Plan:
    """The plan for n sets: a segment has a bit more than n needs, so a look-up meets less than one set by chance. For sets of
    that similarity (of one size) the projections behind two bits have a correlation of 2 s / (1 + s); with it the chance is
    simulated that two segments are equal or differ only in one of the bits flipped, and so many segments are taken that
    less than `missed` of the pairs meet in none."""
    width = min(32, max(14, math.ceil(math.log2(max(n, 2))) + 1))
    rho = 2 * similar / (1 + similar)
    r = np.random.default_rng(5)
    x = r.standard_normal((40_000, width))
    differ = np.signbit(x) != np.signbit(rho * x + math.sqrt(1 - rho * rho) * r.standard_normal(x.shape))
    low = np.take_along_axis(differ, np.argpartition(np.abs(x), flipped, axis=1)[:, :flipped], axis=1)
    met = float(np.mean((differ.sum(axis=1) == 0) | ((differ.sum(axis=1) == 1) & (low.sum(axis=1) == 1))))
    segments, per = math.ceil(math.log(missed) / math.log1p(-met)), 64 // width
    words = max(2, math.ceil(segments / per))
    p, q = math.acos(rho) / math.pi, math.acos(2 * FAMILY / (1 + FAMILY)) / math.pi
    most = lambda bits, p, sigmas: math.ceil(bits * p + sigmas * math.sqrt(bits * p * (1 - p)))
    return Plan(width, segments, per, words, most(64 * words, p, 4), most(64, p, 4), most(64 * words, q, 2), most(64, q, 1.6))


def _more(h: np.ndarray) -> np.ndarray:
    """A second, independent hash of each."""
    h = (h ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text. A-Z are lower-cased; repeats count; fewer words than a shingle: one
    shingle of all words; no word: none."""
    parts = (text or "").encode().lower().split()  # bytes: only ASCII letters and ASCII white space
    if not parts:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(parts))
    digest, n = xxhash.xxh64_intdigest, len(parts) - k + 1
    return np.array([digest(line[s:e], SEED) for s, e in zip((end - size)[:n].tolist(), end[k - 1 :].tolist())], dtype="<u8")


def _votes(h: np.ndarray, count: int) -> np.ndarray:
    """For each of `count` words of 64 bits: in how many hashes a bit is set. The hashes of the first word are h."""
    hashes = np.empty((count, len(h)), dtype="<u8")
    for i in range(count):
        hashes[i], h = h, _more(h)
    total = np.zeros((count, 64), dtype=np.int64)
    for s in range(0, len(h), 255):
        part = np.ascontiguousarray(hashes[:, s : s + 255])
        bits = np.unpackbits(part.view(np.uint8).reshape(count, -1, 8), axis=2, bitorder="little")
        # eight counters of a byte in one number; none exceeds 255
        total += np.ascontiguousarray(bits).view("<u8").sum(axis=1, dtype="<u8").view(np.uint8).reshape(count, 64)
    return total


def _fingerprint(h: np.ndarray, count: int) -> list[int]:
    return np.packbits(2 * _votes(h, count) > len(h), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprint(text: str | None, shingle: int, count: int = 1) -> list[int]:
    """`count` words of 64 bits, unsigned: a bit is 1 if it is set in over half of the hashes of the text's shingles, which
    are those of shingles() for the first word. No word: 0."""
    return _fingerprint(shingles(text, shingle), count)


def fingerprints(docs: DataFrame, shingle: int = 4, count: int = 1) -> DataFrame:
    """(doc_id, fp0, fp1, ...): the words of the fingerprint as signed longs."""
    names = [f"fp{i}" for i in range(count)]

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle, count) for t in b.column(1).to_pylist()], dtype=np.uint64).reshape(-1, count)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in range(count))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def _value(w: int, low: int, width: int, seg: int):
    """The key of a segment's value in its table."""
    return F.shiftrightunsigned(F.col(f"fp{w}"), low).bitwiseAND(F.lit((1 << width) - 1).cast("long")).bitwiseOR(F.lit(seg << 32).cast("long"))


def _words(segments) -> list[str]:
    return [f"fp{i}" for i in range(1 + max(w for w, *_ in segments))]


def _distance(fps: list[str], one: str, two: str):
    differ = [F.bit_count(F.col(f"{x}{one}").bitwiseXOR(F.col(f"{x}{two}"))) for x in fps]
    return sum(differ[1:], differ[0])


def anchored(classes: DataFrame, bits: int, segments) -> DataFrame:
    """Links (a, b) of each class to the smallest and the largest rep that share a segment's value with it, where they are
    at most `bits` apart: a few rows for each class, however many are alike."""
    fps = _words(segments)
    keys = F.explode(F.array(*[_value(*x[:3], i) for i, x in enumerate(segments)]))
    there = classes.select(keys.alias("key"), "rep", *fps)
    both = F.struct("rep", *fps)
    ends = there.groupBy("key").agg(F.min(both).alias("low"), F.max(both).alias("high")).where("low.rep < high.rep")
    ends = ends.select(F.col("key").alias("at"), "low", "high")
    rows = there.join(ends, F.col("key") == F.col("at"))
    near = lambda side: sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{side}.{x}"))) for x in fps[1:]), F.bit_count(F.col(fps[0]).bitwiseXOR(F.col(f"{side}.{fps[0]}"))))
    met = F.filter(F.array(*[F.when((near(side) <= bits) & (F.col(f"{side}.rep") != F.col("rep")), F.col(f"{side}.rep")) for side in ("low", "high")]), lambda x: x.isNotNull())
    return rows.select(F.col("rep").alias("a"), met.alias("met")).where(F.size("met") > 0).select("a", F.explode("met").alias("b"))


def links(classes: DataFrame, bits: int = 4, segments=EXACT) -> DataFrame:
    """Pairs (a, b) of components of classes (rep, component, fp0, ...; each fingerprint once), one row for each pair of
    classes of different components that differ by at most `bits`.

    Every fingerprint goes into one table per segment under the segment's value. Each also looks up, in each table, all
    values in the Hamming ball of the segment's radius; what it meets is verified on all bits. A pair comes once: at the
    first segment that finds it, looked up from its smaller rep. Pairs already in one component are left out in the join.
    """
    fps = _words(segments)
    exact = [_value(*x[:3], i) for i, x in enumerate(segments)]
    ball = []
    for value, (_, _, width, radius) in zip(exact, segments):
        flips = [sum(1 << p for p in ps) for r in range(radius + 1) for ps in combinations(range(width), r)]
        ball.append(F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), _flipped(value)))
    there = classes.select(F.explode(F.array(*exact)).alias("key"), F.col("rep").alias("rep_b"), F.col("component").alias("b"), *[F.col(x).alias(f"{x}_b") for x in fps])
    asked = classes.select(F.explode(F.flatten(F.array(*ball))).alias("key"), F.col("rep").alias("rep_a"), F.col("component").alias("a"), *[F.col(x).alias(f"{x}_a") for x in fps])
    first = F.lit(True)
    for i, (w, low, width, radius) in enumerate(segments):
        mask = ((1 << width) - 1) << low
        mask -= (mask >> 63) << 64
        differ = F.col(f"fp{w}_a").bitwiseXOR(F.col(f"fp{w}_b"))
        first = first & ((F.shiftright(asked.key, 32) <= i) | (F.bit_count(differ.bitwiseAND(F.lit(mask).cast("long"))) > radius))
    found = (asked.key == there.key) & (F.col("rep_a") < F.col("rep_b")) & (F.col("a") != F.col("b")) & (_distance(fps, "_a", "_b") <= bits) & first
    return asked.join(there.hint("shuffle_hash"), found).select("a", "b")


def _flipped(value):
    return lambda flip: value.bitwiseXOR(flip)


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, segments=None) -> DataFrame:
    """(doc_id, fp0, component_id) for each row of docs (doc_id, text). The segments are those of exact_segments() for the
    number of different fingerprints, or given for another number of bits.

    Equal fingerprints are one class, which its smallest doc_id stands for; only classes are linked, so a group of
    copies costs one row in the tables. component_id is the smallest doc_id reachable over links. Null and empty texts
    have fingerprint 0 and are linked like any other; a null doc_id counts as the smallest; a repeated row comes as often
    as it is there; an empty table gives an empty result; other columns are ignored.
    """
    names = _words(segments or EXACT)
    fps = scratch(fingerprints(docs, shingle, len(names)), "fingerprints")
    lowest = F.lit(-(1 << 63)).cast("long")
    classes = scratch(fps.groupBy(*names).agg(F.min(F.coalesce("doc_id", lowest)).alias("rep")), "classes")
    segments = segments or exact_segments(classes.count())
    # first the links to a few others of each bucket, which join a dense group without all its pairs; then all links between
    # what is not joined yet
    joined = components(anchored(classes, bits, segments))
    some = classes.join(joined, classes.rep == joined.node, "left").select("rep", *names, F.coalesce("component", "rep").alias("component"))
    some = scratch(some, "joined")
    labels = components(links(some, bits, segments)).withColumnRenamed("component", "last")
    of = some.join(labels, some.component == labels.node, "left").select(*names, F.coalesce("last", "component").alias("component_id"))
    return fps.join(of, names).select("doc_id", *names, "component_id")


def _sets(rows: DataFrame, key: str, shingle: int, how: Plan | None) -> DataFrame:
    """(rep, hashes) for each row, all hashes of its distinct shingles; or with a plan (rep, first, same, n, fp, at, asked):
    what orders the rows, one hash of the set, its size, the words of its fingerprint, its segments' values, each with the
    segment's number, and the bits of each that its look-ups flip."""
    columns = ["rep", "hashes"] if how is None else ["rep", "first", "same", "n", "fp", "at", "low"]

    def lists(x: np.ndarray, kind) -> pa.Array:
        flat = np.ascontiguousarray(x).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, max(1, x.shape[1])).astype(np.int32)), pa.array(flat, kind)) if len(x) else pa.array([], pa.list_(kind))

    def segments(votes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, values and bits to flip for (rows, words, 64) of votes, which are positive where a bit is set."""
        n, number = len(votes), np.arange(how.segments, dtype=np.int64)
        words = np.packbits(votes > 0, axis=2, bitorder="little").view("<i8").reshape(n, how.words)
        own = votes[:, :, : how.per * how.width].reshape(n, -1, how.width)[:, : how.segments]
        values = (own > 0) @ (np.int64(1) << np.arange(how.width, dtype=np.int64))
        low = np.argsort(np.abs(own), axis=2, kind="stable")[:, :, :FLIPPED]
        return words, values | number << 32, (low << (6 * np.arange(FLIPPED))).sum(axis=2).astype(np.int32)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [np.unique(shingles(t, shingle)) for t in part.column("text").to_pylist()]
                if how is None:
                    flat = np.concatenate(found) if found else np.zeros(0, "<u8")
                    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                    rest = [part.column("rep"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))]
                else:
                    same = pa.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in found], pa.uint64()).view(pa.int64())
                    votes = np.array([2 * _votes(h, how.words) - len(h) for h in found], dtype=np.int64).reshape(-1, how.words, 64)
                    fp, values, low = segments(votes)
                    rest = [part.column("rep"), part.column("first"), same, pa.array([len(h) for h in found], pa.int64()), lists(fp, pa.int64()), lists(values, pa.int64()), lists(low, pa.int32())]
                yield pa.RecordBatch.from_arrays(rest, names=columns)
        pa.default_memory_pool().release_unused()  # workers live on beside later stages

    schema = "rep long, hashes array<long>" if how is None else "rep long, first binary, same long, n long, fp array<long>, at array<long>, low array<int>"
    # bytes that sort as the doc_id does, null last, then by the text
    order = F.concat_ws("", F.when(F.col("doc_id").isNull(), F.lit("1")).otherwise(F.lit("0")), F.lpad(F.hex(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0"), F.lpad(F.hex(F.xxhash64("text")), 16, "0")).cast("binary")
    some = rows.select(F.col(key).alias("rep"), "text", *([] if how is None else [order.alias("first")]))
    return some.mapInArrow(run, schema)


def _apart(one: str, two: str):
    """Bits that differ in two fingerprints."""
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)


def _word(how: Plan):
    """The word, another than that of the i-th segment, that a row of a table carries."""
    return lambda i: F.get("fp", (F.floor(i / how.per).cast("int") + 1) % how.words)


def families(classes: DataFrame, how: Plan) -> DataFrame:
    """(node, component): classes joined by fingerprints at most `family_bits` apart, each compared with two of each bucket only, the
    first and the last by a hash. A few rows for each class, however many are alike; classes far from all have no row."""
    word = _word(how)
    there = classes.select("rep", F.explode(F.transform("at", lambda v, i: F.struct(v.alias("key"), word(i).alias("word")))).alias("t")).select("t.key", "t.word", "rep")
    one = F.struct(F.xxhash64("rep", F.lit(1)).alias("order"), "rep", "word")
    ends = there.groupBy("key").agg(F.min(one).alias("low"), F.max(one).alias("high")).where("low.rep <> high.rep")
    rows = there.join(ends, "key").select(F.col("rep").alias("a"), "word", F.explode(F.array("low", "high")).alias("to"))
    near = rows.where((F.col("a") != F.col("to.rep")) & (F.bit_count(F.col("word").bitwiseXOR(F.col("to.word"))) <= how.family_word_bits)).select("a", F.col("to.rep").alias("b"))
    return components(_near(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), classes, how.family_bits))


def _near(pairs: DataFrame, classes: DataFrame, bits: int) -> DataFrame:
    """The pairs (a, b) whose fingerprints are at most `bits` apart."""
    one, two = (classes.select(F.col("rep").alias(x), F.col("fp").alias(f"fp_{x}")) for x in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").where(_apart("fp_a", "fp_b") <= bits).select("a", "b")


def _candidates(classes: DataFrame, how: Plan) -> DataFrame:
    """(a, b): all pairs of classes of different components that meet in a segment and are at most `bits` apart. Each class is in a table under each of its segments' values, and looks up each value and the
    balls around it, in the directions of the bits that the fewest shingles decided. Of the fingerprint, a row holds only
    one word, another than the segment's; the others are compared where that one is near."""
    word = _word(how)
    flips = lambda v, l: F.array(v, *[v.bitwiseXOR(_one_bit(l, i)) for i in range(FLIPPED)])
    table = F.transform("at", lambda v, i: F.struct(v.alias("key"), word(i).alias("word")))
    asked = F.flatten(F.transform(F.zip_with("at", "low", lambda v, l: F.struct(flips(v, l).alias("keys"))), lambda x, i: F.transform(x["keys"], lambda k: F.struct(k.alias("key"), word(i).alias("word")))))
    # most components are one class: what is null needs no room
    other = F.when(F.col("component") != F.col("rep"), F.col("component")).alias("component")
    there = classes.select(F.explode(table).alias("t"), "rep", other).select("t.key", F.col("t.word").alias("w_b"), F.col("rep").alias("b"), F.col("component").alias("c_b"))
    asking = classes.select(F.explode(asked).alias("t"), "rep", other).select("t.key", F.col("t.word").alias("w_a"), F.col("rep").alias("a"), F.col("component").alias("c_a"))
    apart = F.coalesce("c_a", "a") != F.coalesce("c_b", "b")
    found = (asking.key == there.key) & apart & (F.bit_count(F.col("w_a").bitwiseXOR(F.col("w_b"))) <= how.word_bits)
    pairs = asking.join(there.hint("shuffle_hash"), found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _near(pairs, classes, how.bits)


def _one_bit(low, i: int):
    """The i-th of the bits to flip, as a number."""
    place = F.shiftright(low, 6 * i).bitwiseAND(F.lit(63))
    return F.pow(F.lit(2.0), place).cast("long")


def _verified(pairs: DataFrame, rows: DataFrame, key: str, shingle: int, similar: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a Jaccard similarity of `similar` or more, by all their hashes."""
    pairs = scratch(pairs, "pairs")
    ids = pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key))).distinct()
    sets = scratch(_sets(rows.select(key, "text").join(ids, key, "left_semi"), key, shingle, None), "sets")
    one, two = (sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"h_{x}")) for x in ("a", "b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("h_a", "h_b")).alias("both"), (F.size("h_a") + F.size("h_b")).alias("sizes"))
    good = scratch(both.where(F.col("both") >= (F.col("sizes") - F.col("both")) * F.lit(similar) - 1e-9).select("a", "b"), "similar")
    discard(sets, pairs)
    return good


def _within(members: DataFrame, rows: DataFrame, key: str, shingle: int, similar: float) -> DataFrame:
    """Links (a, b) between the members (family, size, rep, n) of large families that join what all pairs of similar members
    would join, without comparing all pairs.

    A member is what its set and the family's core, the shingles of over half of the members, have not in common: d of
    them. Sets of sizes n and m are similar if they differ in f * (n + m) shingles at most, with f = (1 - s) / (1 + s), so if
    those sets of differences have (d + e - f * (n + m)) / 2 in common. With the slack f * n - d of a member that is minus half
    the sum of both slacks. So all members whose slack and the family's largest make no less than zero are similar to the one
    that has it. Any other has to share some differences with whatever it is similar to; of its differences, the rarest of
    the family first, one of the first few must then be one of the other's first few. A family without a core, which is
    one by chance, is compared by all its shingles in the same way.
    """
    f = (1 - similar) / (1 + similar)
    parts = F.ceil(F.col("size") / 1024).cast("int")
    by = ["family", "part"]  # a large family is in many parts, to each of which what is known of it as a whole is sent
    each = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("size")
    sets = _sets(rows.select(key, "text").join(members.select(F.col("rep").alias(key)), key, "left_semi"), key, shingle, None)
    own = members.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    sets = scratch(sets.join(own, "rep").select("family", "size", "part", "rep", "n", "hashes"), "sets")
    counts = scratch(sets.select("family", "size", F.explode("hashes").alias("h")).groupBy("family", "size", "h").agg(F.count(F.lit(1)).alias("times")), "counts")
    core = each(counts.where(F.col("times") * 2 > F.col("size")).groupBy("family", "size").agg(F.collect_list("h").alias("core")))
    none = F.array().cast("array<bigint>")
    differ = lambda c: F.concat(F.array_except("hashes", c), F.array_except(c, "hashes"))
    deltas = sets.join(core, by, "left").select("family", "size", "part", "rep", "n", differ(F.coalesce("core", none)).alias("delta"))
    deltas = scratch(deltas.withColumn("slack", f * F.col("n") - F.size("delta")), "deltas")
    best = scratch(each(deltas.groupBy("family", "size").agg(F.max(F.struct("slack", "rep")).alias("best"))), "best")
    held = deltas.join(best, by).withColumn("joined", F.col("slack") + F.col("best.slack") >= -1e-9)
    edge = each(held.where("not joined").groupBy("family", "size").agg(F.max("slack").alias("edge")))
    # how many differences a member shares at least with what is similar to it: a joined one with any other, and any other
    # with a joined one, or with one that is not
    shared = lambda slack: F.greatest(F.lit(1), F.ceil((-F.col("slack") - F.col(slack)) / 2 - 1e-6)).cast("int")
    held = held.join(edge, by).select("family", "size", "rep", "joined", "delta", shared("best.slack").alias("with_joined"), shared("edge").alias("with_other"))
    spread = held.select("family", "size", "rep", "joined", "with_joined", "with_other", F.explode("delta").alias("h"))
    # a difference is in `times` sets, or if it is one of the core, in all but so many
    rare = counts.select("family", "h", F.when(F.col("times") * 2 > F.col("size"), F.col("size") - F.col("times")).otherwise(F.col("times")).alias("times"))
    ranked = spread.join(rare.where("times > 1"), ["family", "h"], "left").withColumn("times", F.coalesce("times", F.lit(1)))
    firsts = ranked.groupBy("family", "rep", "joined", "with_joined", "with_other").agg(F.array_sort(F.collect_list(F.struct("times", "h"))).alias("order"))
    upto = F.size("order") - F.when(F.col("joined"), F.col("with_other")).otherwise(F.col("with_joined")) + 1
    firsts = firsts.select("family", "rep", "joined", (F.size("order") - F.col("with_other") + 1).alias("short"), F.posexplode(F.slice("order", F.lit(1), F.greatest(F.lit(0), upto))).alias("at", "o"))
    firsts = scratch(firsts.where("o.times > 1").select("family", "rep", "joined", (F.col("at") < F.col("short")).alias("short"), F.col("o.h").alias("h")), "firsts")
    other = firsts.where("not joined").select("family", "h", F.col("rep").alias("x"), "short")
    with_joined = other.join(firsts.where("joined").select("family", "h", F.col("rep").alias("y")), ["family", "h"]).select("x", "y")
    among = other.where("short").join(other.where("short").select("family", "h", F.col("x").alias("y")), ["family", "h"]).where("x < y").select("x", "y")
    meet = with_joined.unionByName(among).distinct()
    ends = lambda e: deltas.select(F.col("rep").alias(e), F.col("delta").alias(f"d_{e}"), F.col("slack").alias(f"s_{e}"))
    both = meet.join(ends("x"), "x").join(ends("y"), "y").where(F.size(F.array_intersect("d_x", "d_y")) >= -(F.col("s_x") + F.col("s_y")) / 2 - 1e-9)
    star = deltas.join(best, by).where((F.col("slack") + F.col("best.slack") >= -1e-9) & (F.col("rep") != F.col("best.rep"))).select(F.col("rep").alias("a"), F.col("best.rep").alias("b"))
    out = scratch(star.unionByName(both.select(F.col("x").alias("a"), F.col("y").alias("b"))), "within")
    discard(sets, counts, deltas, best, firsts)
    return out


def similar_groups(rows: DataFrame, key: str, shingle: int = 5, similar: float = SIMILAR, missed: float = MISSED) -> DataFrame:
    """(first, component) for each class of rows (a number `key`, doc_id, text), which are texts with equal sets of shingles:
    first ends in the number of its first row, and of what is joined by links, the component is the same. Fingerprints only
    propose pairs: two classes are linked if the Jaccard similarity of their sets reaches `similar`."""
    how = plan(rows.count(), similar, missed)
    found = _sets(rows, key, shingle, how).withColumn("first", F.struct("first", "rep")).groupBy("same", "n", "fp", "at", "low").agg(F.min("first").alias("first"))
    classes = scratch(found.select("n", "fp", "at", "low", "first", F.col("first.rep").alias("rep")), "classes")
    # what is joined by fingerprints is compared within, and each with all that is apart by what the segments propose
    close = families(classes, how)
    sizes = close.groupBy(F.col("component").alias("family")).agg(F.count(F.lit(1)).alias("size"))
    members = close.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(sizes, "family")
    members = scratch(classes.select("rep", "n").join(members, "rep").select("family", "size", "rep", "n"), "members")
    few = members.where(F.col("size") <= FEW).groupBy("family").agg(F.array_sort(F.collect_list("rep")).alias("r"))
    few = few.select(F.explode(F.flatten(F.transform("r", lambda a, i: F.transform(F.slice("r", i + 2, F.size("r")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    many = members.where(F.col("size") > FEW)
    apart = classes.join(members.select("rep", "family"), "rep", "left").select("fp", "at", "low", "rep", F.coalesce("family", "rep").alias("component"))
    links = _verified(_candidates(apart, how).unionByName(few), rows, key, shingle, similar)
    if not many.isEmpty():
        links = links.unionByName(_within(many, rows, key, shingle, similar))
    labels = components(links)
    return classes.join(labels, classes.rep == labels.node, "left").select("first", F.coalesce("component", "rep").alias("component"))


def one_of_each(docs: DataFrame, shingle: int = 5, similar: float = SIMILAR, missed: float = MISSED) -> DataFrame:
    """docs without near-duplicates, which are linked at a Jaccard similarity of `similar` or more on shingles of five words:
    of each group, which is what links reach, one row stays, with all its columns: that of the smallest doc_id, of equal ids
    that of the least hash of the text.

    Null texts and texts without words are alike, so one of them stays; a text of fewer words than a shingle is one shingle.
    A null doc_id comes last; rows are told apart by a number, so different texts with one doc_id, or with none, all stay.
    An empty table gives an empty result; a column of any other name is kept.
    """
    key = fresh(docs, "row")[0]
    rows = numbered(docs, key)
    kept = similar_groups(rows, key, shingle, similar, missed).groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.rep").alias(key))
    return rows.join(kept.hint("shuffle_hash"), key, "left_semi").drop(key)
