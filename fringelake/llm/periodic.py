"""Periodic runs of words: Karp-Miller-Rosenberg naming of windows of 1, 2, 4, ... words, and runs read off grids of names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import fresh, let, text_of, words

#: A run has this many periods and words at least.
PERIODS, SHORTEST = 4, 6
#: Words of texts that are named together, and grid places that are compared at once; a longer text is named alone.
TOGETHER, PLACES = 1 << 18, 1 << 20
RUNS = ArrayType(StructType([StructField(x, LongType()) for x in ("start", "length", "period")]))


def _next_names(names: np.ndarray, width: int) -> np.ndarray:
    """Names of windows of twice the width, of those of the width: equal pairs of names have one name. Only windows that come
    more than once have a name; others, and those that have no room, have -1."""
    out = np.full(len(names), -1, np.int32)
    at = np.flatnonzero((names[:-width] >= 0) & (names[width:] >= 0)) if len(names) > width else np.empty(0, np.int64)
    if len(at):
        pairs = names[at].astype(np.int64) * (int(names.max()) + 1) + names[at + width]
        _, named, often = np.unique(pairs, return_inverse=True, return_counts=True)
        again = often[named] > 1
        out[at[again]] = named[again]
    return out


def _grids(starts: np.ndarray, sizes: np.ndarray, low: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(grid, texts, period, place): the grid, period and place of all pairs of neighbouring places on the grids of the periods
    low to 2 * low - 1 of each text, and the text of each grid, in parts of some PLACES places; a grid is never cut. The
    texts are given by their starts and sizes."""
    most = np.minimum(2 * low - 1, sizes // PERIODS)
    texts = np.flatnonzero(most >= low)
    if not len(texts):
        return
    n = most[texts] - low + 1
    text = np.repeat(texts, n)
    period = (low + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    count = sizes[text] // period - 1  # the pair of blocks of a place must fit
    part = np.cumsum(count) // PLACES
    for cut in np.split(np.arange(len(text), dtype=np.int32), np.flatnonzero(np.diff(part)) + 1):
        c = count[cut]
        grid = np.repeat(cut, c)
        q = period[grid]
        at = np.arange(c.sum(), dtype=np.int32) - np.repeat((np.cumsum(c) - c).astype(np.int32), c)
        at *= q
        at += np.repeat(starts[text[cut]].astype(np.int32), c)
        yield grid, text, q, at


def find_runs(words_of: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, given as an array of numbers that are equal where its words are, the rows (start, length, period) of
    its runs in order of their starts.

    A run of PERIODS periods q or more holds two neighbouring blocks of the grid 0, q, 2q, ... that each equal the block after
    them; blocks are equal where the names of the windows of the largest power of two at their start and at their end
    are. Where such blocks follow each other on a grid, they lie in one stretch of period q, which goes on for less than
    q words on either side: how far tell the names of descending levels. A stretch that several periods find has the
    smallest one for its own, as the others are its multiples."""
    sizes = np.array([len(w) for w in words_of], np.int64)
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    found = []
    whole = np.concatenate(words_of) if len(words_of) else np.empty(0, np.int64)
    text_of_word = np.repeat(np.arange(len(sizes)), sizes)
    # words of different texts are different, so no window that comes again lies across two texts; one that does not come again has no name
    _, first, often = np.unique(text_of_word * (int(whole.max(initial=0)) + 1) + whole, return_inverse=True, return_counts=True)
    names = [np.where(often[first] > 1, first, -1).astype(np.int32)] if len(whole) else []
    level = 0
    while names and (names[level] >= 0).any():
        width, now = 1 << level, names[level]
        lively = np.zeros(len(sizes), bool)
        lively[text_of_word[now >= 0]] = True
        for grid, text_of_grid, q, at in _grids(starts, np.where(lively, sizes, 0), width):
            same = (now[at] == now[at + q]) & (now[at] >= 0)
            same[same] = (now[(at + q - width)[same]] == now[(at + 2 * q - width)[same]]) & (now[(at + q - width)[same]] >= 0)
            # streaks of two and more equal blocks on one grid
            inner = same[1:] & same[:-1] & (grid[1:] == grid[:-1])
            edge = np.diff(np.concatenate([[0], inner.astype(np.int8), [0]]))
            left, right = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if not len(left):
                continue
            text = text_of_grid[grid[left]]
            period, lo, hi = q[left].astype(np.int64), starts[text], ends[text]
            begin, x = at[left].astype(np.int64), at[right] + period
            for k in range(level, -1, -1):
                w, n = 1 << k, names[k]
                room = begin - w >= lo
                b = np.where(room, begin - w, begin)
                begin = np.where(room & (n[b] >= 0) & (n[b] == n[b + period]), b, begin)
                room = x + period + w <= hi
                y = np.where(room, x, lo)
                x = np.where(room & (n[y] >= 0) & (n[y] == n[y + np.where(room, period, 0)]), x + w, x)
            length = x + period - begin
            long = length >= np.maximum(SHORTEST, PERIODS * period)
            found.append(np.stack([text, begin - lo, length, period], axis=1)[long])
        names.append(_next_names(now, width))
        level += 1
    out = [np.empty((0, 3), np.int64) for _ in words_of]
    if found:
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate([[True], (np.diff(rows[:, :3], axis=0) != 0).any(axis=1)])] if len(rows) else rows
        texts, at = np.unique(rows[:, 0], return_index=True)
        for i, part in zip(texts, np.split(rows[:, 1:], at[1:])):
            out[i] = part
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those in no run, or within the first period of every run that holds them."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:-1] == 0


def collapse(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns runs, an array of (start, length, period) in order of starts, and collapsed, the words that
    stay, joined by one space, each column with underscores before its name where docs has that name.

    A run is a stretch of words with smallest period q, so words q apart are identical, of max(6, 4 * q) words at least, that
    no neighbouring word extends; all of it but its first q words goes. Null and empty texts have no runs and collapse to an
    empty text. Rows are judged one by one, so repeated rows come out as often as they are there; an empty table gives an empty
    result; all other columns stay. Whole texts are named together up to 262144 words, a longer one alone, at some 100
    bytes a word and 4 more for each level at which one of its windows comes again."""
    found, short = fresh(docs, "runs", "collapsed")
    place = docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # any name may hold a dot
    schema = StructType([*plain.schema.fields, StructField("runs", RUNS), StructField("collapsed", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(place), 0
            while at < len(texts):
                split, size, rest = [], 0, at
                while rest < len(texts) and (size == 0 or size < TOGETHER):
                    split.append((texts[rest].as_py() or "").encode().split())  # of bytes, only ASCII white space splits
                    size, rest = size + len(split[-1]), rest + 1
                numbers = []
                for w in split:
                    number = {x: i for i, x in enumerate(dict.fromkeys(w))}
                    numbers.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
                runs = find_runs(numbers)
                left = [b" ".join(w if not len(r) else [w[i] for i in np.flatnonzero(kept_words(len(w), r))]).decode() for w, r in zip(split, runs)]
                offsets = np.cumsum([0] + [len(r) for r in runs])
                flat = np.concatenate(runs)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
                part = batch.slice(at, rest - at)
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(left, pa.string())], names=schema.names)
                at = rest
            pa.default_memory_pool().release_unused()

    return plain.mapInArrow(run, schema).toDF(*docs.columns, found, short)


def damaged(doc_id: Column, text: Column) -> Column:
    """The text of a document with a run planted in it, or as it is: with h the CRC-32 of the decimal doc_id and g = h div 10,
    where h % 10 = 0 the words from a = g % n on repeat the first p = 1 + (n - a) div (3 + g % 8) of them. The words are joined by
    one space. A null doc_id plants nothing; a null text is empty."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    plain = F.coalesce(text, F.lit(""))

    def planted(w: Column) -> Column:
        n = F.size(w)
        start = (g % n).cast("int")
        period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < start, x).otherwise(F.get(w, start + (i - start) % period))), " ")).otherwise("")

    return F.when(h % 10 == 0, let(words(plain), planted)).otherwise(plain)


def longest(runs: Column) -> Column:
    """The run of the greatest length; of equally long ones that of the smallest start, then period. Null without runs."""
    ranked = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ranked)
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def digest(docs: DataFrame) -> DataFrame:
    """What collapse() finds in the damaged texts of docs (doc_id, text), as numbers and hashes of one row for each of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), damaged(F.col("doc_id"), text_of()).alias("text"))
    found = collapse(texts).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
