"""Substring deduplication: windows of words that also start earlier, found by level-wise doubling."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_of

#: Bytes of text hashed at once, and bytes of text for each bucket of the shuffle.
CHUNK, BUCKET = 2 << 20, 1 << 20
#: Bytes of text for each partition of a shuffle.
TASK = 32 << 20
#: Windows that a task remembers as frequent, at most.
FREQUENT = 500_000
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(line: bytes) -> np.ndarray:
    """64-bit hashes of the words of a line in which one space separates them."""
    arr = np.frombuffer(line, dtype=np.uint8)
    space = np.flatnonzero(arr == 32)
    start = np.concatenate([[0], space + 1])
    size = np.concatenate([space, [len(arr)]]) - start
    order = np.argsort(-size, kind="stable")
    at, n = start[order], size[order]
    h = np.full(len(at), _ODD, dtype=np.uint64)
    longer, k = len(at), 0
    while longer:
        h[:longer] = h[:longer] * _ODD + _BYTE[arr[at[:longer] + k]]
        k += 1
        longer = int(np.searchsorted(-n, -k, side="left"))
    out = np.empty_like(h)
    out[order] = _mix(h + n.astype(np.uint64))
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a window followed by another."""
    return _mix(a * _ODD + b)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of `width` words, by doubling."""
    if width == 1:
        return h
    half = window_hashes(h, width // 2)
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = joined(half[:n], half[width // 2 : width // 2 + n])
    return joined(out, h[width - 1 : width - 1 + n]) if width % 2 else out


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each `span` values in a row."""
    out, got = h, 1
    while got < span:
        step = min(got, span - got)
        out = np.minimum(out[: len(out) - step], out[step:])
        got += step
    return out


def _runs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs, given where one begins."""
    at = np.flatnonzero(first)
    return at, np.diff(np.append(at, len(first)))


def _later(least: np.ndarray, whole: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a window, known by its two hashes, also has a smaller (doc, start), and whether it is the first of several."""
    order = np.lexsort((start, doc, least, whole))
    m, k, d, s = least[order], whole[order], doc[order], start[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    later, first = np.empty(len(k), dtype=bool), np.zeros(len(k), dtype=bool)
    later[order] = (d != d[lead]) | (s != s[lead])
    first[order[lead[later[order]]]] = True
    return later, first


_SHIPPED = pa.schema([("bucket", pa.int32()), ("found", pa.bool_()), *((x, pa.binary()) for x in ("least", "doc", "start", "n", "low", "high"))])
_SHIPPED_DDL = "bucket int, found boolean, least binary, doc binary, start binary, n binary, low binary, high binary"


def _batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows), _SHIPPED)], schema=_SHIPPED)


def _intervals(doc, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in order, joined to (doc, start, n) where one follows the other."""
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at, n = _runs(first)
    return doc[at], start[at], n.astype(np.int32)


def _windows(docs: list[tuple[int, str]], width: int):
    """(doc, start, whole, least) of all windows of (key, text) in order: the window's hash, and the least one of the windows
    of half its width that it holds."""
    lines = [(k, b" ".join(t.encode().split())) for k, t in sorted(docs, key=lambda x: x[0])]
    lines = [(k, x) for k, x in lines if x]
    h = word_hashes(b" ".join(x for _, x in lines)) if lines else np.zeros(0, np.uint64)
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    counts = np.array([x.count(b" ") + 1 for _, x in lines])
    half = window_hashes(h, width // 2)
    whole = joined(half[: len(h) - width + 1], half[width // 2 : width // 2 + len(h) - width + 1])
    least = _least(half, width - width // 2 + 1)
    which = np.repeat(np.arange(len(lines)), counts)
    at = np.flatnonzero(which[: len(whole)] == which[width - 1 :])
    which = which[at]
    doc = np.array([k for k, _ in lines], dtype=np.int64)[which]
    return doc, (at - np.concatenate([[0], np.cumsum(counts)])[which]).astype(np.int32), whole[at], least[at]


def _records(doc, start, whole, least, buckets: int):
    """One row for each bucket: its runs of neighbouring windows with one least hash."""
    if not len(doc):
        return
    first = np.ones(len(doc), dtype=bool)
    first[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    first[::60_000] = True  # a run's length has 16 bits
    run, n = _runs(first)
    bucket = (least[run] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    run, n, bucket = run[order], n[order], bucket[order]
    edge = np.concatenate([[0], np.cumsum(n)])
    content = whole[np.repeat(run - edge[:-1], n) + np.arange(edge[-1])]
    low, high = content.astype(np.uint32), (content >> np.uint64(32)).astype(np.uint16)  # with the least hash 112 bits
    m, d, s, short = least[run], doc[run], start[run], n.astype(np.uint16)
    rows = []
    new = np.ones(len(bucket), dtype=bool)
    new[1:] = bucket[1:] != bucket[:-1]
    for a, size in zip(*(x.tolist() for x in _runs(new))):
        b = a + size
        rows.append((int(bucket[a]), False, m[a:b].tobytes(), d[a:b].tobytes(), s[a:b].tobytes(), short[a:b].tobytes(), low[edge[a] : edge[b]].tobytes(), high[edge[a] : edge[b]].tobytes()))
    yield _batch(rows)


class _Frequent:
    """Windows that come more than once in a chunk: a task sends each of them once, its first place; of all later places,
    also in later chunks, it knows at once that they are repeats. Holds `most` windows at most; others are sent as any."""

    def __init__(self, most: int):
        self.most = most
        self.whole, self.least = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.doc, self.start = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def split(self, doc, start, whole, least):
        """(rest, doc, start): which of the windows are not held, and the places that are repeats of held ones."""
        if not len(self.whole):
            return np.ones(len(doc), dtype=bool), doc[:0], start[:0]
        at = np.minimum(np.searchsorted(self.whole, whole), len(self.whole) - 1)
        held = (self.whole[at] == whole) & (self.least[at] == least)
        i, h = np.flatnonzero(held), at[held]
        # equal windows of one chunk were settled before, so each h comes once, or with one place
        later = (doc[i] > self.doc[h]) | ((doc[i] == self.doc[h]) & (start[i] > self.start[h]))
        earlier = (doc[i] < self.doc[h]) | ((doc[i] == self.doc[h]) & (start[i] < self.start[h]))
        out = np.concatenate([doc[i[later]], self.doc[h[earlier]]]), np.concatenate([start[i[later]], self.start[h[earlier]]])
        self.doc[h[earlier]], self.start[h[earlier]] = doc[i[earlier]], start[i[earlier]]
        return ~held, *out

    def add(self, doc, start, whole, least):
        """Hold these, which are not held yet; which of them there is room for."""
        room = np.zeros(len(doc), dtype=bool)
        room[: max(0, self.most - len(self.whole))] = True
        parts = [np.concatenate(x) for x in ((self.whole, whole[room]), (self.least, least[room]), (self.doc, doc[room]), (self.start, start[room]))]
        order = np.argsort(parts[0], kind="stable")
        self.whole, self.least, self.doc, self.start = (x[order] for x in parts)
        return room

    def rest(self):
        order = np.lexsort((self.start, self.doc))
        return self.doc[order], self.start[order], self.whole[order], self.least[order]


def _ship(docs: list[tuple[int, str]], width: int, buckets: int, frequent: _Frequent):
    """Record batches for a chunk of (key, text)."""
    doc, start, whole, least = _windows(docs, width)
    if not len(doc):
        return
    later, first = _later(least, whole, doc, start)
    rest, old_doc, old_start = frequent.split(doc[~later], start[~later], whole[~later], least[~later])
    here, first = np.flatnonzero(~later)[rest], first[~later][rest]
    found_doc, found_start = np.concatenate([doc[later], old_doc]), np.concatenate([start[later], old_start])
    if len(found_doc):
        order = np.lexsort((found_start, found_doc))
        d, s, n = _intervals(found_doc[order], found_start[order])
        yield _batch([(int(d[0]) % buckets, True, b"", d.tobytes(), s.tobytes(), n.tobytes(), b"", b"")])
    if first.any():
        some = here[first]
        kept = frequent.add(doc[some], start[some], whole[some], least[some])
        stay = np.ones(len(here), dtype=bool)
        stay[np.flatnonzero(first)[kept]] = False
        here = here[stay]
    yield from _records(doc[here], start[here], whole[here], least[here], buckets)


def _bucket(t: pa.Table) -> pa.Table:
    """What is repeated among the windows of one bucket."""
    get = lambda rows, name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype=kind)
    found = t.filter(t.column("found"))
    rest = t.filter(pa.compute.invert(t.column("found")))
    out = [(get(found, "doc", np.int64), get(found, "start", np.int32), get(found, "n", np.int32))]
    m, d, s, n = get(rest, "least", np.uint64), get(rest, "doc", np.int64), get(rest, "start", np.int32), get(rest, "n", np.uint16).astype(np.int64)
    if len(m):
        # half the width: only runs whose half-window comes more than once go on
        _, back, count = np.unique(m, return_inverse=True, return_counts=True)
        alive = count[back] > 1
        windows = np.repeat(alive, n)
        content = get(rest, "low", np.uint32)[windows].astype(np.uint64) | get(rest, "high", np.uint16)[windows].astype(np.uint64) << np.uint64(32)
        m, d, s, n = m[alive], d[alive], s[alive], n[alive]
        if len(m):
            # the whole width
            run_of = np.repeat(np.arange(len(n)), n)
            edge = np.concatenate([[0], np.cumsum(n)])[:-1]
            start = (s[run_of] + np.arange(len(run_of)) - edge[run_of]).astype(np.int32)
            later, _ = _later(m[run_of], content, d[run_of], start)
            out.append(_intervals(d[run_of][later], start[later]))
    doc, start, n = (np.concatenate(x) for x in zip(*out))
    return pa.table({"k": pa.array(doc, pa.int64()), "span": pa.array(start.astype(np.int64) << 32 | n.astype(np.int64), pa.int64())})


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _partitions(docs: DataFrame, total: int) -> int:
    """Partitions of a shuffle for so many bytes of text: as many as the session says, or more, so that tasks stay small."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK))


def repeated_spans(docs: DataFrame, width: int = 20, bucket_bytes: int = BUCKET) -> DataFrame:
    """(k, span) for docs (k, text): spans of windows of `width` words that also start earlier; span is the first window's
    start, shifted left by 32 bits, and the number of windows in a row.

    Windows are grouped by the least hash among the windows of half their width that they hold, which two equal windows
    share. A run of neighbouring windows with one such hash travels as one record. Within a bucket only runs whose
    half-window comes twice go on to the whole width: what is not repeated at half the length cannot be at the whole. At
    the last level no candidates are left to extend, as longer repeats cover no other words. Windows are known by both
    hashes, 112 bits (in one chunk 128). Copies inside one chunk are settled where they are read, and what comes twice in a chunk is remembered
    by its task, so of a passage that many documents hold a task sends one copy.
    """
    assert width % 2 == 0
    total = _bytes(docs)
    buckets = max(16, math.ceil(total / bucket_bytes))

    def ship(batches):
        waiting, size, frequent = [], 0, _Frequent(FREQUENT)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                for k, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    waiting.append((k, text))
                    size += len(text)
                    if size >= CHUNK:
                        yield from _ship(waiting, width, buckets, frequent)
                        waiting, size = [], 0
        yield from _ship(waiting, width, buckets, frequent)
        yield from _records(*frequent.rest(), buckets)

    return docs.mapInArrow(ship, _SHIPPED_DDL).repartition(_partitions(docs, total), "bucket").groupBy("bucket").applyInArrow(_bucket, "k long, span long")


def without_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs (doc_id, text): kept is the words that no removed window
    covers, joined by one space. A window is removed if its words also start earlier: in a smaller doc_id, or earlier in
    the same document. Windows are judged on the input.

    Null text: no words. A null doc_id comes before all others. Rows with one doc_id come in the order of a hash of their
    texts; those with equal texts too are one document, so all of them stay or go alike. An empty table gives an empty
    result; other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), text_of().alias("text"))
    if not keyed.groupBy("k").count().where("count > 1").isEmpty():
        rows = keyed.withColumn("hash", F.md5("text"))
        places = rows.select("k", "hash").distinct().repartitionByRange("k", "hash").sortWithinPartitions("k", "hash")
        places = scratch(places.withColumn("place", F.monotonically_increasing_id()), "places")  # in the order of ranges
        keyed = rows.join(places, ["k", "hash"]).select("doc_id", F.col("place").alias("k"), "text")
    spans = repeated_spans(keyed.select("k", "text"), width).groupBy("k").agg(F.collect_list("span").alias("spans"))

    def cut(batches):
        for b in batches:
            words_n, removed, kept = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts = text.encode().split()
                gone = 0
                if spans:
                    x = np.array(spans, dtype=np.int64)
                    start, n = x >> 32, x & 0xFFFFFFFF
                    step = np.zeros(len(parts) + 1, dtype=np.int64)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + n - 1 + width, -1)
                    stay = np.cumsum(step)[:-1] == 0
                    gone = len(parts) - int(stay.sum())
                    kept.append(b" ".join(p for p, s in zip(parts, stay.tolist()) if s).decode())
                else:
                    kept.append(b" ".join(parts).decode())
                words_n.append(len(parts))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words_n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    both = keyed.join(spans.hint("shuffle_hash"), "k", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
