"""Sum-of-squares online packing of token sequences."""

from __future__ import annotations

import json
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END_ID = 2048, 1
#: Words whose ids a Python worker remembers; beyond that it starts anew.
REMEMBERED = 700_000
#: Texts encoded together.
ROWS = 2000
_cache: dict[str, _Ids] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def check(path: str) -> None:
    """Raise ValueError unless the tokenizer is one whose ids of a text are those of its words, one after the other: it takes lower
    case, white space is one space, which ends every token, special tokens begin with <| and ids fit 16 bits."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    parts = lambda x, inner: [y for y in (x or {}).get(inner, [x or {}])]
    normal, before = parts(d.get("normalizer"), "normalizers"), parts(d.get("pre_tokenizer"), "pretokenizers")
    white = any(x.get("type") == "Replace" and x.get("pattern") == {"Regex": "\\s+"} and x.get("content") == " " for x in normal)
    split = any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") and "^\\s" in x.get("pattern", {}).get("Regex", "") for x in before)
    ids = [*d["model"].get("vocab", {}).values(), *(t["id"] for t in d["added_tokens"])]
    if not (white and split and any(x.get("type") == "Lowercase" for x in normal) and all(t["content"].startswith("<|") for t in d["added_tokens"]) and max(ids) < 1 << 16):
        raise ValueError(f"{path} is not a tokenizer of lower-case words between white space")


class _Ids:
    """Ids of texts by a tokenizer that splits at white space: a text's ids are those of its words, one after the other,
    so each word is encoded once and then remembered."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share the cores already
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.ids, self.start, self.used = np.zeros(1 << 16, np.uint16), np.zeros(1 << 16, np.int64), 0

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 1000):
            part = new[i : i + 1000]
            e = self.tok.encode(" ".join(part), add_special_tokens=False)
            first = np.cumsum([0] + [len(w) + 1 for w in part])
            got = np.array(e.ids, dtype=np.uint16)
            begin = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(got))[::2]
            count = np.bincount(np.searchsorted(first, begin, side="right") - 1, minlength=len(part))
            while self.used + len(got) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + len(got)] = got
            n = len(self.at)
            self.at.update(zip(part, range(n, n + len(part))))
            while n + len(part) >= len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.start[n + 1 : n + 1 + len(part)] = self.used + np.cumsum(count)
            self.used += len(got)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END_ID, and where each text's begin (one more for the end)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring(texts, "<|")  # may hold the text of a special token
        special = {j: np.array(self.tok.encode(texts[j].as_py(), add_special_tokens=False).ids, dtype=np.uint16) for j in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(odd, "", texts)))
        plain = pc.list_value_length(split).to_numpy()
        parts = split.flatten().dictionary_encode()
        own = parts.dictionary.to_pylist()
        if len(self.at) > REMEMBERED:
            self.clear()
        self.learn([w for w in own if w not in self.at])
        which = np.fromiter(map(self.at.__getitem__, own), np.int64, len(own))
        begin, size = self.start[which], self.start[which + 1] - self.start[which]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(begin - before[:-1], size) + np.arange(before[-1])]
        flat = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids)).take(parts.indices).flatten().to_numpy()
        upto = np.concatenate([[0], np.cumsum(size[parts.indices.to_numpy()])])
        edge = upto[np.concatenate([[0], np.cumsum(plain)])]
        if special:
            parts = [special.get(j, flat[edge[j] : edge[j + 1]]) for j in range(len(texts))]
            flat, edge = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        edge = edge + np.arange(len(edge))
        out = np.full(edge[-1], END_ID, dtype="<u4")
        own_ids = np.ones(len(out), dtype=bool)
        own_ids[edge[1:] - 1] = False
        out[own_ids] = flat
        return out, edge


class SumOfSquares:
    """Windows of one capacity that are filled online. levels[h] counts the open windows filled up to h; a piece goes to
    the level, or to a new window, that leaves the least sum of squared counts."""

    def __init__(self, capacity: int):
        self.capacity, self.levels = capacity, np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def place(self, piece, size: int) -> list | None:
        """Put a piece of `size` ids in; the window's pieces if that fills it."""
        top = self.capacity - size
        gain = 2 * self.levels[size : self.capacity + 1] + 1  # what the new level adds
        gain[top] = 0  # a full window is closed
        cost = gain - np.where(self.levels[: top + 1] > 0, 2 * self.levels[: top + 1] - 1, -(1 << 40))
        cost[0] = gain[0]  # a new window
        h = top - int(np.argmin(cost[::-1]))  # ties: the fullest window
        pieces = []
        if h:
            self.levels[h] -= 1
            pieces = self.open[h].pop(0)
        pieces.append(piece)
        if h + size == self.capacity:
            return pieces
        self.levels[h + size] += 1
        self.open[h + size].append(pieces)
        return None

    def rest(self) -> list:
        """The pieces of the windows still open, the fullest first."""
        return [p for h in range(self.capacity, 0, -1) for w in self.open[h] for p in w]


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all docs (doc_id, text) in sequences of at most `capacity` ids, a power of two.

    Each partition is packed on its own, as its rows come, without a shuffle: a document's full windows are closed at
    once and its remainder is placed by sum of squares. At the end of the partition the pieces of the windows that are
    still open are cut to fill whole windows, and the last of them to powers of two, so no sequence needs padding. What
    is held in memory is the open windows. sequence_id is the partition's number and a count.

    A tokenizer that check() refuses raises ValueError. Null text: empty, so a document of one id. Repeated rows are packed each on their own. An empty table gives no rows.
    Other columns are ignored.
    """
    path = tokenizer or tokenizer_path()
    check(path)

    def run(batches):
        if path not in _cache:
            _cache[path] = _Ids(path)
        encode = _cache[path].of
        box, rows, count = SumOfSquares(capacity), [], TaskContext.get().partitionId() << 40

        def emit(pieces):
            nonlocal count
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, count, offset))
                offset += len(ids)
            count += 1

        def out():
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            batch = pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows)], names=names)
            rows.clear()
            return batch

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                flat, edge = encode(part.column(1))
                for j, doc in enumerate(part.column(0).to_pylist()):
                    ids = flat[edge[j] : edge[j + 1]]
                    whole = len(ids) - len(ids) % capacity
                    for s in range(0, whole, capacity):
                        emit([(doc, s, ids[s : s + capacity], len(ids))])
                    if whole < len(ids) and (full := box.place((doc, whole, ids[whole:].copy(), len(ids)), len(ids) - whole)):
                        emit(full)
                if rows:
                    yield out()
        rest = box.rest()
        left = sum(len(x[2]) for x in rest)
        while left:
            size = capacity if left >= capacity else 1 << (left.bit_length() - 1)
            pieces, need = [], size
            while need:
                doc, start, ids, total = rest[0]
                pieces.append((doc, start, ids[:need], total))
                rest[:1] = [(doc, start + need, ids[need:], total)] if len(ids) > need else []
                need -= min(need, len(ids))
            emit(pieces)
            left -= size
            if len(rows) > 10_000:
                yield out()
        if rows:
            yield out()
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
