"""Repair of conversations: the cheapest edits that give turns of user and assistant, by Dial's shortest paths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, scratch

#: What edits cost; a kept row whose text is cut off costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
COSTLIEST = max(REROLE + TRUNCATED, DELETE, INSERT)
#: What has been said: nothing, the system's row, the user's, the assistant's. Next state by the role's initial, and the only
#: role of the two that may follow each state.
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
FOLLOWS = {NONE: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Cost from each state to a whole conversation when no row is left, and the edits.
END = (0, 2 * INSERT, INSERT, 0)
LAST = ("", "II", "I", "")
FAR = 1 << 60
#: A row as a number: its role's initial, and whether it must go or is cut off.
INITIALS, MUST_GO, CUT_OFF = "sua", 4, 8
#: Conversations of more rows or characters are cut into blocks of so many rows.
ROWS, CHARS, BLOCK = 20_000, 16_000_000, 1 << 14
FAULTS = ("blank", "duplicate", "truncated")
WHITE = " \t\n\v\f\r"


def arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, next state, cost) of what can be done with a row in a state, in the order of the edits' letters; rows only, as
    an insertion does not use one up."""
    initial = "" if code & 3 == 3 else INITIALS[code & 3]
    out = [("D", state, DELETE)]
    if not code & MUST_GO:
        more = TRUNCATED if code & CUT_OFF else 0
        if (state, initial) in NEXT:
            out.append(("K", NEXT[state, initial], more))
        out.append(("R", FOLLOWS[state], REROLE + more))
    return out


#: By code and state, so that rows need no rules.
ARCS = [[arcs(code, state) for state in range(4)] for code in range(16)]
#: The same arcs backwards: (state before, cost) by code and state after. INTO: the states before an insertion.
BACK = [[[(s, cost) for s in range(4) for _, t, cost in ARCS[code][s] if t == after] for after in range(4)] for code in range(16)]
INTO = [[s for s in range(4) if FOLLOWS[s] == after] for after in range(4)]


def distances(codes: bytes, end: tuple[int, ...]) -> list[int]:
    """The cost of the cheapest edits from each place, 4 * row + state, to the goal, which is `end` away after the last row.

    Dial's algorithm from the goal against the arcs: places wait in buckets by their distance, of which, as no arc costs
    more than COSTLIEST, only so many and one are in use at a time."""
    n = len(codes)
    known = [FAR] * (4 * n + 4)
    buckets: list[list[int]] = [[] for _ in range(COSTLIEST + 1)]
    least = min(end)
    if least >= FAR:
        return known
    todo = sorted(((d, s) for s, d in enumerate(end) if d < FAR), reverse=True)
    now, waiting = least, 0
    while waiting or todo:
        if not waiting:
            now = max(now, todo[-1][0])
        while todo and todo[-1][0] <= now:
            d, s = todo.pop()
            if d < known[4 * n + s]:
                known[4 * n + s] = d
                buckets[d % (COSTLIEST + 1)].append(4 * n + s)
                waiting += 1
        bucket = buckets[now % (COSTLIEST + 1)]
        while bucket:
            place = bucket.pop()
            waiting -= 1
            if known[place] != now:
                continue  # a shorter way was found
            row, state = divmod(place, 4)
            if row < n:
                for before in INTO[state]:
                    p, d = 4 * row + before, now + INSERT
                    if d < known[p]:
                        known[p] = d
                        buckets[d % (COSTLIEST + 1)].append(p)
                        waiting += 1
            if row:
                for before, cost in BACK[codes[row - 1]][state]:
                    p, d = place - 4 - state + before, now + cost
                    if d < known[p]:
                        known[p] = d
                        buckets[d % (COSTLIEST + 1)].append(p)
                        waiting += 1
        now += 1
    return known


def walk(codes: bytes, known: list[int], state: int) -> tuple[list[str], int]:
    """(the edits of each row with the insertions before it, the state after) along tight arcs from a state, each the least by
    its letter: from one place each letter is one arc, so these edits are the least of the cheapest."""
    out, before = [], ""
    for row, code in enumerate(codes):
        while True:
            here = known[4 * row + state]
            edit, after, cost = ARCS[code][state][0]
            if here == cost + known[4 * row + 4 + after]:
                break
            after = FOLLOWS[state]
            if here == INSERT + known[4 * row + after]:
                before, state = before + "I", after
                continue
            edit, after, cost = next(x for x in ARCS[code][state][1:] if here == x[2] + known[4 * row + 4 + x[1]])
            break
        out.append(before + edit)
        state, before = after, ""
    return out, state


def replayed(edits: list[str], rows: list[tuple[str, str]], state: int) -> tuple[list[tuple[str, str, str]], int]:
    """((edit, role, text) of what the edits of rows (role, text) leave, the state after)."""
    out = []
    for letters, row in zip(edits, [*rows, None]):
        for x in letters:
            if x == "D":
                continue
            state = NEXT[state, row[0][:1]] if x == "K" else FOLLOWS[state]
            out.append((x, row[0] if x == "K" else ROLE[state], "" if x == "I" else row[1]))
    return out, state


def code_of(role: str, gone: bool, cut_off: bool) -> int:
    at = INITIALS.find(role[:1]) if role else -1
    return (at if at >= 0 else 3) | (MUST_GO if gone else 0) | (CUT_OFF if cut_off else 0)


def fault_of(text: str, seen: bool) -> str | None:
    """The first fault of a row: blank, duplicate or truncated; None if it has none."""
    solid = text.rstrip(WHITE)
    if not solid:
        return "blank"
    if seen:
        return "duplicate"
    return None if solid[-1] in ".!?" else "truncated"


def illegal(one: str, two: str) -> bool:
    return one[:1] + two[:1] not in ("su", "ua", "au")


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


SUMMARY = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "array<struct<edit:string,role:string,text:string>>"


def judged(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple[dict, list[tuple[str, str, str]]]:
    """(summary, repaired turns) of one conversation's rows (role, text) in order."""
    seen, codes, counts = set(), bytearray(), dict.fromkeys(FAULTS, 0)
    for role, text in rows:
        fault = fault_of(text, (role, text) in seen)
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        codes.append(code_of(role, fault in FAULTS[:2], fault == "truncated"))
    cost, audit, left = 0, "", []
    if rows:
        known = distances(bytes(codes), END)
        edits, state = walk(bytes(codes), known, NONE)
        edits.append(LAST[state])
        left, _ = replayed(edits, rows, NONE)
        cost, audit = known[NONE], "".join(edits)
    whole = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in left).encode()).hexdigest()
    broken = sum(illegal(a[0], b[0]) for a, b in zip(rows, rows[1:]))
    return {"gaps": _gaps(turns), **counts, "illegal": broken, "cost": cost, "audit": audit, "repaired_sha256": whole}, left


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.sortWithinPartitions(*[F.col(x) for x in first], F.col("turn").asc_nulls_first(), "role", "text")


def _small(rows: DataFrame, texts: bool) -> DataFrame:
    """Conversations that each fit a task: one shuffle by conv_id, then one after the other from the sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, turns, said = [], (), [], []

        def done() -> None:
            if now:
                summary, left = judged(turns, said)
                out.append({"conv_id": now[0], **summary} | ({"repaired": [dict(zip(("edit", "role", "text"), x)) for x in left]} if texts else {}))

        for batch in batches:
            for conv, turn, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now != (conv,):
                    done()
                    now, turns, said = (conv,), [], []
                turns += [turn] * (copies > 0)
                said += [(role, text)] * copies
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    kind = f"conv_id bigint, {SUMMARY}" + (f", repaired {TURNS}" if texts else "")
    fields = [(x, pa.string() if x in ("audit", "repaired_sha256") else pa.int64()) for x in ("conv_id", *[f.split()[0] for f in SUMMARY.split(", ")])]
    turn = pa.struct([(x, pa.string()) for x in ("edit", "role", "text")])
    schema = pa.schema(fields + ([("repaired", pa.list_(turn))] if texts else []))
    sorted_rows = _in_order(rows.repartition("conv_id"), "conv_id")
    return sorted_rows.select("conv_id", "turn", "role", "text", "copies").mapInArrow(run, kind)


def _blocks(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(placed, faulty, edited) of conversations of any length, none of which meets in one task.

    placed has the rows with place, a number in the order of each conversation; faulty has their faults, codes and blocks
    without the texts; edited (conv_id, block, edits, cost, last, place) has the edits of each row of a block. Rows are dealt by ranges of their order,
    so one conversation, turn or repeated row may fill many partitions; each partition's part of a conversation is cut
    into blocks. A block gives the costs from each state before it to each after it, by four runs of Dial's algorithm; these
    4 x 4 numbers of all blocks of a conversation are chained in one task, and a second run over the block, from
    the costs behind it, gives its edits for each state before it, of which the chain of states picks one."""
    keyed = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("tie", F.monotonically_increasing_id())  # tells repeated rows apart
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = scratch(dealt.select("conv_id", "turn", "role", "text").withColumn("place", F.monotonically_increasing_id()), "turns")
    begin = placed.groupBy("conv_id", F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("begin"))
    hashed = placed.select("conv_id", "role", F.sha2("text", 256).alias("said"), "place")
    first = hashed.groupBy("conv_id", "role", "said").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    solid = F.rtrim("text", F.lit(WHITE))
    fault = F.when(solid == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.substring(solid, -1, 1).isin(".", "!", "?"), "truncated")
    # the last character is all that a fault needs of a text
    narrow = placed.select("conv_id", "turn", "role", "place", F.substring(solid, -1, 1).alias("text"), F.shiftright("place", 33).alias("part"))
    faulty = narrow.join(first, "place", "left").join(begin, ["conv_id", "part"]).withColumn("fault", fault)
    faulty = faulty.withColumn("block", F.struct(F.col("part"), F.floor((F.col("place") - F.col("begin")) / block).alias("n")))
    initial = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in INITIALS]), F.substring("role", 1, 1)).cast("int"), F.lit(0))
    code = F.when(initial == 0, 3).otherwise(initial - 1) + F.when(F.col("fault").isin(*FAULTS[:2]), MUST_GO).otherwise(0) + F.when(F.col("fault") == FAULTS[2], CUT_OFF).otherwise(0)
    faulty = scratch(faulty.select("conv_id", "turn", "role", "place", "fault", code.cast("int").alias("code"), F.concat_ws(":", F.lpad(F.col("part").cast("string"), 12, "0"), F.lpad(F.col("block.n").cast("string"), 12, "0")).alias("block")), "faults")
    codes = faulty.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("place", "code"))).alias("rows"))
    codes = scratch(codes.select("conv_id", "block", "rows.place", "rows.code"), "blocks")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cost = []
            for code in b["code"]:
                ends = [distances(bytes(code.astype(np.uint8)), tuple(0 if s == t else FAR for s in range(4)))[:4] for t in range(4)]
                cost.append([ends[t][s] for s in range(4) for t in range(4)])
            yield b[["conv_id", "block"]].assign(cost=cost)

    def chained(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("block")
        behind, now = [], np.array(END)
        for cost in b["cost"][::-1]:
            behind.append(now.tolist())
            now = np.minimum((cost.reshape(4, 4) + now).min(axis=1), FAR)
        return b[["conv_id", "block"]].assign(behind=behind[::-1])

    behind = codes.select("conv_id", "block", "code").mapInPandas(matrices, "conv_id string, block string, cost array<bigint>")
    behind = scratch(behind.groupBy("conv_id").applyInPandas(chained, "conv_id string, block string, behind array<bigint>"), "behind")

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for conv, block, code, end in zip(b["conv_id"], b["block"], b["code"], b["behind"]):
                code = bytes(code.astype(np.uint8))
                known = distances(code, tuple(int(x) for x in end))
                for state in range(4):
                    if known[state] < FAR:
                        edits, after = walk(code, known, state)
                        rows.append((conv, block, state, edits, after, known[state]))
            yield pd.DataFrame(rows, columns=["conv_id", "block", "state", "edits", "after", "cost"])

    ways = codes.join(behind, ["conv_id", "block"]).select("conv_id", "block", "code", "behind")
    ways = scratch(ways.mapInPandas(walked, "conv_id string, block string, state int, edits array<string>, after int, cost bigint"), "ways")

    def picked(b: pd.DataFrame) -> pd.DataFrame:
        state, rows, after = NONE, [], {(x, s): a for x, s, a in zip(b["block"], b["state"], b["after"])}
        for block in sorted(set(b["block"])):
            rows.append((block, state))
            state = after[block, state]
        out = pd.DataFrame(rows, columns=["block", "state"])
        return out.assign(conv_id=b["conv_id"].iloc[0], last=[""] * (len(rows) - 1) + [LAST[state]])[["conv_id", "block", "state", "last"]]

    chosen = ways.select("conv_id", "block", "state", "after").groupBy("conv_id").applyInPandas(picked, "conv_id string, block string, state int, last string")
    edited = ways.join(chosen, ["conv_id", "block", "state"]).join(codes, ["conv_id", "block"])
    edited = scratch(edited.select("conv_id", "block", "edits", "cost", "last", "place"), "edits")
    discard(codes, behind, ways)
    return placed, faulty, edited


def _large(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The summaries of conversations of any length. All but the hash is summed over blocks; a SHA-256 over a conversation
    can only be taken in order, so its repaired rows pass one task as a stream, of which it holds one batch."""
    placed, faulty, edited = _blocks(rows.withColumn("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))), block)
    next_role = F.lead(F.substring("role", 1, 1))
    within = Window.partitionBy("conv_id", "block").orderBy("place")
    pair = F.concat(F.substring("role", 1, 1), next_role.over(within))
    steps = faulty.withColumn("pair", pair)
    per = steps.groupBy("conv_id", "block").agg(
        *[F.sum((F.col("fault") == x).cast("long")).alias(x) for x in FAULTS], F.sum((F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au")).cast("long")).alias("illegal"),
        F.min_by("role", "place").alias("one"), F.max_by("role", "place").alias("end"),
    )
    over = Window.partitionBy("conv_id").orderBy("block")  # one row for each block
    joint = F.concat(F.substring("end", 1, 1), F.lead(F.substring("one", 1, 1)).over(over))
    per = per.withColumn("illegal", F.col("illegal") + F.when(joint.isNotNull() & ~joint.isin("su", "ua", "au"), 1).otherwise(0))
    counts = per.groupBy("conv_id").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in (*FAULTS, "illegal")])
    turns = placed.select("conv_id", "turn").distinct().groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    audits = edited.select("conv_id", "block", "cost", F.concat(F.array_join("edits", ""), F.col("last")).alias("part"))
    audits = audits.groupBy("conv_id").agg(F.min_by("cost", "block").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda x: x["part"]), "").alias("audit"))

    zipped = edited.select("last", F.explode(F.arrays_zip("place", "edits")).alias("x"), F.element_at("place", -1).alias("end"))
    zipped = zipped.select("x.place", "x.edits", F.when(F.col("x.place") == F.col("end"), F.col("last")).otherwise("").alias("last"))
    texts = placed.select("conv_id", "place", "role", "text").join(zipped, "place").repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, digest, any_yet = (), NONE, None, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            for conv, role, text, edits, last in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if now != (conv,):
                    if now:
                        yield row()
                    now, state, digest, any_yet = (conv,), NONE, hashlib.sha256(), False
                left, state = replayed([edits, last], [(role, text)], state)
                for _, r, t in left:
                    digest.update((("\n" if any_yet else "") + f"{r}:{t}").encode())
                    any_yet = True
        if now:
            yield row()

    hashes = texts.select("conv_id", "role", "text", "edits", "last").mapInArrow(hashed, "conv_id string, repaired_sha256 string")
    out = counts
    for other in (turns, audits, hashes):
        out = out.join(other, "conv_id")
    return out.select(F.when(F.col("conv_id") != " ", F.col("conv_id")).cast("long").alias("conv_id"), *[f.split()[0] for f in SUMMARY.split(", ")])


def _plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with one space for null roles and texts, each row once, or as often as it says."""
    copies = F.col("copies").cast("int") if "copies" in conversations.columns else F.lit(1)
    blank = F.lit(" ")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), copies.alias("copies"))


def repair(conversations: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """One row for each conv_id of conversations (conv_id, turn, role, text): gaps in its turns, its rows with each first fault
    (blank; duplicate: role and text stood earlier; truncated: no full stop, exclamation or question mark at the end), its illegal pairs of
    neighbours, the cost of the cheapest edits that make its roles' initials an optional s and then pairs ua, or nothing;
    audit, these edits' initials, the ASCII-least of equally cheap ones, and the SHA-256 of the repaired role:text lines.

    Rows count by turn, nulls first, then role and text, so repeated rows stand beside each other. A null role or text is
    one space; rows of a null conv_id are one conversation; an empty table gives an empty result; other columns are ignored, but
    an integer column `copies`, if there is one, tells how often a row is there; 0 leaves its conversation. Conversations of up to
    `rows` rows and `chars` characters are shuffled once; longer ones are cut into blocks that many tasks share."""
    plain = _plain(conversations)
    size = plain.groupBy("conv_id").agg(F.sum("copies").alias("rows"), F.sum(F.length("text") * F.col("copies")).alias("chars"))
    large = scratch(size.where((F.col("rows") > rows) | (F.col("chars") > chars)).select("conv_id", F.lit(True).alias("large")), "large")
    if large.isEmpty():
        discard(large)
        return _small(plain, False)
    same = F.col("p.conv_id").eqNullSafe(F.col("l.conv_id"))
    few = plain.alias("p").join(large.alias("l"), same, "left_anti")
    many = plain.alias("p").join(large.alias("l"), same, "left_semi").where("copies > 0")
    return _small(few, False).unionByName(_large(many))


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, repaired), the repaired conversations that repair() judges: an array of (edit, role, text), edit K for what was
    kept, R with another role and I for what was put in. For conversations that fit a row."""
    return _small(_plain(conversations), True).select("conv_id", "repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations with faults planted in them by crc32(conv_id:turn) % 20: 0 drops a
    row (copies is 0), 1 empties its text, 2 takes its full stops, exclamation and question marks away, 3 repeats it
    (copies is 2), 4 gives it to the user. Nulls read as one space, but turn stays null."""
    blank = F.lit(" ")
    act = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(act == 4, "user").otherwise(role).alias("role"),
        F.when(act == 1, "").when(act == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(act == 0, 0).when(act == 3, 2).otherwise(1).cast("int").alias("copies"),
    )
