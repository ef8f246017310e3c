"""Cheapest repair of conversation structure by an auction for shortest paths.

The turns of a conversation span a lattice: a node is the number of turns done and what the repaired sequence ends with,
an arc is one edit. The auction keeps a price for every node, never above the cost of any arc plus the price behind it,
and a path from its origin: where no arc out of the path's end is tight, that node's price rises to the cheapest one and
the path gives the node up, else the path goes on along the cheapest arc, until it reaches the end. The origin's price
is then its distance. All shortest paths consist of tight arcs; they are followed in the order of their letters, and the
node behind an arc is made the origin of another auction before the arc counts as tight.

Long conversations are priced in blocks from the end, each block against the prices of the next one. Turns are sorted over
all partitions; conversations inside one partition are solved there. One that reaches over a partition's edge (or is too
long to hold) is solved by segments, a segment being what one partition holds of it: the costs between a segment's first
and last states, the auction over the segments, the paths inside each. Only the hash of its repaired text runs over the
conversation in order, fed from packed chunks.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired sequence ends with
FOLLOWER = (USER, USER, ASSISTANT, USER)  # the role a turn put in or given anew has
NAMES = ("", "system", "user", "assistant")
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDING, TAIL = (0, 4, 2, 0), ("", "II", "I", "")  # costs and letters of ending on a user's and assistant's turn
INITIALS, MUST_GO = "sua", 8  # a turn's code: twice the place of its initial (3: another one), plus 1 if truncated
FAR = 1 << 60
BLOCK = 16  # turns priced at once: an auction's steps grow with the square of the path
HELD = 1 << 22  # characters of a conversation held while its partition is read
CHUNK = 1 << 20  # characters of repaired text hashed at once
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = {"su", "ua", "au"}
Arcs = tuple[tuple[int, int, str], ...]


def arcs(code: int, state: int) -> Arcs:
    """(step to the node behind, cost, letter) in the order of the letters; nodes are 4 x turns done + state."""
    follower, late = FOLLOWER[state], TRUNCATED * (code & 1)
    out = [(4, DELETE, "D"), (follower - state, INSERT, "I")]
    if code != MUST_GO:
        kept = KEPT.get((state, (INITIALS + "-")[code >> 1]))
        if kept is not None:
            out.append((4 + kept - state, KEEP + late, "K"))
        out.append((4 + follower - state, REROLE + late, "R"))
    return tuple(out)


ARCS = tuple(tuple(arcs(code, state) for state in range(4)) for code in range(9))


def auction(layers: list[tuple[Arcs, ...]], exits: tuple[int, ...], price: list[int], origin: int) -> int:
    """Distance of ``origin`` to the end, which lies ``exits[state]`` behind the last nodes; raises prices on the way."""
    path, last = [origin], 4 * len(layers)
    while True:
        node, to, best = path[-1], -1, FAR
        if node >= last:
            best = exits[node - last]
            if price[node] >= best:
                return price[origin]
        else:
            for step, cost, _ in layers[node >> 2][node & 3]:
                value = cost + price[node + step]
                if value < best:
                    best, to = value, node + step
        if price[node] < best:
            price[node] = best  # contract: the path's end was too cheap
            if len(path) > 1:
                path.pop()
            elif best >= FAR:
                return FAR
        else:
            path.append(to)  # extend along a tight arc


def reaching(layers: list[tuple[Arcs, ...]], exits: tuple[int, ...]) -> list[bool]:
    """Which first states can reach an end at all."""
    able = [e < FAR for e in exits]
    for layer in reversed(layers):
        here = [False] * 4
        for _ in range(3):  # arcs inside a layer lead over two others at most
            here = [any((able if step + q >= 4 else here)[(step + q) & 3] for step, _, _ in layer[q]) for q in range(4)]
        able = here
    return able


def prices(layers: list[tuple[Arcs, ...]], exits: tuple[int, ...]) -> tuple[list[tuple[list, tuple, list[int]]], tuple[int, ...]]:
    """Blocks in order, each with its exits and its prices, and the distances of the four first states.

    A block's prices are those beyond its cheapest exit: prices climb from 0, so the costs behind would be climbed again."""
    out = []
    for at in range((len(layers) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        block, base = layers[at:at + BLOCK], min(exits)
        exits = tuple(e - base if e < FAR else FAR for e in exits)
        price = [0] * (4 * len(block) + 4)
        able = reaching(block, exits) if max(exits) >= FAR else (True,) * 4
        out.append((block, exits, price))
        exits = tuple(auction(block, exits, price, q) + base if able[q] else FAR for q in range(4))
    return out[::-1], exits


def trace(blocks: list[tuple[list, tuple, list[int]]], state: int) -> tuple[str, int]:
    """Letters of the first shortest path in the order of the letters, and the state it ends in."""
    out = []
    for layers, exits, price in blocks:
        node, last = state, 4 * len(layers)
        auction(layers, exits, price, node)
        while node < last:
            for step, cost, letter in layers[node >> 2][node & 3]:
                to = node + step
                if price[node] == cost + price[to] and price[node] == cost + auction(layers, exits, price, to):
                    out.append(letter)
                    node = to
                    break
        state = node - last
    return "".join(out), state


@lru_cache(50_000)
def solved_short(codes: bytes) -> tuple[int, str]:
    blocks, entry = prices([ARCS[c] for c in codes], ENDING)
    found, state = trace(blocks, NOTHING)
    return entry[NOTHING], found + TAIL[state]


def solve(codes: bytes) -> tuple[int, str]:
    """Cost and letters of the cheapest repair."""
    return solved_short(codes) if len(codes) <= BLOCK else solved_short.__wrapped__(codes)


def replay(audit: str, codes: bytes, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(turns done, letter, state after, place in the audit) of every edit."""
    at = 0
    for k, letter in enumerate(audit):
        if letter == "K":
            state = KEPT[state, INITIALS[codes[at] >> 1]]
        elif letter != "D":
            state = FOLLOWER[state]
        yield at, letter, state, k
        at += letter != "I"


def fault(role: str, text: str) -> tuple[str, int]:
    """Blank, truncated or no fault of a turn by itself, and its code."""
    shown = text.rstrip(WHITE)
    if not shown:
        return "blank", MUST_GO
    code = 2 * (INITIALS + role[:1]).index(role[:1]) if role else 6
    return ("truncated", code + 1) if shown[-1] not in ".!?" else ("", code)


FAULTS = ("blank", "duplicate", "truncated")


def repaired(turns: list[tuple[int | None, str, str]]) -> tuple[int, int, int, int, int, int, str, str]:
    """Everything about one conversation whose turns (number, role, text) are given in order."""
    seen, codes, counts, illegal = set(), bytearray(), dict.fromkeys(FAULTS, 0), 0
    for i, (_, role, text) in enumerate(turns):
        name, code = fault(role, text)
        if name != "blank" and (role, text) in seen:
            name, code = "duplicate", MUST_GO
        seen.add((role, text))
        codes.append(code)
        if name:
            counts[name] += 1
        illegal += i > 0 and turns[i - 1][1][:1] + role[:1] not in LEGAL
    cost, audit = solve(bytes(codes))
    digest, first = hashlib.sha256(), True
    for at, letter, state, _ in replay(audit, codes, NOTHING):
        if letter != "D":
            role = turns[at][1] if letter == "K" else NAMES[state]
            digest.update(f"{'' if first else chr(10)}{role}:{'' if letter == 'I' else turns[at][2]}".encode())
            first = False
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, *counts.values(), illegal, cost, audit, digest.hexdigest()


RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
          ("audit", pa.string()), ("repaired_sha256", pa.string())]
RESULT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = [("part", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("code", pa.int32()), ("fault", pa.string()),
        ("digest", pa.binary())]
OPEN_DDL = "part int, pos long, turn long, role string, text string, code int, fault string, digest binary"


def sorted_pass(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One sorted partition (key, id, turn, role, text, live): a result for every conversation that surely lies inside it,
    the turns of the first and the last one and of those too long to hold."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("key", pa.string()), ("id", id_type), *RESULT, *OPEN])
    rows: list[tuple] = []
    size = place = 0
    key = ident = None
    held: list[tuple] | None = None  # turns of a conversation that may still be solved here
    known = False  # whether the conversation has given a row yet

    def leave_open(turn, role, text) -> None:
        nonlocal place, size
        name, code = fault(role, text)
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        rows.append((key, ident, *[None] * len(RESULT), part, (part << 40) + place, turn, role, text, code, name, digest))
        place, size = place + 1, size + len(text) + 200

    def name_only() -> None:
        rows.append((key, ident, *[None] * len(RESULT), part, *[None] * (len(OPEN) - 1)))

    def flush() -> pa.RecordBatch:
        nonlocal rows, size
        columns = list(zip(*rows)) or [()] * len(schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        rows, size = [], 0
        return out

    started = False
    length = 0
    for batch in batches:
        for k, i, turn, role, text, live in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or k != key:
                if started and held is not None:
                    rows.append((key, ident, *repaired(held), *[None] * len(OPEN)))
                    size += 200
                key, ident, length = k, i, 0
                held = [] if started else None
                if not started:
                    name_only()
                started = True
            if live:
                if held is None:
                    leave_open(turn, role, text)
                else:
                    held.append((turn, role, text))
                    length += len(text) + 100
                    if length > HELD:
                        name_only()
                        for t in held:
                            leave_open(*t)
                        held = None
            if size > HELD:
                yield flush()
    if held is not None:
        name_only()
        for t in held:
            leave_open(*t)
    yield flush()


SEGMENT = [("key", pa.string()), ("part", pa.int32()), ("base", pa.int64()), ("codes", pa.binary()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
           ("illegal", pa.int64()), ("first_role", pa.string()), ("last_role", pa.string()), ("numbers", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
           ("costs", pa.list_(pa.int64()))]
SEGMENT_DDL = ("key string, part int, base long, codes binary, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, numbers long, "
               "first_turn long, last_turn long, costs array<long>")


def segment(turns: pa.Table) -> pa.Table:
    """What one partition holds of a conversation: codes, counts and the costs from each first to each last state."""
    rows = sorted(turns.select(["pos", "turn", "initial", "code", "fault", "is_first"]).to_pylist(), key=lambda r: -1 if r["pos"] is None else r["pos"])
    key, part = turns.column("key")[0].as_py(), turns.column("part")[0].as_py()
    rows = [r for r in rows if r["pos"] is not None]
    names = [r["fault"] if r["fault"] == "blank" or r["is_first"] else "duplicate" for r in rows]
    codes = bytes(MUST_GO if name in ("blank", "duplicate") else r["code"] for r, name in zip(rows, names))
    layers = [ARCS[c] for c in codes]
    costs = [[FAR] * 4 for _ in range(4)]
    for to in range(4):
        exits = tuple(0 if q == to else FAR for q in range(4))
        entry = prices(layers, exits)[1]
        for q in range(4):
            costs[q][to] = entry[q]
    initials, numbers = [r["initial"] for r in rows], [r["turn"] for r in rows if r["turn"] is not None]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    values = (key, part, rows[0]["pos"] if rows else part << 40, codes, *(names.count(f) for f in FAULTS), illegal, *((initials[0], initials[-1]) if rows else (None, None)),
              len(set(numbers)), *((numbers[0], numbers[-1]) if numbers else (None, None)), [c for row in costs for c in row])
    return pa.table([pa.array([v], t) for v, (_, t) in zip(values, SEGMENT)], names=[n for n, _ in SEGMENT])


def ordered(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r["part"])


def segment_exits(table: pa.Table) -> pa.Table:
    """The auction over the segments of one conversation: distances to the end behind each of them, and the whole cost."""
    rows = ordered(table)
    least = [min(r["costs"]) for r in rows]  # every path pays it once
    layers = [tuple(tuple((4 + t - q, c - low, "") for t, c in enumerate(r["costs"][4 * q:4 * q + 4]) if c < FAR) for q in range(4)) for r, low in zip(rows, least)]
    blocks, entry = prices(layers, ENDING)
    behind = []  # only their differences matter to the paths before
    for block, exits, price in blocks:
        behind += [tuple(auction(block, exits, price, 4 * k + q) for q in range(4)) for k in range(1, len(block))] + [exits]
    return pa.table({"key": [r["key"] for r in rows], "part": pa.array([r["part"] for r in rows], pa.int32()), "exits": pa.array([list(x) for x in behind], pa.list_(pa.int64())),
                     "cost": pa.array([entry[NOTHING] + sum(least)] * len(rows), pa.int64()), "is_last": [i == len(rows) - 1 for i in range(len(rows))]})


def segment_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each first state of a segment the letters and the last state."""
    for batch in batches:
        for r in batch.to_pylist():
            blocks, _ = prices([ARCS[c] for c in r["codes"]], tuple(r["exits"]))
            paths = [trace(blocks, q) for q in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([r["key"]]), pa.array([r["part"]], pa.int32()), pa.array([[a for a, _ in paths]]),
                                              pa.array([[s for _, s in paths]], pa.list_(pa.int32()))], names=["key", "part", "audits", "leave"])


def segment_states(table: pa.Table) -> pa.Table:
    """The state every segment of one conversation starts and ends in."""
    rows, state, states = ordered(table), NOTHING, []
    for r in rows:
        states.append(state)
        state = r["leave"][state]
    return pa.table({"key": [r["key"] for r in rows], "part": pa.array([r["part"] for r in rows], pa.int32()), "entry": pa.array(states, pa.int32())})


def segment_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of the repaired segment: place of the turn, order there, given role, whether the turn's text stays."""
    for batch in batches:
        for r in batch.to_pylist():
            lines = [(r["base"] + at, k, None if letter == "K" else NAMES[state], letter != "I")
                     for at, letter, state, k in replay(r["audit"], r["codes"], r["entry"]) if letter != "D"]
            for i in range(0, len(lines), 10_000):
                pos, k, role, keeps = zip(*lines[i:i + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * len(pos)), pa.array([r["part"]] * len(pos), pa.int32()), pa.array(pos, pa.int64()), pa.array(k, pa.int64()),
                                                  pa.array(role, pa.string()), pa.array(keeps)], names=["key", "part", "pos", "k", "given", "keeps"])


def pack_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted lines (key, part, line) as chunks of joined lines."""
    at, chunk, held, size = None, 0, [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int32()), pa.array([chunk], pa.int64()), pa.array(["\n".join(held)])],
                                             names=["key", "part", "chunk", "lines"])
    for batch in batches:
        for key, part, line in zip(*(c.to_pylist() for c in batch.columns)):
            if held and ((key, part) != at or size > CHUNK):
                yield out()
                chunk, held, size = chunk + 1 if (key, part) == at else 0, [], 0
            at = (key, part)
            held.append(line)
            size += len(line)
    if held:
        yield out()


def hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks (key, lines) to one hash a conversation."""
    current, digest = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], names=["key", "repaired_sha256"])
    for batch in batches:
        for key, lines in zip(*(c.to_pylist() for c in batch.columns)):
            if key == current:
                digest.update(b"\n")
            else:
                if digest is not None:
                    yield out()
                current, digest = key, hashlib.sha256()
            digest.update(lines.encode())
    if digest is not None:
        yield out()


def whole(table: pa.Table) -> pa.Table:
    """Counts, cost and letters of one conversation from its segments."""
    rows = ordered(table)
    audit, gaps_first, last_turn, last_role = [], None, None, None
    counts, numbers = dict.fromkeys((*FAULTS, "illegal"), 0), 0
    for r in rows:
        for c in counts:
            counts[c] += r[c]
        if r["first_role"] is not None:
            counts["illegal"] += last_role is not None and last_role + r["first_role"] not in LEGAL
            last_role = r["last_role"]
        if r["first_turn"] is not None:
            numbers += r["numbers"] - (last_turn == r["first_turn"])
            gaps_first = r["first_turn"] if gaps_first is None else gaps_first
            last_turn = r["last_turn"]
        audit.append(r["audit"])
    gaps = last_turn - gaps_first + 1 - numbers if last_turn is not None else 0
    values = (rows[0]["key"], gaps, *(counts[c] for c in (*FAULTS, "illegal")), rows[0]["cost"], "".join(audit))
    return pa.table([pa.array([v], t) for v, t in zip(values, (pa.string(), *[t for _, t in RESULT[:-1]]))], names=["key", *[n for n, _ in RESULT[:-1]]])


def solve_open(rows: DataFrame) -> DataFrame:
    """Results of the conversations whose turns the sorted pass left open."""
    live = rows.where("pos IS NOT NULL")
    first = live.groupBy("key", "digest").agg(F.min("pos").alias("first_pos")).select("first_pos", F.lit(True).alias("is_first"))
    slim = rows.select("key", "part", "pos", "turn", F.substring("role", 1, 1).alias("initial"), "code", "fault")
    marked = slim.join(first, F.col("pos") == F.col("first_pos"), "left").select(*slim.columns, F.coalesce("is_first", F.lit(False)).alias("is_first"))
    segments = stored(marked.groupBy("key", "part").applyInArrow(segment, SEGMENT_DDL), "auction-segments")
    exits = segments.select("key", "part", "costs").groupBy("key").applyInArrow(segment_exits, "key string, part int, exits array<long>, cost long, is_last boolean")
    priced = stored(segments.drop("costs").join(exits, ["key", "part"]), "auction-exits")
    paths = stored(priced.select("key", "part", "codes", "exits").mapInArrow(segment_paths, "key string, part int, audits array<string>, leave array<int>"), "auction-paths")
    states = paths.select("key", "part", "leave").groupBy("key").applyInArrow(segment_states, "key string, part int, entry int")
    taken = paths.join(states, ["key", "part"]).select("key", "part", "entry", F.get("audits", "entry").alias("audit"), F.get("leave", "entry").alias("left"))
    tail = F.when(F.col("is_last"), F.get(F.array(*map(F.lit, TAIL)), F.col("left"))).otherwise("")
    chosen = stored(priced.join(taken, ["key", "part"]).withColumn("audit", F.concat("audit", tail)).drop("left"), "auction-chosen")
    lines = chosen.select("key", "part", "base", "codes", "entry", "audit").mapInArrow(segment_lines, "key string, part int, pos long, k long, given string, keeps boolean")
    texts = live.select(F.col("pos").alias("at"), "role", "text")
    line = F.concat(F.coalesce("given", "role"), F.lit(":"), F.when(F.col("keeps"), F.col("text")).otherwise(""))
    spoken = lines.join(texts, F.col("pos") == F.col("at"), "left").select("key", "part", "pos", "k", line.alias("line"))
    packed = spoken.repartition("key", "part").sortWithinPartitions("key", "part", "pos", "k").select("key", "part", "line").mapInArrow(
        pack_lines, "key string, part int, chunk long, lines string")
    hashes = packed.repartition("key").sortWithinPartitions("key", "part", "chunk").select("key", "lines").mapInArrow(hash_chunks, "key string, repaired_sha256 string")
    counted = chosen.groupBy("key").applyInArrow(whole, "key string, " + RESULT_DDL.rsplit(",", 1)[0])
    named = rows.groupBy("key").agg(F.first("id").alias("id"))
    nothing = hashlib.sha256().hexdigest()
    return named.join(counted, "key").join(hashes, "key", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(nothing)))


def damage(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (id, turn, role, text, live) damaged by the checksum of ``id:turn`` modulo 20: 0 drops the turn (it stays as a row
    that is not live), 1 empties its text, 2 takes its full stops, exclamation and question marks away, 3 repeats it, 4 makes it
    the user's. A null role or text is one space, and so is a null in the checksum."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text(conversation), F.lit(":"), as_text(turn))) % 20
    given = turns.select(F.col(conversation).alias("id"), F.col(turn).alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), kind.alias("kind"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return given.withColumn("copy", F.explode(times)).select(
        "id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") != 0).alias("live"))


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", live: Column | None = None) -> DataFrame:
    """Faults and cheapest repair of every conversation.

    Turns are taken by number (null first), equal ones by role, then by the text's first 64 characters, then by its hash.
    Null roles and texts are one space. Rows without a conversation id are one conversation. Repeated rows are turns of their
    own, all but the first of them duplicates. Rows where ``live`` is false only name their conversation. Other columns are
    ignored; an empty table gives no rows. Turn numbers are whole numbers.

    Result: ``id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. The audit has a letter per edit:
    Keep, Rerole, Delete, Insert.
    """
    spark = turns.sparkSession
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    id_type = turns.schema[conversation].dataType
    slim = turns.select(F.to_json(F.struct(F.col(conversation).alias("c"))).alias("key"), F.col(conversation).alias("id"), F.col(turn).cast("long").alias("turn"),
                        space(role).alias("role"), space(text).alias("text"), (F.lit(True) if live is None else live).alias("live"))
    # the last two tell equal turns apart, so that any number of them can be dealt to several partitions
    order = ["key", "turn", "role", F.substring("text", 1, 64), F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = slim.select("*", *[c.alias(f"by{i}") for i, c in enumerate(order[3:])])
    names = ["key", "turn", "role", "by0", "by1", "by2"]
    placed = keyed.repartitionByRange(*names).sortWithinPartitions(*names).select(*slim.columns)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)
    kind = id_type.simpleString()
    pass_: Callable = lambda batches: sorted_pass(batches, arrow_id)
    found = stored(placed.mapInArrow(pass_, f"key string, id {kind}, {RESULT_DDL}, {OPEN_DDL}"), "auction-sorted")
    columns = ["id", *[n for n, _ in RESULT]]
    inside = found.where("audit IS NOT NULL").select(*columns)
    rest = found.where("audit IS NULL").select("key", "id", *[n for n, _ in OPEN])
    if rest.isEmpty():
        return inside
    return inside.unionByName(solve_open(rest).select(*columns))
