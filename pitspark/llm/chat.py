"""Chat formatting with the cheapest repair of the role sequence.

Legal conversations are an optional system turn, then user and assistant in turn, the last turn an assistant's. A turn
may keep its role, get another one, or be merged with the turn before it; empty turns may be put in. Each has a cost, and
the cheapest way through the automaton is found by dynamic programming. A turn acts on the automaton's states as a
matrix of costs (minimum and sum in place of sum and product), so a conversation of any length is cut into the segments
that lie in one sorted partition each: segments are multiplied out where they lie, the few products of a conversation
are joined to fix the states at its cuts, and every segment then finds its own path between them.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatbot": "assistant"}
START = 3  # states 0 to 2: the last turn's role
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
INF = float("inf")
#: Empty turns put in before a turn of the second role when the last turn was the first one; absent: not legal.
PUT_IN = {(START, 0): (), (START, 1): (), (START, 2): (1,), (0, 1): (), (0, 2): (1,), (1, 2): (), (2, 1): ()}
#: Empty turns that end a conversation.
ENDING = {2: (), 1: (2,), 0: (1, 2)}


def step(role: int, merge: float = MERGE, relabel: float = RELABEL, insert: float = INSERT) -> np.ndarray:
    """Cost matrix (state before, state after) of a turn; ``role`` is -1 when unknown."""
    cost = np.full((4, 4), INF)
    for before in range(4):
        for after in range(3):
            way = merge if before == after else insert * len(PUT_IN[before, after]) if (before, after) in PUT_IN else INF
            cost[before, after] = way + (0.0 if role == after else relabel)
    return cost


STEPS = {r: step(r) for r in (-1, 0, 1, 2)}
FINAL = np.array([INSERT * len(ENDING[s]) for s in range(3)] + [INF])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(1)


def product(roles: list[int]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for r in roles:
        out = times(out, STEPS[r])
    return out


def path(roles: list[int], entry: int, leave: int) -> list[int]:
    """States after each turn on the cheapest way from ``entry`` to ``leave``; of equal ones that with the smaller last states."""
    costs = [np.where(np.arange(4) == entry, 0.0, INF)]
    for r in roles:
        costs.append((costs[-1][:, None] + STEPS[r]).min(0))
    states = [leave]
    for i in range(len(roles) - 1, 0, -1):
        states.append(int((costs[i] + STEPS[roles[i]][:, states[-1]]).argmin()))
    return states[::-1]


def cut_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, leave) of each segment of one conversation."""
    costs = [np.where(np.arange(4) == START, 0.0, INF)]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(0))
    state = int((costs[-1] + FINAL).argmin())
    out = []
    for i in range(len(matrices) - 1, -1, -1):
        before = int((costs[i] + matrices[i][:, state]).argmin())
        out.append((before, state))
        state = before
    return out[::-1]


def repair(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repairs and renders all conversations.

    Turns are taken by turn number (null first), equal ones by role and text. Role names are trimmed and lower-cased,
    common other names count as the three roles, anything else (null too) is unknown and gets a role for the price of
    a relabel. Null text is empty. Rows without a conversation id are one conversation. Repeated rows are turns of their
    own. Other columns are ignored; an empty table gives no rows.

    Result, a row per source turn or empty turn: ``conv_id, position`` (ascending in a conversation), ``piece``
    (order at one position), ``turn`` (null for empty turns), ``source_role, role, action`` (keep, relabel, merge,
    merge_relabel, insert), ``cost, rendered``. The pieces of a conversation, in order, are the rendered text.
    """
    name = F.lower(F.trim(F.coalesce(F.col(role), F.lit(""))))
    known = F.create_map(*[F.lit(x) for r in ROLES for x in (r, ROLES.index(r))] + [F.lit(x) for a, r in ALIASES.items() for x in (a, ROLES.index(r))])
    slim = turns.select(F.col(conversation).alias("conv_id"), F.to_json(F.struct(F.col(conversation).alias("c"))).alias("_conv"), F.col(turn).alias("turn"),
                        F.col(role).alias("source_role"), F.coalesce(F.get(F.array(known[name]), F.lit(0)), F.lit(-1)).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = ["_conv", "turn", "source_role", F.xxhash64("text")]
    placed = slim.repartitionByRange(*keys).sortWithinPartitions(*keys[:3], "text").withColumn("position", F.monotonically_increasing_id())
    placed = stored(placed.withColumn("_part", F.shiftright("position", 33).cast("int")), "chat-turns")

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        roles = group.sort_values("position")["_role"].tolist()
        return pd.DataFrame({"_conv": group["_conv"].iloc[:1], "_part": group["_part"].iloc[:1], "costs": [product(roles).ravel().tolist()]})

    segments = placed.select("_conv", "_part", "position", "_role").groupBy("_conv", "_part").applyInPandas(multiply, "_conv string, _part int, costs array<double>")

    def fix(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_part")
        states = cut_states([np.array(c).reshape(4, 4) for c in group["costs"]])
        last = [False] * (len(group) - 1) + [True]
        return pd.DataFrame({"_conv": group["_conv"], "_part": group["_part"], "entry": [a for a, _ in states], "leave": [b for _, b in states], "last": last})

    cuts = stored(segments.groupBy("_conv").applyInPandas(fix, "_conv string, _part int, entry int, leave int, last boolean"), "chat-cuts")

    def write(group: pd.DataFrame, cut: pd.DataFrame) -> pd.DataFrame:
        names = ["conv_id", "position", "piece", "turn", "source_role", "role", "action", "cost", "rendered"]
        if not len(group):
            return pd.DataFrame({n: [] for n in names})
        group = group.sort_values("position")
        roles, before = group["_role"].tolist(), int(cut["entry"].iloc[0])
        states = path(roles, before, int(cut["leave"].iloc[0]))
        rows: list[tuple] = []

        def header(r: int, state: int) -> str:
            return ("" if state == START else "<|im_end|>\n") + f"<|im_start|>{ROLES[r]}\n"

        conv = group["conv_id"].iloc[0]
        for given, after, place, number, source, body in zip(roles, states, group["position"], group["turn"], group["source_role"], group["text"]):
            piece = 0
            if before == after:
                action, cost, shown = "merge", MERGE, "\n" + body
            else:
                for empty in PUT_IN[before, after]:
                    rows.append((conv, place, piece, None, None, ROLES[empty], "insert", INSERT, header(empty, before)))
                    before, piece = empty, piece + 1
                action, cost, shown = "keep", 0.0, header(after, before) + body
            if given != after:
                action, cost = ("relabel" if action == "keep" else "merge_relabel"), cost + RELABEL
            rows.append((conv, place, piece, number, source, ROLES[after], action, cost, shown))
            before = after
        if cut["last"].iloc[0]:
            for empty in ENDING[before]:
                rows.append((conv, rows[-1][1], rows[-1][2] + 1, None, None, ROLES[empty], "insert", INSERT, header(empty, before)))
                before = empty
            rows[-1] = (*rows[-1][:-1], rows[-1][-1] + "<|im_end|>\n")
        out = pd.DataFrame(rows, columns=names)
        out["turn"] = out["turn"].astype("Int64") if pd.api.types.is_integer_dtype(group["turn"]) else out["turn"]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = f"conv_id {kinds['conv_id']}, position long, piece int, turn {kinds['turn']}, source_role string, role string, action string, cost double, rendered string"
    return placed.groupBy("_conv", "_part").cogroup(cuts.groupBy("_conv", "_part")).applyInPandas(write, schema)
