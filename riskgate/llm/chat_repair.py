"""Chat formatting with minimum-cost role repair.

A legal conversation has at most one system turn, first, then user and assistant turns
in alternation, and ends with the assistant. Each turn of a conversation may keep its
role, be relabelled, be merged into the turn before it (same role), and have an empty
turn inserted before it; the end may need inserted turns too. Dynamic programming over
the automaton of legal turns finds the cheapest repair (COST); among equally cheap ones
the first by preference, decided turn by turn from the start, so the result does not
depend on how the rows are dealt out.

One conversation may hold a large part of all rows, so it is never handled as one
group: rows are range-sorted by conversation and turn and cut into blocks of at most
BLOCK_TURNS turns.
1. Each block yields the 4 x 4 matrix of least costs between automaton states.
2. Along each conversation the matrices are combined from the end, which gives every
   block the cost to go behind it.
3. Each block of a longer conversation maps its four possible entry states to its exit
   state on the preferred path; the maps are composed from the start.
4. Each block, now knowing its entry state and the cost to go, repairs and renders its
   turns: the rendered segments in order are the formatted conversation.
Steps 2 and 3 see a few numbers per block.

Defined results: turns are ordered by turn number (null first), equal ones by role and
text; a null or unknown role must be relabelled; a null text counts as empty; rows with
a null conversation id form one conversation; repeated rows are turns of their own;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType)

from riskgate.llm.storage import stored

BLOCK_TURNS = 1024
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant",
           "ai": "assistant"}
COST = {"merge": 1.0, "insert": 2.0, "relabel": 3.0}
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which states may follow a state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
OPEN, CLOSE, JOINT = "<|im_start|>", "<|im_end|>\n", "\n\n"
_FAR = float("inf")


def _options(state: int, role: int) -> list[tuple[float, int, int, bool]]:
    """(cost, new state, inserted state or 0, merged) for a turn of a role (0: unknown),
    in order of preference: own role first, no insertion first."""
    found = []
    for target in sorted((SYSTEM, USER, ASSISTANT), key=lambda r: (r != role, r)):
        price = 0.0 if target == role else COST["relabel"]
        if target in NEXT[state]:
            found.append((price, target, 0, False))
        if target == state:
            found.append((price + COST["merge"], target, 0, True))
        found += [(price + COST["insert"], target, between, False) for between in NEXT[state]
                  if target in NEXT[between]]
    return found


OPTIONS = {(s, r): _options(s, r) for s in range(4) for r in range(4)}


def ending(state: int) -> list[int]:
    """Roles inserted behind the last turn so that the assistant ends."""
    found = []
    while state != ASSISTANT:
        state = USER if state in (START, SYSTEM) else ASSISTANT
        found.append(state)
    return found


#: Cost to go behind the last turn, by state.
END = [COST["insert"] * len(ending(s)) for s in range(4)]


def to_go(roles: list[int], behind: np.ndarray) -> list[np.ndarray]:
    """Cost to go before each turn and behind the last, from the costs behind (one value
    per state, or one row of values per state)."""
    found = [np.asarray(behind, dtype=float)]
    for role in reversed(roles):
        after = found[-1]
        found.append(np.array([np.min([cost + after[to] for cost, to, _, _ in OPTIONS[s, role]], axis=0)
                               for s in range(4)]))
    return found[::-1]


def walk(roles: list[int], state: int, behind) -> list[tuple[float, int, int, bool]]:
    """The preferred cheapest choice for each turn from an entry state on."""
    costs, found = to_go(roles, behind), []
    for k, role in enumerate(roles):
        best = costs[k][state]
        choice = next(o for o in OPTIONS[state, role] if o[0] + costs[k + 1][o[1]] == best)
        found.append(choice)
        state = choice[1]
    return found


def segment(text: str, state: int, choice: tuple[float, int, int, bool]) -> str:
    """What a turn adds to the rendered conversation, after a turn in `state`."""
    _, role, inserted, merged = choice
    if merged:
        return JOINT + text
    parts = [CLOSE] if state != START else []
    if inserted:
        parts.append(f"{OPEN}{ROLES[inserted - 1]}\n{CLOSE}")
    return "".join([*parts, f"{OPEN}{ROLES[role - 1]}\n", text])


def tail(state: int) -> str:
    """What follows the last turn."""
    return CLOSE + "".join(f"{OPEN}{ROLES[r - 1]}\n{CLOSE}" for r in ending(state))


# -- Spark ---------------------------------------------------------------------------

_KEY = [StructField("conv", StringType()), StructField("block", LongType())]
_MATRIX = StructType([*_KEY, StructField("matrix", ArrayType(DoubleType()))])
_BEHIND = StructType([*_KEY, StructField("behind", ArrayType(DoubleType())), StructField("last", IntegerType()),
                      StructField("only", IntegerType())])
_MAP = StructType([*_KEY, StructField("leave", ArrayType(IntegerType()))])
_ENTRY = StructType([*_KEY, StructField("entry", IntegerType())])
_REPAIR = StructType([
    StructField("pos", LongType()), StructField("new_role", StringType()), StructField("action", StringType()),
    StructField("inserted_before", StringType()), StructField("inserted_after", StringType()),
    StructField("cost", DoubleType()), StructField("rendered", StringType())])


def _groups(batches, keys: int):
    """(key, columns as lists) of runs of equal keys in ordered rows."""
    key, held = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:keys] != key:
                if held is not None:
                    yield key, held
                key, held = row[:keys], [[] for _ in row[keys:]]
            for column, value in zip(held, row[keys:], strict=True):
                column.append(value)
    if held is not None:
        yield key, held


def _emit(rows, schema: StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    target, held = to_arrow_schema(schema), []

    def batch():
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target, strict=True)],
                                          schema=target)

    for row in rows:
        held.append(row)
        if len(held) >= 2000:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _per_group(rows: DataFrame, keys: list[str], order: list, columns: list[str], work, schema: StructType) -> DataFrame:
    """`work(key, column lists)` for every group, its rows in order; a generator of rows."""
    dealt = rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *columns)

    def run(batches):
        return _emit((r for key, held in _groups(batches, len(keys)) for r in work(key, held)), schema)

    return dealt.mapInArrow(run, schema)


def _matrix(key, held):
    yield (*key, to_go(held[0], np.where(np.eye(4) > 0, 0.0, _FAR))[0].ravel().tolist())


def _behind(key, held):
    """Blocks of a conversation, last first."""
    behind = np.array(END)
    blocks, matrices = held
    for k, (block, matrix) in enumerate(zip(blocks, matrices, strict=True)):
        yield key[0], block, behind.tolist(), int(k == 0), int(len(blocks) == 1)
        behind = (np.array(matrix).reshape(4, 4) + behind).min(axis=1)


def _maps(key, held):
    roles, behind = held[0], held[1][0]
    leave = []
    for s in range(4):
        passable = np.isfinite(to_go(roles, behind)[0][s])
        leave.append(walk(roles, s, behind)[-1][1] if passable else -1)
    yield (*key, leave)


def _entries(key, held):
    state = START
    for block, leave in zip(*held, strict=True):
        yield key[0], block, state
        state = leave[state]


def _repairs(key, held):
    pos, roles, texts, behind, last, entry = held
    state, choices = entry[0], walk(roles, entry[0], behind[0])
    for k, (p, role, text, choice) in enumerate(zip(pos, roles, texts, choices, strict=True)):
        cost, to, inserted, merged = choice
        done = " ".join(w for w, x in (("relabel", to != role), ("merge", merged)) if x) or "keep"
        rendered, after = segment(text, state, choice), None
        if last[0] and k == len(pos) - 1:
            after = ",".join(ROLES[r - 1] for r in ending(to)) or None
            rendered, cost = rendered + tail(to), cost + END[to]
        yield p, ROLES[to - 1], done, ROLES[inserted - 1] if inserted else None, after, cost, rendered
        state = to


def repair_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """Per input turn: conv_id, turn, its place `pos` in the global order, new_role, action
    (keep, merge, relabel, relabel merge), roles of empty turns inserted before and after
    it, cost, and its segment of the rendered conversation."""
    name = F.lower(F.trim(F.col(role)))
    for alias, meant in ALIASES.items():
        name = F.when(name == alias, meant).otherwise(name)
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), name).cast("int"), F.lit(0))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), code.alias("code"), F.col(role).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.when(F.col(conv).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv).cast("string"))).alias("conv"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    ordered = rows.repartitionByRange("conv", "turn", "tie").sortWithinPartitions("conv", "turn", "tie", "role", "text")
    rows = stored(ordered.withColumn("pos", F.monotonically_increasing_id()).drop("tie", "role"), "chat-turns")
    rows = rows.withColumn("block", F.expr(f"pos div {BLOCK_TURNS}"))
    key = ["conv", "block"]
    matrices = _per_group(rows, key, ["pos"], ["code"], _matrix, _MATRIX)
    behind = stored(_per_group(matrices, ["conv"], [F.desc("block")], ["block", "matrix"], _behind, _BEHIND), "chat-costs")
    longer = rows.join(behind.where("only = 0"), key)
    maps = _per_group(longer, key, ["pos"], ["code", "behind"], _maps, _MAP)
    entries = _per_group(maps, ["conv"], ["block"], ["block", "leave"], _entries, _ENTRY)
    known = behind.join(entries, key, "left").select(*key, "behind", "last", F.coalesce("entry", F.lit(START)).alias("entry"))
    repaired = _per_group(rows.join(known, key), key, ["pos"], ["pos", "code", "text", "behind", "last", "entry"],
                          _repairs, _REPAIR)
    return rows.select("conv_id", "turn", "pos").join(repaired, "pos")
