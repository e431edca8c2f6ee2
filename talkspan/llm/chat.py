"""Chat formatting: minimum-cost repair of role sequences, then rendering.

A conversation is legal if an automaton over its roles accepts it: an optional system turn, then user and assistant turns in
alternation (an assistant may answer tool turns), ending with the assistant. For every turn the repair keeps its role,
relabels it, merges it into the turn before, or puts one empty turn in front; an empty turn may close the whole. Dynamic
programming picks the cheapest repair of the whole conversation. Among equal costs every turn, from the first on, gets
the smallest state, then the first action by name.

A turn is a matrix of prices from state to state, and the prices of a run of turns are the min-plus product of its
matrices. So conversations are cut into chunks of at most `CHUNK_TURNS` turns and about `CHUNK_BYTES` bytes. Each chunk is
reduced to one matrix; from the matrices follow the prices of all that is behind a chunk (`goal`), from those the state
each chunk leads to from each state, and from those the state before it. Then every chunk is repaired on its own. The
result is the same wherever the cuts fall, and no task holds a conversation: rows are ranged by conversation and turn, so
a conversation with most of all rows is spread too. Matrices and states are combined in two levels, the chunks of a range
and the ranges of a conversation.

The rendered form is one fragment per turn, with the merged, relabelled and inserted headers; the fragments of a
conversation in order are its text, which is never put together in one row here.

Defined results: a null or unknown role has no role of its own and is always relabelled; a null text is an empty turn;
turns with equal numbers keep input order, a null turn number comes first; rows with a null `conv_id` are one
conversation. Input columns other than the four are not returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.llm import arrays as ar
from talkspan.llm import store

ROLES = ("system", "user", "assistant", "tool")
START = len(ROLES)
N_STATES = START + 1
#: Which role may follow which; START begins a conversation.
LEGAL = {
    START: ("system", "user"), 0: ("user",), 1: ("assistant",), 2: ("user", "tool"), 3: ("assistant", "tool"),
}
ACCEPTED = (2,)
CHUNK_TURNS = 256
CHUNK_BYTES = 1 << 20
_INF = 1 << 40
KEEP, RELABEL, MERGE, INSERT = "keep", "relabel", "merge", "insert"


@dataclass(frozen=True)
class Prices:
    relabel: int = 3
    merge: int = 1
    insert: int = 4


@dataclass(frozen=True)
class Template:
    """What stands around the text of a turn."""

    open: str = "<|im_start|>{role}\n"
    close: str = "<|im_end|>\n"
    joint: str = "\n"


class Automaton:
    """For each role (and for none) the cheapest step between two states, as price and action."""

    def __init__(self, prices: Prices):
        self.legal = np.zeros((N_STATES, N_STATES), bool)
        for state, roles in LEGAL.items():
            self.legal[state, [ROLES.index(r) for r in roles]] = True
        self.steps = [[[self._steps(prices, role, s, t) for t in range(N_STATES)] for s in range(N_STATES)]
                      for role in range(len(ROLES) + 1)]
        self.matrices = np.array([[[min((p for p, *_ in x), default=_INF) for x in row] for row in role]
                                  for role in self.steps], np.int64)
        self.closing = [self._closing(prices, s) for s in range(N_STATES)]

    def _steps(self, prices, role, s, t):
        """(price, action, inserted roles) of all ways a turn of `role` leads from state s to state t, best first."""
        if t == START:
            return []
        change = 0 if role == t else prices.relabel
        out = []
        if self.legal[s, t]:
            out.append((change, KEEP if role == t else RELABEL, ()))
        if s == t:
            out.append((prices.merge + change, MERGE, ()))
        for x in range(len(ROLES)):
            if self.legal[s, x] and self.legal[x, t]:
                out.append((prices.insert + change, INSERT, (x,)))
        return sorted(out, key=lambda o: (o[0], o[1], o[2]))

    def _closing(self, prices, s):
        """(price, inserted roles) of ending in state s."""
        if s in ACCEPTED:
            return 0, ()
        for x in ACCEPTED:
            if self.legal[s, x]:
                return prices.insert, (x,)
        return _INF, ()

    def product(self, roles) -> np.ndarray:
        """Min-plus product of the matrices of some turns."""
        out = None
        for r in roles:
            out = self.matrices[r] if out is None else min_plus(out, self.matrices[r])
        return out

    def path(self, roles, start: int, goal: np.ndarray) -> list[tuple[int, str, tuple, int]]:
        """(state, action, inserted roles, price) of each turn on the cheapest way from `start`, where `goal` prices
        the states behind the last turn."""
        ahead = np.empty((len(roles) + 1, N_STATES), np.int64)
        ahead[-1] = goal
        for k in range(len(roles) - 1, -1, -1):
            ahead[k] = before(self.matrices[roles[k]], ahead[k + 1])
        state, out = start, []
        for k, r in enumerate(roles):
            t = int(np.argmin(self.matrices[r][state] + ahead[k + 1]))
            price, action, inserted = self.steps[r][state][t][0]
            out.append((t, action, inserted, price))
            state = t
        return out


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _INF)


def before(matrix: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Prices of the states before a part, given those behind it."""
    return np.minimum((matrix + goal[None, :]).min(axis=1), _INF)


def _role_numbers(roles: list[str | None]) -> list[int]:
    known = {r: i for i, r in enumerate(ROLES)}
    return [known.get(r, len(ROLES)) for r in roles]


_TURN = T.StructType([
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
_KEYS = [T.StructField("conv_id", T.LongType()), T.StructField("range_no", T.IntegerType()),
         T.StructField("chunk_no", T.LongType())]
_CHUNK = T.StructType([*_KEYS, T.StructField("matrix", T.ArrayType(T.LongType())),
                       T.StructField("turns", T.ArrayType(_TURN))])


def chunks(turns: DataFrame, auto: Automaton) -> DataFrame:
    """Chunks of turns in order, each with its matrix; written once."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("at"),
    )
    order = ["conv_id", "turn", "at"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("at")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, range_no = to_arrow_schema(_CHUNK), TaskContext.get().partitionId()
        held, size, conv, number = [], 0, None, 0  # chunks of a range are numbered on over its conversations
        ready, ready_size = [], 0

        def chunk():
            matrix = auto.product(_role_numbers([t["role"] for t in held]))
            return {"conv_id": conv, "range_no": range_no, "chunk_no": number, "matrix": matrix.ravel().tolist(),
                    "turns": held}

        for batch in batches:
            for part in ar.slices(batch, "text"):
                for r in part.to_pylist():
                    new = r["conv_id"] != conv
                    if held and (new or len(held) >= CHUNK_TURNS or size >= CHUNK_BYTES):
                        ready.append(chunk())
                        ready_size += size
                        held, size, number = [], 0, number + 1
                        if ready_size >= CHUNK_BYTES or len(ready) >= 500:
                            yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                            ready, ready_size = [], 0
                    if new:
                        conv = r["conv_id"]
                    held.append({"turn": r["turn"], "role": r["role"], "text": r["text"]})
                    size += 4 * len(r["text"] or "") + 50
        if held:
            ready.append(chunk())
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=arrow)

    ar.bounded_batches(turns.sparkSession)
    return store.written(ranged.mapInArrow(run, _CHUNK), "chat-chunks")


def _parts(rows: DataFrame, keys: list[str], number: str, *columns: str) -> DataFrame:
    """Each group's rows in order: as many as a range has chunks, or a conversation has ranges."""
    row = F.struct(F.col(number).alias("no"), *columns)
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("parts"))


def _mapped(df: DataFrame, fields: list[T.StructField], make) -> DataFrame:
    """The rows that `make` yields for each row."""
    schema = T.StructType(fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = [x for row in batch.to_pylist() for x in make(row)]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _square(flat) -> np.ndarray:
    return np.array(flat, np.int64).reshape(N_STATES, N_STATES)


_GOAL = T.StructField("goal", T.ArrayType(T.LongType()))
_BEHIND = T.StructField("leads_to", T.ArrayType(T.IntegerType()))
_BEFORE = T.StructField("before", T.IntegerType())
_LAST = T.StructField("is_last", T.BooleanType())


def _down(by_range: DataFrame, outer: DataFrame, fields, make) -> DataFrame:
    """Hands what a range was given on to its chunks."""
    given = [c for c in outer.columns if c not in ("conv_id", "range_no")]
    same = by_range["conv_id"].eqNullSafe(outer["conv_id"]) & (by_range["range_no"] == outer["range_no"])
    both = by_range.join(outer, same).select(by_range["conv_id"], by_range["range_no"], "parts", *given)
    return _mapped(both, _KEYS + fields, make)


def chunk_goals(chunked: DataFrame, auto: Automaton) -> DataFrame:
    """`conv_id, range_no, chunk_no, goal`: prices of the states behind each chunk; what follows is repaired best."""
    end = np.array([p for p, _ in auto.closing], np.int64)

    def goals(matrices, last):
        out = [last]
        for m in matrices[:0:-1]:
            out.append(before(m, out[-1]))
        return [g.tolist() for g in out[::-1]]

    def product(row):
        out = _square(row["parts"][0]["matrix"])
        for p in row["parts"][1:]:
            out = min_plus(out, _square(p["matrix"]))
        yield {"conv_id": row["conv_id"], "range_no": row["range_no"], "matrix": out.ravel().tolist()}

    def across(row):
        for p, g in zip(row["parts"], goals([_square(p["matrix"]) for p in row["parts"]], end)):
            yield {"conv_id": row["conv_id"], "range_no": p["no"], "goal": g}

    def within(row):
        last = np.array(row["goal"], np.int64)
        for p, g in zip(row["parts"], goals([_square(p["matrix"]) for p in row["parts"]], last)):
            yield {"conv_id": row["conv_id"], "range_no": row["range_no"], "chunk_no": p["no"], "goal": g}

    by_range = _parts(chunked, ["conv_id", "range_no"], "chunk_no", "matrix")
    ranges = _mapped(by_range, [*_KEYS[:2], T.StructField("matrix", T.ArrayType(T.LongType()))], product)
    outer = _mapped(_parts(ranges, ["conv_id"], "range_no", "matrix"), [*_KEYS[:2], _GOAL], across)
    return _down(by_range, outer, [_GOAL], within)


def chunk_starts(leads: DataFrame) -> DataFrame:
    """`conv_id, range_no, chunk_no, before, is_last` from the states that chunks lead to."""

    def starts(maps, first):
        out = [first]
        for m in maps:
            out.append(m[out[-1]])
        return out

    def whole(row):
        maps = [p["leads_to"] for p in row["parts"]]
        yield {"conv_id": row["conv_id"], "range_no": row["range_no"],
               "leads_to": [starts(maps, s)[-1] for s in range(N_STATES)]}

    def across(row):
        n = len(row["parts"])
        for k, (p, s) in enumerate(zip(row["parts"], starts([p["leads_to"] for p in row["parts"]], START))):
            yield {"conv_id": row["conv_id"], "range_no": p["no"], "before": s, "is_last": k == n - 1}

    def within(row):
        n = len(row["parts"])
        for k, (p, s) in enumerate(zip(row["parts"], starts([p["leads_to"] for p in row["parts"]], row["before"]))):
            yield {"conv_id": row["conv_id"], "range_no": row["range_no"], "chunk_no": p["no"], "before": s,
                   "is_last": row["is_last"] and k == n - 1}

    by_range = _parts(leads, ["conv_id", "range_no"], "chunk_no", "leads_to")
    ranges = _mapped(by_range, [*_KEYS[:2], _BEHIND], whole)
    outer = _mapped(_parts(ranges, ["conv_id"], "range_no", "leads_to"), [*_KEYS[:2], _BEFORE, _LAST], across)
    return _down(by_range, outer, [_BEFORE, _LAST], within)


REPAIRED = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("range_no", T.IntegerType()),
    T.StructField("chunk_no", T.LongType()),
    T.StructField("place", T.IntegerType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("new_role", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("inserted", T.StringType()),
    T.StructField("price", T.LongType()),
    T.StructField("fragment", T.StringType()),
])


def repaired(turns: DataFrame, prices: Prices = Prices(), template: Template = Template()) -> DataFrame:
    """One row per turn, in the order (range_no, chunk_no, place) of its conversation: the role it got, the action, the
    empty turns put in front of it (and, at the end, behind it), their price, and its fragment of the rendered text."""
    auto = Automaton(prices)
    chunked = chunks(turns, auto)
    with_goals = chunked.join(chunk_goals(chunked, auto).drop("conv_id"), ["range_no", "chunk_no"])

    def lead(row):
        roles, goal = _role_numbers([t["role"] for t in row["turns"]]), np.array(row["goal"], np.int64)
        ends = [auto.path(roles, s, goal)[-1][0] for s in range(N_STATES)]
        yield {k: row[k] for k in ("conv_id", "range_no", "chunk_no", "goal")} | {"leads_to": ends}

    leads = store.written(_mapped(with_goals, [*_KEYS, _GOAL, _BEHIND], lead), "chat-leads")
    starts = chunk_starts(leads).drop("conv_id")
    joined = chunked.join(leads.select("range_no", "chunk_no", "goal"), ["range_no", "chunk_no"])
    joined = joined.join(starts, ["range_no", "chunk_no"])
    return _mapped(joined.drop("matrix"), list(REPAIRED), lambda row: _render(row, auto, template))


def _render(row: dict, auto: Automaton, template: Template):
    empty = lambda x: template.open.format(role=ROLES[x]) + template.close
    roles = _role_numbers([t["role"] for t in row["turns"]])
    state, steps = row["before"], auto.path(roles, row["before"], np.array(row["goal"], np.int64))
    for k, (t, (new, action, inserted, price)) in enumerate(zip(row["turns"], steps)):
        # a turn is closed by what begins the next one, since a merge goes on in the same turn
        head = template.joint if action == MERGE else (
            ("" if state == START else template.close) + "".join(map(empty, inserted))
            + template.open.format(role=ROLES[new])
        )
        tail = ""
        if row["is_last"] and k == len(roles) - 1:
            more, closing = auto.closing[new]
            tail = template.close + "".join(map(empty, closing))
            price, inserted = price + more, (*inserted, *closing)
        yield {
            "conv_id": row["conv_id"], "range_no": row["range_no"], "chunk_no": row["chunk_no"], "place": k,
            "turn": t["turn"], "role": t["role"], "new_role": ROLES[new], "action": action,
            "inserted": ",".join(ROLES[x] for x in inserted), "price": price,
            "fragment": head + (t["text"] or "") + tail,
        }
        state = new
