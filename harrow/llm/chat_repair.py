"""Minimum-cost role repair of conversations by dynamic programming over an automaton of legal turns."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow.functions.ranking import running
from harrow.llm.common import cut, join_few

#: States are the role of the turn before; 0 is the start. A conversation is an optional system turn, then user and assistant in turn, and ends with the assistant.
ROLES = ("start", "system", "user", "assistant")
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
#: Other names of roles, in lower case.
ALIASES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "bot": "assistant", "gpt": "assistant"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
INF = float("inf")


class Costs(NamedTuple):
    """Of a known role that is changed, an unknown one that is given a role, a merge with the turn before, and an empty turn put in."""

    relabel: float = 5.0
    name: float = 2.0
    merge: float = 1.0
    insert: float = 3.0

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cost, action)[role in (0: unknown), state before, state after] and end[state], the cost of the empty turns that close a conversation.

        An action is 1 for a relabel, plus 2 for a merge, plus 4 times the role of an empty turn put in before.
        """
        cost, action = np.full((4, 4, 4), INF), np.zeros((4, 4, 4), np.int64)
        for role in range(4):
            for s in range(4):
                for r in (1, 2, 3):
                    other = role != r
                    change = other * (self.relabel if role else self.name)
                    ways = [(change + self.merge, other + 2)] if s == r else []
                    ways += [(change, int(other))] if (s, r) in LEGAL else []
                    ways += [(change + self.insert, other + 4 * x) for x in (2, 3) if (s, x) in LEGAL and (x, r) in LEGAL]
                    if ways:
                        cost[role, s, r], action[role, s, r] = min(ways)
        return cost, action, np.array([INF, 2 * self.insert, self.insert, 0.0])


def fold(steps: list[np.ndarray]) -> np.ndarray:
    """The least cost from each state to each other over all steps: a product in which min takes the place of + and + that of *."""
    d = np.where(np.eye(4, dtype=bool), 0.0, INF)
    for m in steps:
        d = (d[:, :, None] + m[None]).min(1)
    return d


def walk(steps: list[np.ndarray], enter: int, leave: int, end: np.ndarray) -> list[int]:
    """The states before, between and after the steps on a least-cost way; leave is -1 where the conversation ends, at the cost of `end`."""
    d, back = np.where(np.arange(4) == enter, 0.0, INF), []
    for m in steps:
        total = d[:, None] + m
        back.append(total.argmin(0))
        d = total.min(0)
    s = int((d + end).argmin()) if leave < 0 else leave
    way = [s]
    for b in reversed(back):
        way.append(int(b[way[-1]]))
    return way[::-1]


class _Solver:
    """The four steps on arrays, for given costs."""

    def __init__(self, costs: Costs):
        cost, action, end = costs.tables()
        square = lambda x: [np.reshape(y, (4, 4)) for y in x]

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def fold_roles(roles: pd.Series) -> pd.Series:
            return roles.map(lambda r: fold([cost[int(i)] for i in r]).ravel().tolist())

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def fold_tables(m: pd.Series) -> pd.Series:
            return m.map(lambda x: fold(square(x)).ravel().tolist())

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def walk_tables(m: pd.Series, enter: pd.Series, leave: pd.Series) -> pd.Series:
            return pd.Series([walk(square(x), int(a), int(b), end) for x, a, b in zip(m, enter, leave)])

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def walk_roles(roles: pd.Series, enter: pd.Series, leave: pd.Series) -> pd.Series:
            def one(r, a, b):
                way = walk([cost[int(i)] for i in r], int(a), int(b), end)
                return [16 * int(action[int(i), s, t]) + 4 * s + t for i, s, t in zip(r, way, way[1:])]
            return pd.Series([one(*x) for x in zip(roles, enter, leave)])

        self.fold_roles, self.fold_tables, self.walk_tables, self.walk_roles = fold_roles, fold_tables, walk_tables, walk_roles

    def states(self, level: DataFrame, fan: int) -> DataFrame:
        """(c, pos, enter, leave) for rows (c, pos, m): the states at the ends of each part. Up to `fan` parts are folded into one, as often as a conversation needs it."""
        top = level.agg(F.max("pos")).first()[0] or 0
        parts = level.groupBy("c", F.floor(F.col("pos") / fan).alias("up")).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("x"))
        parts = parts.withColumn("ms", F.transform("x", lambda p: p["m"]))
        if top < fan:
            parts = parts.withColumn("enter", F.lit(0)).withColumn("leave", F.lit(-1))
        else:
            parts = cut(parts)
            ends = self.states(parts.select("c", F.col("up").alias("pos"), self.fold_tables("ms").alias("m")), fan)
            parts = parts.join(ends.withColumnRenamed("pos", "up"), ["c", "up"])
        parts = parts.select("c", "x", self.walk_tables("ms", "enter", "leave").alias("way"))
        return parts.select("c", F.posexplode("x").alias("i", "p"), "way").select("c", F.col("p.pos").alias("pos"), F.get("way", F.col("i")).alias("enter"), F.get("way", F.col("i") + 1).alias("leave"))


def role_code(role: Column, aliases: dict[str, str] | None = None) -> Column:
    """1 to 3 for system, user and assistant, whatever their case, and for other names that aliases give; 0 for all else."""
    name, aliases, out = F.lower(F.trim(role)), ALIASES if aliases is None else aliases, None
    for code in (1, 2, 3):
        hit = name.isin(*[a for a, r in aliases.items() if r == ROLES[code]])
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise(0)


def repair_roles(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", part=512, costs=Costs(), aliases: dict[str, str] | None = None) -> DataFrame:
    """A row for each turn: (conv_id, seq, turn, role_in, role, action, inserted, closing, piece).

    role is the repaired role; action is keep, relabel, merge or relabel+merge (merge: with the turn before); inserted is the role of an empty turn put in
    before this one; closing, at a conversation's last turn, names the empty turns after it. The pieces of a conversation in the order of seq, one after the other,
    are its rendered form, so that no conversation is ever put together in one row. The repair has the least total cost. Marks of the
    rendered form inside a text are broken by a space.

    Turns are numbered by running counts over ranges, so neither a conversation nor a turn number is one task's. They are cut into parts of at most `part`, and parts are solved apart, on
    roles alone: the least costs between all states of a part are a 4x4 table; tables are folded up to the
    conversation, and the states found there go down again. Texts are joined with what was found.

    Turns are ordered by turn (null last), role (null last) and the text's digest. A null role or an unknown one can become any role at a lower cost. A null text is
    empty. Null conversation ids are one conversation. Repeated rows stay and are merged. No rows give no rows. Other columns are ignored.
    """
    solver = _Solver(costs)
    c = F.coalesce(F.concat(F.lit("c"), F.col(conv_col).cast("string")), F.lit("n"))
    rows = turns.select(c.alias("c"), F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role_in"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    places = rows.select("row", "c", "turn", role_code(F.col("role_in"), aliases).alias("code"), "role_in", F.md5("text").alias("h"))
    places = running(places, ["c", F.col("turn").asc_nulls_last(), F.col("role_in").asc_nulls_last(), "h", "row"], at=F.lit(1))
    begin = places.groupBy("c").agg(F.min("at").alias("begin"), F.count(F.lit(1)).alias("n"))
    places = join_few(places.select("row", "c", "code", "at"), begin, "c", broadcast_rows=100_000)
    i = F.col("at") - F.col("begin")
    places = cut(places.select("row", "c", "code", i.alias("seq"), F.floor(i / part).cast("long").alias("pos"), (i == F.col("n") - 1).alias("ending")))
    parts = cut(places.groupBy("c", "pos").agg(F.sort_array(F.collect_list(F.struct("seq", "code", "row", "ending"))).alias("x")).withColumn("roles", F.transform("x", lambda t: t["code"])))
    ends = solver.states(parts.select("c", "pos", solver.fold_roles("roles").alias("m")), part)
    solved = parts.join(ends, ["c", "pos"]).withColumn("did", solver.walk_roles("roles", "enter", "leave"))
    did = solved.select("did", F.posexplode("x").alias("k", "t")).select(F.col("t.row").alias("row"), F.col("t.seq").alias("seq"), F.col("t.ending").alias("ending"), F.get("did", F.col("k")).alias("a"))
    out = rows.join(did, "row")
    names = F.array(*[F.lit(r) for r in ROLES])
    name = lambda code: F.get(names, code)
    after, before, act = F.col("a") % 4, F.floor(F.col("a") / 4).cast("int") % 4, F.floor(F.col("a") / 16).cast("int")
    relabel, merge, put = act % 2 == 1, F.floor(act / 2) % 2 == 1, F.floor(act / 4).cast("int")
    turn = lambda role: F.concat(F.lit(OPEN), role, F.lit("\n"))
    empty = lambda role: F.concat(turn(role), F.lit(CLOSE + "\n"))
    closing = F.when(F.col("ending") & (after == 1), "user,assistant").when(F.col("ending") & (after == 2), "assistant")
    text = F.replace(F.replace(F.col("text"), F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    starts = F.concat(F.when(before == 0, "").otherwise(CLOSE + "\n"), F.when(put > 0, empty(name(put))).otherwise(""), turn(name(after)))
    tail = F.when(F.col("ending"), F.concat(F.lit(CLOSE + "\n"), F.when(after == 1, empty(F.lit("user"))).otherwise(""), F.when(after < 3, empty(F.lit("assistant"))).otherwise(""))).otherwise("")
    action = F.when(relabel & merge, "relabel+merge").when(relabel, "relabel").when(merge, "merge").otherwise("keep")
    return out.select(
        "conv_id", "seq", "turn", "role_in", name(after).alias("role"), action.alias("action"), F.when(put > 0, name(put)).alias("inserted"), closing.alias("closing"),
        F.concat(F.when(merge, "\n").otherwise(starts), text, tail).alias("piece"),
    )
