"""Conversation structure repair by depth-first branch and bound.

A repaired conversation's roles are an optional system turn, then pairs of user and assistant. Rows are kept, given
another role, deleted, or preceded by inserted turns; the cheapest edits are searched for, of equal costs those whose
string of initials is least. The search keeps an explicit stack, prunes by a lower bound of the rows still to
come and by the incumbent (cost, audit), and a table of each (row, state) drops every prefix that is no better than
one that came there before. It ends when the stack is empty: then the incumbent is proved.

Spark sorts the rows by conversation and turn into ranges, and each range is cut into runs of at most 16 rows of one
conversation, which bounds a search. Most conversations are one run. A run of a longer one is solved for each state it may be entered and left
in, and neighbouring runs are joined state by state, 64 at a time, in rounds: so a conversation that holds a third of
all rows is solved by many tasks. Joining is exact, as of two edits of equal cost between the same states neither can
begin with the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import WHITE, save

#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
START, S, U, A = range(4)
STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
NEXT = {START: ("u", U), S: ("u", U), U: ("a", A), A: ("u", U)}  # the turn that an edit of roles, or an insert, gives
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

Row = tuple[str, bool, bool]  # the role's initial, must go, is truncated
Solutions = dict[tuple[int, int], tuple[int, str]]


def reachable(state: int, goal: int) -> bool:
    return state == goal or state < goal or (state >= U and goal >= U)


def suffix_bounds(rows: list[Row]) -> list[int]:
    """What the rows from each place on cost at least, whatever the state: the least of each row, and of two neighbours that can't both stay as they are."""
    bound, forced = [0] * (len(rows) + 1), 0
    later: list[tuple[int, int, str]] = [(0, 0, "")]  # of rows that may stay, from the last on: bound, least cost, initial where that keeps it
    spare = [0]
    for i in range(len(rows) - 1, -1, -1):
        initial, gone, cut = rows[i]
        if gone:
            forced += DELETE
        else:
            other = min(DELETE, REROLE + TRUNCATED * cut)
            keeps = initial in ("s", "u", "a")
            least = TRUNCATED * cut if keeps else other
            low, most, after = later[-1][0] + least, other - least, later[-1][2]
            if keeps and after and initial + after not in LEGAL:
                low = max(low, least + later[-1][1] + min(INSERT, most, spare[-1]) + later[-2][0])
            later.append((low, least, initial if keeps else ""))
            spare.append(most)
        bound[i] = forced + later[-1][0]
    return bound


def solve(rows: list[Row], entry: int = START, goal: int = A) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state ``entry`` to ``goal``; null where there are none."""
    n, bound = len(rows), suffix_bounds(rows)
    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, "", 0, entry)]
    while stack:
        cost, audit, i, state = stack.pop()
        if best and (cost + bound[i], audit) > (best[0], best[1][: len(audit)]):
            continue
        held = table.get((i, state))
        if held and held <= (cost, audit):
            continue
        table[i, state] = (cost, audit)
        if i == n and state == goal and (not best or (cost, audit) < best):
            best = (cost, audit)
        found = []
        initial, to = NEXT[state]
        if reachable(to, goal):
            found.append((cost + INSERT, audit + "I", i, to))
        if i < n:
            own, gone, cut = rows[i]
            found.append((cost + DELETE, audit + "D", i + 1, state))
            if not gone:
                more = TRUNCATED * cut
                if reachable(to, goal):
                    found.append((cost + REROLE + more, audit + "R", i + 1, to))
                kept = STEP.get((state, own))
                if kept is not None and reachable(kept, goal):
                    found.append((cost + more, audit + "K", i + 1, kept))
        found.sort(key=lambda x: (x[0] + bound[x[2]], -x[2], x[1]), reverse=True)  # the most hopeful on top
        stack += found
    return best


def solve_all(rows: list[Row], entries: tuple[int, ...], goals: tuple[int, ...]) -> Solutions:
    out = {(e, g): solve(rows, e, g) for e in entries for g in goals if reachable(e, g)}
    return {k: v for k, v in out.items() if v}


def joined(one: Solutions, two: Solutions) -> Solutions:
    """The best edits of two runs that follow each other."""
    out: Solutions = {}
    for (e, m), (cost, audit) in one.items():
        for (m2, g), (more, rest) in two.items():
            if m == m2 and ((e, g) not in out or (cost + more, audit + rest) < out[e, g]):
                out[e, g] = (cost + more, audit + rest)
    return out


def whole(solutions: Solutions) -> tuple[int, str]:
    return min(v for (e, g), v in solutions.items() if e == START and g in (START, A))


class Repair:
    """Applies an audit to the rows of a conversation as they come, keeping no more than the hash of the result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def _line(self, role: str, text: str, state: int) -> None:
        self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any, self.state = True, state

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            initial, to = NEXT[self.state]
            self._line(ROLE[initial], "", to)
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._line(role, text, STEP[self.state, role[:1]])
        elif edit == "R":
            initial, to = NEXT[self.state]
            self._line(ROLE[initial], text, to)

    def end(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


# --- runs of rows ------------------------------------------------------------------------------------------

_SOLUTIONS = "array<struct<entry: int, goal: int, cost: long, audit: string>>"
_RUN = f"conv_key string, part long, seq long, solved boolean, illegal long, first string, last string, solutions {_SOLUTIONS}, cost long, audit string, repaired_sha256 string, roles array<string>, texts array<string>"


def _packed(solutions: Solutions) -> list[dict]:
    return [{"entry": e, "goal": g, "cost": c, "audit": a} for (e, g), (c, a) in solutions.items()]


def _unpacked(found) -> Solutions:
    return {(x["entry"], x["goal"]): (x["cost"], x["audit"]) for x in found}


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _runs(length: int):
    columns = [c.split(" ")[0] for c in "conv_key,part,seq,solved,illegal,first,last,solutions,cost,audit,repaired_sha256,roles,texts".split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, out = TaskContext.get().partitionId(), 0, []

        def emit(key: str, rows: list, starts: bool, ends: bool) -> None:
            """``starts``, ``ends``: whether the conversation's first and last row are surely here."""
            nonlocal seq
            cases = [(r[:1], gone, cut) for r, _, gone, cut in rows]
            initials = [c[0] for c in cases]
            found = solve_all(cases, (START,) if starts else (START, S, U, A), (START, A) if ends else (START, S, U, A))
            row = [key, part, seq, starts and ends, _illegal(initials), initials[0], initials[-1]]
            if starts and ends:
                cost, audit = whole(found)
                repair = Repair(audit)
                for role, text, _, _ in rows:
                    repair.row(role, text)
                row += [[], cost, audit, repair.end(), [], []]
            else:
                row += [_packed(found), None, None, None, [r[0] for r in rows], [r[1] for r in rows]]
            out.append(row)
            seq += 1

        key, rows, starts = None, [], False
        for pdf in batches:
            for k, *row in zip(pdf["conv_key"], pdf["role"], pdf["text"], pdf["gone"], pdf["cut"]):
                if k != key or len(rows) == length:
                    if rows:
                        emit(key, rows, starts, k != key)
                    rows, starts, key = [], key is not None and k != key, k
                rows.append(row)
            if out:
                yield pd.DataFrame(out, columns=columns)
                out.clear()
        if rows:
            emit(key, rows, starts, False)
            yield pd.DataFrame(out, columns=columns)

    return run


_JOINED = f"conv_key string, at long, illegal long, first string, last string, solutions {_SOLUTIONS}"


def _join_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("at", ignore_index=True)
    found, illegal = _unpacked(pdf["solutions"][0]), int(pdf["illegal"].sum()) + sum(_illegal([a, b]) for a, b in zip(pdf["last"], pdf["first"][1:]))
    for more in pdf["solutions"][1:]:
        found = joined(found, _unpacked(more))
    return pd.DataFrame([[pdf["conv_key"][0], int(pdf["to"][0]), illegal, pdf["first"][0], pdf["last"].iloc[-1], _packed(found)]], columns=["conv_key", "at", "illegal", "first", "last", "solutions"])


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, repair = None, None
    for pdf in batches:
        out = []
        for k, audit, roles, texts in zip(pdf["conv_key"], pdf["audit"], pdf["roles"], pdf["texts"]):
            if k != key:
                if repair:
                    out.append((key, repair.end()))
                key, repair = k, Repair(audit)
            for role, text in zip(roles, texts):
                repair.row(role, text)
        yield pd.DataFrame(out, columns=["conv_key", "repaired_sha256"])
    if repair:
        yield pd.DataFrame([(key, repair.end())], columns=["conv_key", "repaired_sha256"])


# --- tables ------------------------------------------------------------------------------------------------


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): rows damaged by a hash of conversation and turn, to test a repair on.

    Of twenty rows one goes, one loses its text, one its full stops and marks, one comes twice and one becomes the user's.
    Nulls count as one space in the hash, and become one in role and text.
    """
    space = F.lit(" ")
    case = F.crc32(F.concat(F.coalesce(F.col(conv_id).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))) % 20
    rows = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"), case.alias("case")).where("case > 0")
    texts = F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    roles = F.when(F.col("case") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", roles.alias("role"), texts.alias("text"), copies).drop("copy")


def conv_key(conv_id: Column) -> Column:
    """A string that stands for the id; null is one conversation, too."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_key, turn, role, text, row, blank, duplicate, truncated): each row's first fault.

    Rows come by turn, null first; rows of one turn by role and text. A duplicate repeats role and text of an earlier row.
    """
    body = F.btrim("text", F.lit(WHITE))
    base = rows.select(conv_key(F.col("conv_id")).alias("conv_key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    base = save(base.withColumns({"blank": F.btrim("text", F.lit(WHITE)) == "", "open": ~F.right(body, F.lit(1)).isin(".", "!", "?")}), "turns")
    same = base.select("conv_key", "role", F.sha2("text", 256).alias("h"), F.struct(F.col("turn").isNotNull(), F.col("turn"), F.col("row")).alias("place"))
    first = same.groupBy("conv_key", "role", "h").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = save(same.join(first, ["conv_key", "role", "h"]).where("place.row != first.row").select(F.col("place.row").alias("row"), F.lit(True).alias("again")), "again")
    found = base.join(again, "row", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    duplicate = ~F.col("blank") & F.col("again")
    return found.select("conv_key", "turn", "role", "text", "row", "blank", duplicate.alias("duplicate"), (~F.col("blank") & ~duplicate & F.col("open")).alias("truncated"))


def repair(rows: DataFrame, length: int = 16) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): conv_key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Nulls in role and text are read as one space, which is no role and a blank text; rows with a null turn come first, and
    those with a null conversation are one. Rows of one turn come by role and text, and rows that repeat are duplicates.
    Texts of any length are taken whole; an empty table gives no rows. Other columns are not read.
    """
    found = save(faults(rows), "faults")
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = found.groupBy("conv_key").agg(span.alias("gaps"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")])
    ranged = found.repartitionByRange("conv_key", F.col("turn").asc_nulls_first(), "role", "text", "row").sortWithinPartitions("conv_key", F.col("turn").asc_nulls_first(), "role", "text", "row")
    cases = ranged.select("conv_key", "role", "text", (F.col("blank") | F.col("duplicate")).alias("gone"), F.col("truncated").alias("cut"))
    runs = save(cases.mapInPandas(_runs(length), _RUN), "runs")
    answer = ["conv_key", "illegal", "cost", "audit", "repaired_sha256"]
    out = runs.where("solved").select(*answer)
    most = runs.where("not solved").agg(F.max("seq")).first()[0]
    if most is not None:
        parts = runs.where("not solved").withColumn("at", F.col("part") * (most + 1) + F.col("seq"))
        left = parts.select("conv_key", "at", "illegal", "first", "last", "solutions")
        while True:
            left = save(left.withColumn("to", F.shiftright("at", 6)).groupBy("conv_key", "to").applyInPandas(_join_runs, _JOINED), "joined")
            if left.groupBy("conv_key").count().where("count > 1").isEmpty():
                break
        ways = F.filter("solutions", lambda x: (x["entry"] == START) & x["goal"].isin(START, A))
        best = F.array_min(F.transform(ways, lambda x: F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"))))
        best = save(left.select("conv_key", "illegal", best.alias("best")).select("conv_key", "illegal", "best.cost", "best.audit"), "best")
        heads = parts.groupBy("conv_key").agg(F.min("at").alias("at")).join(best.select("conv_key", "audit"), "conv_key")
        texts = parts.select("conv_key", "at", "roles", "texts").join(heads, ["conv_key", "at"], "left")
        hashed = texts.repartition("conv_key").sortWithinPartitions("conv_key", "at").select("conv_key", "audit", "roles", "texts").mapInPandas(_hashes, "conv_key string, repaired_sha256 string")
        out = out.unionByName(best.join(hashed, "conv_key").select(*answer))
    return counts.join(out, "conv_key").select("conv_key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_conversations(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """``repair`` of ``damaged`` for every conversation of ``conversations``; where no row is left: zeros, an empty audit, the hash of nothing."""
    every = conversations.select("conv_id").distinct().withColumn("conv_key", conv_key(F.col("conv_id")))
    found = every.join(repair(damaged), "conv_key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
