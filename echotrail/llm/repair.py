"""Repair of conversation structure: cheapest edits by dynamic programming with checkpoints.

A conversation is right when its role initials are ``(s?(ua)+)?`` and no turn is blank or said before. Edits
cost what ``EDITS`` says. Cost vectors run backwards over the turns, one cost per state of that pattern; they
are kept only at checkpoints, about the square root of the turns apart. The blocks between are computed
again, walking forward, to emit the edits whose initials are least in ASCII order among the cheapest.

Blocks are rows of a Spark table. Each is reduced to a matrix of costs from state to state; matrices chained
from the end give the vectors at the checkpoints, ends of walks chained from the start give the state in
which each block begins. So a conversation of any length is repaired by many tasks, and the texts themselves
are shuffled once, streamed in order into the digest of the repaired conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from echotrail.llm.common import SPACES, name
from echotrail.operators.ordered import ordered_chunks
from echotrail.session import small_side, written

# Costs of the edits, and what an undeleted truncated turn adds.
EDITS = {"D": 2, "I": 5, "K": 0, "R": 1}
TRUNCATED = 5
# States: nothing yet, after system, after user, after assistant. Kept roles lead on as listed ...
KEPT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
# ... and a changed or inserted role is always the one that may come next.
NEXT = [2, 2, 3, 2]
ROLE_OF = {2: "user", 3: "assistant"}
FINAL = [0, 3]
STATES = range(4)
FAR = 1 << 60
# Conversations of at most so many turns are one block.
SHORT = 64


def _with_inserts(costs: list[int]) -> list[int]:
    """Costs when turns may be inserted first: at most two lead from any state to any other that inserts reach."""
    once = [min(costs[s], EDITS["I"] + costs[NEXT[s]]) for s in STATES]
    return [min(once[s], EDITS["I"] + once[NEXT[s]]) for s in STATES]


END = _with_inserts([0 if s in FINAL else FAR for s in STATES])


def _moves(symbol: str) -> list[list[tuple[int, int, str]]]:
    """Per state: cost, next state and initial of the edits that use up a turn. Symbols are the role's initial
    (``o`` for any other role), in upper case for a truncated turn, or ``x`` for one that has to go."""
    extra = TRUNCATED if symbol.isupper() else 0
    out = []
    for s in STATES:
        moves = [(EDITS["D"], s, "D")]
        if symbol != "x":
            if symbol.lower() in KEPT[s]:
                moves.append((EDITS["K"] + extra, KEPT[s][symbol.lower()], "K"))
            moves.append((EDITS["R"] + extra, NEXT[s], "R"))
        out.append(moves)
    return out


MOVES = {symbol: _moves(symbol) for symbol in "suaoSUAOx"}


def back(symbol: str, after: list[int]) -> list[int]:
    """Costs before a turn from the costs behind it."""
    return _with_inserts([min(cost + after[to] for cost, to, _ in moves) for moves in MOVES[symbol]])


def block_costs(symbols: str) -> list[int]:
    """Cheapest cost through a block, state * 4 + state; inserts behind its last turn belong to what follows."""
    columns = []
    for end in STATES:
        costs = [0 if s == end else FAR for s in STATES]
        for symbol in reversed(symbols):
            costs = back(symbol, costs)
        columns.append(costs)
    return [min(columns[e][s], FAR) for s in STATES for e in STATES]


def walk(symbols: str, after: list[int], starts: list[int], last: bool) -> list[tuple[str, int, int]]:
    """Edits, end state and cost from each start state, with the block's vectors computed again from ``after``."""
    vectors = [after]
    for symbol in reversed(symbols):
        vectors.append(back(symbol, vectors[-1]))
    vectors.reverse()
    walks = []
    for state in starts:
        edits, total = [], vectors[0][state]
        i = 0
        while total < FAR:
            here = vectors[i][state]
            options = [("I", EDITS["I"] + vectors[i][NEXT[state]], i, NEXT[state])]
            if i < len(symbols):
                options += [(e, cost + vectors[i + 1][to], i + 1, to) for cost, to, e in MOVES[symbols[i]][state]]
            elif not last or here == 0:
                break
            e, _, i, state = min(o for o in options if o[1] == here)
            edits.append(e)
        walks.append(("".join(edits), state, total))
    return walks


def _symbol(role: Column, fault: Column) -> Column:
    """One character that says all the walk has to know about a turn."""
    first = F.substring(role, 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(letter)).otherwise(letter)


def faults(turns: DataFrame) -> DataFrame:
    """Per turn, without its text: ``conv_id, pos, role, fault``, the first of blank, duplicate, truncated or null.

    ``turns`` has ``conv_id, turn, role, text``. Turns of a conversation come by turn (null first), role and
    digest of role and text. A copy is found through the first position of its digest, which partial
    aggregates give however often a text repeats.
    """
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    light = turns.select("conv_id", "turn", "role", turn_digest().alias("digest"),
                         F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("plain"))
    placed = written(ordered_chunks(light, ["conv_id"], turn_order(), halo=0).select("conv_id", "pos", "role", "digest", "plain"))
    firsts = placed.groupBy("conv_id", "digest").agg(F.min("pos").alias("pos"))
    none = F.lit(None).cast("string")
    both = placed.select("conv_id", "pos", "role", "plain", F.lit(False).alias("new")).unionByName(
        firsts.select("conv_id", "pos", none.alias("role"), none.alias("plain"), F.lit(True).alias("new")))
    merged = both.groupBy("conv_id", "pos").agg(F.max("role").alias("role"), F.max("plain").alias("plain"), F.max("new").alias("new"))
    fault = F.when(F.col("plain") == "blank", "blank").when(~F.col("new"), "duplicate").otherwise(F.col("plain"))
    return merged.select("conv_id", "pos", "role", fault.alias("fault"))


def turn_digest() -> Column:
    return F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256))


def turn_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _map_rows(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over each row as a dict; it returns the values of the new row."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            yield pa.RecordBatch.from_pylist([run(row) for row in batch.to_pylist()], schema=target)

    target = to_arrow_schema(T.StructType.fromDDL(schema))
    return df.mapInArrow(batches, schema)


def cheapest_edits(turns: DataFrame, short: int = SHORT) -> DataFrame:
    """Per conversation: ``conv_id, audit, cost`` from ``conv_id, pos, symbol`` of a stored table."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    sizes = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > short).withColumnRenamed("conv_id", "_conv"))
    marked = turns.join(small_side(sizes, 32), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    width = F.ceil(F.sqrt("_n"))
    blocks = marked.withColumn("block", F.coalesce(F.floor((F.col("pos") - 1) / width), F.lit(-1)).cast("long")).groupBy("conv_id", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"))

    def whole(row):
        edits, _, cost = walk(row["symbols"], END, [0], True)[0]
        return {"conv_id": row["conv_id"], "audit": edits, "cost": cost}

    audit_schema = f"conv_id {kind}, audit string, cost long"
    audits = _map_rows(blocks.filter("block < 0").select("conv_id", "symbols"), whole, audit_schema)
    if sizes.limit(1).count() == 0:
        return audits

    def reduced(row):
        return {**row, "costs": block_costs(row["symbols"])}

    stored = written(_map_rows(blocks.filter("block >= 0"), reduced, f"conv_id {kind}, block long, symbols string, costs array<long>"))

    def checkpoints(matrices: pd.DataFrame) -> pd.DataFrame:
        matrices = matrices.sort_values("block", ascending=False)
        vectors, after = [], END
        for costs in matrices["costs"]:
            vectors.append(list(after))
            after = [min(int(costs[s * 4 + e]) + after[e] for e in STATES) for s in STATES]
        return pd.DataFrame({"_conv": matrices["conv_id"], "_block": matrices["block"], "after": vectors, "last": [i == 0 for i in range(len(vectors))]})

    # One row of sixteen costs per block: about the square root of a conversation's turns in one group.
    vectors = stored.select("conv_id", "block", "costs").groupBy("conv_id").applyInPandas(
        checkpoints, f"_conv {kind}, _block long, after array<long>, last boolean")
    met = stored.select("conv_id", "block", "symbols").join(vectors, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))

    def walked(row):
        walks = walk(row["symbols"], row["after"], list(STATES), row["last"])
        return {"conv_id": row["conv_id"], "block": row["block"], "edits": [w[0] for w in walks], "ends": [w[1] for w in walks], "costs": [w[2] for w in walks]}

    walks = written(_map_rows(met.select("conv_id", "block", "symbols", "after", "last"), walked,
                              f"conv_id {kind}, block long, edits array<string>, ends array<int>, costs array<long>"))

    def begins(ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("block")
        states, state = [], 0
        for e in ends["ends"]:
            states.append(state)
            state = int(e[state])
        return pd.DataFrame({"_conv": ends["conv_id"], "_block": ends["block"], "state": states})

    begun = walks.select("conv_id", "block", "ends").groupBy("conv_id").applyInPandas(begins, f"_conv {kind}, _block long, state int")
    chosen = walks.join(begun, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).select(
        "conv_id", F.struct("block", F.get("edits", F.col("state")).alias("edits"), F.get("costs", F.col("state")).alias("cost")).alias("part"))
    joined = chosen.groupBy("conv_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return audits.unionByName(joined.select(
        "conv_id", F.array_join(F.transform("parts", lambda p: p["edits"]), "").alias("audit"), F.get("parts", F.lit(0))["cost"].alias("cost")))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_FINE = {"su", "ua", "au"}


class _Stream:
    """One conversation at a time over rows that come ordered: its audit first, then its turns."""

    def __init__(self, head: dict):
        self.head, self.sha, self.said = head, hashlib.sha256(), False
        self.edits, self.at, self.state = head["audit"] or "", 0, 0
        self.initial, self.illegal = None, 0
        self.low = self.high = None
        self.turns = 0

    def _say(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.said else "") + role + ":" + text).encode())
        self.said = True

    def _inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.state = NEXT[self.state]
            self._say(ROLE_OF[self.state], "")
            self.at += 1

    def turn(self, turn: int | None, role: str, text: str) -> None:
        self._inserts()
        e = self.edits[self.at]
        self.at += 1
        if e == "K":
            self.state = KEPT[self.state][role[0]]
            self._say(role, text)
        elif e == "R":
            self.state = NEXT[self.state]
            self._say(ROLE_OF[self.state], text)
        if self.initial is not None and self.initial + role[:1] not in _FINE:
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def done(self) -> dict:
        self._inserts()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        counts = {k: self.head[k] or 0 for k in ("blank", "duplicate", "truncated", "cost")}
        return {"conv_id": self.head["conv_id"], "gaps": gaps, **counts, "illegal": self.illegal,
                "audit": self.head["audit"] or "", "repaired_sha256": self.sha.hexdigest()}


def repair(turns: DataFrame, conversations: DataFrame | None = None, short: int = SHORT) -> DataFrame:
    """One row per conversation: ``conv_id`` and the columns of ``REPORT``.

    ``turns`` has ``conv_id, turn, role, text``; ``conversations`` names ids that get a row even without a
    turn. Null and empty roles and null texts count as one space, so such a turn's role cannot be kept and
    such a text is blank. A null id is one conversation; repeated rows are turns; turns alike in turn and role
    come by digest. An empty table gives an empty result. The walk sees one character per turn; the audit of
    a conversation is one value, and its texts are streamed.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"),
                        F.when(space("role") == "", " ").otherwise(space("role")).alias("role"), space("text").alias("text"))
    judged = written(faults(rows).select("conv_id", "pos", "fault", _symbol(F.col("role"), F.col("fault")).alias("symbol")))
    counts = judged.groupBy("conv_id").agg(*[F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")])
    audits = cheapest_edits(judged.select("conv_id", "pos", "symbol"), short)
    ids = (turns if conversations is None else conversations).select("conv_id").distinct()
    columns = ["audit", "cost", "blank", "duplicate", "truncated"]
    types = {"audit": "string"}
    parts = [df.select("conv_id", *[(F.col(c) if c in df.columns else F.lit(None).cast(types.get(c, "long"))).alias(c) for c in columns]) for df in (ids, counts, audits)]
    heads = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("conv_id").agg(*[F.max(c).alias(c) for c in columns])
    none = lambda kind: F.lit(None).cast(kind)
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", turn_digest().alias("digest"), *[none(types.get(c, "long")).alias(c) for c in columns])
    head = heads.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("binary").alias("digest"), *columns)
    ordered = body.unionByName(head).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *turn_order()).drop("digest")
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {REPORT}"
    target = to_arrow_schema(T.StructType.fromDDL(schema))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if now is not None:
                        out.append(now.done())
                    now = _Stream(row)
                else:
                    now.turn(row["turn"], row["role"], row["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.done()], schema=target)

    return ordered.mapInArrow(stream, schema)


def damaged(df: DataFrame, every: int = 20) -> DataFrame:
    """``conv_id, turn, role, text`` with damage by the unsigned CRC-32 of ``conv_id:turn`` modulo ``every``:
    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's. Null values count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % every
    rows = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def repair_report(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``repair`` of the damaged table, one row for every conversation of the table as it was."""
    named = conversations.select(*[name(c).alias(a) for c, a in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    return repair(damaged(named), named)
