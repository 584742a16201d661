"""Conversation structure repair: the cheapest edits after which a conversation is an optional system turn and then user and assistant by turns.

A row's symbol is its role's initial with its fault, and each symbol is a min-plus matrix over four states of what has been said so far (nothing, system, user, assistant): the least
cost of the inserts before the row and of keeping, reroling or deleting it. Equal consecutive symbols are one run, which a vector of costs passes through by the cached binary powers of the
symbol's matrix. With the costs to go known behind each run, the choices are unrolled from the front, always the ASCII-least that is still cheapest, which gives the audit.

The matrices multiply, so no conversation needs to be in one task: rows are ordered once and numbered, a conversation's rows of one block of numbers are a segment, and segments that may have neighbours
get the costs behind them and the state before them by two scans over a tree of products, each node of which has at most 2 ** BLOCK_BITS children. Only the last step, the hash of a
conversation's whole repaired text, is by nature one pass over it; that pass streams its rows in order and keeps a few numbers and the audit.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frostline.llm.lineage import cut, extended, written

#: Fixed values of the task: what edits cost, and white space.
RETAG, DELETE, INSERT, BROKEN = 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
BLOCK_BITS = 12

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: The state after a user or assistant turn where it has its place, and that turn's initial.
ONWARD = (USER, USER, ASSISTANT, USER)
INITIAL = ("u", "u", "a", "u")
ENDS = (NOTHING, ASSISTANT)
FAR = 1 << 50
#: A symbol is MUST_GO, or 1 + 2 * role + truncated with a role of ROLES.
MUST_GO = 0
ROLES = "sua?"


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product of a matrix with a matrix or a vector."""
    return np.minimum((a[:, :, None] + b[None] if b.ndim == 2 else a + b[None]).min(axis=1), FAR)


def _inserts() -> np.ndarray:
    cost = np.full((4, 4), FAR)
    np.fill_diagonal(cost, 0)
    for s in STATES:
        cost[s, ONWARD[s]] = INSERT
    return np.minimum(cost, times(cost, cost))


INSERTS = _inserts()
ACCEPT = times(INSERTS, np.array([0 if s in ENDS else FAR for s in STATES]))
START = np.array([0, FAR, FAR, FAR])


def kept(state: int, symbol: int) -> int | None:
    """The state after a row that keeps its role, if it may stand there."""
    role = ROLES[(symbol - 1) // 2]
    return SYSTEM if role == "s" and state == NOTHING else ONWARD[state] if role == INITIAL[state] else None


@cache
def power(symbol: int, b: int) -> np.ndarray:
    """The symbol's matrix to the power of 2 ** b."""
    if b:
        return times(power(symbol, b - 1), power(symbol, b - 1))
    cost = np.full((4, 4), FAR)
    np.fill_diagonal(cost, DELETE)
    if symbol != MUST_GO:
        broken = BROKEN * ((symbol - 1) % 2)
        for s in STATES:
            for to, c in ((ONWARD[s], RETAG + broken), (kept(s, symbol), broken)):
                if to is not None:
                    cost[s, to] = min(cost[s, to], c)
    return times(INSERTS, cost)


def through(symbol: int, n: int, behind: np.ndarray) -> np.ndarray:
    """Costs to go before n rows of the symbol, given those behind them (a vector, or a matrix for all ends)."""
    for b in range(n.bit_length()):
        if n >> b & 1:
            behind = times(power(symbol, b), behind)
    return behind


def runs_of(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(symbol, how many) of rows (at, symbol of the first copy, copies); later copies must go."""
    each = ((s, k) for _, symbol, n in rows for s, k in ((symbol, 1), (MUST_GO, n - 1)) if k)
    return [(s, sum(k for _, k in g)) for s, g in groupby(each, key=lambda x: x[0])]


def transition(rows: list[tuple[int, int, int]]) -> np.ndarray:
    out = INSERTS
    for symbol, n in reversed(runs_of(rows)):
        out = through(symbol, n, out)
    return out


def choose(rows: list[tuple[int, int, int]], state: int, behind: np.ndarray, last: bool) -> tuple[list[tuple[str, str]], int]:
    """((audit, shape) of each row, the state after them): the ASCII-least of the cheapest edits from state on.

    A shape has a sign for each turn that comes out: u and a for inserted ones, = for the row with its own role, U and A for the row as user or assistant.
    """
    runs = runs_of(rows)
    costs = [behind]
    for symbol, n in reversed(runs):
        costs.append(through(symbol, n, costs[-1]))
    steps: list[tuple[int, np.ndarray, np.ndarray]] = []  # of rows that may stay: symbol, costs before and behind
    for (symbol, n), after in zip(runs, costs[-2::-1]):
        if symbol != MUST_GO:
            one, run = power(symbol, 0), [after]
            for _ in range(n):
                run.append(times(one, run[-1]))
            steps += zip([symbol] * n, run[:0:-1], run[-2::-1])
    step, out = iter(steps), []
    for _, symbol, n in rows:
        audit, shape = "", ""
        if symbol != MUST_GO:
            _, now, then = next(step)
            broken = BROKEN * ((symbol - 1) % 2)
            while True:
                left, to, own = now[state], ONWARD[state], kept(state, symbol)
                if DELETE + then[state] == left:
                    audit += "D"
                    break
                if INSERT + now[to] == left:
                    audit, shape, state = audit + "I", shape + INITIAL[state], to
                    continue
                if own is not None and broken + then[own] == left:
                    audit, shape, state = audit + "K", shape + "=", own
                    break
                audit, shape, state = audit + "R", shape + INITIAL[state].upper(), to
                break
            n -= 1
        out.append((audit + "D" * n, shape))
    while last and state not in ENDS:
        out[-1] = (out[-1][0] + "I", out[-1][1] + INITIAL[state])
        state = ONWARD[state]
    return out, state


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with made-up damage by the checksum of 'conv_id:turn' modulo 20; null roles and texts, and null parts of the checksum's text, are one space.

    0 drops the row (no copies), 1 empties its text, 2 takes out full stops, exclamation and question marks, 3 makes two copies, 4 sets the role to user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(id_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part(text_col), ".!?", "")).otherwise(part(text_col))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long")
    return turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(kind == 4, "user").otherwise(part(role_col)).alias("role"), text.alias("text"), copies.alias("copies"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ordered_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, fault, symbol, at): equal rows of one turn are one with n copies; fault and symbol are the first copy's; at numbers all rows in order."""
    rows = written(turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("said", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)))
    # a struct compares a null turn as the least
    first = rows.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("said").alias("s")).agg(F.min(F.struct("turn")).alias("first"))
    new = F.struct("turn") == F.col("first")
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    fault = F.when(end == "", "blank").when(~new, "duplicate").when(~end.isin(".", "!", "?"), "truncated")
    role = F.coalesce(F.nullif(F.instr(F.lit(ROLES[:3]), F.substring("role", 1, 1)) * F.when(F.col("role") == "", 0).otherwise(1), F.lit(0)), F.lit(4)) - 1
    marked = rows.join(first, _same("conv_id", "c") & (F.col("said") == F.col("s")), "left").withColumn("fault", F.when(F.col("n") > 0, fault))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(1 + 2 * role + F.when(F.col("fault") == "truncated", 1).otherwise(0))
    marked = marked.select("conv_id", "turn", "role", "text", "n", "fault", symbol.cast("int").alias("symbol"))
    by = ["conv_id", "turn", "role", F.substring("text", 1, 64)]  # a long text need not be in the sample of the ranges
    ranged = marked.repartitionByRange(*by).sortWithinPartitions(*by, "text")
    placed = written(ranged.withColumns({"part": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    counts = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row per partition
    offsets = np.cumsum([0, *(n for _, n in counts)]).tolist()
    places = placed.sparkSession.createDataFrame([(p, o) for (p, _), o in zip(counts, offsets)], "part int, begin long")
    return placed.join(F.broadcast(places), "part").withColumn("at", F.col("i") + F.col("begin")).drop("part", "i", "begin")


def _mapped(df: DataFrame, more: str, keep: list[str], rows_of) -> DataFrame:
    """For each row's dict, the rows of rows_of behind the columns of keep; none of them holds a text."""
    schema = extended(df.select(*keep), more)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            made = [(k, *r) for k, row in enumerate(part.to_pylist()) for r in rows_of(row)]
            if made:
                at, *columns = zip(*made)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at)) for c in keep), *map(pa.array, columns)], names=schema.names)

    return df.mapInArrow(run, schema)


def scanned(nodes: DataFrame, top: int, bits: int, right: bool) -> DataFrame:
    """(conv_id, at, v) for nodes (conv_id, at, m), at from 0 to top: what the products of all the conversation's nodes behind (right) or before each give. v has the costs and, fifth, whether the node is the outermost."""
    groups = cut(nodes.groupBy("conv_id", F.shiftright("at", bits).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("at", "m"))).alias("kids")))
    matrix = lambda m: np.array(m).reshape(4, 4)

    def product(row: dict):
        out = matrix(row["kids"][0]["m"])
        for k in row["kids"][1:]:
            out = times(out, matrix(k["m"]))
        yield row["parent"], out.ravel().tolist()

    if top >> bits:
        above = scanned(_mapped(groups, "at long, m array<long>", ["conv_id"], product), top >> bits, bits, right).select(F.col("conv_id").alias("c"), F.col("at").alias("p"), "v")
        groups = groups.join(above, _same("conv_id", "c") & (F.col("parent") == F.col("p"))).drop("c", "p")
    else:
        groups = groups.withColumn("v", F.array(*(F.lit(int(x)).cast("long") for x in [*(ACCEPT if right else START), 1])))

    def spread(row: dict):
        *v, outer = row["v"]
        v = np.array(v)
        for k in reversed(row["kids"]) if right else row["kids"]:
            yield k["at"], [*v.tolist(), outer]
            v = times(matrix(k["m"]), v) if right else times(v[None], matrix(k["m"]))[0]
            outer = 0

    return _mapped(groups, "at long, v array<long>", ["conv_id"], spread)


def plan_edits(turns: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """The rows of ordered_rows() with audit and shape, the edits of each as choose() gives them; rows of no copies have none.

    turns: conv_id, turn, role, text, copies. Turns are in order, null first, then by role and text. Rows with a null conversation are one conversation.
    """
    rows = ordered_rows(turns)
    top = (rows.agg(F.max("at")).first()[0] or 0) >> bits
    one = F.when(F.col("n") > 0, F.struct("at", "symbol", "n"))
    inner = F.col("at").bitwiseAND((1 << bits) - 1)
    segments = rows.groupBy("conv_id", F.shiftright("at", bits).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("rows"), ((F.min(inner) == 0) | (F.max(inner) == (1 << bits) - 1)).alias("open"))
    segments = cut(segments.where("size(rows) > 0"))
    tuples = lambda row: [(r["at"], r["symbol"], r["n"]) for r in row["rows"]]
    apart = segments.where("not open").select("conv_id", "block", "rows", F.array(*(F.lit(int(x)).cast("long") for x in [*ACCEPT, 1])).alias("behind"), F.array(*(F.lit(int(x)).cast("long") for x in [*START, 1])).alias("before"))
    # a segment that touches its block's border may go on in the next
    opened = segments.where("open").select("conv_id", "block", "rows")
    matrices = _mapped(opened, "at long, m array<long>", ["conv_id"], lambda row: [(row["block"], transition(tuples(row)).ravel().tolist())])
    named = lambda df, v: df.select(F.col("conv_id").alias("c"), F.col("at").alias("b"), F.col("v").alias(v))
    on = _same("conv_id", "c") & (F.col("block") == F.col("b"))
    with_end = cut(opened.join(named(scanned(matrices, top, bits, True), "behind"), on).drop("c", "b"))

    def exits(row: dict):
        m = np.full((4, 4), FAR)
        for s in STATES:
            if times(transition(tuples(row)), np.array(row["behind"][:4]))[s] < FAR:
                m[s, choose(tuples(row), s, np.array(row["behind"][:4]), bool(row["behind"][4]))[1]] = 0
        yield row["block"], m.ravel().tolist()

    forward = scanned(_mapped(with_end, "at long, m array<long>", ["conv_id"], exits), top, bits, False)
    both = with_end.join(named(forward, "before"), on).drop("c", "b")

    def edits(row: dict):
        own = tuples(row)
        made, _ = choose(own, int(np.argmin(row["before"][:4])), np.array(row["behind"][:4]), bool(row["behind"][4]))
        yield from ((at, a, s) for (at, _, _), (a, s) in zip(own, made))

    made = _mapped(apart.unionByName(both), "at long, audit string, shape string", [], edits)
    return rows.join(made, "at", "left")


def repaired_turns(edits: DataFrame) -> DataFrame:
    """(conv_id, at, k, role, text, made): the turns that come out, in order of at and k; made is kept, reroled or inserted."""
    each = edits.where("length(shape) > 0").select("conv_id", "at", "role", "text", F.posexplode(F.split("shape", "")).alias("k", "sign")).where("sign <> ''")
    sign = F.col("sign")
    role = F.when(sign == "=", F.col("role")).when(F.lower("sign") == "u", "user").otherwise("assistant")
    made = F.when(sign == "=", "kept").when(sign.isin("U", "A"), "reroled").otherwise("inserted")
    return each.select("conv_id", "at", "k", role.alias("role"), F.when(made == "inserted", "").otherwise(F.col("text")).alias("text"), made.alias("made"))


def report(edits: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation of which no row is left has zeros, no audit and the hash of no text. One task reads a conversation in order, holding its audit and no text but the one at hand.
    """
    rows = edits.select("conv_id", "at", F.col("turn").cast("long").alias("turn"), "role", "text", "n", "fault", "audit", "shape").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = extended(rows.select("conv_id"), ", ".join(f"{c} long" for c in numbers) + ", audit string, repaired_sha256 string")
    id_type = rows.limit(0).select("conv_id").toArrow().schema.field(0).type
    role_of = {"u": b"user:", "a": b"assistant:"}

    class Talk:
        def __init__(self, conv_id):
            self.conv_id, self.count, self.audit, self.text, self.any = conv_id, dict.fromkeys(numbers, 0), io.StringIO(), hashlib.sha256(), False
            self.first = self.turn = None
            self.turns, self.before = 0, None

        def add(self, turn, role, text, n, fault, audit, shape) -> None:
            count = self.count
            if turn is not None and turn != self.turn:
                self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            if fault == "blank":
                count["blank"] += n
            else:
                count["duplicate"] += n - (fault != "duplicate")
                count["truncated"] += fault == "truncated"
            count["illegal"] += n - 1 + (self.before is not None and self.before + role[:1] not in ("su", "ua", "au"))
            self.before = role[:1]
            stays = any(s in "=UA" for s in shape)
            count["cost"] += DELETE * audit.count("D") + RETAG * audit.count("R") + INSERT * audit.count("I") + (BROKEN if stays and fault == "truncated" else 0)
            self.audit.write(audit)
            for sign in shape:
                if self.any:
                    self.text.update(b"\n")
                self.any = True
                self.text.update(f"{role}:{text}".encode() if sign == "=" else role_of[sign.lower()])
                if sign in "UA":
                    self.text.update(text.encode())

        def row(self) -> tuple:
            if self.first is not None:
                self.count["gaps"] = self.turn - self.first + 1 - self.turns
            return (self.conv_id, *self.count.values(), self.audit.getvalue(), self.text.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(done: list[Talk]) -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * len(numbers), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(t.row() for t in done)), kinds)], names=["conv_id", *numbers, "audit", "repaired_sha256"])

        talk, done = None, []
        for conv_id, _, *rest in chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches):
            if talk is None or talk.conv_id != conv_id:
                done += [talk] if talk else []
                talk = Talk(conv_id)
                if len(done) >= 5000:
                    yield table(done)
                    done = []
            if rest[3]:
                talk.add(*rest)
        if talk:
            yield table([*done, talk])

    return rows.mapInArrow(run, schema)


def repair(turns: DataFrame) -> DataFrame:
    """report() of plan_edits(). Faults: blank (no character but white space), duplicate (role and text seen earlier), truncated (the last character but white space is not . ! or ?), the first that
    fits. Blank and duplicate rows go; the others are kept, reroled or deleted, and empty turns inserted, as is cheapest; of the cheapest, the audit that is least in ASCII.

    turns has conv_id, turn (a whole number), role, text and copies; null roles and texts are to be replaced before, as damaged() does. Long texts are read whole, repeated rows are duplicates, rows of no copies leave
    their conversation without a trace in it, no rows give no rows.
    """
    return report(plan_edits(turns))
