"""Conversation repair by Knuth's lightest-derivation agenda.

Items are deductions "rows up to i can be read as turns that leave the dialogue in state s", weighted by
(cost, audit): the audit is the string of edit initials so far. Hyperedges join such an item with an edit of the
next rows (keep, rerole, delete) or with an inserted turn: costs add, audits concatenate. On one item two
audits of the same cost never are a prefix of one another (whatever one has in addition costs something), so
joining is monotone, and as each join adds rows or cost it is superior: an item popped first from the agenda,
ordered by (cost, rows, audit), is final. The goal is an item over all rows in an accepting state.

The dialogue's states: nothing said, system, user, assistant; it may end after nothing or an assistant turn.

Scale: rows are sorted by a range exchange on (conversation, turn, ...), so a conversation of any size spreads
over tasks. Tasks cut it into pieces of bounded rows and bytes. A conversation of one piece is solved where it
is; for others every piece becomes one block of weighted items (from each state to each state), and blocks
are joined by the same agenda, some at a time, level by level; the chosen states then go down to the
pieces. Only the joined text of a conversation's pieces passes through one stream, for its digest.

Order of rows: turn (nulls first), role, the text's first 64 characters, its md5. Duplicates are found by a
range exchange on (conversation, role, text), where a row only looks at the one before it.

Input rules: a null role or text is one space, a null conv_id or turn reads as one space in the damage hash and
a null conv_id is a conversation; equal turns and repeated rows all count, in the order above; a role that is
neither system, user nor assistant can't be kept, unless it has the initial of one; conversations without rows
after damage have zeros, an empty audit and the digest of nothing; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
#: States: nothing said, system, user, assistant. Next state by a role's initial; those a dialogue may end in.
START, ACCEPTING = 0, (0, 3)
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = ("su", "ua", "au")
SPOKEN = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1

Block = dict[tuple[int, int], tuple[int, str]]
INSERTED: Block = {(s, MOVES[s, r]): (INSERT, "I") for s in range(4) for r in "ua" if (s, r) in MOVES}


@dataclass(frozen=True)
class Step:
    """What one row allows: its role's initial, whether it must go, whether it is cut off."""
    initial: str
    drop: bool
    cut: bool

    def block(self) -> Block:
        out: Block = {(s, s): (DELETE, "D") for s in range(4)}
        if not self.drop:
            for s in range(4):
                for role in "ua":
                    if (s, role) in MOVES:
                        out[s, MOVES[s, role]] = (REROLE + self.cut, "R")
                if (s, self.initial) in MOVES:
                    out[s, MOVES[s, self.initial]] = (int(self.cut), "K")
        return out


def lightest(blocks: list[Block], start: int, inserts: bool, goal: tuple = ()) -> dict[int, tuple[int, str, list[int]]]:
    """The agenda: end state -> (cost, audit, states after each block) of its lightest derivation from `start`.

    `blocks` are the edits of consecutive rows, or whole pieces; `inserts` adds the inserted turns between them
    (states after blocks are only asked for without). With a `goal` the first item that ends in one of its
    states is the only result: no lighter one can follow.
    """
    last, final, back, out = len(blocks), {}, {}, {}
    agenda = [(0, 0, "", start, None)]
    edges = [{s: [(t, w) for (p, t), w in block.items() if p == s] for s in range(4)} for block in blocks]
    extra = {s: [(t, w) for (p, t), w in INSERTED.items() if p == s] for s in range(4)} if inserts else {}
    while agenda and len(out) < 4:
        cost, at, audit, state, origin = heappop(agenda)
        if (at, state) in final:
            continue
        final[at, state], back[at, state] = (cost, audit), origin
        if at == last and (not goal or state in goal):
            out[state] = (cost, audit)
            if goal:
                break
        for to, (more, edit) in extra.get(state, ()):
            if (at, to) not in final:
                heappush(agenda, (cost + more, at, audit + edit, to, (at, state)))
        if at < last:
            for to, (more, edit) in edges[at][state]:
                if (at + 1, to) not in final:
                    heappush(agenda, (cost + more, at + 1, audit + edit, to, (at, state)))
    return {s: (*weight, _states(back, last, s)) for s, weight in out.items()}


def _states(back: dict, at: int, state: int) -> list[int]:
    states = []
    while before := back[at, state]:
        if before[0] < at:
            states.append(state)
        at, state = before
    return states[::-1]


def best(ends: dict[int, tuple]) -> tuple[int, str, int]:
    """The lightest accepting item: (cost, audit, state)."""
    return min((*ends[s][:2], s) for s in ACCEPTING if s in ends)


def replay(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The (role, text) turns that an audit makes of rows, from a state."""
    out, k = [], 0
    for edit in audit:
        if edit in "RI":  # one spoken role only fits a state that is followed by one
            role = next(r for r in "ua" if (state, r) in MOVES)
            out.append((SPOKEN[role], texts[k] if edit == "R" else ""))
        elif edit == "K":
            role = roles[k][0]
            out.append((roles[k], texts[k]))
        if edit != "D":
            state = MOVES[state, role]
        k += edit != "I"
    return out


def damage(rows: DataFrame) -> DataFrame:
    """Drops, empties, cuts, repeats or renames rows by the checksum of their place; columns conv_id, turn, role, text."""
    space = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    text = F.coalesce("text", space)
    out = rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
                      F.when(fate == 1, "").when(fate == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
                      fate.alias("fate")).where("fate <> 0")
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "role", "text", F.explode(copies).alias("copy")).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """Adds blank, duplicate, truncated (a row's first fault only), prefix and digest (the order of equal turns), salt.

    A row is a duplicate if one with its role and text comes earlier in its conversation. Rows are sorted
    by (conversation, role, text, turn) over all tasks, so only a task's first row has to ask the task before
    it: one key per task goes to the driver.
    """
    rows = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    end = F.rtrim("text", F.lit(BLANKS))
    same = F.md5(F.concat_ws("\n", F.when(F.col("conv_id").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string"))),
                             F.length("role").cast("string"), "role", "text").cast("binary"))
    keyed = rows.select("*", (end == "").alias("blank"),
                        (~F.right(end, F.lit(1)).isin(*STOPS)).alias("cut"), same.alias("same"),
                        F.substring("text", 1, 64).alias("prefix"), F.md5(F.col("text").cast("binary")).alias("digest"),
                        F.monotonically_increasing_id().alias("salt"))
    order = ["same", F.col("turn").asc_nulls_first(), "salt"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(6)
            again = pc.equal(key, pa.concat_arrays([pa.array([before or ""], pa.string()), key.slice(0, len(key) - 1)]))
            head = pa.array([before is None] + [False] * (len(key) - 1))
            before = key[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, again, head, pa.array([part] * len(key), pa.int32())],
                                             [*batch.schema.names, "again", "head", "part"])

    schema = ("conv_id long, turn long, role string, text string, blank boolean, cut boolean, same string, prefix string, "
              "digest string, salt long, again boolean, head boolean, part int")
    marked = store(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(mark, schema), "marked")
    ends = sorted((r["part"], r["first"], r["last"]) for r in marked.groupBy("part").agg(
        F.min("same").alias("first"), F.max("same").alias("last")).collect())  # one row per task
    follow = [b[0] for a, b in zip(ends, ends[1:]) if a[2] == b[1]]
    again = F.col("again") | (F.col("head") & F.col("part").isin(follow))
    return marked.select("conv_id", "turn", "role", "text", "prefix", "digest", "salt", "blank",
                         (~F.col("blank") & again).alias("duplicate"),
                         (~F.col("blank") & ~again & F.col("cut")).alias("truncated"))


_END = [("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("path", pa.list_(pa.int32()))]
_PIECE = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("alone", pa.bool_()),
                    *[(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns")],
                    ("first", pa.string()), ("last", pa.string()), ("ends", pa.list_(pa.struct(_END))),
                    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_ENDS = "array<struct<p:int,q:int,cost:long,audit:string,path:array<int>>>"
_PIECE_SQL = ("conv_id long, part int, piece int, alone boolean, n long, blank long, duplicate long, truncated long, "
              f"illegal long, low long, high long, turns long, first string, last string, ends {_ENDS}, "
              "roles array<string>, texts array<string>")
_TURN = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


class _Piece:
    """Rows of one conversation, closed at a bound."""

    def __init__(self, conv):
        self.conv, self.steps, self.roles, self.texts, self.bytes = conv, [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.initials: list[str] = []

    def add(self, turn, role, text, blank, duplicate, truncated) -> None:
        drop = blank or duplicate
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.initials and self.initials[-1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.initials.append(role[:1])
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.steps.append(Step(role[:1], drop, truncated))
        self.roles.append("" if drop else role)
        self.texts.append("" if drop else text)
        self.bytes += 0 if drop else len(text)

    def row(self, part: int, number: int, alone: bool) -> tuple:
        blocks = [s.block() for s in self.steps]
        ends = [{"p": p, "q": q, "cost": c, "audit": a, "path": []} for p in ((START,) if alone else range(4))
                for q, (c, a, _) in lightest(blocks, p, True, ACCEPTING if alone else ()).items()]
        return (self.conv, part, number, alone, len(self.steps), self.blank, self.duplicate, self.truncated, self.illegal,
                self.low, self.high, self.turns, self.initials[0], self.initials[-1], ends, self.roles, self.texts)


def _cut(max_rows: int, max_bytes: int) -> Callable:
    """Task function: sorted rows -> pieces. Only a conversation strictly inside a task can be alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, held, number, inside = TaskContext.get().partitionId(), [], None, 0, False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                conv = row[0]
                if held is not None and held.conv != conv:
                    out.append(held.row(part, number, inside and number == 0))
                    held, number, inside = None, 0, True
                elif held is not None and (len(held.steps) >= max_rows or held.bytes >= max_bytes):
                    out.append(held.row(part, number, False))
                    held, number = None, number + 1
                if held is None:
                    held = _Piece(conv)
                held.add(*row[1:])
                if len(out) >= 64:
                    yield _batch(out, _PIECE)
                    out = []
        if held is not None:
            out.append(held.row(part, number, False))
        yield _batch(out, _PIECE)

    return run


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("seq", pa.int64()), ("ends", pa.list_(pa.struct(_END)))])
    for batch in batches:
        out = []
        for conv, seq, parts in zip(*(c.to_pylist() for c in batch.columns)):
            blocks = [{(e["p"], e["q"]): (e["cost"], e["audit"]) for e in part["ends"]} for part in parts]
            out.append((conv, seq, [{"p": p, "q": q, "cost": c, "audit": a, "path": path} for p in range(4)
                                    for q, (c, a, path) in lightest(blocks, p, False).items()]))
        yield _batch(out, schema)


def _choose(parts: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """From the blocks (conv, seq, ends) of each conversation: its (conv, cost, audit), and (conv, seq, p, audit) of
    every piece on the lightest way."""
    levels = [parts]
    while not levels[-1].where("seq > 1").isEmpty():
        group = F.floor((F.col("seq") - 1) / fan).cast("long") + 1
        held = levels[-1].groupBy("conv", group.alias("seq")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("seq").alias("at"), "ends"))).alias("parts"))  # `fan` blocks
        levels.append(store(held.mapInArrow(_join_blocks, f"conv string, seq long, ends {_ENDS}"), "blocks"))
    ways = F.filter("ends", lambda e: (e["p"] == START) & e["q"].isin(*ACCEPTING))
    way = F.array_min(F.transform(ways, lambda e: F.struct(e["cost"].alias("cost"), e["audit"].alias("audit"), e["q"].alias("q"))))
    top = store(levels[-1].select("conv", way.alias("w")).select("conv", "w.cost", "w.audit", "w.q"), "top")
    way = top.select("conv", F.lit(1).cast("long").alias("seq"), F.lit(START).alias("p"), "q")
    for k, level in enumerate(reversed(levels)):
        end = F.filter("ends", lambda e: (e["p"] == F.col("p")) & (e["q"] == F.col("q")))[0]
        way = way.join(level, ["conv", "seq"]).select("conv", "seq", "p", end.alias("e"))
        if k < len(levels) - 1:
            states = F.concat(F.array("p"), F.col("e")["path"])
            way = way.select("conv", ((F.col("seq") - 1) * fan).alias("base"), states.alias("states"),
                             F.posexplode(F.col("e")["path"]).alias("at", "q")) \
                .select("conv", (F.col("base") + F.col("at") + 1).alias("seq"), F.col("states")[F.col("at")].alias("p"), "q")
            way = store(way, "ways")
    return top.drop("q"), way.select("conv", "seq", "p", F.col("e")["audit"].alias("audit"))


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("seq", pa.int64()), ("said", _TURN)])
    for batch in batches:
        yield _batch([(conv, seq, [{"role": r, "text": t} for r, t in replay(audit, state, roles, texts)])
                      for conv, seq, state, audit, roles, texts in zip(*(c.to_pylist() for c in batch.columns))], schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows in order of (conv, seq): one digest per conversation."""
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    conv, state, out = None, None, []
    for batch in batches:
        for name, _, text in zip(*(c.to_pylist() for c in batch.columns)):
            if name != conv:
                if conv is not None:
                    out.append((conv, state.hexdigest()))
                conv, state, empty = name, hashlib.sha256(), True
            if text is not None:
                state.update(("" if empty else "\n").encode() + text.encode())
                empty = False
        yield _batch(out, schema)
        out = []
    yield _batch([] if conv is None else [(conv, state.hexdigest())], schema)


@dataclass(frozen=True)
class Repaired:
    """`summary`: one row per conversation that has rows (conv, gaps, blank, duplicate, truncated, illegal, cost,
    audit); `said`: (conv, seq, said array<struct<role, text>>), the repaired turns in order of seq."""
    summary: DataFrame
    said: DataFrame


def repair(rows: DataFrame, max_rows: int = 512, max_bytes: int = 1 << 20, fan: int = 64) -> Repaired:
    """Repairs conversations given as rows (conv_id, turn, role, text); conv is conv_id as text, or `null`."""
    marked = faults(rows)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "prefix", "digest", "salt"]
    ordered = marked.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "role", "text", "blank", "duplicate", "truncated")
    pieces = store(ordered.mapInArrow(_cut(max_rows, max_bytes), _PIECE_SQL).withColumn(
        "conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))), "pieces")

    sums = ["blank", "duplicate", "truncated", "illegal"]
    alone, spread = pieces.where("alone"), pieces.where("NOT alone")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    end = F.col("ends")[0]
    one = alone.select("conv", gaps, *sums, end["cost"].alias("cost"), end["audit"].alias("audit"))

    line = Window.partitionBy("conv").orderBy("part", "piece")
    narrow = store(spread.select(
        "conv", "part", "piece", *sums, "low", "high", "turns", "ends", F.row_number().over(line).cast("long").alias("seq"),
        F.concat(F.lag("last").over(line), "first").alias("pair"),
        F.last("high", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("before")), "lines")
    top, ways = _choose(narrow.select("conv", "seq", "ends"), fan)
    # where pieces meet: a pair of initials more, and a turn that both have counted
    counts = narrow.groupBy("conv").agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(F.col("turns") - F.coalesce(F.col("before") == F.col("low"), F.lit(False)).cast("long")).alias("turns"),
        *[F.sum(c).alias(c) for c in sums[:3]],
        F.sum(F.col("illegal") + F.coalesce(~F.col("pair").isin(*LEGAL), F.lit(False)).cast("long")).alias("illegal"))
    many = counts.join(top, "conv").select("conv", gaps, *sums, "cost", "audit")

    schema = "conv string, seq long, said array<struct<role:string,text:string>>"
    whole = alone.select("conv", F.lit(1).cast("long").alias("seq"), F.lit(START).alias("p"), end["audit"].alias("audit"),
                         "roles", "texts").mapInArrow(_said, schema)
    placed = spread.select("conv", "part", "piece", "roles", "texts").join(
        narrow.select("conv", "part", "piece", "seq"), ["conv", "part", "piece"]).join(ways, ["conv", "seq"])
    pieced = placed.select("conv", "seq", "p", "audit", "roles", "texts").mapInArrow(_said, schema)
    return Repaired(one.unionByName(many), whole.unionByName(pieced))


def repaired_turns(rows: DataFrame, **options) -> DataFrame:
    """(conv_id, seq, position, role, text): the turns of every repaired conversation, in order of (seq, position)."""
    kind = rows.schema["conv_id"].dataType
    return repair(rows, **options).said.select(
        F.when(F.col("conv") != "null", F.col("conv")).cast(kind).alias("conv_id"), "seq",
        F.posexplode("said").alias("position", "turn")).select("conv_id", "seq", "position", "turn.role", "turn.text")


def repair_digest(rows: DataFrame, original: DataFrame, **options) -> DataFrame:
    """One row per conversation of `original`: counts, cost, audit, and the digest of the repaired turns of `rows`."""
    done = repair(rows, **options)
    text = F.when(F.size("said") > 0, F.array_join(F.transform(
        "said", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
    spoken = store(done.said.select("conv", "seq", text.alias("text")), "spoken")
    many = spoken.groupBy("conv").agg(F.max("seq").alias("n")).where("n > 1").select("conv")
    nothing = hashlib.sha256(b"").hexdigest()
    single = spoken.join(many, "conv", "left_anti").select(
        "conv", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("repaired_sha256"))
    several = spoken.join(many, "conv", "left_semi").repartition("conv").sortWithinPartitions("conv", "seq") \
        .select("conv", "seq", "text").mapInArrow(_digests, "conv string, repaired_sha256 string")
    every = original.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    zero = F.lit(0).cast("long")
    return every.join(done.summary, "conv", "left").join(single.unionByName(several), "conv", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
