"""Conversation structure repair with Four-Russians block tables.

A conversation is a row of symbols: what a turn's first role letter is (s, u, a, other), whether its text is truncated, or
that it must go (blank or duplicate). Its repair is the cheapest list of edits after which the role letters are empty or
an optional s and then pairs ua. Four states tell what stands last (nothing, s, u, a); a cost vector holds the cost to go from
each state, at a place between two turns. Inserts bound the differences within a vector, so after taking off the least
entry few vectors exist (`Blocks.vectors`), and what a block of LENGTH symbols does to each of them is precomputed for every block:
the number of the new vector and what is added. A conversation is read from its end to its start, one lookup a block.

Tracing goes the other way, from the first block on: a block is expanded into its single steps with the vector behind it,
and from the state before it the ASCII-least edit that stays cheapest is taken, turn by turn. As the vectors hold all costs to go, each choice
is exact, so of all cheapest edits the ASCII-least string comes out. Expanded blocks are remembered.

Edits: K keep 0, R give it the role user or assistant 3, D delete 4, I insert an empty turn of either role 3; a truncated turn that stays adds 3.

Spark deals turns by ranges of (conversation, turn, ...), so a conversation of any size spreads over tasks, in segments of at
most SEGMENT rows. Conversations that lie inside one range and one segment (nearly all) are repaired there. Of the others
each segment tells what it does to every vector (a table as of a block), the tables are chained backward by conversation, segments
are traced from each state, the states are chained forward, and at last the chosen texts are hashed in order; only this
digest, which has no parallel form, and the string of edits pass through one task a conversation, as a stream.

Defined cases: null roles and texts are one space, a null conv_id or turn is one space in the damage's key; a null conv_id
is a conversation of its own; turns that are equal come in the order of role, then of a digest of the text (equal rows
side by side); roles count by their first character, an empty role has none; a conversation without a row left has zeros,
no edits and the digest of the empty text; repeated rows are duplicates; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import materialize, sized, table

LENGTH, SEGMENT, SEGMENT_CHARS = 4, 4096, 4_000_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\f\r"
#: States: nothing, s, u, a stand last. The state after the role that may be given or inserted, and after keeping a letter.
GIVEN = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (None,) * 4}
LETTERS = ("s", "u", "a", "")
LEGAL = {"su", "ua", "au"}
ROLE = {2: "user", 3: "assistant"}
#: Symbol 0 must be deleted; 1 + 2 x letter + truncated.
SYMBOLS = 1 + 2 * len(LETTERS)


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits that use the turn up, in ASCII order: name, cost, state after."""
    out = [("D", DELETE, state)]
    if symbol:
        letter, more = LETTERS[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
        if KEPT[letter][state] is not None:
            out.append(("K", KEEP + more, KEPT[letter][state]))
        out.append(("R", REROLE + more, GIVEN[state]))
    return out


def inserted(base: list[float]) -> tuple:
    """Costs to go when turns may be inserted first: two, as a third only leads round."""
    return tuple(min(base[s], INSERT + base[GIVEN[s]], 2 * INSERT + base[GIVEN[GIVEN[s]]]) for s in range(4))


def before(symbol: int, after: tuple) -> tuple:
    return inserted([min(cost + after[to] for _, cost, to in edits(symbol, s)) for s in range(4)])


class Blocks:
    """Transitions of normalised cost vectors: next_[n][block, vector] and more[n][block, vector] for blocks of n symbols."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        self.end = inserted([0, np.inf, np.inf, 0])
        self.vectors, number = [self.end], {self.end: 0}
        one_next, one_more = [], []
        for vector in self.vectors:  # grows while it is read
            out = []
            for symbol in range(SYMBOLS):
                new = before(symbol, vector)
                least = min(new)
                new = tuple(x - least for x in new)
                if new not in number:
                    number[new] = len(self.vectors)
                    self.vectors.append(new)
                out.append((number[new], least))
            one_next.append([x[0] for x in out]), one_more.append([x[1] for x in out])
        self.next_ = [np.arange(len(self.vectors))[None], np.array(one_next, "i8").T]
        self.more = [np.zeros((1, len(self.vectors)), "i8"), np.array(one_more, "i8").T]
        for n in range(2, length + 1):
            rest = self.next_[n - 1]
            self.next_.append(self.next_[1][:, rest].reshape(-1, len(self.vectors)))
            self.more.append((self.more[n - 1][None] + self.more[1][:, rest]).reshape(-1, len(self.vectors)))
        self.known: dict[tuple, tuple[str, int]] = {}

    def cut(self, symbols: bytes) -> list[tuple[int, int]]:
        """(number of symbols, number of the block) in order."""
        out = []
        for k in range(0, len(symbols), self.length):
            part, code = symbols[k : k + self.length], 0
            for s in part:
                code = code * SYMBOLS + s
            out.append((len(part), code))
        return out

    def behind(self, blocks: list[tuple[int, int]], vector: int) -> tuple[list[int], int, int]:
        """The vector behind each block, that before the first, and what was added on the way, given the vector behind the last."""
        out, total = [], 0
        for n, code in reversed(blocks):
            out.append(vector)
            total += int(self.more[n][code, vector])
            vector = int(self.next_[n][code, vector])
        return out[::-1], vector, total

    def table(self, blocks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """What the blocks make of every vector: its number and what is added."""
        at, total = np.arange(len(self.vectors)), np.zeros(len(self.vectors), "i8")
        for n, code in reversed(blocks):
            total, at = total + self.more[n][code, at], self.next_[n][code, at]
        return at, total

    def expand(self, n: int, code: int, vector: int, state: int) -> tuple[str, int]:
        """The ASCII-least of the cheapest edits of a block from a state, and the state behind it."""
        key = (n, code, vector, state)
        if key not in self.known:
            symbols = [code // SYMBOLS ** (n - 1 - k) % SYMBOLS for k in range(n)]
            costs, audit = [self.vectors[vector]], ""
            for s in reversed(symbols):
                costs.append(before(s, costs[-1]))
            costs.reverse()
            for k, symbol in enumerate(symbols):
                while True:
                    left = costs[k][state]
                    fits = [(name, to, 1) for name, cost, to in edits(symbol, state) if cost + costs[k + 1][to] == left]
                    if INSERT + costs[k][GIVEN[state]] == left:
                        fits.append(("I", GIVEN[state], 0))
                    name, state, used = min(fits)
                    audit += name
                    if used:
                        break
            self.known[key] = audit, state
        return self.known[key]

    def trace(self, blocks: list[tuple[int, int]], behind: list[int], state: int) -> tuple[str, int]:
        out = []
        for (n, code), vector in zip(blocks, behind):
            audit, state = self.expand(n, code, vector, state)
            out.append(audit)
        return "".join(out), state

    def closing(self, state: int) -> str:
        """Inserts behind the last turn."""
        out = ""
        while self.end[state]:
            out, state = out + "I", GIVEN[state]
        return out


def apply(audit: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], int]:
    """The lines role:text that the edits leave, and the state behind them."""
    out, k = [], 0
    for name in audit:
        if name != "D":
            to = KEPT[letter(roles[k])][state] if name == "K" else GIVEN[state]
            role = roles[k] if name == "K" else ROLE[to]
            out.append(f"{role}:{'' if name == 'I' else texts[k]}")
            state = to
        k += name != "I"
    return out, state


def letter(role: str) -> str:
    return role[:1] if role[:1] in LETTERS else ""


def damaged(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with the test's damage: the rows after it; a dropped one stays with `gone`, so that its conversation is not lost."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    out = rows.select("conv_id", "turn", named("role").alias("role"), named("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy"))


def marked(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, gone) with `same` (a digest of conversation, role and text), `id`, and `fault`: blank, duplicate, truncated or null."""
    same = F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), F.lit("\0"), F.length("role").cast("string"), F.lit("\0"), "role", "text")))
    rows = rows.select("conv_id", "turn", "role", "text", "gone", same.alias("same"), F.monotonically_increasing_id().alias("id"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id")
    # the first row of each text that occurs more than once; partial aggregation keeps one row of a hot text a task
    firsts = rows.filter(~F.col("gone")).groupBy("same").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").select("same", "first")
    rest = F.rtrim("text", F.lit(SPACE))
    fault = F.when(rest == "", "blank").when(place > F.col("first"), "duplicate").when(~F.substring(rest, -1, 1).isin(".", "!", "?"), "truncated")
    return rows.join(sized(firsts), "same", "left").withColumn("fault", fault).drop("first")


#: What a segment tells of its conversation.
FACTS = "rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, turns long"
DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = f"no long, {FACTS}, symbols binary, roles array<string>, texts array<string>, next array<int>, more array<long>"


class Facts:
    """Counts of a stretch of turns, which add up from stretch to stretch in order."""

    def __init__(self) -> None:
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.first_turn = self.last_turn = None

    def add(self, other: dict) -> None:
        if not other["rows"]:
            return
        for name in ("rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + other[name])
        if self.first is None:
            self.first = other["first"]
        else:
            self.illegal += self.last + other["first"] not in LEGAL
        self.last = other["last"]
        if other["first_turn"] is not None:
            self.turns -= self.last_turn == other["first_turn"]
            self.first_turn = other["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = other["last_turn"]

    def result(self, cost: int, audit: str, digest: str) -> tuple:
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


def facts_of(turns: list, roles: list[str], faults: list) -> dict:
    letters, known = [r[:1] for r in roles], [t for t in turns if t is not None]
    return {
        "rows": len(roles), "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(letters, letters[1:])), "first": letters[0] if roles else None, "last": letters[-1] if roles else None,
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": sum(a != b for a, b in zip(known, [None, *known])),
    }


def symbols_of(roles: list[str], faults: list) -> bytes:
    return bytes([0 if f in ("blank", "duplicate") else 1 + 2 * LETTERS.index(letter(r)) + (f == "truncated") for r, f in zip(roles, faults)])


def repair(turns: list, roles: list[str], texts: list[str], faults: list, blocks: Blocks) -> tuple:
    """The columns of DONE of one conversation."""
    facts = Facts()
    facts.add(facts_of(turns, roles, faults))
    if not roles:
        return facts.result(0, "", hashlib.sha256(b"").hexdigest())
    cut = blocks.cut(symbols_of(roles, faults))
    behind, vector, total = blocks.behind(cut, 0)
    audit, state = blocks.trace(cut, behind, 0)
    audit += blocks.closing(state)
    lines, _ = apply(audit, 0, roles, texts)
    return facts.result(int(total + blocks.vectors[vector][0]), audit, hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest())


def arrow(schema: StructType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, `done` (columns of DONE; null for a segment that is a part) and `part` (columns of OPEN), of rows sorted within ranges."""
    conv = rows.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", conv), StructField("done", StructType.fromDDL(DONE)), StructField("part", StructType.fromDDL(OPEN))])
    done_names, part_names = ([f.name for f in schema[k].dataType] for k in (1, 2))
    most_rows, most_chars = SEGMENT, SEGMENT_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, task = Blocks(), TaskContext.get().partitionId()
        out: list[tuple] = []
        held, size, conv, begun, number, chars = ([], [], [], []), 0, None, 0, 0, 0

        def close(whole: bool) -> None:
            nonlocal held, number
            if whole:
                out.append((conv, dict(zip(done_names, repair(*held, blocks))), None))
            else:
                turns, roles, texts, faults = held
                symbols = symbols_of(roles, faults)
                at, more = blocks.table(blocks.cut(symbols))
                part = {"no": (task << 33) + number, "symbols": symbols, "roles": roles, "texts": texts, "next": at, "more": more, **facts_of(turns, roles, faults)}
                out.append((conv, None, {n: part[n] for n in part_names}))
                number += 1
            held = ([], [], [], [])

        for batch in batches:
            for c, turn, role, text, gone, fault in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                if not begun or c != conv:
                    if begun:
                        close(begun == 2 and not size)
                    # the first conversation of a range may have begun in the one before
                    conv, begun, size, chars = c, begun and 2 or 1, 0, 0
                elif len(held[0]) >= most_rows or chars >= most_chars:
                    close(False)
                    size, chars = size + 1, 0
                if not gone:
                    for to, value in zip(held, (turn, role, text, fault)):
                        to.append(value)
                    chars += len(text)
            yield arrow(schema, out)
            out.clear()
        if begun:
            close(False)
        yield arrow(schema, out)

    return rows.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(run, schema)


def chained(parts: DataFrame) -> DataFrame:
    """(no, behind, cost) of parts(conv_id, no, next, more): the vector behind each segment, and the cost of its conversation."""
    schema = StructType.fromDDL("no long, behind int, cost long")

    def run(rows: pa.Table) -> pa.Table:
        found = sorted(zip(*[rows.column(n).to_pylist() for n in ("no", "next", "more")]), reverse=True)
        blocks, vector, total, out = Blocks(1), 0, 0, []
        for no, at, more in found:
            out.append((no, vector))
            total, vector = total + more[vector], at[vector]
        cost = int(total + blocks.vectors[vector][0])
        return pa.Table.from_batches([arrow(schema, [(*o, cost) for o in out])])

    return parts.groupBy("conv_id").applyInArrow(run, schema)


def traced(parts: DataFrame) -> DataFrame:
    """(conv_id, no, audits, ends) of parts(conv_id, no, symbols, behind): edits from each of the four states, and the states they end in."""
    schema = StructType([parts.schema["conv_id"], *StructType.fromDDL("no long, audits array<string>, ends array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks()
        for batch in batches:
            out = []
            for conv, no, symbols, behind in zip(*[c.to_pylist() for c in batch.columns]):
                cut = blocks.cut(symbols)
                found = [blocks.trace(cut, blocks.behind(cut, behind)[0], s) for s in range(4)]
                out.append((conv, no, [a for a, _ in found], [s for _, s in found]))
            yield arrow(schema, out)

    return parts.select("conv_id", "no", "symbols", "behind").mapInArrow(run, schema)


def started(ends: DataFrame) -> DataFrame:
    """(no, state) of ends(conv_id, no, ends): the state before each segment."""
    schema = StructType.fromDDL("no long, state int")

    def run(rows: pa.Table) -> pa.Table:
        state, out = 0, []
        for no, to in sorted(zip(rows.column("no").to_pylist(), rows.column("ends").to_pylist())):
            out.append((no, state))
            state = to[state]
        return pa.Table.from_batches([arrow(schema, out)])

    return ends.groupBy("conv_id").applyInArrow(run, schema)


def joined(parts: DataFrame) -> DataFrame:
    """conv_id and the columns of DONE of parts, whose segments come one after the other."""
    schema = StructType([parts.schema["conv_id"], *StructType.fromDDL(DONE)])
    names = [f.name for f in StructType.fromDDL(FACTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, out, conv, facts = Blocks(1), [], None, None

        def finish() -> None:
            lines, _ = apply(blocks.closing(state), state, [], [])
            hashed(lines)
            out.append((conv, *facts.result(cost, "".join(audits) + blocks.closing(state), digest.hexdigest())))

        def hashed(lines: list[str]) -> None:
            nonlocal any_
            if lines:
                digest.update(("\n" * any_ + "\n".join(lines)).encode("utf-8", "surrogatepass"))
                any_ = True

        for batch in batches:
            for row in batch.to_pylist():
                if facts is None or row["conv_id"] != conv:
                    if facts is not None:
                        finish()
                    conv, facts, state, audits, digest, any_ = row["conv_id"], Facts(), 0, [], hashlib.sha256(), False
                facts.add({n: row[n] for n in names})
                cost = row["cost"] if facts.rows else 0
                lines, state = apply(row["audit"], state, row["roles"], row["texts"])
                hashed(lines)
                audits.append(row["audit"])
            yield arrow(schema, out)
            out.clear()
        if facts is not None:
            finish()
        yield arrow(schema, out)

    near = parts.repartition("conv_id").sortWithinPartitions("conv_id", "no")
    return near.select("conv_id", *names, "roles", "texts", "cost", "audit").mapInArrow(run, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id and the columns of DONE of every conversation of rows(conv_id, turn, role, text, gone), which are repaired as they are."""
    dealt = marked(rows).repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "same", "id")
    ordered = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "same", "id")
    every = materialize(segments(ordered))
    parts = every.filter("done is null").select("conv_id", "part.*")
    behind = chained(parts.select("conv_id", "no", "next", "more"))
    placed = parts.select("conv_id", "no", "symbols").join(behind, "no")
    found = materialize(traced(placed))
    chosen = found.join(started(found.select("conv_id", "no", "ends")), "no").select("no", F.expr("audits[state]").alias("audit"))
    whole = parts.drop("symbols", "next", "more").join(behind.select("no", "cost"), "no").join(chosen, "no")
    return every.filter("done is not null").select("conv_id", "done.*").unionByName(joined(whole))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))
