"""Conversation structure repair: generalised LR over the role grammar, with weighted edits.

The order of roles must be `(s?(ua)+)?` by their initials. A graph-structured stack holds all parses of the edited rows so far;
stacks share their lower nodes, and equal tops are merged by the least (cost, audit). The audit is the string of the edits'
initials: Keep, Rerole, Delete, Insert. Audits of one row are compared by rank: each is the audit of a top one row before plus a few
letters, and no two are one another's beginning.

What a stretch of rows does to each possible top is a small table, so long conversations are cut into pieces of a bounded size;
a walk over the tables of a conversation's pieces picks where each piece is entered and left, and the pieces are then
repaired one by one. Only the digest of a conversation of several pieces passes through one task, as a stream.

Rows are taken by turn, nulls first, then by role, then by text (both by their first 64 characters, then by a hash); equal rows
are alike. Null conversation ids are one conversation; other columns aren't read, so their names can't clash. A
conversation that has lost all its rows has zeros, an empty audit and no repaired rows.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import NULL_ID, stored, whole_groups

#: Left sides and right sides; the first left side is the start.
GRAMMAR = (("C", ""), ("C", "sT"), ("C", "T"), ("T", "TP"), ("T", "P"), ("P", "ua"))
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
PIECE_ROWS = 4096
PIECE_CHARS = 1 << 20
BLANK = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}




class Node:
    """A stack: a state on top of another stack. Equal stacks are one object."""

    def __init__(self, state: int, below: "Node | None"):
        self.state, self.below = state, below


class Parser:
    """The states of the grammar, and all stacks that sequences of terminals can build."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar, self.start = grammar, grammar[0][0]
        self.nodes: dict[tuple[int, int], Node] = {}
        self.states: list[frozenset] = []
        self.jumps: list[dict[str, int]] = []
        left = {a for a, _ in grammar}
        self.terminals = sorted({c for _, right in grammar for c in right} - left)
        self._state(self._closure({(k, 0) for k, (a, _) in enumerate(grammar) if a == self.start}))
        self.stacks = [self._node(0, None)]
        self.number = {self.stacks[0]: 0}
        for node in self.stacks:  # grows while it is read
            for t in self.terminals:
                for after in self._shifted(node, t):
                    if after not in self.number:
                        self.number[after] = len(self.stacks)
                        self.stacks.append(after)
            if len(self.stacks) > 64:
                raise ValueError("the grammar's stacks must be few")
        self.after = [{t: sorted(self.number[x] for x in self._shifted(n, t)) for t in self.terminals} for n in self.stacks]
        self.accepts = [self._accepts(n) for n in self.stacks]

    def _closure(self, items: set) -> frozenset:
        todo = list(items)
        for k, dot in todo:
            right = self.grammar[k][1]
            for j, (a, _) in enumerate(self.grammar):
                if right[dot : dot + 1] == a and (j, 0) not in items:
                    items.add((j, 0))
                    todo.append((j, 0))
        return frozenset(items)

    def _state(self, items: frozenset) -> int:
        if items in self.states:
            return self.states.index(items)
        at = len(self.states)
        self.states.append(items)
        self.jumps.append({})
        for symbol in sorted({self.grammar[k][1][dot] for k, dot in items if dot < len(self.grammar[k][1])}):
            moved = {(k, dot + 1) for k, dot in items if self.grammar[k][1][dot : dot + 1] == symbol}
            self.jumps[at][symbol] = self._state(self._closure(moved))
        return at

    def _node(self, state: int, below: Node | None) -> Node:
        return self.nodes.setdefault((state, id(below)), Node(state, below))

    def _reduced(self, node: Node) -> Iterator[tuple[str, Node]]:
        """(left side, stack below its right side) of every rule that ends on top."""
        for k, dot in self.states[node.state]:
            left, right = self.grammar[k]
            if dot == len(right):
                below = node
                for _ in right:
                    below = below.below
                yield left, below

    def _shifted(self, node: Node, terminal: str) -> list[Node]:
        """All stacks after a terminal and any reductions that can still take a terminal or be accepted."""
        if terminal not in self.jumps[node.state]:
            return []
        todo = [self._node(self.jumps[node.state][terminal], node)]
        for top in todo:
            for left, below in self._reduced(top):
                if left != self.start:
                    new = self._node(self.jumps[below.state][left], below)
                    if new not in todo:
                        todo.append(new)
        return [n for n in todo if self._accepts(n) or any(s in self.terminals for s in self.jumps[n.state])]

    def _accepts(self, node: Node) -> bool:
        return any(left == self.start and below.below is None for left, below in self._reduced(node))


PARSER = Parser()


@lru_cache(None)
def inserted(top: int) -> tuple[tuple[int, str], ...]:
    """(stack, inserted initials), the fewest for each stack that is reached by inserts."""
    found = {top: ""}
    for at in (todo := [top]):
        for t in sorted(ROLES):
            for after in PARSER.after[at].get(t, ()):
                if after not in found:
                    found[after] = found[at] + t
                    todo.append(after)
    return tuple(found.items())


@lru_cache(None)
def moves(top: int, symbol: str) -> tuple[tuple[int, int, str, str], ...]:
    """(stack, cost, edits, initials put in) of the ways to take one row, with inserts before it.

    Inserts before a deleted row are left to the next row: the audit is less that way.
    """
    initial, kind = symbol
    out = [(top, DELETE, "D", "")]
    if kind != "d":
        for at, new in inserted(top):
            cost, edits = INSERT * len(new) + TRUNCATED * (kind == "t"), "I" * len(new)
            for after in PARSER.after[at].get(initial, ()):
                out.append((after, cost + KEEP, edits + "K", new))
            for t in sorted(ROLES):
                out += [(after, cost + REROLE, edits + "R", new + t) for after in PARSER.after[at].get(t, ())]
    return tuple(out)


Frontier = tuple[tuple[int, int, int], ...]


@lru_cache(100_000)
def step(tops: Frontier, symbol: str) -> tuple[Frontier, int, dict[int, tuple[int, str, str]]]:
    """The tops (stack, cost beyond the least, rank of its audit) after a row, what the least has risen by, and the ways there."""
    best: dict[int, tuple] = {}
    for top, cost, rank in tops:
        for after, more, edits, new in moves(top, symbol):
            way = (cost + more, rank, edits, new, top)
            if after not in best or way < best[after]:
                best[after] = way
    least = min(way[0] for way in best.values())
    rank = {after: k for k, after in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
    new_tops = tuple((after, best[after][0] - least, rank[after]) for after in sorted(best))
    return new_tops, least, {after: (way[4], way[2], way[3]) for after, way in best.items()}


def exits(symbols: list[str], entry: int) -> list[tuple[int, int, int]]:
    """(stack, cost, rank) after rows that are entered with one stack."""
    tops, total = ((entry, 0, 0),), 0
    for s in symbols:
        tops, rise, _ = step(tops, s)
        total += rise
    return [(top, cost + total, rank) for top, cost, rank in tops]


def edits(symbols: list[str], entry: int, leave: int) -> list[tuple[str, str]]:
    """(edits, initials put in) of each row, from one stack to another."""
    tops, ways = ((entry, 0, 0),), []
    for s in symbols:
        tops, _, back = step(tops, s)
        ways.append(back)
    out = []
    for back in reversed(ways):
        leave, letters, new = back[leave]
        out.append((letters, new))
    return out[::-1]


def walk(pieces: list[list[tuple[int, int, int, int]]]) -> tuple[int, list[tuple[int, int]], str]:
    """The least cost, (entry, exit) of each piece, and the initials to insert at the end.

    A piece is its (entry, stack, cost, rank) rows.
    """
    tops, ways = {0: (0, 0)}, []
    for rows in pieces:
        best: dict[int, tuple] = {}
        for entry, after, more, rank in rows:
            if entry in tops:
                way = (tops[entry][0] + more, tops[entry][1], rank, entry)
                if after not in best or way < best[after]:
                    best[after] = way
        order = {after: k for k, after in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
        ways.append({after: way[3] for after, way in best.items()})
        tops = {after: (way[0], order[after]) for after, way in best.items()}
    ends = [(cost + INSERT * len(new), rank, new, top) for top, (cost, rank) in tops.items() for at, new in inserted(top) if PARSER.accepts[at]]
    cost, _, tail, top = min(ends)
    path = []
    for back in reversed(ways):
        path.append((back[top], top))
        top = back[top]
    return cost, path[::-1], tail


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32 of `conv_id:turn`, modulo 20; null values are read as one space.

    0 drops the row, 1 empties the text, 2 takes its sentence ends away, 3 repeats the row, 4 makes it the user's.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(conversations[name].cast("string"), F.lit(" "))

    harm = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].cast("long").alias("turn"),
        F.when(harm == 4, "user").otherwise(spaced("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text")).alias("text"),
        harm.alias("harm"),
    )
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.where("harm <> 0").withColumn("copy", copies).select("conv_id", "turn", "role", "text")


_LONGS, _STRINGS = pa.list_(pa.int64()), pa.list_(pa.string())
_PIECES = pa.schema(
    [("conv", pa.int64()), ("piece", pa.int64()), ("opens", pa.bool_()), ("turns", _LONGS), ("roles", _STRINGS), ("texts", _STRINGS)]
    + [("initials", _STRINGS), ("faults", pa.string()), ("prints", pa.list_(pa.binary()))]
)
_PIECES_DDL = (
    "conv long, piece long, opens boolean, turns array<long>, roles array<string>, texts array<string>, initials array<string>, "
    "faults string, prints array<binary>"
)


def fault(text: str) -> str:
    left = text.rstrip(BLANK)
    return "b" if not left else "-" if left[-1] in ".!?" else "t"


def _pieces(rows: DataFrame, piece_rows: int, piece_chars: int) -> DataFrame:
    """Conversations in order, cut into pieces of a bounded size; pieces of a conversation have ascending numbers."""
    conv = F.coalesce("conv_id", F.lit(NULL_ID)).alias("conv")
    keyed = rows.select(conv, "turn", "role", "text", F.monotonically_increasing_id().alias("spot"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.left("role", F.lit(64)), F.left("text", F.lit(64)), F.xxhash64("role", "text"), F.col("spot")]

    def run(batches):
        no, last = TaskContext.get().partitionId() << 33, None
        held, size = [], 0
        opens = False  # the first rows of a partition may go on from the one before

        def cut(rows):
            turns, roles, texts = (list(c) for c in zip(*rows))
            prints = [hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for r, t in zip(roles, texts)]
            row = (last, no, opens, turns, roles, texts, [r[:1] for r in roles], "".join(map(fault, texts)), prints)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _PIECES)], schema=_PIECES)

        for batch in batches:
            for own, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "turn", "role", "text"))):
                if held and (own != last or len(held) >= piece_rows or size >= piece_chars):
                    yield cut(held)
                    held, size, no, opens = [], 0, no + 1, own != last
                last = own
                held.append((turn, role, text))
                size += len(text)
        if held:
            yield cut(held)

    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")
    return stored(dealt.mapInArrow(run, _PIECES_DDL))


_EXIT = pa.list_(pa.struct([("entry", pa.int32()), ("top", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32())]))
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
_TABLES = pa.schema(
    [("conv", pa.int64()), ("piece", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("first", pa.string()), ("last", pa.string())]
    + [("low", pa.int64()), ("high", pa.int64()), ("exits", _EXIT), ("symbols", pa.string())]
)
_TABLES_DDL = (
    "conv long, piece long, blank long, duplicate long, truncated long, illegal long, turns long, first string, last string, "
    "low long, high long, exits array<struct<entry:int,top:int,cost:long,rank:int>>, symbols string"
)


def _tables(pieces: DataFrame) -> DataFrame:
    """For each piece, its counts, and what its rows cost from each stack to each other. `symbols` has two characters a row."""
    places = pieces.select("conv", "piece", F.posexplode("prints").alias("k", "print"))
    first = places.groupBy("conv", "print").agg(F.min(F.struct("piece", "k")).alias("at")).select("at.*")
    new = first.groupBy("piece").agg(F.collect_list("k").alias("new"))
    marks = pieces.select("conv", "piece", "opens", "turns", "initials", "faults").join(new, "piece", "left")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                new, symbols, count = set(r["new"] or ()), [], dict.fromkeys("bdt-", 0)
                for k, (initial, kind) in enumerate(zip(r["initials"], r["faults"])):
                    kind = kind if kind == "b" or k in new else "d"
                    count[kind] += 1
                    symbols.append((initial if initial in PARSER.terminals else "?") + ("d" if kind == "b" else kind))
                entries = [0] if r["opens"] else range(len(PARSER.stacks))
                table = [(e, *x) for e in entries for x in exits(symbols, e)]
                known = [t for t in r["turns"] if t is not None]
                pairs = sum(a + b not in LEGAL for a, b in zip(r["initials"], r["initials"][1:]))
                low, high = (known[0], known[-1]) if known else (None, None)
                counts = (count["b"], count["d"], count["t"], pairs, len(set(known)))
                table = [dict(zip(("entry", "top", "cost", "rank"), x)) for x in table]
                out.append((r["conv"], r["piece"], *counts, r["initials"][0], r["initials"][-1], low, high, table, "".join(symbols)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TABLES)], schema=_TABLES)

    return stored(marks.mapInArrow(run, _TABLES_DDL))


_PLANS = pa.schema(
    [("conv", pa.int64()), ("piece", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("tail", pa.string()), ("alone", pa.bool_())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
)
_PLANS_DDL = "conv long, piece long, entry int, leave int, tail string, alone boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _plans(tables: DataFrame) -> DataFrame:
    """How each piece is entered and left; a conversation's last piece has its sums and what is inserted at the end.

    One task sees a row per piece of a conversation, never its rows.
    """

    def run(batches):
        for whole in whole_groups(batches, "conv"):
            out, rows, at = [], whole.to_pylist(), 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end]["conv"] == rows[at]["conv"]:
                    end += 1
                own, at = rows[at:end], end
                cost, path, tail = walk([[tuple(x.values()) for x in r["exits"]] for r in own])
                total = {c: sum(r[c] for r in own) for c in _COUNTS}
                known = None
                for a, b in zip(own, own[1:]):
                    total["illegal"] += a["last"] + b["first"] not in LEGAL
                for r in own:
                    total["turns"] -= known is not None and r["low"] == known
                    known = r["high"] if r["high"] is not None else known
                lows = [r["low"] for r in own if r["low"] is not None]
                total["gaps"] = known - lows[0] + 1 - total["turns"] if lows else 0
                sums = (*(total[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), cost)
                for r, (entry, leave) in zip(own, path):
                    last = r is own[-1]
                    out.append((r["conv"], r["piece"], entry, leave, tail if last else None, len(own) == 1, *(sums if last else [None] * 6)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PLANS)], schema=_PLANS)

    dealt = tables.drop("symbols").repartition("conv").sortWithinPartitions("conv", "piece")
    return stored(dealt.mapInArrow(run, _PLANS_DDL))


def _edited(r: dict) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) in order; a deleted row has neither role nor text."""
    symbols = [r["symbols"][k : k + 2] for k in range(0, len(r["symbols"]), 2)]
    for (letters, new), role, text in zip(edits(symbols, r["entry"], r["leave"]), r["roles"], r["texts"]):
        for letter, t in zip(letters, new):
            if letter == "I":
                yield "I", ROLES[t], ""
        match letters[-1]:
            case "D":
                yield "D", None, None
            case "R":
                yield "R", ROLES[new[-1]], text
            case "K":
                yield "K", role, text
    for t in r["tail"] or "":
        yield "I", ROLES[t], ""


def _planned(rows: DataFrame, piece_rows: int, piece_chars: int) -> tuple[DataFrame, DataFrame]:
    """(plans, pieces with their plan)."""
    pieces = _pieces(rows, piece_rows, piece_chars)
    tables = _tables(pieces)
    plans = _plans(tables)
    full = pieces.select("piece", "roles", "texts").join(tables.select("piece", "symbols"), "piece")
    return plans, full.join(plans.select("conv", "piece", "entry", "leave", "tail", "alone"), "piece")


def repaired(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(conv_id, piece, place, edit, role, text) of (conv_id, turn, role, text): every edit, by piece and place."""
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("place", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                conv = None if r["conv"] == NULL_ID else r["conv"]
                out = [(conv, r["piece"], place, *e) for place, e in enumerate(_edited(r))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return _planned(rows, piece_rows, piece_chars)[1].mapInArrow(run, "conv_id long, piece long, place int, edit string, role string, text string")


_DIGESTS = pa.schema([("conv", pa.int64()), ("piece", pa.int64()), ("audit", pa.string()), ("sha", pa.string()), ("n", pa.int64()), ("lines", pa.binary())])
_DIGESTS_DDL = "conv long, piece long, audit string, sha string, n long, lines binary"


def digests(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that has rows."""
    plans, full = _planned(rows, piece_rows, piece_chars)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                done = list(_edited(r))
                lines = [f"{role}:{text}" for edit, role, text in done if edit != "D"]
                data = "\n".join(lines).encode()
                sha = hashlib.sha256(data).hexdigest() if r["alone"] else None
                row = (r["conv"], r["piece"], "".join(e for e, _, _ in done), sha, len(lines), None if r["alone"] else data)
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _DIGESTS)], schema=_DIGESTS)

    def joined(batches):
        """Pieces of each conversation in order, as a stream."""
        conv, audit, sha, n = None, [], None, 0

        def row():
            values = (conv, 0, "".join(audit), sha.hexdigest(), n, None)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _DIGESTS)], schema=_DIGESTS)

        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if sha is None or r["conv"] != conv:
                    if sha is not None:
                        yield row()
                    conv, audit, sha, n = r["conv"], [], hashlib.sha256(), 0
                audit.append(r["audit"])
                if r["n"]:
                    sha.update((b"\n" if n else b"") + r["lines"])
                    n += r["n"]
        if sha is not None:
            yield row()

    parts = stored(full.mapInArrow(run, _DIGESTS_DDL))
    several = parts.where("sha IS NULL").repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(joined, _DIGESTS_DDL)
    whole = parts.where("sha IS NOT NULL").unionByName(several).select("conv", "audit", F.col("sha").alias("repaired_sha256"))
    sums = plans.where("cost IS NOT NULL").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    ids = F.when(F.col("conv") != NULL_ID, F.col("conv")).alias("conv_id")
    return sums.join(whole, "conv").select(ids, *sums.columns[1:], "audit", "repaired_sha256")


def repair(conversations: DataFrame, **sizes) -> DataFrame:
    """`digests` of the damaged rows, with a row for every conversation of the undamaged ones."""
    found = digests(damaged(conversations), **sizes)
    convs = conversations.select(conversations["conv_id"].cast("long").alias("id")).distinct()
    full = convs.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in found.columns[1:7]]
    none = hashlib.sha256(b"").hexdigest()
    return full.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
