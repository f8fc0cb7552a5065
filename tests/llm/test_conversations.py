"""Repairs against every sequence of edits of short conversations, and against a plain table of strings on longer ones."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from framewise.llm import conversations as cv

LEGAL = re.compile(r"(s?(ua)+)?")
DROP, CUT, OK = "dt-"


def cheapest(rows):
    """(cost, audit, edited initials) over all edits, rows as (initial, kind), inserts of up to three rows anywhere."""
    fills = ["".join(p) for n in range(4) for p in product("ua", repeat=n)]
    best = None

    def go(k, cost, audit, left):
        nonlocal best
        for new in fills:
            c, a, r = cost + 2 * len(new), audit + "I" * len(new), left + new
            if best is not None and c > best[0] or not re.match(r"^(s?(ua)*u?)$", r):
                continue
            if k == len(rows):
                if LEGAL.fullmatch(r) and (best is None or (c, a) < best[:2]):
                    best = (c, a, r)
                continue
            initial, kind = rows[k]
            go(k + 1, c + 3, a + "D", r)
            if kind != DROP:
                go(k + 1, c + (kind == CUT), a + "K", r + initial)
                for t in "ua":
                    go(k + 1, c + 2 + (kind == CUT), a + "R", r + t)

    go(0, 0, "", "")
    return best


def plain(rows):
    """The same by a table of (cost, audit, initials) for each state of the expression, with whole strings."""
    nxt = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def spread(table):
        for _ in range(3):
            for at, (c, a, r) in list(table.items()):
                for t in "ua":
                    to = nxt.get((at, t))
                    if to and (to not in table or (c + 2, a + "I", r + t) < table[to]):
                        table[to] = (c + 2, a + "I", r + t)
        return table

    table = {"0": (0, "", "")}
    for initial, kind in rows:
        new = {}
        for at, (c, a, r) in spread(table).items():
            ways = [(at, c + 3, a + "D", r)]
            if kind != DROP:
                ways += [(nxt.get((at, initial)), c + (kind == CUT), a + "K", r + initial)]
                ways += [(nxt.get((at, t)), c + 2 + (kind == CUT), a + "R", r + t) for t in "ua"]
            for to, *way in ways:
                if to and (to not in new or tuple(way) < new[to]):
                    new[to] = tuple(way)
        table = new
    return min(v for k, v in spread(table).items() if k in "0a")


def by_stack(rows, cuts=()):
    """Cost, audit and initials by the operator's own parts, cut into pieces."""
    symbols = [("?" if i not in "sua" else i) + k for i, k in rows]
    pieces = [symbols[a:b] for a, b in zip([0, *cuts], [*cuts, len(symbols)])]
    entries = range(len(cv.PARSER.stacks))
    cost, path, tail = cv.walk([[(e, *x) for e in entries for x in cv.exits(p, e)] for p in pieces])
    audit, left = "", ""
    for p, (entry, leave) in zip(pieces, path):
        for symbol, (letters, new) in zip(p, cv.edits(p, entry, leave)):
            audit += letters
            left += new + (symbol[0] if letters[-1] == "K" else "")
    return cost, audit + "I" * len(tail), left + tail


def test_every_short_conversation():
    for n in range(3):
        for rows in product(product("suax", (DROP, CUT, OK)), repeat=n):
            assert by_stack(rows) == cheapest(rows) == plain(rows), rows


def test_longer_conversations_in_pieces():
    rnd = random.Random(3)
    for _ in range(400):
        n = rnd.choice([3, 4, 8, 30, 120])
        rows = rnd.choices(list(product("suax", (DROP, CUT, OK))), rnd.choices([1, 4, 9], k=12), k=n)
        cuts = sorted(rnd.sample(range(n + 1), rnd.randint(0, 3)))
        assert by_stack(rows, cuts) == plain(rows), rows
        if n <= 4:
            assert cheapest(rows) == plain(rows)


def test_grammar():
    p = cv.PARSER
    for n in range(7):
        for word in map("".join, product("sua", repeat=n)):
            tops = {0}
            for t in word:
                tops = {x for at in tops for x in p.after[at][t]}
            assert any(p.accepts[x] for x in tops) == bool(LEGAL.fullmatch(word)), word
    with pytest.raises(ValueError):
        cv.Parser((("C", "P"), ("P", "uPa"), ("P", "ua")))  # stacks grow with the text


def expected(given):
    """The contract, row by row."""
    out = []
    space = lambda v: " " if v is None else str(v)
    for conv in {r[0] for r in given}:
        rows = []
        for _, turn, role, text in (r for r in given if r[0] == conv):
            harm = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
            if harm == 0:
                continue
            text = "" if harm == 1 else re.sub("[.!?]", "", space(text)) if harm == 2 else space(text)
            rows += [(turn, "user" if harm == 4 else space(role), text)] * (2 if harm == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for _, role, text in rows:
            left = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            kinds.append("b" if not left else "d" if (role, text) in seen else "t" if left[-1] not in ".!?" else "-")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, left = plain([(r[:1] if r[:1] in tuple("sua") else "x", DROP if k in "bd" else k) for (_, r, _), k in zip(rows, kinds)])
        lines, k, at = [], 0, 0
        for letter in audit:
            name = {"u": "user", "a": "assistant"}.get(left[at : at + 1])
            if letter != "D":
                at += 1
            if letter == "I":
                lines.append(f"{name}:")
                continue
            _, role, text = rows[k]
            k += 1
            if letter != "D":
                lines.append(f"{role if letter == 'K' else name}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(kinds.count(x) for x in "bdt"), illegal, cost, audit, sha))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def given(seed):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "why", "", " \t", None, "so?\n", "\xa0", "a\nb.", "what is it? ok", "long " * 50 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "User", "agent"]
    rows = []
    for conv in [*range(30), None, -5]:
        n = rnd.choice([1, 2, 5, 40])
        for k in range(n):
            turn = rnd.choice([None, k, k, k, 2 * k, 10**12 + k])
            rows.append((conv, turn, rnd.choices(roles, [9, 9, 2, 1, 1, 1, 1, 1])[0], rnd.choice(texts) if rnd.random() < 0.4 else f"{k} words."))
    return rows + rows[:7]


TYPES = "conv_id long, turn long, role string, text string"


def ordered(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("sizes", [{}, {"piece_rows": 3}, {"piece_chars": 30}])
def test_repair(spark, sizes):
    rows = given(5)
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TYPES + ", piece string, spot int, conv int").repartition(5)
    assert ordered(cv.repair(table, **sizes)) == expected(rows)


def test_one_long_conversation(spark):
    """A conversation that holds nearly all rows, over several partitions and pieces."""
    rnd = random.Random(1)
    rows = [(1, rnd.choice([None, k // 3]), rnd.choice(["user", "assistant"]), rnd.choice(["same.", f"{k}.", "cut"])) for k in range(900)] + given(2)[:9]
    got = ordered(cv.repair(spark.createDataFrame(rows, TYPES), piece_rows=50))
    assert got == expected(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "cut"), (1, 2, "user", " "), (2, 0, "system", "S."), (2, 1, "user", "U.")]
    got = cv.repaired(spark.createDataFrame(rows, TYPES)).orderBy("conv_id", "piece", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in got] == [
        (1, "I", "user", ""), (1, "K", "assistant", "Hi."), (1, "D", None, None), (1, "D", None, None),
        (2, "K", "system", "S."), (2, "K", "user", "U."), (2, "I", "assistant", ""),
    ]


def test_empty(spark):
    assert cv.repair(spark.createDataFrame([], TYPES)).collect() == []
    lost = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Gone.")]
    assert ordered(cv.repair(spark.createDataFrame(rows, TYPES))) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
