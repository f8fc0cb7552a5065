"""License scans by conditional compression.

Candidates lie around places of words: for each stem of a licence word in a text, and each place of that stem in a
template, the words that the template would cover there, and on both sides as many more as it may have words missing
or added; line breaks count as spaces. Candidates are compressed with zstandard alone and with their template as a raw
dictionary; templates are ranked by how much smaller the dictionary makes the candidate. The first one in this order
is confirmed whose exact wording is there: the words of candidate and template are aligned, numbers and `STRICT` words
must be the same, and at most `differ` (a tenth) of the template's words missing, and as many added. The span from the
first to the last shared word is the block, and the scan goes on after it, in the same line too.

Where no template is confirmed, the best one of the first stem is given as an unconfirmed block, once for all stems
in it. Every stem of every text is looked at. Null and empty texts have no blocks. Null ids and repeated rows are
kept, other columns aren't read.
"""

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import batch_of
from framewise.llm.notices import NOTICES

STEMS = ("licen", "lizen", "copyright", "warrant", "permission", "redistribut", "public domain", "spdx")
#: Public notices, by the usual short names, and the canonical texts and headers. Each holds a stem.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
} | NOTICES
DIFFER = 0.1
#: Words that tell one licence from another, as numbers do.
STRICT = {"affero", "later", "lesser"}
_STEM = re.compile("|".join(s.replace(" ", r"\W+") for s in STEMS), re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_NUMBER = re.compile(r"\d+(?:\.\d+)*")
BLOCKS = pa.schema(
    [("doc_id", pa.int64()), ("line", pa.int32()), ("n_lines", pa.int32()), ("license", pa.string()), ("plain_size", pa.int32()), ("given_size", pa.int32())]
    + [("n_missing", pa.int32()), ("n_added", pa.int32()), ("confirmed", pa.bool_()), ("block", pa.string())]
)
BLOCKS_DDL = "doc_id long, line int, n_lines int, license string, plain_size int, given_size int, n_missing int, n_added int, confirmed boolean, block string"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Difference:
    missing: tuple[str, ...]
    added: tuple[str, ...]


def aligned(a: list[str], b: list[str]) -> tuple[Difference, int, int]:
    """How the words b differ from a, and where in b the words that they share begin and end."""
    steps = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    shared = [k for k, s in enumerate(steps) if s[0] == "equal"]
    missing = [w for tag, i, j, _, _ in steps if tag != "equal" for w in a[i:j]]
    within = steps[shared[0] : shared[-1] + 1] if shared else []
    added = [w for tag, _, _, i, j in within if tag != "equal" for w in b[i:j]]
    return Difference(tuple(missing), tuple(added)), *((within[0][3], within[-1][4]) if shared else (0, 0))


def differences(template: str, block: str) -> Difference:
    """Words of the template that the block lacks, and words that the block has between those it shares."""
    return aligned(words(template), words(block))[0]


class Words:
    """The words of a text and their places, and (word, stem) for each stem in it."""

    def __init__(self, text: str):
        found = list(_WORD.finditer(text))
        self.text, self.words = text, [m.group().lower() for m in found]
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        self.stems = [(bisect_right(self.starts, m.start()) - 1, m.group().lower().split()[0][:6]) for m in _STEM.finditer(text)]

    def between(self, a: int, b: int) -> str:
        return self.text[self.starts[a] : self.ends[b - 1]]


class Scanner:
    def __init__(self, templates: dict[str, str], differ: float, level: int = 9):
        self.templates = {k: Words(t) for k, t in templates.items()}
        self.bags = {k: Counter(t.words) for k, t in self.templates.items()}
        self.most = {k: differ * len(t.words) for k, t in self.templates.items()}
        self.places: dict[str, list[tuple[str, int]]] = {}
        for k, t in self.templates.items():
            for place, stem in dict.fromkeys(t.stems):
                self.places.setdefault(stem, []).append((k, place))
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False, write_dict_id=False)
        raw = lambda t: zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = {
            k: zstandard.ZstdCompressor(level=level, dict_data=raw(t), write_content_size=False, write_dict_id=False) for k, t in templates.items()
        }

    def sizes(self, name: str, block: str) -> tuple[int, int]:
        raw = block.encode()
        return len(self.plain.compress(raw)), len(self.given[name].compress(raw))

    def candidates(self, t: Words, at: int, stem: str, done: int):
        """(template, first, end) around a stem, not before the word `done`."""
        for name, place in self.places.get(stem, ()):
            n, more = len(self.templates[name].words), int(self.most[name])
            yield name, max(done, at - place - more), min(len(t.words), at - place + n + more)

    def may_be(self, name: str, found: list[str]) -> bool:
        """Whether enough of the template's words are there, in any order."""
        have, bag = Counter(found), self.bags[name]
        return sum(min(n, have[w]) for w, n in bag.items()) >= len(self.templates[name].words) - self.most[name]

    def ranked(self, t: Words, found) -> list[tuple[str, int, int]]:
        """Largest size reduction first. Of equal ones: the larger share of the block, then the longer template."""

        def rank(c):
            plain, given = self.sizes(c[0], t.between(c[1], c[2]))
            return plain - given, (plain - given) / plain, len(self.templates[c[0]].words)

        return sorted(found, key=rank, reverse=True)

    def row(self, t: Words, name: str, a: int, b: int, d: Difference, ok: bool) -> tuple:
        text = t.between(a, b)
        line = t.text.count("\n", 0, t.starts[a])
        return line, text.count("\n") + 1, name, *self.sizes(name, text), len(d.missing), len(d.added), ok, text

    def confirmed(self, t: Words, name: str, a: int, b: int, at: int) -> tuple | None:
        """(first, end, difference) if the template's wording is there and holds the stem at `at`."""
        own, most = self.templates[name].words, self.most[name]
        for first in dict.fromkeys((a, min(a + int(most), at))):
            d, i, j = aligned(own, t.words[first:b])
            odd = any(_NUMBER.search(w) or w in STRICT for w in (*d.missing, *d.added))
            if not odd and len(d.missing) <= most and len(d.added) <= most and first + i <= at < first + j:
                return first + i, first + j, d
        return None

    def scan(self, text: str):
        low = text.lower()
        if not any(s.split()[0] in low for s in STEMS):
            return
        t, done, told, out = Words(text), 0, 0, []
        for at, stem in t.stems:
            if at < done:
                continue
            found = dict.fromkeys(c for c in self.candidates(t, at, stem, done) if c[1] <= at < c[2])
            for name, a, b in self.ranked(t, [c for c in found if self.may_be(c[0], t.words[c[1] : c[2]])]):
                if span := self.confirmed(t, name, a, b, at):
                    while out and not out[-1][2] and out[-1][0] >= span[0]:
                        out.pop()
                    out.append((at, self.row(t, name, *span, True), True))
                    done = told = span[1]
                    break
            else:
                if at >= told:
                    every = found or {(k, at, min(len(t.words), at + len(x.words))): None for k, x in self.templates.items()}
                    name, a, b = self.ranked(t, every)[0]
                    out.append((at, self.row(t, name, a, b, aligned(self.templates[name].words, t.words[a:b])[0], False), False))
                    told = b
        yield from (r for _, r, _ in out)


@cache
def scanner(templates: tuple, differ: float) -> Scanner:
    return Scanner(dict(templates), differ)


def license_blocks(docs: DataFrame, templates: dict[str, str] | None = None, differ: float = DIFFER) -> DataFrame:
    """One row per candidate block: its place, its best template, sizes, wording differences, confirmed or not."""
    templates = templates or TEMPLATES
    if missing := [k for k, t in templates.items() if not _STEM.search(t)]:
        raise ValueError(f"templates without a licence word: {missing}")
    given = tuple(templates.items())

    def run(batches):
        s = scanner(given, differ)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                rows += ((doc_id, *found) for found in s.scan(text))
                if len(rows) > 5000:
                    yield batch_of(BLOCKS, dict(zip(BLOCKS.names, zip(*rows))))
                    rows = []
            if rows:
                yield batch_of(BLOCKS, dict(zip(BLOCKS.names, zip(*rows))))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, BLOCKS_DDL)
