"""Token counts: prefix dynamic programming over a sentencepiece BPE vocabulary.

The last token of every prefix follows from those of shorter prefixes: it is the one piece that ends there and whose
pair with the last token before it encodes to just these two. So one pass gives the exact token count of every prefix,
and truncation or budget questions need no other encoding. Tokens never span a space after another character, so
texts are cut before spaces, and counts of words are kept between rows, in a table of bounded size.

Counts are those of the library without begin, end or added special tokens; strings of special tokens are ordinary
text. Null texts are empty ones and have no tokens. Null ids and repeated rows are kept, other columns aren't read.
"""

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewise.llm.common import batch_of

SPACE = "▁"
LIMIT = 4096
KEPT_WORDS = 600_000
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
COUNTS_DDL = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Vocabulary:
    """Pieces and scores of a model file, and the token counts of all prefixes of a text."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        #: All ends of pieces, and whether they are pieces themselves.
        self.tails = {p[k:]: p[k:] in self.score for p in self.score for k in range(len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by its merges: best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best = max(((score.get(a + b), -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, a: str, b: str) -> bool:
        """Whether a and b stay two tokens next to each other."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        ok = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return ok

    def extend(self, word: str, last: list[str], count: list[int]) -> None:
        """Last token and token count of each prefix of a text that starts at a cut, from where the lists end."""
        tails, pairs = self.tails, self.pairs
        for end in range(len(last), len(word) + 1):
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                whole = tails.get(piece)
                if whole is None:  # nothing that ends so is a piece: a character without one goes as its bytes
                    start = end - 1
                    cost = len(word[start].encode())
                    break
                if whole:
                    before = last[start]
                    ok = pairs.get((before, piece)) if before else True
                    if ok or ok is None and self.follows(before, piece):
                        cost = 1
                        break
            else:
                start = end - 1
                cost = len(word[start].encode())
            last.append(word[start:end])
            count.append(count[start] + cost)

    def counts(self, word: str) -> list[int]:
        """The token count of each prefix, the empty one first."""
        last, count = [""], [0]
        self.extend(word, last, count)
        return count

    def learn(self, words: set[str]) -> None:
        """Totals of new words; in order, so that each goes on from the prefix it shares with the one before."""
        before, last, count = "", [""], [0]
        for word in sorted(words):
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :]
            self.extend(word, last, count)
            self.words[word] = count[-1]
            before = word

    def totals(self, texts: list[str]) -> list[int]:
        """The token count of each text."""
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        known, cut = self.words, [cuts(t) for t in texts]
        new = {w for words in cut for w in words if w not in known}
        self.learn(new)
        out = [sum(map(known.__getitem__, words)) for words in cut]
        for word in new:
            if len(word) > 64:
                del known[word]
        return out

    def count(self, text: str) -> int:
        return self.totals([text])[0]

    def prefix_counts(self, text: str) -> list[int]:
        """The token count of every prefix of text, from the empty one to all of it."""
        out = [0]
        for k, word in enumerate(cuts(text)):
            base = out[-1]
            # The space that is put before a text isn't one of its characters.
            out += [base + n for n in self.counts(word)[1 + (k == 0) :]]
        return out


def cuts(text: str) -> list[str]:
    """A text with the space that goes before it, cut before each row of spaces."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
        return re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
    return [SPACE + w for w in text.split(" ")]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part["text"].to_pylist()
                n = v.totals(texts)
                columns = {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}
                yield batch_of(COUNTS, {"doc_id": part["doc_id"]} | columns)

    return _texts(docs).mapInArrow(run, COUNTS_DDL)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, prefix_counts array<int>): the token count of every prefix, by characters."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("prefix_counts", pa.list_(pa.int32()))])

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for k in range(batch.num_rows):  # a row's table may be large
                text = batch["text"][k].as_py()
                yield batch_of(schema, {"doc_id": batch["doc_id"].slice(k, 1), "text": [text], "prefix_counts": [v.prefix_counts(text)]})

    return _texts(docs).mapInArrow(run, "doc_id long, text string, prefix_counts array<int>")


def within_budget(table: DataFrame, budget: int) -> DataFrame:
    """(doc_id, text, n_chars, n_tokens): each text cut to its longest prefix of at most `budget` tokens.

    Reads prefix counts only; a longer prefix may have fewer tokens, and the longest that fits counts.
    """
    spots = F.filter(F.sequence(F.lit(0), F.size("prefix_counts") - 1), lambda k: F.get("prefix_counts", k) <= budget)
    n = F.array_max(spots)
    return table.select("doc_id", F.substring("text", F.lit(1), n).alias("text"), n.alias("n_chars"), F.get("prefix_counts", n).alias("n_tokens"))
