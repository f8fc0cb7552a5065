"""Plain single-machine versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeated_units(texts, width, equal=tuple):
    """For each row of units, which are covered by a window that starts anywhere else."""
    seen = Counter(equal(t[i : i + width]) for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        until = 0
        for i in range(len(t) - width + 1):
            if seen[equal(t[i : i + width])] > 1:
                for k in range(max(i, until), i + width):
                    gone[k] = True
                until = i + width
        out.append(gone)
    return out


def substrings(docs, width=35):
    """(doc_id, n_words, n_removed, kept) for each (doc_id, text)."""
    words = [WORDS.findall(text or "") for _, text in docs]
    rows = []
    for (doc_id, _), found, gone in zip(docs, words, repeated_units(words, width)):
        rows.append((doc_id, len(found), sum(gone), " ".join(w for w, g in zip(found, gone) if not g)))
    return rows


def suffixes(docs, width=400):
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each (doc_id, text)."""
    raw = [(text or "").encode() for _, text in docs]
    rows = []
    for (doc_id, _), data, gone in zip(docs, raw, repeated_units(raw, width, equal=bytes)):
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        rows.append((doc_id, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return rows


def reachable(n, links):
    """The smallest item that each of n items reaches."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for start in range(n):
        if start in root:
            continue
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += near[x]
    return [root[k] for k in range(n)]


def shingles(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def components(texts):
    sets = [shingles(t) for t in texts]
    return reachable(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if similar(sets[i], sets[j])])
