"""Substring dedup by suffix automata of reference shards.

The corpus is its own reference. A shard is a bounded number of passages, all that
share the shard's anchors (see passages.py). Its suffix automaton carries in each
state the smallest doc_id whose passage holds the state's strings. The passages of
the documents are streamed through it for their matching statistics; wherever the
match reaches the length threshold, the state of exactly that length tells who
holds the window first. Spans of a smaller owner's windows are removed.

Shards are not sent to all tasks: the reference grows with the corpus, so that
would cost its square, and no size bound could be proven. A shard goes to the one
task whose passages can match it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sparkvane.llm import passages


#: Words of a reference shard; a group of more words is a shard of its own.
SHARD = 50_000
NOBODY = 2**63 - 1


class SuffixAutomaton:
    """Generalised suffix automaton over any hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.first = [NOBODY]

    def add(self, symbols) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for c in symbols:
            q = nxt[last].get(c)
            if q is not None:  # the string is there: only its end may need a state of its own
                last = q if size[q] == size[last] + 1 else self._clone(last, c, q)
                continue
            cur = len(size)
            size.append(size[last] + 1)
            nxt.append({})
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        new = len(size)
        size.append(size[p] + 1)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def own(self, symbols, owner: int) -> None:
        """Add a string whose prefixes, and so all its substrings, `owner` holds."""
        self.add(symbols)
        first, nxt, s = self.first, self.next, 0
        first.extend([NOBODY] * (len(self.size) - len(first)))
        for c in symbols:
            s = nxt[s][c]
            if owner < first[s]:
                first[s] = owner

    def settle(self) -> None:
        """Carry owners up the suffix links: a state's strings occur wherever those of the states below do."""
        first, link = self.first, self.link
        first.extend([NOBODY] * (len(self.size) - len(first)))
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p = link[s]
            if first[s] < first[p]:
                first[p] = first[s]

    def owners(self, symbols, length: int) -> list[int]:
        """For every window of `length` symbols, the smallest owner of it (NOBODY if the reference has none)."""
        nxt, link, size, first = self.next, self.link, self.size, self.first
        s = n = 0
        out = []
        for c in symbols:
            t = nxt[s].get(c)
            while t is None and s:
                s = link[s]
                n = size[s]
                t = nxt[s].get(c)
            if t is None:
                n = 0
            else:
                s, n = t, n + 1
            if n >= length:
                n = length
                while size[link[s]] >= length:
                    s = link[s]
                out.append(first[s])
            else:
                out.append(NOBODY)
        return out[length - 1 :]


def kernel(groups: list[list[tuple]], length: int) -> list[np.ndarray]:
    """The smallest owner of each window of each class (sh, owner, n, off, words)
    among the classes of its group; groups make up shards of some SHARD words."""
    out: list[np.ndarray] = []
    shard: list[tuple[int, int, list[str]]] = []
    size = 0

    def stream() -> None:
        sam = SuffixAutomaton()
        for owner, _, words in shard:
            sam.own(words, owner)
        sam.settle()
        out.extend(np.array(sam.owners(words, length)[:n], np.int64) for _, n, words in shard)
        shard.clear()

    for group in groups:
        for c in group:
            shard.append((c[1], c[2], c[4].split(" ")))
            size += len(shard[-1][2])
        if size >= SHARD:
            stream()
            size = 0
    stream()
    return out


def dedup(docs: DataFrame, length: int = passages.LENGTH, gram: int = passages.GRAM, spacing: str = "single", heavy: int = passages.HEAVY) -> DataFrame:
    """docs with repeated passages cut; see passages.remove for columns and cases."""
    return passages.remove(docs, kernel, length, gram, spacing, heavy)
