"""Repeated-passage removal by sparse suffix arrays.

Only suffixes at content-selected minimiser positions are retained (see
passages.py). Suffixes of the same anchor are sorted by the words to the right,
neighbours compared for their longest common prefix; the words to the left are
sorted and compared alike. Two suffixes repeat a window that starts j words left
of the anchor exactly if they lie in one stretch of the right order with common
prefixes of at least length - j, and in one stretch of the left order with at
least j: matches are extended to both sides for all neighbours at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkvane.llm import passages
from sparkvane.llm._text import U64, Words, utf8


def stretches(m: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a word matrix within groups, and each row's longest
    common prefix with its predecessor (-1 at the start of a group)."""
    keys = np.ascontiguousarray(np.concatenate([group.astype(">u8")[:, None], m.astype(">u8")], axis=1))
    order = np.argsort(keys.view(f"V{keys.shape[1] * 8}").ravel(), kind="stable")
    same = m[order[1:]] == m[order[:-1]]
    lcp = np.full(len(m), -1)
    lcp[1:] = np.where(same.all(axis=1), m.shape[1], same.argmin(axis=1)) if m.shape[1] else 0
    lcp[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, lcp


def kernel(groups: list[list[tuple]], length: int) -> list[np.ndarray]:
    """The smallest owner of each window of each class (sh, owner, n, off, words)
    among the classes of its group."""
    flat = [c for g in groups for c in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    owner, n, off = (np.array([c[i] for c in flat], np.int64) for i in (1, 2, 3))
    buf, offs = utf8(pa.array([c[4] for c in flat], pa.large_string()))
    w = Words(buf, offs)
    h = np.append(w.h, U64(0))
    far = int(off.max())  # words to the left that any window reaches
    k = np.arange(length)
    at = (w.at[:-1] + off)[:, None]
    i = at + k
    right = np.where(i < w.at[1:][:, None], h[np.minimum(i, len(h) - 1)], U64(0))
    i = at - 1 - np.arange(far)
    left = np.where(i >= w.at[:-1][:, None], h[np.maximum(i, 0)], U64(0)) if far else np.zeros((len(flat), 0), U64)
    r_order, r_lcp = stretches(right, group)
    l_order, l_lcp = stretches(left, group)
    begin = np.cumsum(n) - n
    least = np.repeat(owner, n)
    rid, lid = np.empty(len(flat), np.int64), np.empty(len(flat), np.int64)
    for j in range(far + 1):
        live = np.flatnonzero((off - n + 1 <= j) & (j <= off))
        if len(live) < 2:
            continue
        rid[r_order] = np.cumsum(r_lcp < length - j)
        lid[l_order] = np.cumsum(l_lcp < j)
        key = rid[live] * (len(flat) + 1) + lid[live]
        order = np.lexsort((owner[live], key))
        ks, own = key[order], owner[live][order]
        new = np.ones(len(ks), bool)
        new[1:] = ks[1:] != ks[:-1]
        who = live[order]
        least[begin[who] + off[who] - j] = own[np.flatnonzero(new)][np.cumsum(new) - 1]
    return np.split(least, begin[1:])


def dedup(docs: DataFrame, length: int = passages.LENGTH, gram: int = passages.GRAM, spacing: str = "original", heavy: int = passages.HEAVY) -> DataFrame:
    """docs with repeated passages cut; see passages.remove for columns and cases."""
    return passages.remove(docs, kernel, length, gram, spacing, heavy)
