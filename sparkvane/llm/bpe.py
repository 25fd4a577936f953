"""Byte-level BPE as a monoid: encode halves, join neighbours.

Token sequences form a monoid under `Bpe.join`. A join re-encodes a window of
tokens around the boundary and grows it until the tokens outside provably
stabilise: a sequence is the BPE encoding of its bytes exactly if each adjacent
pair of tokens (a, b) encodes to itself, encode(bytes(a) + bytes(b)) == [a, b].
Both halves have that property inside, a re-encoded window has it inside, so
only the two seams are left to check. Where a seam fails the window doubles;
at worst it covers both halves. Decoding concatenates bytes up the same tree.

Each match of the split pattern is encoded separately, as the public BPE
library with the same rank file does; whole matches found in the vocabulary are
one token.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvane.llm._store import arrow_map, ship

LEAF_BYTES = 4
#: Windows up to so many bytes are merged by scanning, longer ones by a heap.
SCAN_BYTES = 64
#: Entries of a memo's generation: token pairs and leaves, and whole pieces.
CACHE, PIECES = 60_000, 150_000
DECODE_LEAF = 4096
#: Texts of these characters only (no exotic space, numeral or mark) split alike
#: under the faster engine of the standard library.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ɏ]*\Z")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class _Memo(dict):
    """Bounded memo of two generations: when the young one is full it becomes the
    old one, from which what is still used moves back."""

    def __init__(self, make, most: int = CACHE):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self[key] = self.old[key] if key in self.old else self.make(key)
        return out

    def empty(self) -> None:
        self.clear()
        self.old = {}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.full = regex.compile(pattern)
        quick = pattern.replace(r"\p{L}+", r"[^\W\d_]+").replace(r"\p{N}+", r"\d+").replace(r"[^\s\p{L}\p{N}]+", r"(?:[^\s\w]|_)+")
        self.quick = None if r"\p" in quick else re.compile(quick)
        self.leaves = _Memo(self._short)
        self.pairs = _Memo(self._pair)
        self.words = _Memo(self._piece, PIECES)

    # -- leaves -----------------------------------------------------------
    def _short(self, data: bytes) -> list[int]:
        """Merge the lowest-ranked adjacent pair (leftmost first) until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        far = len(self.bytes_of)
        cost = [get(parts[i] + parts[i + 1], far) for i in range(len(parts) - 1)]
        while cost:
            low = min(cost)
            if low == far:
                break
            i = cost.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del cost[i]
            if i:
                cost[i - 1] = get(parts[i - 1] + parts[i], far)
            if i < len(cost):
                cost[i] = get(parts[i] + parts[i + 1], far)
        return [self.ranks[p] for p in parts]

    def _window(self, data: bytes) -> list[int]:
        """The same result by a heap, for windows that had to grow."""
        if len(data) <= SCAN_BYTES:
            return self._short(data)
        n = len(data)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else -1
            if j < 0 or end[j] != stop or not end[j]:
                continue
            end[i], after[i], k = stop, after[j], after[j]
            end[j] = 0
            if k >= 0:
                before[k] = i
                if (r := self.ranks.get(data[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := self.ranks.get(data[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i >= 0:
            out.append(self.ranks[data[i : end[i]]])
            i = after[i]
        return out

    # -- the monoid -------------------------------------------------------
    def _pair(self, pair: tuple[int, int]) -> list[int] | None:
        """What the bytes of two tokens encode to; None where that is the pair itself."""
        out = self._short(self.bytes_of[pair[0]] + self.bytes_of[pair[1]])
        return None if len(out) == 2 and out[0] == pair[0] and out[1] == pair[1] else out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left or right
        pairs, n, m = self.pairs, len(left), len(right)
        mid = pairs[left[-1], right[0]]
        if mid is None:
            return left + right
        x = y = 1  # tokens of each side in the window, whose encoding is mid
        while True:
            ok_l = x == n or pairs[left[-x - 1], mid[0]] is None
            ok_r = y == m or pairs[mid[-1], right[y]] is None
            if ok_l and ok_r:
                return left[: n - x] + mid + right[y:]
            x, y = min(n, x if ok_l else 2 * x), min(m, y if ok_r else 2 * y)
            mid = self._window(b"".join(map(self.bytes_of.__getitem__, left[n - x :] + right[:y])))

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.leaves[data]
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    # -- texts ------------------------------------------------------------
    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.tree(data)

    def split(self, text: str) -> list[str]:
        return (self.quick if self.quick is not None and _PLAIN.match(text) else self.full).findall(text)

    def _piece(self, w: str) -> bytes:
        return array("i", self.encode_piece(w.encode("utf-8", "surrogatepass"))).tobytes()

    def encode(self, text: str) -> np.ndarray:
        get, own = self.words.__getitem__, self._piece
        return np.frombuffer(b"".join([get(w) if len(w) < 64 else own(w) for w in self.split(text)]), np.int32)

    def decode(self, ids) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def empty(self) -> None:
        for memo in (self.leaves, self.pairs, self.words):
            memo.empty()


_loaded: dict[tuple[str, str], Bpe] = {}


def load(path: str, pattern: str) -> Bpe:
    """One codec per worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`keep` columns and ids array<int> of every whole text; null text: empty
    array. Rows map one to one; other columns are left out, and a kept column
    named `ids` gives way to the operator's own. `path` must name the rank file
    on every worker."""
    ship(docs.sparkSession)
    path, pattern = path or default_vocabulary(), pattern or default_pattern()
    keep = tuple(c for c in keep if c.lower() != "ids")
    src = docs.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            i = 0
            col = b.column(n)
            while i < len(b):
                out, size, j = [], 0, i
                while j < len(b) and size < 8 << 20:
                    out.append(bpe.encode(col[j].as_py() or ""))
                    size, j = size + out[-1].nbytes, j + 1
                at = np.zeros(len(out) + 1, np.int32)
                np.cumsum([len(x) for x in out], out=at[1:])
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(out), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(x.slice(i, j - i) for x in b.columns[:n]), ids], names=schema.names)
                i = j
        bpe.empty()  # the worker may go on with other operators

    return arrow_map(src, run, schema)


def decode(encoded: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`keep` columns and the decoded bytes (binary); null ids: empty. Rows map one
    to one; other columns are left out, and a kept column named `decoded` gives
    way to the operator's own."""
    ship(encoded.sparkSession)
    path, pattern = path or default_vocabulary(), pattern or default_pattern()
    keep = tuple(c for c in keep if c.lower() != "decoded")
    src = encoded.select(*keep, F.col(ids).alias("__ids"))
    schema = T.StructType([*encoded.select(*keep).schema.fields, T.StructField("decoded", T.BinaryType())])
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for b in batches:
            col = b.column(n)
            at = col.offsets.to_numpy()
            flat = col.values.to_numpy(zero_copy_only=False)
            none = col.is_null().to_numpy(zero_copy_only=False)
            out = [b"" if z else bpe.decode(flat[x:y].tolist()) for x, y, z in zip(at[:-1], at[1:], none, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.binary())], names=schema.names)

    return arrow_map(src, run, schema)


def ids_text(ids: str = "ids"):
    """Decimal ids joined by one space."""
    return F.array_join(F.col(ids).cast("array<string>"), " ")
