"""Binary vector files: their bytes, and the formats that read and write them.

bvecs: each record is int32 dim and dim bytes. fbin: int32 rows, int32 dim, then
float32 rows. Ground truth: int32 rows, int32 k, int32 ids, and possibly float32
distances of the same shape. Blocks: int32 rows, int32 columns, payload. See
files.py for how files are dealt to tasks.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

from sparkvane.sources.files import Format, lists, open_input

NO_NEIGHBOR = 0xFFFFFFFF
DEGREE = 64
PAGE = 4096


def bvecs_metadata(path: str) -> tuple[int, int, int]:
    """(dim, record bytes, records); the file size must be a whole number of records."""
    with open_input(path) as f:
        size = f.size()
        if size < 4:
            raise ValueError("bvecs file is too short")
        (dim,) = struct.unpack("<i", f.read(4))
    if dim <= 0 or size % (4 + dim):
        raise ValueError("bvecs size does not match its dimension")
    return dim, 4 + dim, size // (4 + dim)


class Bvecs(Format):
    name, columns = "bvecs", "vec array<float>"

    def _dim(self, f) -> int:
        f.seek(0)
        (dim,) = struct.unpack("<i", f.read(4)) if f.size() >= 4 else (0,)
        if dim <= 0 or f.size() % (4 + dim):
            raise ValueError("bvecs size does not match its dimension")
        return dim

    def count(self, f):
        return f.size() // (4 + self._dim(f))

    def read(self, f, lo, hi):
        dim = self._dim(f)
        f.seek(lo * (4 + dim))
        m = np.frombuffer(f.read((hi - lo) * (4 + dim)), np.uint8).reshape(hi - lo, 4 + dim)
        if (m[:, :4].copy().view("<i4") != dim).any():
            raise ValueError("a bvecs record has another dimension")
        return [lists(m[:, 4:].astype(np.float32), pa.float32())]

    def file(self, cols):
        m = self.matrix(cols[0], np.uint8)
        return np.concatenate([np.full((len(m), 1), m.shape[1], "<i4").view(np.uint8).reshape(len(m), 4), m], axis=1).tobytes()


class _Block(Format):
    """int32 rows, int32 columns, payload of one type."""

    kind, arrow = np.dtype("<f4"), pa.float32()

    def _head(self, f) -> tuple[int, int]:
        f.seek(0)
        rows, dim = struct.unpack("<ii", f.read(8))
        if rows < 0 or dim <= 0 or f.size() < 8 + self.kind.itemsize * rows * dim:
            raise ValueError("block header does not match the file")
        return rows, dim

    def count(self, f):
        return self._head(f)[0]

    def read(self, f, lo, hi):
        dim = self._head(f)[1]
        f.seek(8 + self.kind.itemsize * lo * dim)
        return [lists(np.frombuffer(f.read(self.kind.itemsize * (hi - lo) * dim), self.kind).reshape(hi - lo, dim), self.arrow)]

    def file(self, cols):
        return block_bytes(self.matrix(cols[0], self.kind))


class Fbin(_Block):
    name, columns = "fbin", "vec array<float>"


class PqCodes(_Block):
    name, columns, kind, arrow = "pq_codes", "code array<int>", np.dtype("u1"), pa.int32()


class ErrorBounds(_Block):
    """One float32 a row: the error radius of its residual code."""

    name, columns = "error_bounds", "bound array<float>"


class RawFloat(Format):
    """Headerless float32 rows; option dim."""

    name, columns = "rawfloat", "vec array<float>"

    @property
    def dim(self) -> int:
        return int(self.options.get("dim", 0))

    def count(self, f):
        if self.dim <= 0 or f.size() % (4 * self.dim):
            raise ValueError("raw file size does not match dim")
        return f.size() // (4 * self.dim)

    def read(self, f, lo, hi):
        f.seek(4 * lo * self.dim)
        return [lists(np.frombuffer(f.read(4 * (hi - lo) * self.dim), "<f4").reshape(hi - lo, self.dim), pa.float32())]

    def file(self, cols):
        return self.matrix(cols[0], "<f4").tobytes()


class Truth(Format):
    """Ground-truth ids, and the distances where the file size tells of them (else null)."""

    name, columns = "ann_truth", "vec array<int>, dists array<float>"

    def _head(self, f) -> tuple[int, int, bool]:
        f.seek(0)
        rows, k = struct.unpack("<ii", f.read(8))
        if f.size() not in (8 + 4 * rows * k, 8 + 8 * rows * k):
            raise ValueError("ground-truth size matches neither layout")
        return rows, k, f.size() == 8 + 8 * rows * k

    def count(self, f):
        return self._head(f)[0]

    def read(self, f, lo, hi):
        rows, k, more = self._head(f)
        f.seek(8 + 4 * lo * k)
        ids = lists(np.frombuffer(f.read(4 * (hi - lo) * k), "<i4").reshape(hi - lo, k), pa.int32())
        if not more:
            return [ids, pa.nulls(hi - lo, pa.list_(pa.float32()))]
        f.seek(8 + 4 * (rows + lo) * k)
        return [ids, lists(np.frombuffer(f.read(4 * (hi - lo) * k), "<f4").reshape(hi - lo, k), pa.float32())]

    def file(self, cols):
        with_dists = len(cols) > 1 and not cols[1].null_count
        return truth_bytes(self.matrix(cols[0], "<i4"), self.matrix(cols[1], "<f4") if with_dists else None)


class PageTrace(Format):
    """Packed uint64 page ids (as long; ids from 2**63 on are refused)."""

    name, columns = "page_trace", "page long"

    def count(self, f):
        return f.size() // 8

    def read(self, f, lo, hi):
        f.seek(8 * lo)
        ids = np.frombuffer(f.read(8 * (hi - lo)), "<u8")
        if len(ids) and ids.max() >= 2**63:
            raise ValueError("a page id does not fit into a long")
        return [pa.array(ids.astype(np.int64))]

    def file(self, cols):
        return cols[0].to_numpy().astype("<u8").tobytes()


class Selectors(Format):
    """Selector bits of hybrid codes, LSB first; option chunks."""

    name, columns = "selectors", "use_outlier array<boolean>"

    @property
    def chunks(self) -> int:
        return int(self.options["chunks"])

    def count(self, f):
        stride = -(-self.chunks // 8)
        if f.size() % stride:
            raise ValueError("selector size does not match its shape")
        return f.size() // stride

    def read(self, f, lo, hi):
        stride = -(-self.chunks // 8)
        f.seek(lo * stride)
        return [lists(read_selector_bits(f.read((hi - lo) * stride), hi - lo, self.chunks), pa.bool_())]

    def file(self, cols):
        return selector_bits(self.matrix(cols[0], bool))


class Pivots(Format):
    """A codebook of 256 centers in one file, read and written by one task: a row of
    (chunk, pivot) per center and chunk, row = chunk * 256 + center."""

    name, columns, whole = "pq_pivots", "chunk long, center long, pivot array<float>", True

    def _book(self, f):
        f.seek(0)
        return pq_pivots(f.read())

    def count(self, f):
        return (len(self._book(f)["chunk_offsets"]) - 1) * 256

    def read(self, f, lo, hi):
        b = self._book(f)
        cuts = b["chunk_offsets"].astype(int)
        rows = [(r // 256, r % 256, b["pivots"][r % 256, cuts[r // 256] : cuts[r // 256 + 1]].tolist()) for r in range(lo, hi)]
        return [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.float32())), strict=True)]

    def file(self, cols):
        chunk, center = cols[0].to_numpy(), cols[1].to_numpy()
        size = np.array([len(p) for p in cols[2].to_pylist()])
        sizes = [int(size[chunk == c][0]) for c in range(int(chunk.max()) + 1)]
        offs = np.concatenate([[0], np.cumsum(sizes)])
        out = np.zeros((256, offs[-1]), np.float32)
        for c, k, p in zip(chunk, center, cols[2].to_pylist(), strict=True):
            out[k, offs[c] : offs[c + 1]] = p
        return pq_pivots_bytes(out, np.zeros(offs[-1]), offs)


# -- bytes of each format ----------------------------------------------------------
def bvecs_bytes(rows) -> bytes:
    return b"".join(struct.pack("<i", len(r)) + bytes(r) for r in rows)


def fbin_bytes(m: np.ndarray) -> bytes:
    m = np.ascontiguousarray(m, "<f4")
    return struct.pack("<ii", *m.shape) + m.tobytes()


def truth_bytes(ids: np.ndarray, dists: np.ndarray | None = None) -> bytes:
    ids = np.ascontiguousarray(ids, "<i4")
    return struct.pack("<ii", *ids.shape) + ids.tobytes() + (b"" if dists is None else np.ascontiguousarray(dists, "<f4").tobytes())


def block_bytes(m: np.ndarray) -> bytes:
    """Typed block: int32 rows, int32 columns, payload."""
    return struct.pack("<ii", *m.shape) + np.ascontiguousarray(m).tobytes()


def read_block(data: bytes, kind, offset: int = 0) -> np.ndarray:
    rows, cols = struct.unpack_from("<ii", data, offset)
    n = rows * cols
    if len(data) < offset + 8 + n * np.dtype(kind).itemsize:
        raise ValueError("block is cut short")
    return np.frombuffer(data, kind, n, offset + 8).reshape(rows, cols)


def pq_pivots(data: bytes) -> dict[str, np.ndarray]:
    """Codebook file: a block of 4 or 5 uint64 offsets (the 5-entry form has a
    rearrangement block in between), then pivots (256 x dims), centroid and chunk
    offsets as blocks at those places."""
    head = read_block(data, "<u8")
    n = head.size
    if n not in (4, 5):
        raise ValueError("a codebook has 4 or 5 offsets")
    at = head.ravel().tolist()
    pivots, centroid = read_block(data, "<f4", at[0]), read_block(data, "<f4", at[1])
    chunks = read_block(data, "<u4", at[2 if n == 4 else 3])
    if pivots.shape[0] != 256:
        raise ValueError("a codebook has 256 centers")
    if centroid.size != pivots.shape[1] or int(chunks.ravel()[-1]) != pivots.shape[1]:
        raise ValueError("codebook blocks disagree on the dimension")
    return {"pivots": pivots, "centroid": centroid.ravel(), "chunk_offsets": chunks.ravel()}


def pq_pivots_bytes(pivots: np.ndarray, centroid: np.ndarray, chunk_offsets: np.ndarray) -> bytes:
    parts = [block_bytes(pivots.astype("<f4")), block_bytes(centroid.astype("<f4").reshape(-1, 1)), block_bytes(chunk_offsets.astype("<u4").reshape(-1, 1))]
    at, offs = PAGE, []
    for p in parts:
        offs.append(at)
        at += len(p)
    return block_bytes(np.array([*offs, at], "<u8").reshape(-1, 1)).ljust(PAGE, b"\0") + b"".join(parts)


def selector_bits(sel: np.ndarray) -> bytes:
    """Selector bits, LSB first, ceil(chunks / 8) bytes a row."""
    return np.packbits(sel.astype(bool), axis=1, bitorder="little").tobytes()


def read_selector_bits(data: bytes, rows: int, chunks: int) -> np.ndarray:
    stride = -(-chunks // 8)
    if len(data) != rows * stride:
        raise ValueError("selector size does not match its shape")
    return np.unpackbits(np.frombuffer(data, np.uint8).reshape(rows, stride), axis=1, bitorder="little")[:, :chunks].astype(bool)


def padded(neighbors: list[int], degree: int = DEGREE) -> list[int]:
    """Neighbours padded to the fixed degree with the sentinel."""
    if len(neighbors) > degree:
        raise ValueError(f"more than {degree} neighbours")
    return neighbors + [NO_NEIGHBOR] * (degree - len(neighbors))


def unpadded(slots: list[int], points: int) -> tuple[list[int], int]:
    """(neighbours in range, how many ids were dropped as out of range)."""
    real = [x for x in slots if x != NO_NEIGHBOR]
    kept = [x for x in real if x < points]
    return kept, len(real) - len(kept)


class DiskIndex:
    """Layout of a disk graph index: nodes packed into sectors after one header sector."""

    def __init__(self, points: int, dim: int, medoid: int, node_bytes: int, per_sector: int, sector: int = PAGE):
        self.points, self.dim, self.medoid, self.node_bytes, self.per_sector, self.sector = points, dim, medoid, node_bytes, per_sector, sector

    @classmethod
    def parse(cls, data: bytes) -> DiskIndex:
        points, dim, medoid, node_bytes, per_sector, *_ = struct.unpack_from("<9Q", data, 8)
        return cls(points, dim, medoid, node_bytes, per_sector)

    def node_offset(self, node: int) -> int:
        if not 0 <= node < self.points:
            raise IndexError(node)
        if self.per_sector:
            return self.sector * (1 + node // self.per_sector) + node % self.per_sector * self.node_bytes
        return self.sector * (1 + node * -(-self.node_bytes // self.sector))

    def capacity(self, vector_bytes: int) -> int:
        """Neighbour slots of a node record: what is left after the vector and the degree."""
        return (self.node_bytes - vector_bytes - 4) // 4
