"""Page-packed files: vector stores, padded topologies, stop-prefix traces.

A store begins with one header page (magic, version, shape), records follow in
fixed slots that never straddle a page. Files are read by byte range, so any
record costs one seek.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from sparkvane.sources.binary import DEGREE, NO_NEIGHBOR, PAGE, DiskIndex, padded
from sparkvane.sources.files import Format, lists

VERSION = 1
STORE_MAGIC, GRAPH_MAGIC = b"SPKVSTOR", b"SPKVGRPH"
#: Fixed value: marks each batch of a stop-prefix trace.
TRACE_MAGIC = 0x52535031
KINDS = {0: np.dtype("<f4"), 1: np.dtype("u1"), 2: np.dtype("i1")}


@dataclass(frozen=True)
class StoreLayout:
    kind: int
    dim: int
    count: int
    page: int = PAGE

    @property
    def vector_bytes(self) -> int:
        return self.dim * KINDS[self.kind].itemsize

    @property
    def per_page(self) -> int:
        n = self.page // self.vector_bytes if self.vector_bytes else 0
        if n == 0:
            raise ValueError("a vector must fit into one page")
        return n

    @property
    def pages(self) -> int:
        return -(-self.count // self.per_page)

    def address(self, i: int) -> tuple[int, int, int]:
        """(page, slot, byte offset in the file)"""
        if not 0 <= i < self.count:
            raise IndexError(i)
        p, s = divmod(i, self.per_page)
        return p, s, self.page + p * self.page + s * self.vector_bytes

    def header(self) -> bytes:
        return (STORE_MAGIC + struct.pack("<IIIQI", VERSION, self.kind, self.dim, self.count, self.page)).ljust(self.page, b"\0")

    @classmethod
    def parse(cls, data: bytes, size: int | None = None) -> StoreLayout:
        if data[:8] != STORE_MAGIC:
            raise ValueError("not a vector store")
        version, kind, dim, count, page = struct.unpack_from("<IIIQI", data, 8)
        if version != VERSION or kind not in KINDS:
            raise ValueError("unknown version or scalar kind")
        out = cls(kind, dim, count, page)
        if size is not None and size != page * (1 + out.pages):
            raise ValueError("file size does not match the header")
        return out


def store_bytes(m: np.ndarray) -> bytes:
    """A whole vector store; unused bytes of a page are zero."""
    kind = next((k for k, t in KINDS.items() if t == m.dtype.newbyteorder("<")), None)
    if kind is None:
        raise ValueError(f"no scalar kind for {m.dtype}")
    lay = StoreLayout(kind, m.shape[1], len(m))
    parts = [lay.header()]
    for a in range(0, len(m), lay.per_page):
        parts.append(m[a : a + lay.per_page].tobytes().ljust(lay.page, b"\0"))
    return b"".join(parts)


def store_vector(data: bytes, i: int) -> np.ndarray:
    lay = StoreLayout.parse(data, len(data))
    return np.frombuffer(data, KINDS[lay.kind], lay.dim, lay.address(i)[2])


def topology_bytes(adjacency: list[list[int]]) -> bytes:
    head = (GRAPH_MAGIC + struct.pack("<IIQ", VERSION, DEGREE, len(adjacency))).ljust(PAGE, b"\0")
    return head + b"".join(np.array(padded(a), "<u4").tobytes() for a in adjacency)


def topology_rows(data: bytes) -> list[list[int]]:
    if data[:8] != GRAPH_MAGIC:
        raise ValueError("not a topology file")
    version, degree, nodes = struct.unpack_from("<IIQ", data, 8)
    if version != VERSION or degree != DEGREE or len(data) != PAGE + nodes * degree * 4:
        raise ValueError("version, degree or size differs")
    m = np.frombuffer(data, "<u4", nodes * degree, PAGE).reshape(nodes, degree)
    return [[int(x) for x in r if x != NO_NEIGHBOR] for r in m]


def node_offset(node: int) -> int:
    return PAGE + node * DEGREE * 4


def combined_bytes(vectors: np.ndarray, adjacency: list[list[int]]) -> bytes:
    """Records of vector, degree and neighbours, one after the other."""
    return b"".join(v.astype("<f4").tobytes() + struct.pack("<I", len(a)) + np.array(padded(a), "<u4").tobytes() for v, a in zip(vectors, adjacency, strict=True))


def trace_bytes(batches: list[list[int]]) -> bytes:
    return b"".join(struct.pack("<II", TRACE_MAGIC, len(b)) + np.array(b, "<u4").tobytes() for b in batches)


def trace_batches(data: bytes) -> Iterator[list[int]]:
    at = 0
    while at < len(data):
        magic, n = struct.unpack_from("<II", data, at)
        if magic != TRACE_MAGIC or at + 8 + 4 * n > len(data):
            raise ValueError("broken stop-prefix trace")
        yield np.frombuffer(data, "<u4", n, at + 8).tolist()
        at += 8 + 4 * n


def _neighbors(slots: np.ndarray, degrees: np.ndarray | None = None, points: int | None = None) -> pa.ListArray:
    """Neighbours of each row: slots in use, without the pad and ids of `points` or more."""
    use = slots != NO_NEIGHBOR
    if degrees is not None:
        use &= np.arange(slots.shape[1])[None, :] < degrees[:, None]
    if points is not None:
        use &= slots < points
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(use.sum(axis=1))]), pa.int32()), pa.array(slots[use].astype(np.int64)))


def _padded(col: pa.Array) -> np.ndarray:
    return np.array([padded(r or []) for r in col.to_pylist()], "<u4").reshape(len(col), DEGREE)


class VectorStore(Format):
    """Page-packed vectors; option kind: f32 (default), u8 or i8 for writing."""

    name, columns = "vector_store", "vec array<float>"

    def _layout(self, f) -> StoreLayout:
        f.seek(0)
        return StoreLayout.parse(f.read(64), f.size())

    def count(self, f):
        return self._layout(f).count

    def read(self, f, lo, hi):
        lay = self._layout(f)
        a, z = lo // lay.per_page, -(-hi // lay.per_page)
        f.seek(lay.page * (1 + a))
        raw = np.frombuffer(f.read(lay.page * (z - a)), np.uint8).reshape(z - a, lay.page)[:, : lay.per_page * lay.vector_bytes]
        m = np.ascontiguousarray(raw).reshape(-1, lay.vector_bytes).view(KINDS[lay.kind])[lo - a * lay.per_page : hi - a * lay.per_page]
        return [lists(m.astype(np.float32), pa.float32())]

    def file(self, cols):
        return store_bytes(self.matrix(cols[0], {"f32": "<f4", "u8": "u1", "i8": "i1"}[self.options.get("kind", "f32")]))


class Topology(Format):
    """Padded adjacency; option points: neighbour ids from there on are dropped in reading."""

    name, columns = "topology", "neighbors array<long>"

    def count(self, f):
        f.seek(0)
        data = f.read(PAGE)
        if data[:8] != GRAPH_MAGIC:
            raise ValueError("not a topology file")
        version, degree, nodes = struct.unpack_from("<IIQ", data, 8)
        if version != VERSION or degree != DEGREE or f.size() != PAGE + nodes * degree * 4:
            raise ValueError("version, degree or size differs")
        return nodes

    def read(self, f, lo, hi):
        f.seek(node_offset(lo))
        m = np.frombuffer(f.read((hi - lo) * DEGREE * 4), "<u4").reshape(hi - lo, DEGREE)
        return [_neighbors(m, points=int(self.options["points"]) if "points" in self.options else None)]

    def file(self, cols):
        return (GRAPH_MAGIC + struct.pack("<IIQ", VERSION, DEGREE, len(cols[0]))).ljust(PAGE, b"\0") + _padded(cols[0]).tobytes()


class DiskGraph(Format):
    """Disk graph index of float32 vectors: sectors of node records (vector, degree,
    neighbours) after one header sector; options medoid (writing) and points (as in Topology)."""

    name, columns = "disk_graph", "vec array<float>, neighbors array<long>"

    def _index(self, f) -> DiskIndex:
        f.seek(0)
        return DiskIndex.parse(f.read(PAGE))

    def count(self, f):
        return self._index(f).points

    def read(self, f, lo, hi):
        d = self._index(f)
        rec = np.empty((hi - lo, d.node_bytes), np.uint8)
        first = d.node_offset(lo)
        first -= first % d.sector
        end = d.node_offset(hi - 1) + d.node_bytes
        f.seek(first)
        raw = f.read(end - first)
        for i in range(lo, hi):
            at = d.node_offset(i) - first
            rec[i - lo] = np.frombuffer(raw, np.uint8, d.node_bytes, at)
        vec = np.ascontiguousarray(rec[:, : d.dim * 4]).view("<f4")
        deg = np.ascontiguousarray(rec[:, d.dim * 4 : d.dim * 4 + 4]).view("<u4").ravel()
        slots = np.ascontiguousarray(rec[:, d.dim * 4 + 4 :]).view("<u4")
        return [lists(vec, pa.float32()), _neighbors(slots, np.minimum(deg, DEGREE), int(self.options["points"]) if "points" in self.options else None)]

    def file(self, cols):
        m, slots = self.matrix(cols[0], "<f4"), _padded(cols[1])
        deg = (slots != NO_NEIGHBOR).sum(axis=1).astype("<u4")[:, None]
        rec = np.concatenate([m.view(np.uint8), deg.view(np.uint8), slots.view(np.uint8)], axis=1)
        d = DiskIndex(len(m), m.shape[1], int(self.options.get("medoid", 0)), rec.shape[1], PAGE // rec.shape[1])
        out = bytearray(d.node_offset(len(m) - 1) + d.node_bytes if len(m) else PAGE)
        out[:80] = struct.pack("<II9Q", 9, 1, d.points, d.dim, d.medoid, d.node_bytes, d.per_sector, 0, 0, 0, 0)
        for i, r in enumerate(rec):
            at = d.node_offset(i)
            out[at : at + d.node_bytes] = r.tobytes()
        return bytes(out) + bytes(-len(out) % PAGE)


class CombinedNodes(Format):
    """Headerless records of a float32 vector, degree and 64 neighbours; option dim."""

    name, columns = "combined_nodes", "vec array<float>, neighbors array<long>"

    @property
    def _bytes(self) -> int:
        return int(self.options["dim"]) * 4 + 4 + DEGREE * 4

    def count(self, f):
        if f.size() % self._bytes:
            raise ValueError("file size does not match dim")
        return f.size() // self._bytes

    def read(self, f, lo, hi):
        dim = int(self.options["dim"])
        f.seek(lo * self._bytes)
        rec = np.frombuffer(f.read((hi - lo) * self._bytes), np.uint8).reshape(hi - lo, self._bytes)
        part = lambda a, b, t: np.ascontiguousarray(rec[:, a:b]).view(t)
        return [lists(part(0, dim * 4, "<f4"), pa.float32()), _neighbors(part(dim * 4 + 4, self._bytes, "<u4"), part(dim * 4, dim * 4 + 4, "<u4").ravel())]

    def file(self, cols):
        slots = _padded(cols[1])
        deg = (slots != NO_NEIGHBOR).sum(axis=1).astype("<u4")[:, None]
        return np.concatenate([self.matrix(cols[0], "<f4").view(np.uint8), deg.view(np.uint8), slots.view(np.uint8)], axis=1).tobytes()


class StopTrace(Format):
    """Stop prefixes, a magic and a length before each batch (one batch a file when
    written); appending adds batches."""

    name, columns, whole = "stop_trace", "stop_prefix long", True

    def _all(self, f) -> list[int]:
        f.seek(0)
        return [x for b in trace_batches(f.read()) for x in b]

    def count(self, f):
        return len(self._all(f))

    def read(self, f, lo, hi):
        return [pa.array(self._all(f)[lo:hi], pa.int64())]

    def file(self, cols):
        return trace_bytes([cols[0].to_pylist()])
