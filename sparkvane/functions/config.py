"""Runtime settings: key=value files with # comments."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class RuntimeConfig:
    page_cache_mib: int = 16
    queue_depth: int = 256
    num_queues: int = 8
    partitions: int = 200

    @classmethod
    def parse(cls, text: str) -> RuntimeConfig:
        kinds = {f.name for f in fields(cls)}
        vals: dict[str, int] = {}
        for n, line in enumerate(text.splitlines(), 1):
            line = line.partition("#")[0].strip()
            if not line:
                continue
            k, eq, v = (x.strip() for x in line.partition("="))
            if not eq or k not in kinds:
                raise ValueError(f"line {n}: unknown setting {line!r}")
            vals[k] = int(v)
        return cls(**vals)

    @classmethod
    def load(cls, *paths: str, env: str = "SPARKVANE_CONFIG") -> RuntimeConfig:
        """The file the environment names, else the first path that exists, else defaults."""
        for p in (os.environ.get(env), *paths):
            if p and os.path.exists(p):
                with open(p) as f:
                    return cls.parse(f.read())
        return cls()


def apply(spark, config: RuntimeConfig) -> None:
    """Settings that Spark has a counterpart for: partitions of a shuffle, and the
    bytes of a scan's partition from the page cache a queue is given."""
    spark.conf.set("spark.sql.shuffle.partitions", str(config.partitions))
    spark.conf.set("spark.sql.files.maxPartitionBytes", f"{max(1, config.page_cache_mib * config.num_queues)}m")


def number_list(text: str) -> list[int]:
    """'8, 16,32' as ascending distinct numbers."""
    return sorted({int(x) for x in text.split(",") if x.strip()})


def tile_policy(text: str) -> dict[int, int]:
    """'top_l:tile,...'"""
    out = {}
    for pair in filter(None, (p.strip() for p in text.split(","))):
        k, sep, v = pair.partition(":")
        if not sep or int(k) <= 0 or int(v) <= 0:
            raise ValueError(f"not top_l:tile: {pair!r}")
        out[int(k)] = int(v)
    return out


def cached_nodes(points: int, ratio: float | None = None, gib: float | None = None, node_bytes: int = 256) -> int:
    if (ratio is None) == (gib is None):
        raise ValueError("give either ratio or gib")
    n = int(ratio * points) if ratio is not None else int(gib * (1 << 30) // node_bytes)
    return max(0, min(points, n))
