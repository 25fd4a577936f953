"""The text model of a learned stop and the features it reads.

Label 1 means that a search must go on; it stops where the logit is below the
model's threshold. Features of both kinds are listed in the order of the weights."""

from __future__ import annotations

from dataclasses import dataclass, field

TRAVERSAL = ("prefix_frac", "expanded_frac", "visited_frac", "best_unexpanded", "next64", "next256", "dk", "gap_prefix", "gap32", "delta_dk", "delta_boundary", "churn")
RERANK = ("budget_log2", "prefix_frac", "kth", "delta_kth", "delta_kth_prev", "topk_changed", "entered_ratio", "spread", "live_ratio", "best_gap", "window_exact", "window_filtered", "exact_frac")
#: Features of the reduced models.
TRAVERSAL_CORE = ("visited_frac", "best_unexpanded", "dk", "gap_prefix", "gap32", "delta_boundary", "churn")
RERANK_CORE = ("budget_log2", "prefix_frac", "kth", "topk_changed", "spread", "best_gap")
MOST_STAGES, MOST_TOP_K = 32, 32


@dataclass
class StopModel:
    """key=value text: stage_prefixes, feature_means, feature_inv_stds, weights, bias, threshold_logit."""

    stage_prefixes: list[int]
    feature_means: list[float]
    feature_inv_stds: list[float]
    weights: list[float]
    bias: float = 0.0
    threshold_logit: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> StopModel:
        vals: dict[str, str] = {}
        for line in text.splitlines():
            line = line.partition("#")[0].strip()
            if line:
                k, eq, v = line.partition("=")
                if not eq:
                    raise ValueError(f"not key=value: {line!r}")
                vals[k.strip()] = v.strip()
        nums = lambda k, kind: [kind(x) for x in vals.get(k, "").split(",") if x.strip()]
        m = cls(nums("stage_prefixes", int), nums("feature_means", float), nums("feature_inv_stds", float), nums("weights", float), float(vals.get("bias", 0)), float(vals.get("threshold_logit", 0)))
        for pair in vals.get("thresholds", "").split(","):
            if ":" in pair:
                l, t = pair.split(":")
                m.thresholds[int(l)] = float(t)
        if not len(m.feature_means) == len(m.feature_inv_stds) == len(m.weights):
            raise ValueError("means, inv_stds and weights differ in length")
        return m

    def text(self) -> str:
        row = lambda v: ",".join(map(str, v))
        return (f"stage_prefixes={row(self.stage_prefixes)}\nfeature_means={row(self.feature_means)}\nfeature_inv_stds={row(self.feature_inv_stds)}\nweights={row(self.weights)}\n"
                f"bias={self.bias}\nthreshold_logit={self.threshold_logit}\nthresholds={','.join(f'{k}:{v}' for k, v in self.thresholds.items())}\n")

    def folded(self) -> tuple[list[float], float]:
        """Weights and bias with the standardisation folded in."""
        w = [a * b for a, b in zip(self.weights, self.feature_inv_stds, strict=True)]
        return w, self.bias - sum(a * m for a, m in zip(w, self.feature_means, strict=True))

    def threshold(self, top_l: int) -> float:
        return self.thresholds.get(top_l, self.threshold_logit)


@dataclass(frozen=True)
class Decision:
    """A model made ready for one search: stages, folded weights by feature order, threshold."""

    stages: tuple[int, ...]
    weights: tuple[float, ...] = ()
    bias: float = 0.0
    threshold: float = 0.0

    @classmethod
    def of(cls, model: StopModel, limit: int) -> Decision:
        w, b = model.folded()
        return cls(tuple(model.stage_prefixes), tuple(w), b, model.threshold(limit))

    def stops(self, features: list[float]) -> bool:
        return bool(self.weights) and self.bias + sum(w * x for w, x in zip(self.weights, features, strict=True)) < self.threshold


class TraversalWatch:
    """Checkpoints of one query's traversal. A stage p counts if top_k <= p < top_l;
    it is due once the pool is full and p nodes are expanded. Pool entries are
    (rounded distance, id, distance, expanded), best first."""

    def __init__(self, decision: Decision, top_k: int, top_l: int):
        if top_k > MOST_TOP_K:
            raise ValueError(f"learned stops take a top_k of at most {MOST_TOP_K}")
        self.decision, self.k, self.l = decision, top_k, top_l
        self.stages = [(n, p) for n, p in enumerate([p for p in decision.stages if 0 < p < top_l][:MOST_STAGES]) if p >= top_k]
        self.at, self.before = 0, None
        self.rows: list[tuple[int, int, list[float], list[int]]] = []

    def stop(self, pool: list[tuple], expanded: int, visited: int) -> bool:
        while self.at < len(self.stages):
            stage, p = self.stages[self.at]
            if len(pool) < self.l or expanded < p:
                return False
            self.at += 1
            f = self.features(pool, p, expanded, visited)
            self.rows.append((stage, p, f, [c[1] for c in pool[: self.k]]))
            if self.decision.stops(f):
                return True
        return False

    def features(self, pool: list[tuple], p: int, expanded: int, visited: int) -> list[float]:
        k, l = self.k, self.l
        dist = [c[2] for c in pool[:l]]
        open_ = [not c[3] for c in pool[:l]]
        share = lambda span: sum(open_[p : min(p + span, l)]) / (min(p + span, l) - p)
        dk, edge, top = dist[k - 1], dist[p - 1], {c[1] for c in pool[:k]}
        d0, e0, t0 = self.before or (dk, edge, set())
        self.before = (dk, edge, top)
        return [p / l, expanded / l, visited / l, (open_.index(True) if True in open_ else l) / l, share(64), share(256), dk, edge - dk,
                dist[min(max(k - 1, 31), p - 1)] - dk, d0 - dk, e0 - edge, len(top - t0) / k]
