"""Experiment settings and the places of their outputs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class Data:
    """What the training table is made of (names and defaults are fixed values)."""

    condition: str = ""
    mixing_strategy: str = ""
    shuffle_within_blocks: bool = True
    oversample_x: bool = False
    max_samples_x: int = 0
    experiment_type: str = "linguistic"


@dataclass(frozen=True)
class Attribution:
    """How rows are scored and reported (names and defaults are fixed values)."""

    method: str = "vanilla"
    unit_norm: bool = True
    projection_dim: int = 16
    downweight_components: int = 1000
    lambda_damp: float = 0.1
    aggregate_query: bool = False
    scoring_base_size: int = 0
    stats_base_size: int = 1000
    prec_base_size: int = 0
    k_precisions: tuple[int, ...] = (10, 20)
    inspect_top_k: int = 50
    full_pairs: str | None = None
    no_x_pairs: str | None = None

    def __post_init__(self):
        if self.method not in ("bm25", "vanilla", "trackstar", "ekfac", "kfac", "kfac_fused"):
            raise ValueError(f"unknown method {self.method}")


SPLITS = ("", "learned", "not_learned", "not_learned_no_x", "learned_specific", "learned_confounded")


@dataclass(frozen=True)
class Experiment:
    root: str
    name: str
    data: Data = field(default_factory=Data)
    attribution: Attribution = field(default_factory=Attribution)
    seeds: tuple[int, ...] = (42, 43, 44)

    @property
    def variant(self) -> str:
        return "_".join(x for x in (self.data.condition, self.data.mixing_strategy) if x) or "default"

    @property
    def shared(self) -> str:
        return f"{self.root}/{self.name}/{self.variant}"

    def table(self, name: str) -> str:
        """Place of a shared table: train, queries, query_texts, base_test, train_subset."""
        return f"{self.shared}/{name}"

    def method_dir(self, seed: int) -> str:
        """By method and its whole configuration, so that runs with other settings don't overwrite it."""
        from loomwright.sources.sinks import fingerprint

        return f"{self.shared}/seed_{seed}/{self.attribution.method}-{fingerprint(asdict(self.attribution))[:8]}"

    def output(self, seed: int, name: str, split: str = "") -> str:
        """Place of delta_i_stats, prec_at_k, top_inspect[_good|_bad] or per_source, of one split."""
        if split not in SPLITS:
            raise ValueError(f"unknown split {split}")
        return f"{self.method_dir(seed)}/{name}{'_' + split if split else ''}"

    @property
    def results(self) -> str:
        return f"{self.shared}/results"
