"""Frozen parameter sets of the clustering and replay plans."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ClusterSettings:
    # Fixed default values of the clustering run.
    pca_variance: float = 0.80
    pca_n_components: int | None = None
    preprocess_method: str = "zscore"
    normalize_total_target: float = 10000.0
    scale_max_value: float | None = None
    neighbors_n_pcs: int | None = None
    n_neighbors: int = 15
    graph_method: str = "exact"
    target_clusters: int = 5
    discovery_min_clusters: int = 3
    discovery_max_clusters: int = 10
    resolution_grid: tuple[float, ...] = (
        0.05, 0.10, 0.15, 0.20, 0.30, 0.40, 0.50, 0.60, 0.80, 1.00, 1.25, 1.50, 2.00,
    )
    random_seed: int = 42
    leiden_n_iterations: int = -1
    drop_constant: bool = True


@dataclass(frozen=True)
class ReplaySettings:
    # Fixed parameter values of the replay workflow.
    pca_n_components: int = 50
    neighbors_n_pcs: int = 15
    n_neighbors: int = 30
    resolution: float = 0.50
    random_seed: int = 0
    normalize_total_target: float = 10000.0
    min_patient_count: int = 4
    exclude_codes: tuple[str, ...] = ("343.0", "333.4")
    internal_to_published: dict[str, str] = field(
        default_factory=lambda: {"A": "A", "B": "E", "C": "C", "D": "D", "E": "B"}
    )


@dataclass(frozen=True)
class MatrixSettings:
    min_patients: int = 3
    feature_prefix: str = "phe_"
    exclude_codes: tuple[str, ...] = ()
    min_visits: int | None = None
    require_level: bool = False
