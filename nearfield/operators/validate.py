"""Checks of arguments, before a plan is built."""

from __future__ import annotations

PARALLEL_MODES = ("broadcast", "blocks", "auto")
PRECISIONS = ("single", "double")


def check_knn(m: int, n: int, dim: int, k: int, mode: str = "auto") -> None:
    """Exact search of m queries among n points."""
    if min(m, n, dim, k) <= 0:
        raise ValueError(f"queries, points, dimension and k must be positive, not {m}, {n}, {dim}, {k}")
    if k > n:
        raise ValueError(f"k = {k} exceeds the {n} points")
    if mode not in PARALLEL_MODES:
        raise ValueError(f"mode must be one of {PARALLEL_MODES}, not {mode!r}")


def check_ann(n: int, dim: int, k: int, clusters: int) -> None:
    """Approximate all-to-all search of n points in clusters."""
    if min(n, dim, k, clusters) <= 0:
        raise ValueError(f"points, dimension, k and clusters must be positive, not {n}, {dim}, {k}, {clusters}")
    if clusters > n:
        raise ValueError(f"{clusters} clusters exceed the {n} points")
    if n // clusters <= k:
        raise ValueError(f"{clusters} clusters are too many: {n} points leave {n // clusters} to a cluster, and k = {k} needs more")


def check_options(mode: str, precision: str, ratio: float) -> None:
    """Options of a search that do not depend on its data."""
    if mode not in PARALLEL_MODES:
        raise ValueError(f"mode must be one of {PARALLEL_MODES}, not {mode!r}")
    if precision not in PRECISIONS:
        raise ValueError(f"precision must be one of {PRECISIONS}, not {precision!r}")
    check_ratio(ratio)


def check_ratio(ratio: float) -> None:
    if not 0 < ratio <= 1:
        raise ValueError(f"the memory ratio must be in (0, 1], not {ratio}")
