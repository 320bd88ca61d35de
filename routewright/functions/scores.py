"""Score formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def cluster_confidence(n_names: Column, conf_sum: Column) -> Column:
    return F.least(F.lit(0.95), 0.4 + 0.15 * n_names + 0.4 * conf_sum / F.greatest(n_names, F.lit(1)))


def reconstruction_confidence(n_anchors: Column, rmse_m: Column, label_conf: Column, fidelity: Column) -> Column:
    """Geometric mean of four terms, each held between 0.05 and 1."""
    terms = [_unit((n_anchors - 3) / 3.0), _unit(1.0 - (rmse_m - 30.0) / 170.0), _unit(label_conf), _unit(fidelity)]
    logs = [F.log(F.greatest(term, F.lit(0.05))) for term in terms]
    return F.exp((logs[0] + logs[1] + logs[2] + logs[3]) / 4)


def fidelity_combine(iou: Column, frechet_m: Column, soft_m: float = 200.0) -> Column:
    """0..1 blend of overlap and worst-case distance; an infinite distance contributes nothing."""
    closeness = F.greatest(F.lit(0.0), 1.0 - frechet_m / max(soft_m, 1.0))
    return _unit(0.6 * iou + 0.4 * closeness)


def passes(score: Column) -> Column:
    return score >= 0.6


def error_pct(routed_m: Column, target_m: Column) -> Column:
    return (routed_m - target_m) / target_m * 100.0
