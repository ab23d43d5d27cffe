"""The composite indices, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))


def defined(x: Column) -> Column:
    """0 for null and NaN."""
    return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))


def label(score: Column, names: tuple[str, str, str, str]) -> Column:
    """Names from 80, 60, 40, and below."""
    return F.when(score >= 80, names[0]).when(score >= 60, names[1]).when(score >= 40, names[2]).otherwise(names[3])


# Labels of the two scores.
TOI_LABELS = ("Excelente", "Buena", "Aceptable", "Crítica")
TLI_LABELS = ("Excelente Separabilidad (Alta Aprendibilidad)", "Buena Separabilidad", "Separabilidad Moderada", "Baja Separabilidad (Alta Interferencia Espectral)")


def toi(coverage: Column, median_ratio: Column, entropy: Column, correlation: Column, moran: Column) -> dict[str, Column]:
    """Observability, 0 to 100, with its five parts (weights .20, .25, .25, .15, .15)."""
    parts = {
        "cobertura": clipped(defined(coverage)), "resolucion": clipped((1 - defined(median_ratio)) * 100), "informacion": clipped(defined(entropy) / 8 * 100),
        "redundancia": clipped((1 - defined(correlation)) * 100), "estructura": clipped(F.greatest(defined(moran), F.lit(0.0)) * 100),
    }
    weights = (0.20, 0.25, 0.25, 0.15, 0.15)
    score = sum(w * p for w, p in zip(weights, parts.values(), strict=True))
    return {"toi": score, "categoria": label(score, TOI_LABELS)} | parts


def tli(mahalanobis: Column, purity: Column, silhouette: Column, redundant_ratio: Column) -> dict[str, Column]:
    """Learnability, 0 to 100, with its parts and the penalty for redundant variables."""
    parts = {"distancia": 100 * (1 - F.exp(-defined(mahalanobis) / 4)), "pureza": 100 * defined(purity), "agrupamiento": 100 * F.greatest(defined(silhouette), F.lit(0.0))}
    penalty = F.greatest((defined(redundant_ratio) - 0.3) * 20, F.lit(0.0))
    score = clipped(0.40 * parts["distancia"] + 0.35 * parts["pureza"] + 0.25 * parts["agrupamiento"] - penalty)
    return {"tli": score, "categoria": label(score, TLI_LABELS)} | parts | {"penalizacion": penalty}
