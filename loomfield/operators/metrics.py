"""Evaluation metrics: exact match with Wilson interval, chrF, set retrieval, structured triage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHRF_ORDER, CHRF_BETA, Z95 = 6, 2.0, 1.959963984540054  # fixed values


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = hits / n, Z95 * Z95
    mid, half = p + z2 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (mid - half) / (1 + z2 / n), (mid + half) / (1 + z2 / n)


def _gram_counts(order: int):
    """Struct of arrays m, x, y by order 1..: clipped matches, and grams of prediction and reference; 0 where the reference is shorter than the order."""

    @F.pandas_udf("m array<long>, x array<long>, y array<long>")
    def run(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
        rows = {"m": [], "x": [], "y": []}
        for p, r in zip(pred, ref, strict=True):
            m, x, y = (np.zeros(order, np.int64) for _ in range(3))
            code = np.frombuffer((p + r).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            name, np_, nr = code, len(p), len(r)  # grams of the joined texts are numbered exactly: one of order k is that of order k - 1 and a code point
            for k in range(1, min(order, nr) + 1):
                if k > 1:
                    name = name[: len(code) - k + 1] * 0x110000 + code[k - 1 :]
                distinct, name = np.unique(name, return_inverse=True)
                of = lambda s, n: np.bincount(s[: max(n - k + 1, 0)], minlength=len(distinct))  # noqa: B023,E731
                in_p, in_r = of(name, np_), of(name[np_:], nr)
                m[k - 1], x[k - 1], y[k - 1] = np.minimum(in_p, in_r).sum(), max(np_ - k + 1, 0), nr - k + 1
            for c, v in zip("mxy", (m, x, y), strict=True):
                rows[c].append(v)
        return pd.DataFrame(rows)

    return run


def chrf(pairs: DataFrame, by: list[str], order: int = CHRF_ORDER, beta: float = CHRF_BETA) -> DataFrame:
    """Corpus chrF per group of ``pairs`` (by..., seg, pred, ref), each row a segment: clipped character n-gram matches pooled per order.

    Grams are counted inside the row, so none is shuffled.
    """
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s", "")
    counts = pairs.select(*by, flat("pred").alias("p"), flat("ref").alias("r")).where("r <> ''").select(*by, _gram_counts(order)("p", "r").alias("c"))
    sums = counts.groupBy(*by).agg(*[F.sum(F.col(f"c.{n}")[k]).alias(f"{n}{k}") for n in "mxy" for k in range(order)])
    used = sum(F.when(F.col(f"y{k}") > 0, 1).otherwise(0) for k in range(order))  # orders that some reference is long enough for
    rate = lambda n: sum(F.when((F.col(f"y{k}") > 0) & (F.col(f"{n}{k}") > 0), F.col(f"m{k}") / F.col(f"{n}{k}")).otherwise(0.0) for k in range(order)) / used
    s = sums.select(*by, rate("x").alias("precision"), rate("y").alias("recall"))
    b2 = beta * beta
    f = F.when(b2 * F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(100 * (1 + b2) * F.col("precision") * F.col("recall") / (b2 * F.col("precision") + F.col("recall")))
    return s.select(*by, F.round(f, 6).alias("chrf"))


def set_scores(cases: DataFrame) -> DataFrame:
    """category (ALL for the total), cases, precision, recall, f1, exact from ``cases`` (category, expected, predicted)."""
    i = F.size(F.array_intersect("expected", "predicted"))
    one = cases.withColumn("i", i).withColumn("p", F.when(F.size("predicted") > 0, F.col("i") / F.size("predicted")).otherwise(0.0)).withColumn("r", F.when(F.size("expected") > 0, F.col("i") / F.size("expected")).otherwise(0.0))
    one = one.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)).withColumn("e", ((F.size("expected") == F.col("i")) & (F.size("predicted") == F.col("i"))).cast("double"))
    mean = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return one.rollup("category").agg(F.count(F.lit(1)).alias("cases"), mean("p", "precision"), mean("r", "recall"), mean("f", "f1"), mean("e", "exact")).select(F.coalesce("category", F.lit("ALL")).alias("category"), "cases", "precision", "recall", "f1", "exact")
