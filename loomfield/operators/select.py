"""Ordered selection, splits, allocation, packing and ledgers."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(seed: str, c: Column) -> Column:
    """Hexadecimal SHA-256 of seed, colon and value: an order that does not depend on the input's."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)


def capped_greedy(rows: DataFrame, dims: dict[str, int], total: int, seed: str) -> DataFrame:
    """doc_id, chosen, reason: in hash order a row is taken unless the total or a dimension is full; counters move on acceptance only.

    A prefix that skips is not a running sum, so the fold is ordered. A row beyond the cap of its own value in any one dimension among
    better-ranked rows of equal values can never be taken: that prune is native and leaves at most total x values rows for the fold.
    A pruned row's reason follows from the last row taken under each full cap and the full total, a table bounded by the total.
    """
    ranked = rows.withColumn("__o", hash_rank(seed, F.col("doc_id")))
    same = Window.partitionBy(*dims).orderBy("__o", "doc_id")
    pruned = ranked.withColumn("__k", F.row_number().over(same))
    hopeful = pruned.where(F.col("__k") <= min(total, *dims.values())).select("doc_id", "__o", *dims)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        used: dict = {}
        taken, out = 0, []
        for row in pdf.sort_values(["__o", "doc_id"]).to_dict("records"):
            full = "total" if taken >= total else next((d for d, cap in dims.items() if used.get((d, row[d]), 0) >= cap), None)
            if full is None:
                taken += 1
                for d in dims:
                    used[d, row[d]] = used.get((d, row[d]), 0) + 1
            out.append((row["doc_id"], full is None, full))
        return pd.DataFrame(out, columns=["doc_id", "chosen", "reason"])

    placed = hopeful.withColumn("__all", F.lit("all")).groupBy("__all").applyInPandas(fold, "doc_id long, chosen boolean, reason string")
    name = lambda d: F.concat(F.lit(f"{d}:"), F.coalesce(F.concat(F.lit("="), F.col(d).cast("string")), F.lit("")))
    at = F.struct("__o", "doc_id")
    counters = F.array(F.struct(F.lit(total).alias("cap"), F.lit("").alias("name")), *[F.struct(F.lit(cap).alias("cap"), name(d).alias("name")) for d, cap in dims.items()])
    taken_rows = hopeful.join(placed.where("chosen").select("doc_id"), "doc_id", "left_semi").select(at.alias("at"), F.explode(counters).alias("c"))
    full = taken_rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at")).where("n >= c.cap").agg(F.map_from_entries(F.collect_list(F.struct("c.name", "at"))).alias("__full"))
    past = lambda cap, n: F.lit(cap <= 0) | F.coalesce(F.try_element_at("__full", n) < at, F.lit(False))
    reason = F.coalesce(F.when(past(total, F.lit("")), F.lit("total")), *[F.when(past(cap, name(d)), F.lit(d)) for d, cap in dims.items()])
    out = pruned.select("doc_id", "__o", *dims).join(placed, "doc_id", "left").crossJoin(F.broadcast(full))
    return out.select("doc_id", F.coalesce("chosen", F.lit(False)).alias("chosen"), F.when(~F.coalesce("chosen", F.lit(False)), F.coalesce("reason", reason)).alias("reason"))


def ranked_cap(rows: DataFrame, key: str, cap: int, seed: str) -> DataFrame:
    """First ``cap`` rows of each key in hash order."""
    w = Window.partitionBy(key).orderBy(hash_rank(seed, F.col("doc_id")), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cap)


def byte_budget_break(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """Rows of each key in id order until the first that would pass the budget."""
    w = Window.partitionBy(key).orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum("bytes").over(w)).where(F.col("running") <= budget)


def budget_skip(rows: DataFrame, key: str, budget: int) -> DataFrame:
    """Largest first, a row is taken if it still fits (key, doc_id, bytes): an ordered fold per key over ids and sizes only."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, left, keep = pdf.sort_values(["bytes", "doc_id"], ascending=[False, True]), budget, []
        for b in pdf.bytes:
            keep.append(b <= left)
            left -= b if keep[-1] else 0
        return pdf[keep][[key, "doc_id", "bytes"]]

    return rows.select(key, "doc_id", "bytes").groupBy(key).applyInPandas(fold, f"{key} string, doc_id long, bytes long")


def choose_clusters(sizes: list[tuple[str, int]], seed: str, fraction: float) -> set[str]:
    """Clusters in hash order: the first in any case, then each that does not move the count away from the rounded target, until it is reached; never all."""
    target, have, chosen = max(1, round(sum(n for _, n in sizes) * fraction)), 0, []
    for name, n in sorted(sizes, key=lambda x: hashlib.sha256(f"{seed}\0{x[0]}".encode()).hexdigest()):
        if have >= target:
            break
        if not chosen or abs(have + n - target) <= abs(have - target):
            chosen.append(name)
            have += n
    return set(chosen[:-1] if len(chosen) == len(sizes) else chosen)


def cluster_split(rows: DataFrame, cluster: str, seed: str, test: float = 0.2, validation: float = 0.25) -> DataFrame:
    """doc_id, split: whole clusters go to test, then to validation, the rest to train. One row a cluster reaches the driver."""
    sizes = sorted((str(r[0]), r[1]) for r in rows.groupBy(cluster).count().collect())
    t = choose_clusters(sizes, f"{seed}/test", test)
    v = choose_clusters([s for s in sizes if s[0] not in t], f"{seed}/validation", validation)
    c = F.col(cluster).cast("string")
    return rows.select("doc_id", cluster, F.when(c.isin(*sorted(t)), "test").when(c.isin(*sorted(v)), "validation").otherwise("train").alias("split"))


def split_family(rows: DataFrame, cluster: str, seeds: list[str], fraction: float = 0.10) -> DataFrame:
    """seed, doc_id, role: a variant a seed; documents in no validation of any seed are the shared core."""
    sizes = sorted((str(r[0]), r[1]) for r in rows.groupBy(cluster).count().collect())
    chosen = {s: choose_clusters(sizes, s, fraction) for s in seeds}
    union = sorted(set().union(*chosen.values()))
    c = F.col(cluster).cast("string")
    one = lambda s: rows.select(F.lit(s).alias("seed"), "doc_id", F.when(c.isin(*sorted(chosen[s])), "validation").when(c.isin(*union), "held_back").otherwise("core").alias("role"))
    out = one(seeds[0])
    for s in seeds[1:]:
        out = out.union(one(s))
    return out


# Shares of the strata, and the family caps.
STRATA = {"en": (9, 20), "fr": (7, 20), "de": (1, 5)}
FAMILY_OF_TOTAL, FAMILY_OF_STRATUM, LEAST_FAMILIES, QUANTUM = (1, 4), (3, 5), 2, 100


def feasible(total: int, families: dict[str, list[int]]) -> bool:
    """Whether every stratum can fill its share of ``total`` under the family caps."""
    for stratum, (a, b) in STRATA.items():
        quota = total * a // b
        cap = min(total * FAMILY_OF_TOTAL[0] // FAMILY_OF_TOTAL[1], quota * FAMILY_OF_STRATUM[0] // FAMILY_OF_STRATUM[1])
        own = families.get(stratum, [])
        if len(own) < LEAST_FAMILIES or sum(min(cap, x) for x in own) < quota:
            return False
    return True


def largest_feasible(families: dict[str, list[int]]) -> int:
    """Largest feasible multiple of the quantum, by bisection."""
    lo, hi = 0, sum(map(sum, families.values())) // QUANTUM + 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if feasible(mid * QUANTUM, families) else (lo, mid)
    return lo * QUANTUM


def allocation(vector: DataFrame, total: int) -> DataFrame:
    """stratum, family, allocated: largest capped capacity first until the stratum's quota is full."""
    quota = F.lit(0).cast("bigint")
    for s, (a, b) in STRATA.items():
        quota = F.when(F.col("stratum") == s, F.lit(total * a // b)).otherwise(quota)
    cap = F.least(F.lit(total * FAMILY_OF_TOTAL[0] // FAMILY_OF_TOTAL[1]), F.floor(F.col("quota") * FAMILY_OF_STRATUM[0] / FAMILY_OF_STRATUM[1]))
    v = vector.withColumn("quota", quota).withColumn("cap", F.least("unique_bytes", cap).cast("bigint"))
    w = Window.partitionBy("stratum").orderBy(F.col("cap").desc(), "family").rowsBetween(Window.unboundedPreceding, -1)
    return v.withColumn("before", F.coalesce(F.sum("cap").over(w), F.lit(0))).select("stratum", "family", F.greatest(F.lit(0), F.least("cap", F.col("quota") - F.col("before"))).cast("bigint").alias("allocated"))


def causal_windows(docs: DataFrame, length: int = 128) -> DataFrame:
    """doc_id, start, tokens, padding: windows of ``length`` byte tokens that overlap by one; under two tokens there is none."""
    n = F.octet_length("text")
    at = F.when(n >= 2, F.sequence(F.lit(0), n - 2, F.lit(length - 1))).otherwise(F.array().cast("array<int>"))
    w = docs.select("doc_id", n.alias("n"), F.explode(at).alias("start"))
    return w.select("doc_id", "start", F.least(F.lit(length), F.col("n") - F.col("start")).alias("tokens"), F.greatest(F.lit(0), length - (F.col("n") - F.col("start"))).alias("padding"))


def target_blocks(docs: DataFrame, width: int = 32) -> DataFrame:
    """record_id, offset, targets: features are begin + bytes, targets bytes + end, in blocks of ``width``."""
    n = F.octet_length("text") + 1
    return docs.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1, F.lit(width))).alias("offset")).select("doc_id", "offset", F.least(F.lit(width), F.col("n") - F.col("offset")).alias("targets"))


def block_index(blocks: DataFrame, per_shard: int, parts: int = 64) -> DataFrame:
    """Global row-major index, shard and ordinal without one global window: counts of id ranges first, then ranks within them."""
    cuts = blocks.select("doc_id").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    part = F.lit(0)
    for c in sorted(set(cuts)):  # at most `parts` of them
        part = part + F.when(F.col("doc_id") > c, 1).otherwise(0)
    b = blocks.withColumn("__p", part)
    size = dict(b.groupBy("__p").count().collect())
    before, acc = {}, 0
    for p in sorted(size):
        before[p], acc = acc, acc + size[p]
    base = F.lit(0).cast("bigint")
    for p, x in before.items():
        base = F.when(F.col("__p") == p, F.lit(x).cast("bigint")).otherwise(base)
    w = Window.partitionBy("__p").orderBy("doc_id", "offset")
    i = b.withColumn("block_index", base + F.row_number().over(w) - 1).drop("__p")
    return i.withColumn("shard", F.floor(F.col("block_index") / per_shard)).withColumn("ordinal", F.col("block_index") % per_shard)


def hash_chain(entries: DataFrame, shard: str, index: str, body: Column) -> DataFrame:
    """shard, entries, head: SHA-256 chain over the shard's entries in order; shards are of bounded size by their definition."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(index), body.alias("b")))), lambda x: x["b"])
    return entries.groupBy(shard).agg(F.count(F.lit(1)).alias("entries"), ordered.alias("o")).select(shard, "entries", F.aggregate("o", F.lit("0" * 64), lambda a, x: F.sha2(F.concat(a, x), 256)).alias("head"))


def overlapping_claims(claims: DataFrame) -> DataFrame:
    """Claims (segment, s, e, id) that start before the largest end of an earlier claim of their segment."""
    w = Window.partitionBy("segment").orderBy("s", "e", "id").rowsBetween(Window.unboundedPreceding, -1)
    return claims.withColumn("reach", F.max("e").over(w)).where("s < reach").select("segment", "id", "s", "e")
