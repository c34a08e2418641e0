"""Uniform sharding by a hypergeometric communication matrix (DataFrame functions only).

Rows get a number that a reliable checkpoint fixes, and lie in ``blocks`` source
blocks by a hash of it, so equal rows lie anywhere. Let n_p be a block's row
count and s_t a shard's exact size. The matrix of counts M[p][t] with these
margins is drawn from the law that a uniform shuffle gives it: blocks in turn
draw from what the shards still have room for, a multivariate hypergeometric
draw. Then each block permutes its own rows and deals M[p][0], M[p][1], ... of
them to the shards, the rows are exchanged, and each shard permutes what it got.
The result is a uniform random permutation with exact shard sizes.

The second permutation sorts a shard by a random key. It runs in many tasks even
for few shards: ranges of that key are cells of about ``rows_per_cell`` rows, and
a slot is the number of rows in the shard's earlier cells plus the rank in its
own. So the driver holds the matrix only, blocks x shards counts; blocks are at
most ``MOST_BLOCKS``, whatever the table. Cells are rows of a table.

Law: ``rows`` - shard counts differ by one at most. Equal texts are separate
rows here; no group can unbalance a shard.

Defined cases: null text has size 16 and crc32 0; null doc_ids are rows like
others, as are exact repeats. Very long texts only count their bytes. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

N_SHARDS, LEAST_BLOCKS, MOST_BLOCKS, ROWS_PER_BLOCK, ROWS_PER_CELL = 40, 64, 2_048, 200_000, 50_000


def hypergeometric(rng: random.Random, good: int, total: int, draws: int) -> int:
    """Successes among ``draws`` from ``total`` items of which ``good`` are successes: inversion from the mode."""
    if good == 0 or draws == 0:
        return 0
    if good == total:
        return draws
    lo, hi = max(0, draws - (total - good)), min(draws, good)
    lg = math.lgamma
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    bad = total - good
    log_p = (lg(good + 1) - lg(mode + 1) - lg(good - mode + 1) + lg(bad + 1) - lg(draws - mode + 1) - lg(bad - draws + mode + 1)) - (lg(total + 1) - lg(draws + 1) - lg(total - draws + 1))
    u, p = rng.random(), math.exp(log_p)
    u -= p
    if u < 0:
        return mode
    a = b = mode
    pa = pb = p
    while a > lo or b < hi:
        if b < hi:
            pb *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= pb
            if u < 0:
                return b
        if a > lo:
            pa *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= pa
            if u < 0:
                return a
    return mode


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """M[p][t] with row sums block_rows and column sums shard_rows, as a uniform shuffle would have it."""
    rng, room = random.Random(seed), list(shard_rows)
    out = []
    for n in block_rows:
        left, rest, row = n, sum(room), []
        for t, r in enumerate(room):
            x = hypergeometric(rng, r, rest, left)
            row.append(x)
            rest -= r
            left -= x
            room[t] = r - x
        out.append(row)
    return out


def _constant(values, kind: str) -> Column:
    """A constant array column that the optimizer folds."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def shuffle_shards(rows: DataFrame, n_shards: int = N_SHARDS, seed: int = 2024, rows_per_block: int = ROWS_PER_BLOCK, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """``rows`` (few and short columns) with ``shard`` (int) and ``slot`` (long, gapless from 0 within the shard)."""
    numbered = cut(rows.withColumn("__i", F.monotonically_increasing_id()))  # read once; from here on only these short rows move
    total = numbered.count()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, math.ceil(total / rows_per_block)))
    dealt = numbered.withColumn("__p", F.pmod(F.xxhash64(F.lit(seed), "__i"), F.lit(blocks)).cast("int"))
    counts = dict(dealt.groupBy("__p").count().collect())  # at most `blocks` rows
    block_rows = [counts.get(p, 0) for p in range(blocks)]
    shard_rows = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    # upper bounds of the local ranks that each shard takes: a row a block, blocks x shards numbers in all
    bounds = []
    for row in communication_matrix(block_rows, shard_rows, seed):
        acc, up = 0, []
        for x in row:
            acc += x
            up.append(acc)
        bounds.append(up)
    local = Window.partitionBy("__p").orderBy(F.xxhash64(F.lit(seed + 1), "__i"), "__i")
    ranked = dealt.withColumn("__r", F.row_number().over(local) - 1).withColumn("__up", F.get(_constant(bounds, "array<array<bigint>>"), F.col("__p")))
    steps = F.array(*[F.lit(2**k) for k in reversed(range(n_shards.bit_length()))])
    # number of shards whose upper bound is at most the rank: binary search
    shard = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size("__up")) & (F.get(F.col("__up"), at + s - 1) <= F.col("__r")), at + s).otherwise(at))
    key = F.xxhash64(F.lit(seed + 2), "__i")
    cells = max(1, math.ceil(total / n_shards / rows_per_cell))
    exchanged = cut(ranked.withColumn("shard", shard.cast("int")).withColumn("__k", key).withColumn("__c", F.pmod(F.shiftright("__k", 16), F.lit(cells)).cast("int")).drop("__p", "__up", "__r"))
    sizes = exchanged.groupBy("shard", "__c").agg(F.count(F.lit(1)).alias("n"))  # a row a cell
    before = sizes.withColumn("__first", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(F.col("shard").alias("__s"), F.col("__c").alias("__d"), "__first")
    again = Window.partitionBy("shard", "__c").orderBy("__k", "__i")
    placed = exchanged.withColumn("__rank", F.row_number().over(again) - 1).join(before, (F.col("shard") == F.col("__s")) & (F.col("__c") == F.col("__d")))
    return placed.withColumn("slot", (F.col("__first") + F.col("__rank")).cast("long")).drop("__i", "__k", "__c", "__rank", "__s", "__d", "__first")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 2024, **more) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    # the payload that moves is three numbers a row; texts stay where they are
    rows = docs.select("doc_id", (F.octet_length(text_of()) + 16).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    out = shuffle_shards(rows, n_shards, seed, **more)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
