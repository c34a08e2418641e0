"""Best-fit packing with large-item matching.

A document's ids (its text's, then the end id) are one piece, or, if there are
more than ``capacity``, pieces of ``capacity`` ids of which the first may be
shorter. Only lengths matter for packing, so the plan is made from the histogram
of piece lengths: at most ``capacity`` counts reach the driver, whatever the
number of pieces.

1. Large pieces, above a third of the capacity: at most two fit a bin. From the
   largest down, each is matched with the largest large piece that still fits.
2. Smaller pieces, from the largest down, go to the bin with the smallest gap
   that holds them; where none does, new bins are opened.

Bins with equal contents are one plan entry with a multiplicity. A piece then
finds its place from its rank among pieces of its length. Ranks are made in two
levels, (length, hash block) counts and ranks within a block, so one length that
a third of all pieces share is spread over many tasks.

Defined cases: null text is empty: one piece, the end id alone. Repeated rows are
packed as rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import arrow_rows, cut, on_workers, text_of

CAPACITY, END_ID = 1024, 2


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids] of every piece of every document."""
    arrow_rows(docs.sparkSession)
    on_workers(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    kind = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches):
        c = codec(path)
        for batch in batches:
            cols: list[list] = [[] for _ in kind]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = c.encode_packed(text) + end
                for k, (start, length) in enumerate(piece_bounds(len(packed) // 4, capacity)):
                    own = packed[4 * start : 4 * (start + length)]
                    row = (doc_id, k, start, length, zlib.crc32(own)) + ((np.frombuffer(own, "<u4").tolist(),) if with_ids else ())
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, kind, strict=True)], schema=kind)

    more = ", ids array<int>" if with_ids else ""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, f"doc_id long, piece int, start long, length long, ids_crc32 long{more}")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths in order, number of such bins) for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    bins: list[tuple[list[int], int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]  # indexes of bins with this gap

    def add(items: list[int], many: int) -> None:
        bins.append((items, many))
        by_gap[capacity - sum(items)].append(len(bins) - 1)

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            left[a] -= 1
            b = next((x for x in large if x <= capacity - a and left[x]), None)
            left[a] += 1
            if b is None:
                many, items = left[a], [a]
            elif b == a:
                many, items = left[a] // 2, [a, a]
            else:
                many, items = min(left[a], left[b]), [a, b]
            for x in items:
                left[x] -= many
            add(items, many)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        need = left[n]
        while need:
            gap = next((g for g in range(n, capacity + 1) if by_gap[g]), None)
            if gap is None:
                each = capacity // n
                if need >= each:
                    add([n] * each, need // each)
                if need % each:
                    add([n] * (need % each), 1)
                break
            k = by_gap[gap].pop()
            items, many = bins[k]
            take = min(need, many)
            if take < many:
                bins[k] = (items, many - take)
                by_gap[gap].append(k)
                add([*items, n], take)
            else:
                bins[k] = ([*items, n], many)
                by_gap[gap - n].append(k)
            need -= take
    return bins


def places(bins: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int]]]:
    """length -> (first rank, sequence of that rank, offset), by rank; later ranks of an entry go to later sequences."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    base = 0
    for items, many in bins:
        at = 0
        for n in items:
            out.setdefault(n, []).append((rank.get(n, 0), base, at))
            rank[n] = rank.get(n, 0) + many
            at += n
        base += many
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, rows_per_block: int = 100_000) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset. Reads ``pieces`` twice: pass a materialised table."""
    spark = pieces.sparkSession
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    found = places(plan_bins(counts, capacity))
    rows = [(n, [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for n, v in sorted(found.items())]
    plan = spark.createDataFrame(rows, "__n long, __from array<long>, __seq array<long>, __at array<long>")
    most = max((len(v) for v in found.values()), default=1)

    blocks = max(64, math.ceil(sum(counts.values()) / rows_per_block))
    dealt = pieces.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    block = dealt.groupBy("length", "__b").count()
    before = block.select(F.col("length").alias("__l"), F.col("__b").alias("__k"), (F.sum("count").over(Window.partitionBy("length").orderBy("__b")) - F.col("count")).alias("__before"))
    ranked = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("__l")) & (F.col("__b") == F.col("__k"))).withColumn("__rank", F.col("__before") + F.col("__r"))
    # the plan has one row a length: its size is bounded by the capacity
    ranked = ranked.join(F.broadcast(plan), F.col("length") == F.col("__n"))
    steps = F.array(*[F.lit(2**k) for k in reversed(range(most.bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= F.size("__from")) & (F.get("__from", a + s - 1) <= F.col("__rank")), a + s).otherwise(a))
    ranked = ranked.withColumn("__i", at - 1)
    return ranked.select(
        *[c for c in pieces.columns],
        (F.get("__seq", F.col("__i")) + F.col("__rank") - F.get("__from", F.col("__i"))).cast("long").alias("sequence_id"),
        F.get("__at", F.col("__i")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(cut(token_pieces(docs, path, capacity, end_id)), capacity)


def packed_sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, ids array<int> (at most ``capacity``), doc_ids and starts of their pieces."""
    placed = pack_pieces(cut(token_pieces(docs, path, capacity, end_id, with_ids=True)), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "ids")))  # at most `capacity` pieces
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))
