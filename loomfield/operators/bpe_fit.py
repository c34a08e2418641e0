"""Byte-pair fitting over distinct pre-tokens, and the ordered-merge encoder (reference coverage only; nothing is trained for the pipeline)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_MERGE = 260  # fixed value: bytes 0..255, then four specials


def pretoken_counts(docs: DataFrame) -> DataFrame:
    """Distinct pre-tokens with counts: what a fit needs of a corpus of any size."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(r" ?\S+|\s+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def fit(counts: list[tuple[str, int]], merges: int) -> list[tuple[int, int]]:
    """Most frequent adjacent pair first (ties: the smallest pair), until a pair occurs less than twice. ``counts`` are aggregated pre-tokens."""
    words = [(list(w.encode()), n) for w, n in counts]
    out: list[tuple[int, int]] = []
    for new in range(FIRST_MERGE, FIRST_MERGE + merges):
        pairs: Counter = Counter()
        for ids, n in words:
            for p in zip(ids, ids[1:]):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < 2:
            break
        out.append(best)
        words = [(apply(ids, best, new), n) for ids, n in words]
    return out


def apply(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    out, i = [], 0
    while i < len(ids):
        if tuple(ids[i : i + 2]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def encode(text: str, merges: list[tuple[int, int]]) -> list[int]:
    """The lowest-ranked pair present is merged first, everywhere; equal to applying all merges in order."""
    rank = {p: FIRST_MERGE + k for k, p in enumerate(merges)}
    ids = list(text.encode())
    while pair := min((p for p in zip(ids, ids[1:]) if p in rank), key=rank.get, default=None):
        ids = apply(ids, pair, rank[pair])
    return ids


def decode(ids: list[int], merges: list[tuple[int, int]]) -> str:
    table = {b: bytes([b]) for b in range(256)}
    for k, (a, b) in enumerate(merges):
        table[FIRST_MERGE + k] = table[a] + table[b]
    return b"".join(table.get(i, b"") for i in ids).decode("utf-8", "replace")


def subtract(a: int, b: int, holes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """[a, b) without sorted disjoint ranges."""
    out = []
    for s, e in holes:
        if s > a:
            out.append((a, min(s, b)))
        a = max(a, e)
    return [*out, (a, b)] if a < b else [r for r in out if r[0] < r[1]]
