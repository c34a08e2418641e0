"""MinHash near-deduplication with tensored banding; candidates are confirmed on full shingle sets.

Signatures. Two collections of ``halves`` sub-keys are made, each sub-key from
``rows`` minhashes. A table key is a pair of sub-keys, one of each collection:
``halves``^2 tables of 2 x ``rows`` minhashes come from 2 x halves x rows minhash
functions instead of 2 x halves^2 x rows. With 12 and 3, a link at exactly 0.8
is missed with probability 2 x (1 - 0.8^3)^12 = 4e-4, at 0.9 with 5e-7.

Candidates. Documents with equal sets form one class first. A table key can only
be shared where both its sub-keys are, so sub-keys that one class alone has are
dropped before pairs of them are formed; for most documents nothing remains.
Classes that share a table key are then linked by ``links.linked``: pivot rounds,
then an exact bound for the pairs that remain, all confirmed on whole sets.

Defined cases: a text without words (null, empty, white space) has no shingles
and is linked with nothing. A text with fewer words than ``width`` has its whole
word sequence as its one shingle. A row with a null doc_id is linked with
nothing and stays. Rows that repeat one doc_id are documents of their own, each
with the component of its own text: with equal texts the same one, with
different texts as the texts are linked; the order of rows has no influence.
``keep_representatives`` keeps one row of each component, the one with the
smallest doc_id (ties: the smallest text hash). Very long texts count whole.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_rows, cut, on_workers, release, text_of
from .links import busy, linked

WIDTH, HALVES, ROWS, PERCENT = 5, 12, 3, 80
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # exactly at \x20 and \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(width, len(h)), np.uint64)
    for k in range(min(width, len(h))):
        out = _mix(out * _M1 + h[k : k + n])
    return np.unique(out)


def signature(s: np.ndarray, halves: int, rows: int) -> np.ndarray:
    """2 x halves sub-keys; the first half belong to one collection, the others to the second."""
    rng = np.random.default_rng(20240229)
    total = 2 * halves * rows
    flip = rng.integers(0, 2**64, (total, 1), np.uint64)
    times = rng.integers(0, 2**63, (total, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(total, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        low = np.minimum(low, ((s[None, at : at + 2048] ^ flip) * times).min(axis=1))
    low = low.reshape(2 * halves, rows)
    key = np.arange(2 * halves, dtype=np.uint64)
    for r in range(rows):
        key = _mix(key * _M1 + low[:, r])
    return key


def signatures(docs: DataFrame, width: int, halves: int, rows: int) -> DataFrame:
    """doc_id, tie, n_shingles, set_key, keys array<long>; tie is a hash of the text, set_key a 128-bit hash of the set, null for an empty one."""
    arrow_rows(docs.sparkSession)
    on_workers(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.string()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            n, sets, keys = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                sets.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                keys.append(signature(s, halves, rows).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sets, pa.string()), pa.array(keys, pa.list_(pa.int64()))], schema=kind)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("tie"), text_of().alias("text")).mapInArrow(run, "doc_id long, tie long, n_shingles long, set_key string, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, n, s): the whole shingle sets of ``wanted`` (id, doc, set_key) as sorted arrays of 64-bit hashes. A text of that id with another set is not the one."""
    kind = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, sets = [], []
            for i, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingles(text, width)
                if xxhash.xxh3_128_hexdigest(s.tobytes()) == key:
                    ids.append(i)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], schema=kind)

    thin = docs.select(docs["doc_id"].cast("long").alias("__doc"), text_of().alias("text"))
    return thin.join(wanted, F.col("__doc") == F.col("doc")).select("id", "set_key", "text").mapInArrow(run, "id long, n long, s array<long>")


def shared_sides(classes: DataFrame, halves: int) -> DataFrame:
    """(id, n, x, y): of each class the sub-keys of both collections that other classes have too. classes: id, n, keys."""
    sub = classes.select("id", "n", F.posexplode("keys").alias("pos", "val")).withColumn("key", F.xxhash64("pos", "val"))
    first, second = F.col("pos") < halves, F.col("pos") >= halves
    sides = busy(sub).groupBy("id", "n").agg(F.collect_set(F.when(first, F.col("key"))).alias("x"), F.collect_set(F.when(second, F.col("key"))).alias("y"))  # at most `halves` each
    return sides.where("size(x) > 0 and size(y) > 0")


def table_rows(sides: DataFrame) -> DataFrame:
    """(id, n, key): a row for each pair of sub-keys, one of each collection."""
    return sides.select("id", "n", F.explode("x").alias("x"), "y").select("id", "n", "x", F.explode("y").alias("y")).select("id", "n", F.xxhash64("x", "y").alias("key"))


def near_classes(docs: DataFrame, width: int, percent: int, halves: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(sigs, named): the signatures of all rows, and for each set_key the smallest (doc_id, tie) of its component: set_key, doc, tie."""
    spark = docs.sparkSession
    sigs = cut(signatures(docs, width, halves, rows))
    usable = sigs.where("set_key is not null and doc_id is not null")
    # a class is named by a number of its own: one doc_id may stand on texts of several classes. The checkpoint fixes the numbers.
    first = usable.groupBy("set_key").agg(F.min(F.struct("doc_id", "tie", "n_shingles", "keys")).alias("f"))
    classes = cut(first.select(F.monotonically_increasing_id().alias("id"), "set_key", F.col("f.doc_id").alias("doc"), F.col("f.tie").alias("tie"), F.col("f.n_shingles").alias("n"), F.col("f.keys").alias("keys")))
    tables = cut(table_rows(shared_sides(classes.select("id", "n", "keys"), halves)))
    # a class's weight is its number of table rows shared with others: the original of many near copies has the greatest
    size = tables.groupBy("key", F.xxhash64("key")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"), "c")
    met = tables.join(size, F.col("key") == F.col("k"))
    rest = cut(met.select("id", "n", "key", F.sum("c").over(Window.partitionBy("id")).alias("w")))
    wanted = classes.select("id", "doc", "set_key").join(rest.select(F.col("id").alias("b")).distinct(), F.col("id") == F.col("b"), "left_semi")
    sets = full_sets(docs, wanted, width)
    if not usable.groupBy("doc_id").count().where("count > 1").isEmpty():  # rows that repeat an id may give a set twice
        sets = sets.dropDuplicates(["id"])
    sets = cut(sets)
    del tables, size, met, wanted
    release(spark)
    comp = linked(rest, sets, percent)
    least = comp.join(classes.select("id", "doc", "tie"), F.col("node") == F.col("id")).groupBy("component", F.xxhash64("component")).agg(F.min(F.struct("doc", "tie")).alias("least")).select(F.col("component").alias("c"), "least")
    joined = comp.join(least, F.col("component") == F.col("c")).select("node", "least")
    own = F.struct("doc", "tie")
    named = classes.join(joined, F.col("id") == F.col("node"), "left").select("set_key", F.coalesce("least", own).alias("least"))
    return sigs, named.select("set_key", "least.doc", "least.tie")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sigs, named = near_classes(docs, width, percent, halves, rows)
    named = named.select(F.col("set_key").alias("__key"), F.col("doc").alias("__c"))
    out = sigs.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(named, F.col("set_key") == F.col("__key"), "left")
    component = F.coalesce("__c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """The documents that stay, one row of each component and every row without an id or a word, with all their columns."""
    sigs, named = near_classes(docs, width, percent, halves, rows)
    best = named.select(F.col("set_key").alias("__key"), F.col("doc").alias("__doc"), F.col("tie").alias("__least"))
    judged = sigs.select("doc_id", "tie", "set_key").where("set_key is not null and doc_id is not null").join(best, F.col("set_key") == F.col("__key"))
    stays = (F.col("doc_id") == F.col("__doc")) & (F.col("tie") == F.col("__least"))
    # a row goes unless it is its component's representative; decided by (doc_id, text hash), as an id may stand on several texts
    decided = cut(judged.groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("c"), F.bool_or(stays).alias("stays")))
    lost = decided.where("not stays").select(F.col("doc_id").alias("__lost"), F.col("tie").alias("__tie"))
    text_hash = F.xxhash64(text_of())
    marked = docs.withColumn("__text", text_hash)
    out = marked.join(lost, (marked["doc_id"] == lost["__lost"]) & (marked["__text"] == lost["__tie"]), "left_anti")
    twice = decided.where("stays and c > 1").select(F.col("doc_id").alias("__twice"), F.col("tie").alias("__tie"))
    if not twice.isEmpty():
        both = (out["doc_id"] == twice["__twice"]) & (out["__text"] == twice["__tie"])
        out = out.join(twice, both, "left_anti").unionByName(out.join(twice, both, "left_semi").dropDuplicates(["doc_id", "__text"]))
    return out.drop("__text")
