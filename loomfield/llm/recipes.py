"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

Each normalised text is cut where its own content says (after ``.`` or a line
end, at least ``min_chunk`` and at most ``max_chunk`` characters in), so equal
passages give equal chunks wherever they stand. A chunk's identifier is its
64-bit hash, *verified*: every distinct chunk text is moved once, grouped by
(hash, text), and a hash that carries several texts is split into numbered
identifiers. Documents are then equal exactly when their ordered identifier
lists are equal, and only those lists (eight bytes for about a thousand
characters) move when documents are compared.

Skew: chunks are combined on the map side before they move, so a chunk that a
third of the corpus shares costs one row a task. Lists are grouped with a
map-side maximum and count; the groups get an exchange of their own (they are
grouped by the list and its hash), so adaptive execution can split the partition
of a hot list in the join that returns the result to each document.

Defined cases: null text is the empty text, whose list is empty; all empty
texts are equal. A null doc_id never wins over another; a group of null ids only
has keep_id null and keeps them. Rows repeated with one doc_id and one text are
one document and share ``kept``; rows of one doc_id with different texts are
judged each by its own text. Very long texts are cut like others. Empty tables
give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, text_of

MIN_CHUNK, MAX_CHUNK = 768, 8192


def chunk_column(norm: Column, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK) -> Column:
    """Ordered chunks whose concatenation is the text."""
    pattern = rf"(?s).{{{min_chunk},{max_chunk - 1}}}?[.\n]|.{{1,{max_chunk}}}"
    return F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))


def _hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def colliding_hashes(docs: DataFrame, chunk_hash=_hash, **sizes) -> DataFrame:
    """Hashes under which more than one chunk text exists: (h). The chunk texts move once, combined."""
    chunks = docs.select(F.explode(chunk_column(ascii_lower(text_of()), **sizes)).alias("chunk"))
    distinct = chunks.select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    return distinct.groupBy("h").count().where("count > 1").select("h")


def recipes(docs: DataFrame, chunk_hash=_hash, **sizes) -> DataFrame:
    """(doc_id, n_chars, recipe, text_sha256): each document's ordered verified chunk identifiers."""
    norm = docs.select("doc_id", ascii_lower(text_of()).alias("norm"))
    plain = norm.select(
        "doc_id",
        F.length("norm").cast("long").alias("n_chars"),
        F.transform(chunk_column(F.col("norm"), **sizes), chunk_hash).alias("recipe"),
        F.sha2(F.col("norm"), 256).alias("text_sha256"),
    )
    bad = colliding_hashes(docs, chunk_hash, **sizes).select(F.col("h").alias("bad"))
    if bad.isEmpty():  # each hash names one chunk text: the hashes are the verified identifiers
        return plain
    # A hash with several texts: number them, and append the number to the hash in every list.
    pieces = docs.select(ascii_lower(text_of()).alias("norm")).select(
        F.length("norm").cast("long").alias("n_chars"), F.sha2("norm", 256).alias("text_sha256"), F.posexplode_outer(chunk_column(F.col("norm"), **sizes)).alias("pos", "chunk")
    )
    pieces = pieces.withColumn("h", chunk_hash(F.col("chunk")))
    rivals = pieces.select("h", "chunk").distinct().join(bad, F.col("h") == F.col("bad"), "left_semi")
    numbered = rivals.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("chunk"))).select(F.col("h").alias("rh"), F.col("chunk").alias("rc"), "k")
    pieces = pieces.join(numbered, (F.col("h") == F.col("rh")) & (F.col("chunk") == F.col("rc")), "left")
    entry = F.struct("pos", "h", F.coalesce("k", F.lit(1)).alias("k"))
    lists = pieces.groupBy(F.col("text_sha256").alias("__t"), F.col("n_chars").alias("__n")).agg(F.sort_array(F.collect_set(F.when(F.col("pos").isNotNull(), entry))).alias("e"))
    lists = lists.select("__t", "__n", F.flatten(F.transform("e", lambda x: F.array(x["h"], x["k"].cast("long")))).alias("recipe"))
    every = plain.select("doc_id", "n_chars", "text_sha256")
    return every.join(lists, (F.col("text_sha256") == F.col("__t")) & (F.col("n_chars") == F.col("__n"))).select("doc_id", "n_chars", "recipe", "text_sha256")


def _groups(rows: DataFrame) -> DataFrame:
    """(n_chars, recipe, keep_id, group_size) of each list."""
    return rows.groupBy("n_chars", "recipe", F.xxhash64("recipe")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).select("n_chars", "recipe", "keep_id", "group_size")


def exact_groups(docs: DataFrame, chunk_hash=_hash, **sizes) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = recipes(docs, chunk_hash, **sizes)
    return rows.join(_groups(rows), ["n_chars", "recipe"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_unique(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows that repeat one doc_id and text stay once.

    A decision belongs to an id and its text: null ids and ids with several texts are common to rows that are no copies. Only
    the decisions on groups of two and more are written down, and rows are kept unless one names them.
    """
    rows = recipes(docs)
    copies = rows.join(_groups(rows).where("group_size > 1"), ["n_chars", "recipe"])
    decided = cut(copies.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("stays")))
    named = docs.withColumn("__text", F.sha2(ascii_lower(text_of()), 256))

    def among(which: str) -> tuple:
        some = decided.where(which).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
        return some, named["doc_id"].eqNullSafe(some["__id"]) & (named["__text"] == some["__sha"])

    out = named.join(*among("not stays"), "left_anti")
    if not decided.where("stays and n > 1").isEmpty():
        out = out.join(*among("stays and n > 1"), "left_anti").unionByName(named.join(*among("stays and n > 1"), "left_semi").dropDuplicates(["doc_id", "__text"]))
    return out.drop("__text")
