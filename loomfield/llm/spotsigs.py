"""SpotSigs document fingerprints (DataFrame functions only).

A text's words are runs of letters and digits of its lower-cased form. *Anchors*
are common function words (``COMMON_WORDS``); all other words are content words.
Each anchor with the ``CHAIN`` content words that follow it (fewer at the end, at
least one) is one spot signature, kept as a 31-bit hash; a text's fingerprint is
its set of signatures. Stretches without any common word, such as tables and
lists, would have no anchor: there, and only there (no common word within
``REACH`` words), a word whose CRC-32 is divisible by ``RARE_ANCHOR`` is one. A
text without any signature has the windows of ``CHAIN`` words at each of its
words instead; a text without words has the empty fingerprint.

The fingerprint is written as the set's sorted hexadecimal hashes, so equal
texts have equal fingerprints and a likeness can be computed from two
fingerprints alone: Jaccard similarity, 1 for two empty ones.

``near_classes`` finds what is alike at ``percent`` or more: sets are partitioned
by length, as only sets whose lengths differ by at most the factor percent / 100
can reach it, and within a partition candidates must share one of their first
n - ceil(percent x n / 100) + 1 signatures. Such buckets are linked by
``links.linked``, which prunes by size, prefix and position and compares whole
sets. Before that, sets go that have too few signatures in common with any other.

``next_in_order`` gives each row its successor without one global window: ids
are cut at quantiles into blocks, the first row of each block also joins the
block before it, and a window runs in each block. Blocks have some hundred rows
and are at most ``most_blocks``; beyond that many they grow with the table, and
their sort spills.

Defined cases: null text is empty. Null doc_ids sort last. Rows that tie in
doc_id are ordered by the text's hash. One row alone follows itself. A class of
null doc_ids only is named null. Very long texts count whole. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, release, text_of
from .links import busy, linked

# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = """
a about all an and are as at be been but by can did do for from had has have he her his i if in is it its more not of on one or our out said she so than that the their them there they this to up was we were what when which who will with would you
aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist man mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war wenn wie wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur un une vous y
al como con cuando de del desde el ella en entre era es esta este fue ha hay la las le lo los mas me mi muy no nos o para pero por porque que se ser si sin sobre su sus también un una y ya
""".split()

CHAIN, RARE_ANCHOR, REACH, PERCENT = 3, 11, 8, 80


def words_of(text: Column) -> Column:
    """The words of the text in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _anchors(words: Column) -> Column:
    """Whether each word is an anchor: common words, and rare ones with no common word within ``REACH`` words."""

    def flags(common):
        def one(x, i):
            near = F.slice(common, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH)) + REACH + 1)
            return F.when(x["c"], F.lit(True)).when(F.crc32(x["w"].cast("binary")) % RARE_ANCHOR == 0, ~F.exists(near, lambda c: c)).otherwise(F.lit(False))

        return F.transform(F.zip_with(words, common, lambda w, c: F.struct(w.alias("w"), c.alias("c"))), one)

    return let(F.transform(words, lambda w: w.isin(*sorted(set(COMMON_WORDS)))), flags)


def _short(h: Column) -> Column:
    """The upper 31 bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 33).cast("int")


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct spot signatures of the text, as array<int>."""

    def spots(words):
        # A run of content words before the j-th anchor moves its rank among content words to (position - j).
        flagged = F.zip_with(words, _anchors(words), lambda w, a: F.struct(w.alias("w"), a.alias("a")))
        return let(flagged, lambda f: let(F.filter(F.transform(f, lambda x, i: F.when(x["a"], i)), lambda i: i.isNotNull()), lambda at: let(F.filter(f, lambda x: ~x["a"]), lambda content: of(f, at, content))))

    def of(f, at, content):
        links = [lambda i, j, k=k: F.get(content, i - j + k)["w"] for k in range(chain)]
        spot = F.transform(at, lambda i, j: F.when(i - j < F.size(content), _short(F.xxhash64(F.get(f, i)["w"], *[g(i, j) for g in links]))))
        return F.filter(spot, lambda h: h.isNotNull())

    def windows(words):
        return F.transform(words, lambda w, i: _short(F.xxhash64(w, *[F.get(words, i + k) for k in range(1, chain)])))

    def whole(words):
        found = let(spots(words), lambda s: F.when(F.size(s) > 0, s).otherwise(windows(words)))
        return F.sort_array(F.array_distinct(found))

    return let(words_of(text), whole)


def fingerprint(sigs: Column) -> Column:
    """The set as a string: eight hexadecimal digits a signature, in order."""
    return F.array_join(F.transform(sigs, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; 1 for two empty ones."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def next_in_order(rows: DataFrame, key: str, ties: str, carry: dict[str, str], derive: dict[str, Column] | None = None, rows_per_block: int = 256, most_blocks: int = 16_384) -> DataFrame:
    """``rows`` with the columns ``carry`` (name -> new name) of the next row in descending ``key``; the first follows the last.

    Columns of ``derive`` are computed after the rows have moved, so that they need not move.
    """
    keys = rows.select(F.col(key).cast("long").alias("k"))
    n = keys.count()
    blocks = max(1, min(most_blocks, math.ceil(n / rows_per_block)))
    cuts = keys.agg(F.percentile_approx("k", [i / blocks for i in range(1, blocks)], 10 * blocks)).first()[0] if blocks > 1 else None
    cuts = sorted(set(cuts or []))  # bounded by most_blocks
    bound = F.from_json(F.lit(str(cuts)), "array<bigint>")
    steps = F.array(*[F.lit(2**k) for k in reversed(range(max(1, len(cuts).bit_length())))])
    # number of cuts below the key by binary search; a null key is in the lowest block
    at = F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= len(cuts)) & (F.get(bound, a + s - 1) < F.col(key)), a + s).otherwise(a)) if cuts else F.lit(0)
    block = F.coalesce(at, F.lit(0))
    tops = dict(keys.select(F.coalesce(at if not cuts else F.aggregate(steps, F.lit(0), lambda a, s: F.when((a + s <= len(cuts)) & (F.get(bound, a + s - 1) < F.col("k")), a + s).otherwise(a)), F.lit(0)).alias("b"), "k").groupBy("b").agg(F.max("k")).collect())
    order = sorted(tops, reverse=True)  # blocks in the order of the rows
    above = {b: a for a, b in zip(order, order[1:])}  # the block that reads this block's first row
    if order:
        above[order[0]] = order[-1]
    guest_of = F.from_json(F.lit(str([above.get(b, -1) for b in range(len(cuts) + 1)])), "array<int>")
    top_of = F.from_json(F.lit(str([tops.get(b) if tops.get(b) is not None else "null" for b in range(len(cuts) + 1)]).replace("'", "")), "array<bigint>")
    placed = rows.withColumn("__b", block)
    is_top = F.get(top_of, F.col("__b")).eqNullSafe(F.col(key).cast("long"))
    own = F.struct(F.col("__b").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(guest_of, F.col("__b")).alias("b"), F.lit(1).alias("guest"))
    dealt = placed.withColumn("__to", F.explode(F.when(is_top, F.array(own, guest)).otherwise(F.array(own)))).withColumn("__g", F.col("__to.guest")).withColumn("__b", F.col("__to.b")).drop("__to")
    w = Window.partitionBy("__b").orderBy("__g", F.col(key).desc_nulls_last(), ties)
    led = dealt.repartition("__b").withColumns(derive or {})
    for name, new in carry.items():
        led = led.withColumn(new, F.lead(name).over(w))
    return led.where("__g = 0").drop("__b", "__g")


def _class_key(sigs: Column) -> Column:
    """128 bits that name a fingerprint."""
    return F.struct(F.xxhash64(sigs).alias("k"), F.xxhash64(F.lit(1), sigs).alias("l"))


def near_classes(docs: DataFrame, percent: int = PERCENT, chain: int = CHAIN) -> DataFrame:
    """(k, l, class_id, component_id): a row a fingerprint, named by its class key; a reliable table.

    class_id is the smallest doc_id with that fingerprint; component_id the smallest doc_id that can be reached over fingerprints
    with a likeness of ``percent`` or more.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signatures(text_of(), chain).alias("s")).select("doc_id", "s", _class_key(F.col("s")).alias("key"))
    first = rows.groupBy("key.k", "key.l").agg(F.min("doc_id").alias("class_id"), F.any_value("s").alias("s"))
    classes = cut(first.select(F.monotonically_increasing_id().alias("id"), "k", "l", "class_id", "s", F.size("s").cast("long").alias("n")))
    release(spark)
    # The order of signatures by value is one that all sets share. Let a set's head be its first n - ceil(percent x n / 100) + 1.
    # Linked sets share one signature of both heads, and in about twice that length as many as the shorter head has; most sets
    # have fewer there that any other set has, and go here.
    out_of = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100 - F.lit(1e-9))
    least = F.ceil(F.col("n") * F.lit(percent) / 100 - F.lit(1e-9))  # size of the smallest partner
    need = least - F.ceil(least * F.lit(percent) / 100 - F.lit(1e-9)) + 1
    starts = classes.where("n > 0").select("id", need.cast("int").alias("need"), F.explode(F.slice("s", F.lit(1), (2 * out_of + 1).cast("int"))).alias("key"))
    seen = starts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"))
    enough = starts.join(seen, F.col("key") == F.col("k"), "left_semi").groupBy("id", "need").agg(F.count(F.lit(1)).alias("m")).where("m >= need").select(F.col("id").alias("i"))
    able = cut(classes.select("id", "n", "s").join(enough, F.col("id") == F.col("i"), "left_semi"))
    del starts, seen, enough
    release(spark)
    prefix = able.select("id", "n", F.explode(F.slice("s", F.lit(1), (out_of + 1).cast("int"))).alias("key"))
    # partition number by set length: lengths within the factor are in the same or neighbouring partitions, so a set is in its own and the next
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(percent / 100)) + F.lit(1e-9))
    placed = busy(prefix).select("id", "n", "key", F.explode(F.array(part, part + 1)).alias("p")).select("id", "n", F.xxhash64("key", "p").alias("key"))
    found = cut(busy(placed))
    del prefix, placed
    release(spark)
    sets = cut(able.join(found.select(F.col("id").alias("b")).distinct(), F.col("id") == F.col("b"), "left_semi"))
    # a set's weight is how common its signatures are on average: the original of many near copies has the greatest
    spots = sets.select("id", F.explode("s").alias("h"))
    spread = spots.groupBy("h", F.xxhash64("h")).agg(F.count(F.lit(1)).alias("df")).select(F.col("h").alias("e"), "df")
    weights = spots.join(spread, F.col("h") == F.col("e")).groupBy("id").agg(F.avg(F.log("df")).alias("w")).select(F.col("id").alias("i"), "w")
    rest = cut(found.join(weights, F.col("id") == F.col("i")).select("id", "n", "key", "w"))
    del found, spots, spread, weights
    comp = linked(rest, sets, percent, every_bucket=False)
    least = comp.join(classes.select("id", "class_id"), F.col("node") == F.col("id")).groupBy("component", F.xxhash64("component")).agg(F.min("class_id").alias("least")).select(F.col("component").alias("c"), "least")
    joined = comp.join(least, F.col("component") == F.col("c")).select("node", "least")
    out = cut(classes.select("id", "k", "l", "class_id").join(joined, F.col("id") == F.col("node"), "left").select("k", "l", "class_id", F.coalesce("least", "class_id").alias("component_id")))
    del able, rest, sets, comp, classes
    release(spark)
    return out


def compare_with_next(docs: DataFrame, chain: int = CHAIN, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, component_id of every document.

    The edited text has its last floor(n_chars / 3) characters replaced by the
    first as many (or all) of the next document in descending doc_id.
    """
    classes = near_classes(docs, percent, chain).select(F.col("k").alias("__k"), F.col("l").alias("__l"), "class_id", "component_id")
    rows = docs.select("doc_id", text_of().alias("text")).select("doc_id", "text", F.xxhash64("text").alias("tie"))
    led = next_in_order(rows, "doc_id", "tie", {"text": "next_text", "sigs": "next_sigs"}, {"sigs": signatures(F.col("text"), chain)})
    led = led.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring("next_text", F.lit(1), third))

    def digest(e):
        return F.struct(F.sha2(e, 256).alias("sha"), signatures(e, chain).alias("sigs"))

    led = led.withColumn("__e", let(edited, digest))
    # from here on no text moves; sets move as numbers and are written as strings last
    thin = led.select(
        "doc_id",
        "n_chars",
        F.col("__e.sha").alias("edited_sha256"),
        "sigs",
        F.col("__e.sigs").alias("edited_sigs"),
        likeness(F.col("sigs"), F.col("__e.sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    ).withColumn("__key", _class_key(F.col("sigs")))
    out = thin.join(classes, (F.col("__key.k") == F.col("__k")) & (F.col("__key.l") == F.col("__l")), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id", "component_id")
