"""Components of sets under Jaccard similarity, from buckets of candidates (DataFrame functions only).

A bucket is a key that any two linked sets share at least once. Within a bucket
no pairs are enumerated: members are compared with the bucket's pivot, first the
member of the greatest weight (how common its elements are, so the middle of a
group of near copies, which most of the group is linked to), in later rounds that
member of its largest component that comes first in a random order. Linked sets
are contracted; buckets that still hold several components get further pivot
rounds, until a round links less than one in ``least_gain`` of its pairs. The pairs that
remain between components of a bucket are then narrowed down by exact bounds on
the whole sets (prefix, position, and a bitmap of element parities, whose
differing bits are at most the elements that the sets do not share) and all
compared, once each. So every pair
that shares a bucket ends in one component or is known to be no link: nothing is
capped, and a group of n near copies costs about n comparisons a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release
from .components import components


def busy(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` (id, n, key) whose key several sets have; distinct rows."""
    shared = rows.groupBy("key", F.xxhash64("key")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"))
    return rows.join(shared, F.col("key") == F.col("k"), "left_semi")


def parities(elements: Column) -> list[Column]:
    """128 bits as two numbers: a bit is set if an odd number of elements fall on it."""

    def half(k):
        def flip(bits, e):
            at = F.xxhash64(e).bitwiseAND(127)
            on = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
            return bits.bitwiseXOR(F.when(F.shiftright(at, 6) == k, on).otherwise(F.lit(0).cast("long")))

        return F.aggregate(elements, F.lit(0).cast("long"), flip)

    return [half(0), half(1)]


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are alike: 100 x intersection >= percent x union."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
    # sizes alone rule many pairs out, before any set moves
    sized = pairs.join(left, "a").join(right, "b").where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))
    common = F.size(F.array_intersect("sa", "sb"))
    return sized.withColumn("__i", common).where(100 * F.col("__i") >= percent * (F.col("na") + F.col("nb") - F.col("__i"))).select("a", "b")


def linked(rest: DataFrame, sets: DataFrame, percent: int, least_gain: int = 10, every_bucket: bool = True) -> DataFrame:
    """(node, component) of the sets with a link. rest: busy rows (id, n, key, w), a reliable table, w being an id's weight as a first pivot; sets: id, n, s of every id in it.

    In a round a set is compared with the pivots of all its buckets, or of the largest one only, which suits sets with many buckets.
    """
    spark = rest.sparkSession
    rest = rest.withColumn("comp", F.col("id"))
    alike = lambda x, y: (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))
    comp = rest.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)  # of linked sets only
    turn, stuck = 0, False
    while True:
        # buckets that still hold several components; each has a largest one, and minor rows besides it
        each = rest.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.max("w").alias("w"))
        sized = cut(each.groupBy("key").agg(F.max(F.struct("c", "w", "comp")).alias("most"), F.count(F.lit(1)).alias("m")).where("m > 1"))
        if sized.isEmpty():
            break
        named = sized.select(F.col("key").alias("k"), F.col("most.comp").alias("main"))
        rest = cut(rest.join(named, F.col("key") == F.col("k")).select("id", "n", "key", "w", "comp", "main"))
        if stuck:
            pairs = _remaining_pairs(rest, sets, percent)
        else:
            # one order for all buckets, so that a group has few pivots; they are of the largest component, so only minor rows are compared
            rank = F.xxhash64(F.lit(turn), "id") if turn else -F.col("w")
            order = F.struct(rank.alias("o"), F.col("id").alias("p"), F.col("n").alias("pn"))
            pivots = rest.groupBy("key", F.xxhash64("key")).agg(F.min(F.when(F.col("comp") == F.col("main"), order)).alias("first"), F.count(F.lit(1)).alias("c")).select(F.col("key").alias("k"), "c", "first.p", "first.pn")
            near = rest.where("comp <> main").join(pivots, F.col("key") == F.col("k")).where(alike("n", "pn"))
            if not every_bucket:
                near = near.groupBy("id").agg(F.max(F.struct("c", "p")).alias("m")).select("id", "m.p")
            pairs = near.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
        pairs = cut(pairs)
        release(spark)
        links = cut(confirm(pairs, sets, percent))
        release(spark)
        gained = links.count()
        last, stuck = stuck, gained == 0 or least_gain * gained < pairs.count()  # a round without a link changes nothing, so none may follow it
        comp = cut(_merged(comp, links))
        if last:
            break
        now = comp.select(F.col("node").alias("nid"), F.col("component").alias("nc"))
        rest = cut(rest.join(now, F.col("id") == F.col("nid"), "left").select("id", "n", "key", "w", F.coalesce("nc", "id").alias("comp")))
        turn += 1
        del each, sized, named, pairs, links, now
        release(spark)
    return comp


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after ``links`` (a, b): only the components that they join are worked on, not their members."""
    x, y = comp.select(F.col("node").alias("x"), F.col("component").alias("cx")), comp.select(F.col("node").alias("y"), F.col("component").alias("cy"))
    new = components(links.join(x, F.col("a") == F.col("x"), "left").join(y, F.col("b") == F.col("y"), "left").select(F.coalesce("cx", "a").alias("a"), F.coalesce("cy", "b").alias("b")))
    to = new.select(F.col("node").alias("was"), F.col("component").alias("is"))
    moved = comp.join(to, F.col("component") == F.col("was"), "left").select("node", F.coalesce("is", "component").alias("component"))
    return moved.union(new.join(comp.select(F.col("node").alias("had")), F.col("node") == F.col("had"), "left_anti"))


def _remaining_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) between components of one bucket that can still be links, each once.

    One of the two is minor in their bucket, so minor rows are joined with all. With its elements in order of rarity, a set of
    n elements must share one of its first n - ceil(percent x n / 100) + 1 with any set it is linked to, and from the first
    shared element on both must have enough elements left for the overlap that a link needs. Linked sets differ in at most
    (100 - percent) / (100 + percent) of their joint number of elements, so in no more bits of their parities.
    """
    who = cut(rest.groupBy("id", "comp").agg(F.max(F.col("comp") != F.col("main")).alias("minor")))
    named = sets.withColumnRenamed("id", "sid")
    odd = parities(F.col("s"))
    thin = who.join(named, F.col("id") == F.col("sid")).select(F.col("id").alias("i"), "n", "comp", "minor", odd[0].alias("x"), odd[1].alias("y"))
    elements = cut(who.select("id").join(named, F.col("id") == F.col("sid")).select("id", F.explode("s").alias("h")))
    spread = elements.groupBy("h", F.xxhash64("h")).agg(F.count(F.lit(1)).alias("df")).select(F.col("h").alias("e"), "df")
    ordered = elements.join(spread, F.col("h") == F.col("e")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("o")).join(thin, F.col("id") == F.col("i"))
    head = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100 - F.lit(1e-9)) + 1
    own = ("id", "n", "comp", "minor", "x", "y")
    full = cut(ordered.select(*own, F.posexplode(F.slice("o", F.lit(1), head.cast("int"))).alias("pos", "t")).where("t.df > 1").select(*own, (F.col("n") - F.col("pos")).alias("left"), F.col("t.h").alias("h")))
    one = full.where("minor").select(*[F.col(c).alias(f"{c}1") for c in ("id", "n", "comp", "x", "y", "left", "h")])
    once = ~F.col("minor") | (F.col("id1") < F.col("id"))
    both = F.col("n1") + F.col("n")
    enough = (100 + percent) * F.least("left1", "left") >= percent * both
    apart = F.bit_count(F.col("x1").bitwiseXOR(F.col("x"))) + F.bit_count(F.col("y1").bitwiseXOR(F.col("y")))
    joined = one.join(full, (F.col("h1") == F.col("h")) & (F.col("comp1") != F.col("comp")) & once & enough & ((100 + percent) * apart <= (100 - percent) * both))
    return joined.select(F.least("id1", "id").alias("a"), F.greatest("id1", "id").alias("b")).distinct()
