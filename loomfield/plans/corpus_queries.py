"""Queries over the corpus as a whole: duplicates, overlap, selection, splits, packing, ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfield.functions import text as T
from loomfield.operators import overlap, select
from loomfield.plans.registry import query
from loomfield.sources.tables import corpus, table

NORM = "trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))"


@query("exact_dedup_families", f"""
WITH k AS (SELECT doc_id, sha256({NORM}) AS family_sha256 FROM documents)
SELECT doc_id, family_sha256, min(doc_id) OVER (PARTITION BY family_sha256) AS representative, count(*) OVER (PARTITION BY family_sha256) AS members FROM k""")
def _(spark, d):
    """DUP-01."""
    return overlap.exact_families(table(spark, d, "documents"), T.squeeze(F.lower(F.coalesce("text", F.lit("")))))


@query("exact_unique_survivors", "SELECT sha256(coalesce(text, '')) AS payload, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def _(spark, d):
    """DUP-02: one row a payload, the smallest id."""
    return table(spark, d, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("payload")).agg(F.min("doc_id").alias("doc_id"), F.min_by("source", "doc_id").alias("source"))


@query("cluster_survivors", f"""
WITH k AS (SELECT doc_id, source, n_chars, sha256({NORM}) AS f FROM documents)
SELECT doc_id, f AS family, n_chars AS capacity FROM k QUALIFY row_number() OVER (PARTITION BY f ORDER BY n_chars DESC, doc_id) = 1""")
def _(spark, d):
    """DUP-06: of each cluster the largest declared capacity, ties to the smallest id (a struct maximum, combined before the shuffle)."""
    k = table(spark, d, "documents").select("doc_id", "n_chars", F.sha2(T.squeeze(F.lower(F.coalesce("text", F.lit("")))), 256).alias("family"))
    best = k.groupBy("family").agg(F.max(F.struct("n_chars", (-F.col("doc_id")).alias("m"))).alias("b"))
    return best.select((-F.col("b.m")).alias("doc_id"), "family", F.col("b.n_chars").alias("capacity"))


@query("origin_capacity", f"""
WITH k AS (SELECT source, n_chars, sha256({NORM}) AS f FROM documents), m AS (SELECT f, max(n_chars) AS c, count(DISTINCT source) AS s FROM k GROUP BY f)
SELECT sum(c)::BIGINT AS capacity_after, count(*) AS independent_origins, count(*) FILTER (s > 1) AS shared_origins FROM m""")
def _(spark, d):
    """DUP-07."""
    m = table(spark, d, "documents").groupBy(F.sha2(T.squeeze(F.lower(F.coalesce("text", F.lit("")))), 256)).agg(F.max("n_chars").alias("c"), F.countDistinct("source").alias("s"))
    return m.agg(F.sum("c").alias("capacity_after"), F.count(F.lit(1)).alias("independent_origins"), F.count_if(F.col("s") > 1).alias("shared_origins"))


@query("decontam_gram_screen", """
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
g AS (SELECT DISTINCT unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
bw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM bw)
SELECT item_id, count(*) AS total, count(g.g) AS matched, count(g.g) * 5 >= count(*) * 4 AS rejected FROM bg LEFT JOIN g USING (g) GROUP BY item_id""")
def _(spark, d):
    """JON-07: holdout items most of whose 8-grams occur in train."""
    return overlap.gram_screen(corpus(spark, d), table(spark, d, "benchmark"))


@query("overlap_match_edges")
def _(spark, d):
    """JON-01/04/08, DUP-08: verified train x evaluation matches (tested against brute force)."""
    return overlap.match_edges(overlap.fingerprints(corpus(spark, d), "doc_id"), overlap.fingerprints(table(spark, d, "benchmark"), "item_id"))


@query("overlap_self_edges")
def _(spark, d):
    """JON-02/03: verified matches within train."""
    f = overlap.fingerprints(corpus(spark, d), "doc_id")
    return overlap.match_edges(f, f, same=True)


@query("decontamination_report")
def _(spark, d):
    """DEC-01/02/03, DUP-05: components with an evaluation item, and quarantined families."""
    return overlap.decontamination(corpus(spark, d), table(spark, d, "benchmark"))


@query("near_duplicate_pairs")
def _(spark, d):
    """JON-05 (tested against brute force): pairs between representatives of equal folded texts, and copies with their representative."""
    return overlap.near_links(corpus(spark, d))


@query("mirror_pairs_across_sources")
def _(spark, d):
    """JON-06: near pairs of different sources between representatives, and copies in one source, ids hashed."""
    p = overlap.near_across(corpus(spark, d))
    return p.select(F.sha2(F.col("a").cast("string"), 256).alias("a_sha256"), F.sha2(F.col("b").cast("string"), 256).alias("b_sha256"), "kind")


@query("near_duplicate_families")
def _(spark, d):
    """DUP-03."""
    return overlap.near_families(corpus(spark, d))


@query("candidate_work", """
WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS w FROM documents), p AS (SELECT unnest(w) AS t, doc_id FROM w), b AS (SELECT t, count(*) AS n FROM p GROUP BY t)
SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM documents)::BIGINT AS all_pairs, sum(n)::BIGINT AS postings, sum(n * (n - 1) // 2)::BIGINT AS expansions FROM b""")
def _(spark, d):
    """AGG-19: work of an index before it is expanded."""
    c = corpus(spark, d)
    b = c.select(F.explode(F.array_distinct(T.word_tokens(F.lower("text")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    n = c.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("bigint").alias("all_pairs"))
    return n.join(b.agg(F.sum("n").alias("postings"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("expansions")))


@query("survivor_anti_join", "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes FROM documents WHERE sha256(doc_id::VARCHAR) NOT IN (SELECT sha256(doc_id::VARCHAR) FROM labels WHERE quality = 0)")
def _(spark, d):
    """JON-09: rows whose hashed id is not excluded."""
    out = table(spark, d, "labels").where("quality = 0").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("h")).distinct()
    docs = table(spark, d, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"), F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return docs.join(out, "h", "left_anti").select("doc_id", "bytes")


@query("binding_violations", "SELECT count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (d.doc_id IS NULL) AS orphans FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    """JON-10: ids on one side only."""
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select(F.col("doc_id").alias("l"))
    j = a.join(b, F.col("doc_id") == F.col("l"), "full_outer")
    return j.agg(F.count_if(F.col("l").isNull()).alias("unlabelled"), F.count_if(F.col("doc_id").isNull()).alias("orphans"))


@query("parallel_triples", "SELECT a.conv_id, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' QUALIFY row_number() OVER (PARTITION BY lower(a.text), lower(b.text) ORDER BY a.conv_id, a.turn) = 1")
def _(spark, d):
    """JON-11: linked pairs, one of each normalized pair in link order."""
    c = table(spark, d, "conversations")
    a, b = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    w = Window.partitionBy(F.lower("question"), F.lower("answer")).orderBy("conv_id", "turn")
    return a.join(b, ["conv_id", "turn"]).withColumn("k", F.row_number().over(w)).where("k = 1").select("conv_id", "question", "answer")


@query("reference_overlap_exclusion", "SELECT page_id FROM pages WHERE regexp_extract(url, '://([^/?#]*)', 1) NOT IN (SELECT regexp_extract(url, '://([^/?#]*)', 1) FROM pages WHERE page_id % 2 = 0) AND page_id % 2 = 1")
def _(spark, d):
    """JON-12: rows none of whose keys occur in the reference set."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return p.where("page_id % 2 = 1").join(p.where("page_id % 2 = 0").select("host").distinct(), "host", "left_anti").select("page_id")


@query("mixture_capped_greedy")
def _(spark, d):
    """WIN-01 (tested against a plain loop)."""
    return select.capped_greedy(corpus(spark, d).select("doc_id", "lang", "family"), {"lang": 150, "family": 30}, 400, "mix-1")


@query("mixture_single_cap", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('mix-1:' || doc_id::VARCHAR), doc_id) AS rank FROM documents QUALIFY rank <= 50")
def _(spark, d):
    """WIN-01 with one cap, TOP-10, WIN-02: first rows of a category in hash order."""
    return select.ranked_cap(table(spark, d, "documents").select("doc_id", "lang"), "lang", 50, "mix-1").withColumn("rank", F.col("rank").cast("bigint"))


@query("mixture_contributions", """
SELECT 'lang' AS dim, lang AS name, count(*) AS records, sum(n_chars)::BIGINT AS units FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY source""")
def _(spark, d):
    """AGG-02: all dimensions in one pass over the rows."""
    g = table(spark, d, "documents").select("n_chars", F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))).alias("dim", "name"))
    return g.groupBy("dim", "name").agg(F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("units"))


@query("byte_budget_prefix", "SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS running FROM documents QUALIFY running <= 20000")
def _(spark, d):
    """WIN-02, stop at the first row over the budget."""
    return select.byte_budget_break(table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("bytes")), "source", 20_000).select("source", "doc_id", "running")


@query("byte_budget_skip")
def _(spark, d):
    """TOP-09/14, WIN-02: skip what does not fit (tested against a plain loop)."""
    return select.budget_skip(table(spark, d, "documents").select("source", "doc_id", F.col("n_chars").alias("bytes")), "source", 20_000)


@query("cluster_split")
def _(spark, d):
    """WIN-03/04."""
    return select.cluster_split(table(spark, d, "documents").select("doc_id", "source"), "source", "split-1")


@query("split_family")
def _(spark, d):
    """WIN-05, SET-01."""
    return select.split_family(table(spark, d, "documents").select("doc_id", "source"), "source", ["a", "b"])


@query("cluster_leakage", f"""
WITH k AS (SELECT sha256({NORM}) AS c, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT % 100) < 80 AS train FROM documents)
SELECT c AS cluster, count(*) AS members FROM k GROUP BY c HAVING bool_or(train) AND bool_or(NOT train)""")
def _(spark, d):
    """AGG-17: clusters that straddle a record-level split."""
    k = table(spark, d, "documents").select(F.sha2(T.squeeze(F.lower(F.coalesce("text", F.lit("")))), 256).alias("cluster"), (T.hash_bucket(F.col("doc_id").cast("string")) < 80).alias("train"))
    return k.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.bool_or("train").alias("a"), F.bool_and("train").alias("b")).where("a and not b").select("cluster", "members")


@query("partition_disjointness", "SELECT source, count(DISTINCT doc_id % 3) AS parts FROM documents GROUP BY source HAVING count(DISTINCT doc_id % 3) > 1")
def _(spark, d):
    """SET-02: keys in more than one part."""
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct(F.col("doc_id") % 3).alias("parts")).where("parts > 1")


@query("rebuild_witness", "SELECT 0::BIGINT AS only_first, 0::BIGINT AS only_second")
def _(spark, d):
    """SET-05: two builds with different partitionings hold the same rows."""
    a = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("s"))
    b = table(spark, d, "documents").repartition(7, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("s"))
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_first")).join(b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_second")))


@query("gate_convergence", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def _(spark, d):
    """SET-04."""
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


@query("reserved_union", "SELECT item_id AS id, 'benchmark' AS kind FROM benchmark UNION SELECT doc_id, 'label' FROM labels")
def _(spark, d):
    """SET-03."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind")).union(table(spark, d, "labels").select("doc_id", F.lit("label"))).distinct()


@query("inventory_diff", """
WITH a AS (SELECT doc_id, source FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'moved' ELSE source END AS source FROM documents WHERE doc_id % 10 <> 1)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.source IS DISTINCT FROM b.source""")
def _(spark, d):
    """JON-15."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    a = docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("x"), F.col("source").alias("sx"))
    b = docs.where("doc_id % 10 <> 1").select(F.col("doc_id").alias("y"), F.when(F.col("doc_id") % 7 == 0, "moved").otherwise(F.col("source")).alias("sy"))
    j = a.join(b, F.col("x") == F.col("y"), "full_outer").where(~F.col("sx").eqNullSafe(F.col("sy")))
    return j.select(F.coalesce("x", "y").alias("doc_id"), F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))


VECTOR = "SELECT lang AS stratum, source AS family, sum(n_chars)::BIGINT AS unique_bytes FROM documents GROUP BY 1, 2"


def _vector(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("stratum"), F.col("source").alias("family")).agg(F.sum("n_chars").alias("unique_bytes"))


@query("family_vector_rollup", "SELECT coalesce(lang, 'ALL') AS stratum, coalesce(source, 'ALL') AS family, count(*) AS records, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ROLLUP (lang, source)")
def _(spark, d):
    """AGG-01."""
    r = table(spark, d, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("bytes"))
    return r.select(F.coalesce("lang", F.lit("ALL")).alias("stratum"), F.coalesce("source", F.lit("ALL")).alias("family"), "records", "bytes")


@query("role_language_pivot", "SELECT role, count(*) FILTER (turn = 0) AS first_turns, count(*) FILTER (turn = 1) AS second_turns FROM conversations GROUP BY role")
def _(spark, d):
    """AGG-03: pivoted coverage."""
    p = table(spark, d, "conversations").where("turn < 2").groupBy("role").pivot("turn", [0, 1]).agg(F.count(F.lit(1)))
    roles = table(spark, d, "conversations").select("role").distinct()
    return roles.join(p, "role", "left").select("role", F.coalesce("0", F.lit(0)).alias("first_turns"), F.coalesce("1", F.lit(0)).alias("second_turns"))


@query("balance_feasible_total")
def _(spark, d):
    """TOP-07: the family vector is aggregated in Spark, the search runs over it on the driver."""
    fam: dict = {}
    for r in _vector(spark, d).collect():  # one row a family
        fam.setdefault(r.stratum, []).append(r.unique_bytes)
    return spark.createDataFrame([(select.largest_feasible(fam),)], "largest_total long")


@query("deterministic_allocation", f"""
WITH v AS ({VECTOR}), q AS (SELECT *, CASE stratum WHEN 'en' THEN 200000 * 9 // 20 WHEN 'fr' THEN 200000 * 7 // 20 WHEN 'de' THEN 200000 // 5 ELSE 0 END AS quota FROM v),
c AS (SELECT *, least(unique_bytes, 50000, quota * 3 // 5) AS cap FROM q), b AS (SELECT *, coalesce(sum(cap) OVER (PARTITION BY stratum ORDER BY cap DESC, family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT stratum, family, greatest(0, least(cap, quota - before))::BIGINT AS allocated FROM b""")
def _(spark, d):
    """TOP-08."""
    return select.allocation(_vector(spark, d), 200_000)


@query("packed_measure", """
SELECT lang, count(*) AS documents, sum(length(text))::BIGINT AS code_points, sum(n)::BIGINT AS tokens, sum(greatest(n - 1, 0))::BIGINT AS loss_tokens, sum(CASE WHEN n < 2 THEN 0 ELSE (n - 1 + 126) // 127 END)::BIGINT AS examples, count(*) FILTER (n < 2) AS short_documents
FROM (SELECT lang, text, octet_length(encode(text))::BIGINT AS n FROM documents) GROUP BY lang""")
def _(spark, d):
    """AGG-05: closed form, nothing is packed to be counted."""
    n = F.octet_length("text")
    return corpus(spark, d).groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("code_points"), F.sum(n).alias("tokens"), F.sum(F.greatest(n - 1, F.lit(0))).alias("loss_tokens"),
        F.sum(F.when(n < 2, 0).otherwise(F.floor((n + 125) / 127))).cast("bigint").alias("examples"), F.count_if(n < 2).alias("short_documents"),
    )


@query("packed_windows", """
SELECT doc_id, s::INT AS start, least(128, n - s)::INT AS tokens, greatest(0, 128 - (n - s))::INT AS padding FROM (SELECT doc_id, n, unnest(range(0, n - 1, 127)) AS s FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents) WHERE n >= 2)""")
def _(spark, d):
    """WIN-06/12."""
    return select.causal_windows(corpus(spark, d))


@query("target_block_index", """
WITH b AS (SELECT doc_id, o, least(32, n - o) AS targets FROM (SELECT doc_id, n, unnest(range(0, n, 32)) AS o FROM (SELECT doc_id, octet_length(encode(text))::BIGINT + 1 AS n FROM documents)))
SELECT doc_id, o::INT AS "offset", targets::INT AS targets, i AS block_index, i // 1000 AS shard, i % 1000 AS ordinal FROM (SELECT *, row_number() OVER (ORDER BY doc_id, o) - 1 AS i FROM b)""")
def _(spark, d):
    """WIN-07/08/11, SNK-02: blocks with global index and shard."""
    return select.block_index(select.target_blocks(corpus(spark, d)), 1000)


@query("exposure_chain_heads")
def _(spark, d):
    """WIN-09: a hash chain a shard."""
    b = select.block_index(select.target_blocks(corpus(spark, d)), 1000)
    return select.hash_chain(b, "shard", "block_index", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("offset").cast("string")))


@query("exposure_plan", """
SELECT i // 8 AS batch, (i // 8) % 4 AS worker, (i // 8) // 16 AS shard, sum(n_chars)::BIGINT AS targets FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, n_chars FROM documents) GROUP BY ALL""")
def _(spark, d):
    """WIN-10: contiguous batches dealt to workers and shards."""
    docs = select.block_index(table(spark, d, "documents").select("doc_id", "n_chars", F.lit(0).alias("offset")), 8)
    return docs.groupBy(F.col("shard").alias("batch")).agg(F.sum("n_chars").alias("targets")).select("batch", (F.col("batch") % 4).alias("worker"), F.floor(F.col("batch") / 16).alias("shard"), "targets")


@query("unique_loss_totals", f"""
WITH k AS (SELECT lang, octet_length(encode(text))::BIGINT AS n, row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY doc_id) AS k FROM documents)
SELECT lang, sum(CASE WHEN k = 1 THEN greatest(n - 1, 0) ELSE 0 END)::BIGINT AS unique_targets, sum(CASE WHEN k > 1 THEN greatest(n - 1, 0) ELSE 0 END)::BIGINT AS replayed_targets FROM k GROUP BY lang""")
def _(spark, d):
    """AGG-06: targets of first copies and of replays."""
    f = overlap.exact_families(corpus(spark, d), T.squeeze(F.lower("text"))).select("doc_id", (F.col("doc_id") == F.col("representative")).alias("first"))
    n = F.greatest(F.octet_length("text") - 1, F.lit(0))
    return corpus(spark, d).join(f, "doc_id").groupBy("lang").agg(F.sum(F.when(F.col("first"), n).otherwise(0)).alias("unique_targets"), F.sum(F.when(F.col("first"), 0).otherwise(n)).alias("replayed_targets"))


@query("interval_claim_overlaps", """
WITH c AS (SELECT user_id AS segment, event_id AS id, (event_id * 7 % 1000)::BIGINT AS s, (event_id * 7 % 1000 + 1 + event_id % 5)::BIGINT AS e FROM events), w AS (SELECT *, max(e) OVER (PARTITION BY segment ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c)
SELECT segment, id, s, e FROM w WHERE s < reach""")
def _(spark, d):
    """JON-14, STR-03: claims that overlap an earlier one, in one ordered pass."""
    e = table(spark, d, "events")
    s = F.col("event_id") * 7 % 1000
    return select.overlapping_claims(e.select(F.col("user_id").alias("segment"), F.col("event_id").alias("id"), s.alias("s"), (s + 1 + F.col("event_id") % 5).alias("e")))


@query("stream_continuity", """
WITH w AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM (SELECT doc_id, unnest(range(0, n - 1, 127)) AS s FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents) WHERE n >= 2))
SELECT count(*) AS windows, count(*) FILTER (p IS NOT NULL AND s <> p + 127) AS breaks FROM w""")
def _(spark, d):
    """WIN-15: each window continues the one before it."""
    w = select.causal_windows(corpus(spark, d)).withColumn("p", F.lag("start").over(Window.partitionBy("doc_id").orderBy("start")))
    return w.agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("start") != F.col("p") + 127).alias("breaks"))


@query("length_bucketed_batches", """
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY sha256('epoch-0:' || doc_id::VARCHAR), doc_id) - 1 AS i FROM documents), b AS (SELECT doc_id, i // 64 AS w, row_number() OVER (PARTITION BY i // 64 ORDER BY n_chars, doc_id) - 1 AS k FROM r)
SELECT doc_id, w AS "window", k // 8 AS batch FROM b""")
def _(spark, d):
    """WIN-14: seeded order, sorted by length inside windows; the order is ranked within 16 hash ranges, not in one task."""
    r = table(spark, d, "documents").select("doc_id", "n_chars", select.hash_rank("epoch-0", F.col("doc_id")).alias("o")).withColumn("p", F.substring("o", 1, 1))
    size = {x[0]: x[1] for x in r.groupBy("p").count().collect()}
    base, acc = F.lit(0).cast("bigint"), 0
    for p in sorted(size):
        base, acc = F.when(F.col("p") == p, F.lit(acc).cast("bigint")).otherwise(base), acc + size[p]
    i = r.withColumn("i", base + F.row_number().over(Window.partitionBy("p").orderBy("o", "doc_id")) - 1).withColumn("window", F.floor(F.col("i") / 64))
    return i.select("doc_id", "window", F.floor((F.row_number().over(Window.partitionBy("window").orderBy("n_chars", "doc_id")) - 1) / 8).alias("batch"))


@query("rights_materialization", """
SELECT s.s_suppkey AS source_id, count(*) AS records FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_regionkey = 1 AND s.s_acctbal > 0 GROUP BY 1""")
def _(spark, d):
    """RGT-01/02: records of sources with a grant for the purpose (suppliers stand in for sources)."""
    ok = table(spark, d, "supplier").where("s_acctbal > 0").join(table(spark, d, "nation").where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey")
    return table(spark, d, "lineitem").select("l_suppkey").join(ok, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_suppkey").alias("source_id")).agg(F.count(F.lit(1)).alias("records"))


@query("provenance_denylist", "SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') AND sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE source IN ('src1', 'src2'))")
def _(spark, d):
    """RGT-03/04: rows that neither their payload nor their source rules out."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    denied = F.col("source").isin("src1", "src2")
    return docs.where(~denied).join(docs.where(denied).select("h").distinct(), "h", "left_anti").select("doc_id")
