"""Queries over texts: normalization, tokens, quality, privacy, language, HTML and URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomfield.functions import text as T
from loomfield.operators import html, privacy, quality
from loomfield.plans.registry import query
from loomfield.sources.tables import corpus, table

DOCS = "SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents"


@query("normalized_lines", """
SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(replace(nfc_normalize(coalesce(text, '')), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS lines_sha256
FROM documents""")
def _(spark, d):
    """NRM-03/04: unix lines with squeezed space and no empty line."""
    c = corpus(spark, d)
    lines = F.filter(F.transform(F.split(T.unix_lines(T.nfc(F.col("text"))), "\n"), T.squeeze), lambda x: x != "")
    return c.select("doc_id", F.sha2(F.array_join(lines, "\n"), 256).alias("lines_sha256"))


@query("contamination_normal_forms")
def _(spark, d):
    """NRM-01/02/10: normal forms for matching (case folding has no SQL counterpart; tested against Python)."""
    c = corpus(spark, d)
    t = F.col("text")
    return c.select("doc_id", F.sha2(T.contamination_text(t), 256).alias("text_form"), F.sha2(T.contamination_code(t), 256).alias("code_form"), F.sha2(T.near_fold(t), 256).alias("near_form"), F.sha2(T.alnum_key(t), 256).alias("key_form"), F.sha2(T.full_lines(t), 256).alias("line_form"), F.coalesce(F.sha2(T.nfc_text(t), 256), F.lit("rejected")).alias("nfc_form"))


@query("markdown_and_markup_text")
def _(spark, d):
    """NRM-05/06 over page sources and documents (tested on small rows)."""
    p = table(spark, d, "pages")
    return p.select("page_id", F.length(T.markup_text(F.coalesce("html", F.lit("")))).cast("bigint").alias("markup_chars"), F.length(T.markdown_text(F.coalesce("html", F.lit("")))).cast("bigint").alias("markdown_chars"))


@query("generic_token_counts", """
SELECT doc_id, length(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}\\p{M}_]+|[^\\p{L}\\p{N}\\p{M}_\\s]'))::BIGINT AS tokens,
  length(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+'))::BIGINT AS words,
  length(regexp_extract_all(lower(coalesce(text, '')), '\\p{L}+(?:[''’ʼ-]\\p{L}+)*'))::BIGINT AS natural_words
FROM documents""")
def _(spark, d):
    """TOK-01/02: token proxy and word counts."""
    t = F.col("text")
    return corpus(spark, d).select("doc_id", F.size(T.generic_tokens(t)).cast("bigint").alias("tokens"), F.size(T.word_tokens(t)).cast("bigint").alias("words"), F.size(T.natural_words(t)).cast("bigint").alias("natural_words"))


@query("word_shingle_counts", """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) >= 3 THEN len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) WHEN len(w) > 0 THEN 1 ELSE 0 END::BIGINT AS shingles
FROM t""")
def _(spark, d):
    """TOK-04: distinct word shingles of width 3."""
    return corpus(spark, d).select("doc_id", F.size(T.shingles(T.word_tokens(F.lower("text")), 3, " ")).cast("bigint").alias("shingles"))


@query("code_skeleton_profile")
def _(spark, d):
    """TOK-03: kinds of skeleton tokens (page scripts are the fixture's only code; tested on small rows)."""
    k = table(spark, d, "pages").select(F.explode(T.code_skeleton(F.coalesce("html", F.lit("")))).alias("kind"))
    return k.where(F.col("kind").isin("ID", "NUM", "STR", "COMMENT")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("byte_token_stats", """
SELECT lang, count(*) AS documents, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS byte_tokens, round(sum(octet_length(encode(coalesce(text, '')))) / sum(length(coalesce(text, ''))), 6) AS fertility
FROM documents GROUP BY lang""")
def _(spark, d):
    """TOK-05: identity byte tokens; fertility is bytes a code point."""
    b, n = F.sum(F.octet_length("text")), F.sum(F.length("text"))
    return corpus(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), b.alias("byte_tokens"), F.round(b / n, 6).alias("fertility"))


@query("content_fingerprints", """
SELECT doc_id, sha256('{"answer":"' || lang || '","task":"' || source || '"}') AS fingerprint FROM documents""")
def _(spark, d):
    """NRM-11: SHA-256 of the canonical JSON of a task and its answer."""
    return table(spark, d, "documents").select("doc_id", T.content_fingerprint(F.col("source"), F.col("lang")).alias("fingerprint"))


@query("hash_bucket_split", """
SELECT doc_id, b AS bucket, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT doc_id, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::UBIGINT % 100)::BIGINT AS b FROM documents)""")
def _(spark, d):
    """HSH-02: split by the first 32 bits of SHA-256."""
    b = table(spark, d, "documents").select("doc_id", T.hash_bucket(F.col("doc_id").cast("string")).alias("bucket"))
    return b.withColumn("split", F.when(F.col("bucket") < 80, "train").when(F.col("bucket") < 90, "validation").otherwise("test"))


@query("legacy_hash_split", """
SELECT doc_id, (('0x' || substr(sha256('seed-1' || chr(0) || doc_id::VARCHAR), 1, 16))::UBIGINT % 10000) < 1000 AS validation FROM documents""")
def _(spark, d):
    """HSH-03: record-level split by the first 64 bits, kept as a leakage baseline."""
    key = F.concat(F.lit("seed-1\x00"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", (T.hash_bucket64(key) < 1000).alias("validation"))


@query("row_identity", """
SELECT source, sha256(string_agg(doc_id::VARCHAR || ':' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS inventory_sha256, count(*) AS records, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS total_bytes
FROM documents GROUP BY source""")
def _(spark, d):
    """HSH-01/AGG-04/AGG-18: digest of the ordered inventory of each source (ids and hashes only; texts stay)."""
    rows = table(spark, d, "documents").select("source", "doc_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("line"), F.octet_length(F.coalesce("text", F.lit(""))).alias("b"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"])
    return rows.groupBy("source").agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("inventory_sha256"), F.count(F.lit(1)).alias("records"), F.sum("b").alias("total_bytes"))


@query("script_ratios", """
SELECT doc_id, n AS letters, CASE WHEN n = 0 THEN 0.0 ELSE round(l / n, 6) END AS latin_ratio, CASE WHEN n = 0 THEN 0.0 ELSE round(c / n, 6) END AS cyrillic_ratio
FROM (SELECT doc_id, length(regexp_replace(text, '\\P{L}', '', 'g')) AS n, length(regexp_replace(text, '\\P{Latin}', '', 'g')) - length(regexp_replace(regexp_replace(text, '\\p{L}', '', 'g'), '\\P{Latin}', '', 'g')) AS l, length(regexp_replace(text, '\\P{Cyrillic}', '', 'g')) AS c FROM documents)""")
def _(spark, d):
    """LNG-01: script shares of the letters."""
    t = F.col("text")
    return corpus(spark, d).select("doc_id", F.regexp_count(t, F.lit(r"\p{L}")).cast("bigint").alias("letters"), F.round(T.script_ratio(t, "Latin"), 6).alias("latin_ratio"), F.round(T.script_ratio(t, "Cyrillic"), 6).alias("cyrillic_ratio"))


@query("language_gates", """
SELECT doc_id, CASE WHEN n = 0 THEN 'und' WHEN c / n >= 0.7 AND u >= 20 THEN 'uk' ELSE 'und' END AS language,
  list_sort(list_filter([CASE WHEN n < 200 THEN 'too_few_letters' END, CASE WHEN n > 0 AND c / n < 0.5 THEN 'low_cyrillic' END, CASE WHEN u < 20 THEN 'few_specific_letters' END, CASE WHEN tabs * 20 > chars THEN 'tabular' END], lambda x: x IS NOT NULL)) AS reasons
FROM (SELECT doc_id, length(text) AS chars, length(regexp_replace(text, '\\P{L}', '', 'g')) AS n, length(regexp_replace(text, '\\P{Cyrillic}', '', 'g')) AS c, length(regexp_replace(text, '[^іїєґІЇЄҐ]', '', 'g')) AS u, length(regexp_replace(text, '[^\\t]', '', 'g')) AS tabs FROM documents)""")
def _(spark, d):
    """LNG-02/03: language evidence and all failing metric reasons."""
    t = F.col("text")
    m = corpus(spark, d).select("doc_id", F.length(t).alias("chars"), *[F.regexp_count(t, F.lit(p)).alias(n) for n, p in (("n", r"\p{L}"), ("c", r"\p{IsCyrillic}"), ("u", "[іїєґІЇЄҐ]"), ("tabs", r"\t"))])
    share = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("c") / F.col("n"))
    reasons = T.all_reasons((F.col("n") < 200, "too_few_letters"), ((F.col("n") > 0) & (share < 0.5), "low_cyrillic"), (F.col("u") < 20, "few_specific_letters"), (F.col("tabs") * 20 > F.col("chars"), "tabular"))
    return m.select("doc_id", F.when((share >= 0.7) & (F.col("u") >= 20), "uk").otherwise("und").alias("language"), reasons.alias("reasons"))


@query("content_classes", """
SELECT doc_id, CASE WHEN contains(text, chr(0)) THEN 'binary' WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(text, '^\\s*<(?:!DOCTYPE|html|\\?xml)') THEN 'markup' WHEN bars * 50 > length(text) THEN 'tabular' ELSE 'plain_text' END AS class
FROM (SELECT doc_id, coalesce(text, '') AS text, length(regexp_replace(coalesce(text, ''), '[^|\\t]', '', 'g')) AS bars FROM documents)""")
def _(spark, d):
    """LNG-04: first class of the ladder that fits."""
    t = F.col("text")
    bars = F.regexp_count(t, F.lit(r"[|\t]"))
    ladder = T.first_reason((F.contains(t, F.lit("\x00")), "binary"), (F.trim(t) == "", "empty"), (t.rlike(r"^\s*<(?:!DOCTYPE|html|\?xml)"), "markup"), (bars * 50 > F.length(t), "tabular"))
    return corpus(spark, d).select("doc_id", F.coalesce(ladder, F.lit("plain_text")).alias("class"))


@query("license_lines", """
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)non-?commercial|BY-NC|all rights reserved') THEN 'EXCLUDE' WHEN regexp_matches(text, '(?i)public domain|MIT License|Apache License|CC BY|CC0') THEN 'ACCEPT' WHEN regexp_matches(text, '(?i)copyright|licen[sc]e') THEN 'QUARANTINE' ELSE 'NONE' END AS license_class
FROM documents""")
def _(spark, d):
    """LIC-01: license classification ladder."""
    t = F.col("text")
    ladder = T.first_reason((t.rlike("(?i)non-?commercial|BY-NC|all rights reserved"), "EXCLUDE"), (t.rlike("(?i)public domain|MIT License|Apache License|CC BY|CC0"), "ACCEPT"), (t.rlike("(?i)copyright|licen[sc]e"), "QUARANTINE"))
    return corpus(spark, d).select("doc_id", F.coalesce(ladder, F.lit("NONE")).alias("license_class"))


@query("quality_features", """
WITH t AS (
  SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines, regexp_extract_all(lower(text), '\\p{L}+(?:[''’ʼ-]\\p{L}+)*') AS tk,
    regexp_extract_all(text, '(?i)\\b(?:https?://|www\\.)\\S+') AS urls FROM documents
), u AS (SELECT *, list_filter(lines, lambda x: trim(regexp_replace(x, '\\s', ' ', 'g')) <> '') AS ne FROM t),
v AS (SELECT *, list_transform(ne, lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))) AS folded FROM u)
SELECT doc_id, length(text)::BIGINT AS chars, octet_length(encode(text))::BIGINT AS utf8_bytes, len(lines)::BIGINT AS lines, len(ne)::BIGINT AS nonempty_lines,
  length(regexp_replace(text, '[^\\p{P}\\p{S}]', '', 'g'))::BIGINT AS punctuation_symbol_chars,
  CASE WHEN len(ne) < 2 THEN 0 ELSE len(ne) - len(list_distinct(folded)) END::BIGINT AS repeated_lines,
  len(urls)::BIGINT AS url_count, coalesce(list_sum(list_transform(urls, lambda x: length(x))), 0)::BIGINT AS url_chars,
  len(tk)::BIGINT AS token_count, len(list_distinct(tk))::BIGINT AS unique_token_count,
  CASE WHEN len(tk) = 0 THEN 0.0 ELSE round(len(list_distinct(tk)) / len(tk), 6) END AS distinct_token_ratio
FROM v""")
def _(spark, d):
    """QLT-01: the features that SQL states alike."""
    a = quality.assess(corpus(spark, d))
    names = ["chars", "utf8_bytes", "lines", "nonempty_lines", "punctuation_symbol_chars", "repeated_lines", "url_count", "url_chars", "token_count", "unique_token_count"]
    return a.select("doc_id", *[F.col(f"f.{n}").alias(n) for n in names], F.round("f.distinct_token_ratio", 6).alias("distinct_token_ratio"))


@query("quality_decisions")
def _(spark, d):
    """QLT-02: accepted, score, reasons, warnings, margin (tested against Python)."""
    return quality.assess(corpus(spark, d)).select("doc_id", "d.accepted", "d.score", "d.reasons", "d.warnings", "d.edge_margin")


@query("quality_short_and_symbols", """
SELECT doc_id, list_sort(list_filter([CASE WHEN length(text) < 60 THEN 'too_short' END, CASE WHEN ns > 0 AND s / ns > 0.4 THEN 'high_symbol_ratio' END], lambda x: x IS NOT NULL)) AS reasons
FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\\p{P}\\p{S}]', '', 'g')) AS s, length(regexp_replace(text, '\\s', '', 'g')) AS ns FROM documents)""")
def _(spark, d):
    """QLT-02 restricted to two reasons that SQL states."""
    a = quality.assess(corpus(spark, d))
    return a.select("doc_id", F.filter("d.reasons", lambda r: r.isin("too_short", "high_symbol_ratio")).alias("reasons"))


@query("quality_reason_histogram")
def _(spark, d):
    """QLT-03."""
    return quality.reason_histogram(quality.assess(corpus(spark, d)))


@query("quality_mode_report")
def _(spark, d):
    """QLT-03: acceptance per language."""
    return quality.mode_report(quality.assess(corpus(spark, d)), "lang")


@query("quality_calibration")
def _(spark, d):
    """QLT-04: agreement with labels."""
    return quality.calibration(quality.assess(corpus(spark, d)), table(spark, d, "labels"), "lang")


@query("quality_edge_samples")
def _(spark, d):
    """TOP-01."""
    return quality.edge_samples(quality.assess(corpus(spark, d)))


@query("quality_windows")
def _(spark, d):
    """SEG-01/QLT-07: windows of long documents with decisions."""
    return quality.window_decisions(corpus(spark, d))


@query("quality_granularity")
def _(spark, d):
    """QLT-05: retain all, part or nothing, with byte conservation."""
    return quality.granularity(corpus(spark, d))


@query("quality_three_granularities")
def _(spark, d):
    """QLT-06 (tested against decisions on joined texts)."""
    return quality.compare_granularities(corpus(spark, d))


@query("fixed_packs", """
SELECT doc_id, p::INT AS pack, length(substr(text, p::INT * 4096 + 1, 4096))::BIGINT AS chars
FROM (SELECT doc_id, text, unnest(range(0, ((length(text) + 4095) // 4096)::BIGINT)) AS p FROM documents WHERE length(text) > 0)""")
def _(spark, d):
    """SEG-03: slices of 4096 characters."""
    return quality.fixed_packs(corpus(spark, d)).select("doc_id", "pack", F.length("text").cast("bigint").alias("chars"))


@query("newline_records", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, i::INT AS index, (sum(octet_length(encode(line)) + 1) OVER w - octet_length(encode(line)) - 1)::BIGINT AS start_byte, (sum(octet_length(encode(line)) + 1) OVER w - 1)::BIGINT AS end_byte, sha256(line) AS sha256
FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def _(spark, d):
    """SEG-04/WIN-13: each line with its byte range, by a fold inside the row (no shuffle)."""
    lines = F.split("text", "\n")
    start = F.aggregate(lines, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.octet_length(x) + 1)))
    r = corpus(spark, d).select("doc_id", F.arrays_zip(lines.alias("line"), start.alias("s")).alias("z")).select("doc_id", F.posexplode("z").alias("index", "z")).where("z.line is not null")
    return r.select("doc_id", "index", F.col("z.s").alias("start_byte"), (F.col("z.s") + F.octet_length("z.line")).cast("bigint").alias("end_byte"), F.sha2("z.line", 256).alias("sha256"))


@query("line_segments")
def _(spark, d):
    """SEG-02: whole lines grouped up to 32768 bytes, greedily within the row."""
    return html.line_segments(corpus(spark, d), 32_768)


@query("privacy_email_counts", """
SELECT doc_id, length(regexp_extract_all(text, '(?i)[A-Z0-9.!#$%&''*+/=?^_`{|}~-]+@(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\\.)+[A-Z]{2,63}'))::BIGINT AS emails FROM documents""")
def _(spark, d):
    """PRV-01 restricted to e-mail addresses, which SQL states."""
    return privacy.scan(corpus(spark, d)).select("doc_id", F.size(F.filter("findings", lambda f: f["detector"] == "email")).cast("bigint").alias("emails"))


@query("privacy_findings")
def _(spark, d):
    """PRV-01: spans of all detectors (no texts)."""
    return privacy.scan(corpus(spark, d)).select("doc_id", F.explode("findings").alias("f")).select("doc_id", "f.*")


@query("privacy_actions")
def _(spark, d):
    """PRV-02."""
    return privacy.scan(corpus(spark, d)).groupBy("action").agg(F.count(F.lit(1)).alias("documents"))


@query("privacy_manifest")
def _(spark, d):
    """PRV-03."""
    return privacy.manifest(privacy.scan(corpus(spark, d)))


@query("privacy_gate")
def _(spark, d):
    """PRV-04: ALLOW only; a removal list takes precedence."""
    c = corpus(spark, d)
    return privacy.gate(privacy.scan(c), c.where("lang = 'fr'").select("doc_id"))


@query("privacy_survivors")
def _(spark, d):
    """PRV-05/SPN-01: redacted texts must scan clean."""
    return privacy.survivors(corpus(spark, d)).select("doc_id", "was_redacted", F.sha2("text", 256).alias("text_sha256"))


LADDER_SQL = """CASE WHEN length(text) < 20 THEN 'too_short' WHEN regexp_matches(text, '[\\x00-\\x08]') THEN 'control' WHEN contains(text, '@') THEN 'email' WHEN regexp_matches(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') THEN 'ipv4' WHEN regexp_matches(text, '(?i)(?:token|password|secret|api_key)\\s*[:=]') THEN 'secret' WHEN length(regexp_replace(text, '\\P{L}', '', 'g')) < 0.5 * length(text) THEN 'alpha_fraction' ELSE 'accepted' END"""


@query("intake_ladder_chat", f"SELECT conv_id, turn, {LADDER_SQL} AS reason FROM conversations")
def _(spark, d):
    """INT-01: first failing reason of a chat turn."""
    return table(spark, d, "conversations").select("conv_id", "turn", html.intake_reason(F.col("text")).alias("reason"))


@query("intake_ladder_documents", f"SELECT doc_id, {LADDER_SQL} AS reason FROM documents")
def _(spark, d):
    """INT-02/03/04/07: the same ladder over documents."""
    return table(spark, d, "documents").select("doc_id", html.intake_reason(F.col("text")).alias("reason"))


@query("intake_all_reasons", """
SELECT doc_id, list_sort(list_filter([CASE WHEN octet_length(encode(text)) < 200 THEN 'too_small' END, CASE WHEN contains(text, '@') THEN 'email' END, CASE WHEN regexp_matches(text, '[0-9]{7,}') THEN 'long_digits' END], lambda x: x IS NOT NULL)) AS reasons FROM documents""")
def _(spark, d):
    """INT-05: every failing reason."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.all_reasons((F.octet_length(t) < 200, "too_small"), (F.contains(t, F.lit("@")), "email"), (t.rlike("[0-9]{7,}"), "long_digits")).alias("reasons"))


@query("intake_url_schema", r"""SELECT page_id, url IS NOT NULL AND html IS NOT NULL AND regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages""")
def _(spark, d):
    """INT-06: record schema gate for web rows."""
    return table(spark, d, "pages").select("page_id", (F.col("url").isNotNull() & F.col("html").isNotNull() & F.col("url").rlike("^https?://[^/?#]+")).alias("valid"))


@query("url_canonical")
def _(spark, d):
    """URL-01."""
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query("html_links", """
SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def _(spark, d):
    """SRC-08: links of pages."""
    return html.links(table(spark, d, "pages"))


@query("html_next_page", """
WITH u AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, try_cast(regexp_extract(url, '/(\\d+)', 1) AS BIGINT) AS n FROM pages)
SELECT a.page_id, min(b.n) AS next_number FROM u a JOIN u b ON a.host = b.host AND b.n > a.n GROUP BY a.page_id""")
def _(spark, d):
    """SRC-08: the smallest larger page number of the same host, by a window."""
    return html.next_page(table(spark, d, "pages"))


@query("html_visible_text")
def _(spark, d):
    """NRM-07/08/09: visible text (tested against small pages)."""
    return html.visible(table(spark, d, "pages")).select("page_id", F.length("visible").cast("bigint").alias("chars"), F.sha2("visible", 256).alias("visible_sha256"))
