"""Document quality: features, decision, windows, calibration and reports (all native expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions.text import NATURAL_WORD, all_reasons, let, lines_of, once, squeeze

# Thresholds of the natural modes and of code.
NATURAL = dict(min_chars=60, max_chars=250_000, symbol=0.40, repeated=0.60, url=0.25, template=0.50, boilerplate=0.50, distinct=0.20, dominant=0.22, diversity_tokens=30, other_script=0.20, structure=0)
CODE = dict(min_chars=30, max_chars=400_000, symbol=0.78, repeated=0.75, url=0.45, template=0.70, boilerplate=0.70, distinct=0.10, dominant=0.38, diversity_tokens=20, other_script=1.0, structure=2)
# Markers, matched in folded lines.
TEMPLATE_MARKERS = [
    "privacy policy", "terms of use", "terms and conditions", "cookie policy", "accept cookies", "all rights reserved", "sign in", "log in", "subscribe", "newsletter", "skip to content",
    "політика конфіденційності", "умови використання", "файли cookie", "прийняти cookie", "усі права захищено", "увійти", "підписатися", "перейти до вмісту",
]
BOILERPLATE_MARKERS = [
    "javascript is required", "enable javascript", "read more", "click here", "share this", "follow us", "contact us", "advertisement", "sponsored", "©", "powered by",
    "завантажити більше", "читати далі", "поділитися", "реклама", "зв'язатися з нами",
]
# Keywords that count as code structure.
STRUCTURE_WORDS = "def class return if else elif for while try except import from function const let var interface type public private static void int SELECT FROM WHERE GROUP ORDER JOIN CREATE INSERT UPDATE DELETE echo fi then do done case esac".split()
# Windows of long natural documents.
TRIGGER, TARGET, MAXIMUM, MIN_TAIL = 16_384, 8_192, 12_288, 2_048


def _marked(folded: Column, markers: list[str]) -> Column:
    """Number of lower-cased lines that hold a marker."""
    hit = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(m)) for m in markers])
    return F.size(F.filter(folded, hit)).cast("bigint")


def with_features(docs: DataFrame, text: str = "text", code: bool = False) -> DataFrame:
    """``docs`` with the struct column f of the feature values of a text.

    Lines and tokens are columns of their own, each evaluated once a row: nested lambdas in their place make analysis slow.
    """
    count = lambda p: F.regexp_count("__t", F.lit(p)).cast("bigint")
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    one = lambda c: F.when(c, 1).otherwise(0)
    pattern = "[A-Za-z_][A-Za-z0-9_]*" if code else NATURAL_WORD
    d = docs.withColumn("__t", once(F.coalesce(F.col(text), F.lit(""))))
    d = d.withColumn("__ls", once(F.when(F.col("__t") == "", F.array(F.lit(""))).otherwise(lines_of(F.col("__t")))))
    d = d.withColumn("__ne", once(F.filter("__ls", lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != "")))
    d = d.withColumn("__tk", once(F.sort_array(F.regexp_extract_all(F.lower("__t"), F.lit(pattern), F.lit(0)))))
    d = d.withColumn("__low", once(F.transform("__ne", lambda x: F.lower(x))))
    d = d.withColumn("__m", once(F.struct(_marked(F.col("__low"), TEMPLATE_MARKERS).alias("a"), _marked(F.col("__low"), BOILERPLATE_MARKERS).alias("b"))))
    d = d.withColumn("__folded", once(F.array_distinct(F.transform("__low", squeeze))))
    # positions where runs of equal tokens begin: their number is that of distinct tokens, the longest run the dominant one
    d = d.withColumn("__st", once(F.filter(F.transform("__tk", lambda w, i: F.when((i == 0) | (w != F.get(F.col("__tk"), i - 1)), i)), lambda i: i.isNotNull())))
    d = d.withColumn("__run", once(F.array_max(F.transform("__st", lambda x, j: F.coalesce(F.get(F.col("__st"), j + 1), F.size("__tk")) - x))))
    d = d.withColumn("__urls", once(F.regexp_extract_all("__t", F.lit(r"(?i)\b(?:https?://|www\.)\S+"), F.lit(0))))
    d = d.withColumn("__c", once(F.struct(*[count(q).alias(n) for n, q in {
        "nonspace": r"(?U)\S", "letters": r"\p{L}", "latin": r"(?=\p{L})\p{IsLatin}", "cyrillic": r"(?=\p{L})\p{IsCyrillic}", "symbols": r"[\p{P}\p{S}]", "replaced": "\ufffd",
        "controls": r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "keywords": rf"\b(?:{'|'.join(STRUCTURE_WORDS)})\b", "marks": r"[{}\[\]();:=<>]", "comments": r"#|//|/\*|<!--",
    }.items() if code or n not in ("keywords", "marks", "comments")])))
    c = F.col("__c")
    chars, n, tokens, unique = F.length("__t").cast("bigint"), F.size("__ne").cast("bigint"), F.size("__tk").cast("bigint"), F.size("__st").cast("bigint")
    repeated = F.when(n < 2, F.lit(0)).otherwise(n - F.size("__folded")).cast("bigint")
    url_chars = F.length(F.array_join("__urls", "")).cast("bigint")
    template, boiler = F.col("__m.a"), F.col("__m.b")
    indented = F.size(F.filter("__ls", lambda x: x.rlike(r"^[ \t]") & (F.trim(x) != ""))).cast("bigint")
    structure = F.lit(0) if not code else one(n >= 2) + one(indented > 0) + one(c["keywords"] > 0) + one(tokens >= 3) + one(c["marks"] >= 2) + one(c["comments"] > 0)
    other = c["letters"] - c["latin"] - c["cyrillic"]
    values = {
        "chars": chars, "utf8_bytes": F.octet_length("__t").cast("bigint"), "nonspace_chars": c["nonspace"], "lines": F.size("__ls").cast("bigint"), "nonempty_lines": n,
        "replacement_characters": c["replaced"], "disallowed_controls": c["controls"], "latin_letters": c["latin"], "cyrillic_letters": c["cyrillic"], "other_script_letters": other,
        "other_script_letter_ratio": ratio(other, c["letters"]), "punctuation_symbol_chars": c["symbols"], "symbol_ratio": ratio(c["symbols"], c["nonspace"]),
        "repeated_lines": repeated, "repeated_line_ratio": F.when(n < 2, F.lit(0.0)).otherwise(repeated / n),
        "url_count": F.size("__urls").cast("bigint"), "url_chars": url_chars, "url_char_ratio": url_chars / F.greatest(chars, F.lit(1)),
        "template_lines": template, "template_line_ratio": ratio(template, n), "boilerplate_lines": boiler, "boilerplate_line_ratio": ratio(boiler, n),
        "token_count": tokens, "unique_token_count": unique, "distinct_token_ratio": ratio(unique, tokens), "dominant_token_ratio": ratio(F.coalesce("__run", F.lit(0)), tokens),
        "code_keyword_hits": c["keywords"] if code else F.lit(0).cast("bigint"), "indented_lines": indented if code else F.lit(0).cast("bigint"), "code_structure_score": structure if code else F.lit(0),
    }
    return d.withColumn("f", once(F.struct(*[v.alias(k) for k, v in values.items()]))).drop("__t", "__ls", "__ne", "__low", "__m", "__tk", "__folded", "__st", "__run", "__urls", "__c")


def decide(f: Column, t: dict = NATURAL, code: bool = False) -> Column:
    """struct<accepted, score, reasons, warnings, edge_margin> from features."""
    enough = f["token_count"] >= t["diversity_tokens"]
    invalid = (f["replacement_characters"] > 0) | (f["disallowed_controls"] > 0)
    tests = [
        (f["replacement_characters"] > 0, "invalid_replacement_character"), (f["disallowed_controls"] > 0, "disallowed_control_character"),
        (f["chars"] < t["min_chars"], "too_short"), (f["chars"] > t["max_chars"], "too_long"), (f["nonspace_chars"] == 0, "empty_or_whitespace"),
        (f["symbol_ratio"] > t["symbol"], "high_symbol_ratio"), (f["repeated_line_ratio"] > t["repeated"], "high_line_repetition"), (f["url_char_ratio"] > t["url"], "high_url_density"),
        (f["template_line_ratio"] > t["template"], "high_template_density"), (f["boilerplate_line_ratio"] > t["boilerplate"], "high_boilerplate_density"),
        (f["other_script_letter_ratio"] > t["other_script"], "unexpected_script_density"),
        (enough & (f["distinct_token_ratio"] < t["distinct"]), "low_token_diversity"), (enough & (f["dominant_token_ratio"] > t["dominant"]), "dominant_token_repetition"),
    ]
    if code:
        tests.append((f["code_structure_score"] < t["structure"], "insufficient_code_structure"))
    reasons = all_reasons(*tests)
    near = all_reasons(
        (f["url_char_ratio"] > t["url"] * 0.70, "near_url_density_limit"), (f["repeated_line_ratio"] > t["repeated"] * 0.70, "near_line_repetition_limit"),
        (f["symbol_ratio"] > t["symbol"] * 0.80, "near_symbol_ratio_limit"), (f["template_line_ratio"] > t["template"] * 0.70, "near_template_density_limit"),
        (enough & (f["distinct_token_ratio"] < t["distinct"] * 1.30), "near_diversity_limit"),
    )
    none = F.array().cast("array<string>")
    upper = lambda c, m: (F.lit(t[m]) - f[c]) / t[m]
    margins = [(f["chars"] - t["min_chars"]) / t["min_chars"], (F.lit(t["max_chars"]) - f["chars"]) / t["max_chars"]]
    margins += [upper("symbol_ratio", "symbol"), upper("repeated_line_ratio", "repeated"), upper("url_char_ratio", "url"), upper("template_line_ratio", "template"), upper("boilerplate_line_ratio", "boilerplate"), upper("other_script_letter_ratio", "other_script")]
    margins += [F.when(enough, (f["distinct_token_ratio"] - t["distinct"]) / t["distinct"]), F.when(enough, upper("dominant_token_ratio", "dominant")), F.when(invalid, F.lit(-1.0))]
    if code:
        margins.append((f["code_structure_score"] - t["structure"]) / max(1, t["structure"]))

    def result(r):
        w = F.when(F.size(r) == 0, near).otherwise(none)
        return let(w, lambda w: F.struct((F.size(r) == 0).alias("accepted"), F.greatest(F.lit(0), 100 - 25 * F.size(r) - 5 * F.size(w)).alias("score"), r.alias("reasons"), w.alias("warnings"), F.bround(F.least(*margins), 6).alias("edge_margin")))

    return let(reasons, result)


def assess(docs: DataFrame, text: str = "text", code: bool = False) -> DataFrame:
    """``docs`` with the struct columns f (features) and d (decision)."""
    withf = with_features(docs, text, code)
    return withf.withColumn("d", once(decide(F.col("f"), CODE if code else NATURAL, code)))


REASONS = """
invalid_replacement_character disallowed_control_character too_short too_long empty_or_whitespace high_symbol_ratio high_line_repetition high_url_density
high_template_density high_boilerplate_density unexpected_script_density low_token_diversity dominant_token_repetition insufficient_code_structure
""".split()


def reason_histogram(assessed: DataFrame) -> DataFrame:
    """(reason, n) of the reasons that occur: one conditional count each, so no row is exploded."""
    counts = assessed.agg(*[F.count_if(F.array_contains("d.reasons", F.lit(r))).alias(r) for r in REASONS])
    pairs = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in REASONS])
    return counts.select(F.inline(pairs)).where("n > 0")


def mode_report(assessed: DataFrame, mode: str) -> DataFrame:
    ok = F.col("d.accepted").cast("bigint")
    return assessed.groupBy(mode).agg(F.count(F.lit(1)).alias("records"), F.sum(ok).alias("accepted"), F.round(F.avg(ok.cast("double")), 6).alias("acceptance_rate"))


def calibration(assessed: DataFrame, labels: DataFrame, mode: str) -> DataFrame:
    """Agreement of the gate with labels.quality, per mode."""
    j = assessed.join(labels, "doc_id").select(mode, F.col("d.accepted").alias("a"), (F.col("quality") == 1).alias("y"))
    n = lambda c: F.count_if(c).alias
    return j.groupBy(mode).agg(F.count(F.lit(1)).alias("labelled"), n(F.col("a") == F.col("y"))("right"), n(F.col("a") & ~F.col("y"))("false_accepts"), n(~F.col("a") & F.col("y"))("false_rejects"))


def edge_samples(assessed: DataFrame, k: int = 5) -> DataFrame:
    """The k documents nearest to the decision boundary, of accepted and of rejected ones."""
    w = Window.partitionBy("accepted").orderBy(F.abs("edge_margin"), "doc_id")
    flat = assessed.select("doc_id", F.col("d.accepted").alias("accepted"), F.col("d.edge_margin").alias("edge_margin"))
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def windows(text: Column) -> Column:
    """array<struct<index,start,end>>: local windows of a long text that rebuild it exactly; one for a text of at most the maximum."""
    t_struct = "array<struct<start:int,end:int>>"

    def of(t):
        n = F.length(t)

        def step(a, _):
            s = F.when(F.size(a) == 0, F.lit(0)).otherwise(F.element_at(a, -1)["end"])

            def cut(s):
                end = s + TARGET
                forward = F.locate("\n", F.substring(t, end + 1, F.lit(MAXIMUM - TARGET)))
                before = F.substring(t, s + TARGET // 2 + 1, F.lit(TARGET // 2))
                backward = F.locate("\n", F.reverse(before))
                at = F.when(forward > 0, end + forward).when(backward > 0, end - backward + 1).otherwise(end)
                return F.when(n - s > MAXIMUM, F.concat(a, F.array(F.struct(s.cast("int").alias("start"), at.cast("int").alias("end"))))).otherwise(a)

            return let(s, cut)

        cuts = F.aggregate(F.sequence(F.lit(0), F.floor(n / (TARGET // 2)).cast("int")), F.array().cast(t_struct), step)

        def finish(c):
            last = F.when(F.size(c) == 0, F.lit(0)).otherwise(F.element_at(c, -1)["end"])
            prev = F.element_at(c, -1)["start"]
            whole = F.concat(c, F.array(F.struct(last.alias("start"), n.alias("end"))))
            head = F.slice(c, F.lit(1), F.size(c) - 1)
            merged = F.concat(head, F.array(F.struct(prev.alias("start"), n.alias("end"))))
            moved = n - MIN_TAIL
            shifted = F.concat(head, F.array(F.struct(prev.alias("start"), moved.alias("end")), F.struct(moved.alias("start"), n.alias("end"))))
            short = (F.size(c) > 0) & (n - last < MIN_TAIL)
            return F.when(n == 0, F.array().cast(t_struct)).when(F.size(c) == 0, whole).when(short & (n - prev <= MAXIMUM), merged).when(short, shifted).otherwise(whole)

        spans = let(cuts, finish)
        return F.transform(spans, lambda x, i: F.struct(i.alias("index"), x["start"].alias("start"), x["end"].alias("end")))

    return let(text, of)


def window_decisions(docs: DataFrame) -> DataFrame:
    """A row a window: doc_id, index, start, end, bytes, accepted. Short documents have one window, the whole."""
    t = F.coalesce("text", F.lit(""))
    spans = F.when(F.length(t) > TRIGGER, windows(t)).otherwise(F.array(F.struct(F.lit(0).alias("index"), F.lit(0).alias("start"), F.length(t).alias("end"))))
    w = docs.select("doc_id", t.alias("text"), F.explode(spans).alias("w")).select("doc_id", "w.index", "w.start", "w.end", F.substring(F.col("text"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("text"))
    return assess(w).select("doc_id", "index", "start", "end", F.col("f.utf8_bytes").alias("bytes"), F.col("d.accepted").alias("accepted"))


def granularity(docs: DataFrame) -> DataFrame:
    """Per document: windows, retained ones, retained and rejected bytes (they add up to all bytes), status."""
    ok = F.col("accepted")
    g = window_decisions(docs).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(ok).alias("retained"), F.sum(F.when(ok, F.col("bytes")).otherwise(0)).alias("retained_bytes"), F.sum(F.when(ok, 0).otherwise(F.col("bytes"))).alias("rejected_bytes")
    )
    return g.withColumn("status", F.when(F.col("retained") == F.col("windows"), "RETAIN_ALL").when(F.col("retained") > 0, "RETAIN_PARTIAL").otherwise("REJECT_DOCUMENT"))


def fixed_packs(docs: DataFrame, size: int = 4096) -> DataFrame:
    """(doc_id, pack, text): slices of ``size`` characters."""
    n = F.length("text")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return docs.select("doc_id", "text", F.posexplode(at).alias("pack", "s")).select("doc_id", "pack", F.substring(F.col("text"), F.col("s") + 1, F.lit(size)).alias("text"))


def three_granularities(docs: DataFrame, family: str = "family", size: int = 4096) -> DataFrame:
    """Acceptance by family (a vote of its documents by bytes, not the whole-source decision of ``compare_granularities``), by document and by fixed pack: (granularity, units, accepted, largest_rejected_bytes).

    Each text is assessed once, for family and document; one of at most ``size`` characters is its own only pack, so only packs of longer ones are assessed besides.
    """
    ok, data = F.col("d.accepted"), F.col("f.utf8_bytes")
    short = F.col("f.chars").between(1, size)
    counts = lambda c, k: [F.count_if(c).alias(f"units{k}"), F.count_if(c & ok).alias(f"accepted{k}"), F.max(F.when(c & ~ok, data)).alias(f"largest{k}")]
    # the family's decision is that of its documents weighed by bytes: texts of a family are never gathered in one row
    per = assess(docs).groupBy(family).agg(F.sum(F.when(ok, data).otherwise(0)).alias("good"), F.sum(data).alias("all"), *counts(F.lit(True), 1), *counts(short, 2))
    good = 2 * F.col("good") >= F.col("all")
    row = lambda name, units, accepted, largest: F.struct(F.lit(name).alias("granularity"), F.coalesce(units, F.lit(0).cast("bigint")).alias("units"), F.coalesce(accepted, F.lit(0).cast("bigint")).alias("accepted"), F.coalesce(largest, F.lit(0).cast("bigint")).alias("largest_rejected_bytes"))
    of = lambda name, k: row(name, F.sum(f"units{k}"), F.sum(f"accepted{k}"), F.max(f"largest{k}"))
    rows = per.agg(F.array(row("family", F.count(F.lit(1)), F.count_if(good), F.max(F.when(~good, F.col("all")))), of("document", 1), of("pack", 2)).alias("rows")).select(F.inline("rows"))
    packs = assess(fixed_packs(docs.where(F.length("text") > size), size)).agg(row("pack", F.count(F.lit(1)), F.count_if(ok), F.max(F.when(~ok, data))).alias("row")).select("row.*")
    return rows.union(packs).groupBy("granularity").agg(F.sum("units").alias("units"), F.sum("accepted").alias("accepted"), F.max("largest_rejected_bytes").alias("largest_rejected_bytes"))


def whole_sources(docs: DataFrame, family: str = "family") -> DataFrame:
    """family, accepted, bytes: the decision on each family's joined text, its documents by doc_id without anything between.

    A text of more than max_chars is rejected whatever else it holds, so only shorter ones are joined: a row has max_chars characters at most.
    """
    t = docs.select(F.col(family).alias("family"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = t.groupBy("family").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).cast("bigint").alias("bytes"))
    short = sizes.where(F.col("chars") <= NATURAL["max_chars"]).select(F.col("family").alias("source"), "bytes")
    joined = t.where("text <> ''").join(short.select(F.col("source").alias("k")), F.col("family").eqNullSafe(F.col("k")), "left_semi").groupBy("family").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "").alias("text"))
    whole = short.join(joined, F.col("source").eqNullSafe(F.col("family")), "left").select("source", "bytes", F.coalesce("text", F.lit("")).alias("text"))
    long = sizes.where(F.col("chars") > NATURAL["max_chars"]).select("family", F.lit(False).alias("accepted"), "bytes")
    return assess(whole).select(F.col("source").alias("family"), F.col("d.accepted").alias("accepted"), "bytes").union(long)


def compare_granularities(docs: DataFrame, family: str = "family", size: int = 4096) -> DataFrame:
    """Decisions on whole sources, documents, fixed packs and the windows of the frozen policy: (granularity, units, accepted, largest_rejected_bytes, disagreements).

    disagreements: families whose whole-source decision differs from "all documents", "all packs, if any" and "some bytes retained"; their sum is the
    reference's count over all families. A document is its own only window up to TRIGGER characters, and its own only pack up to ``size``.
    """
    ok, data, chars = F.col("d.accepted"), F.col("f.utf8_bytes"), F.col("f.chars")
    d = docs.select(F.col(family).alias("family"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def units(name, rows, ok, data):
        return rows.groupBy("family").agg(F.count(F.lit(1)).alias("units"), F.count_if(ok).alias("accepted"), F.max(F.when(~ok, data)).alias("largest"), F.sum(F.when(ok, data).otherwise(0)).alias("kept")).withColumn("granularity", F.lit(name))

    assessed = assess(d)
    cuts = F.transform(windows(F.col("text")), lambda w: F.substring(F.col("text"), w["start"] + 1, w["end"] - w["start"]))
    packs = fixed_packs(d.where(F.length("text") > size).select(F.struct("family", "doc_id").alias("doc_id"), "text"), size).select("doc_id.family", "text")
    split = d.where(F.length("text") > TRIGGER).select("family", F.explode(cuts).alias("text"))
    per = units("document", assessed, ok, data).union(units("pack", assessed.where(chars.between(1, size)), ok, data)).union(units("pack", assess(packs), ok, data))
    per = per.union(units("window", assessed.where(chars <= TRIGGER), ok, data)).union(units("window", assess(split), ok, data))
    per = per.groupBy("granularity", "family").agg(*[f(c).alias(c) for f, c in ((F.sum, "units"), (F.sum, "accepted"), (F.max, "largest"), (F.sum, "kept"))])
    whole = whole_sources(d)
    sources = whole.select(F.col("family").alias("source"), F.col("accepted").alias("whole"))
    agreed = F.when(F.col("granularity") == "window", F.col("kept") > 0).otherwise(F.col("accepted") == F.col("units"))
    rows = per.join(sources, F.col("family").eqNullSafe(F.col("source"))).select("granularity", "units", "accepted", "largest", (F.col("whole") != agreed).alias("apart"))
    own = whole.select(F.lit("family").alias("granularity"), F.lit(1).cast("bigint").alias("units"), F.col("accepted").cast("bigint").alias("accepted"), F.when(~F.col("accepted"), F.col("bytes")).alias("largest"), F.lit(False).alias("apart"))
    return rows.union(own).groupBy("granularity").agg(F.sum("units").alias("units"), F.sum("accepted").alias("accepted"), F.coalesce(F.max("largest"), F.lit(0).cast("bigint")).alias("largest_rejected_bytes"), F.count_if(F.col("apart")).alias("disagreements"))
