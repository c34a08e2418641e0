"""HTML, charset, line segments and intake ladders."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomfield.functions.text import first_reason

# Elements whose text is hidden, and those that end a line.
HIDDEN = {"head", "script", "style", "noscript", "template", "svg"}
BLOCK = set("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag in BLOCK:
            self.out.append("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif tag in BLOCK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def visible_text(source: str) -> str:
    p = _Visible()
    p.feed(source)
    p.close()
    lines = (" ".join(x.split()) for x in unicodedata.normalize("NFKC", "".join(p.out)).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def _visible_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: visible_text(t or ""))


def visible(pages: DataFrame) -> DataFrame:
    return pages.withColumn("visible", _visible_udf("html"))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decoded(raw: pd.Series) -> pd.DataFrame:
    """text and encoding: strict UTF-8 (with or without mark), else strict Windows-1251 (no builtin decodes it), else null."""

    def one(b):
        for name, label in (("utf-8-sig", "utf-8"), ("cp1251", "windows-1251")):
            try:
                return bytes(b).decode(name), label
            except UnicodeDecodeError:
                pass
        return None, None

    return pd.DataFrame([one(b) if b is not None else (None, None) for b in raw], columns=["text", "encoding"])


def body_lines(text: Column, title: str, footer: str) -> Column:
    """Lines from the last that matches ``title`` to the first after it that matches ``footer``; null under three lines."""
    ls = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    start = F.coalesce(F.array_max(F.transform(ls, lambda x, i: F.when(x.rlike(title), i))), F.lit(0))
    kept = F.filter(ls, lambda x, i: i >= start)
    stop = F.coalesce(F.array_min(F.transform(kept, lambda x, i: F.when(x.rlike(footer), i))), F.size(kept))
    body = F.slice(kept, F.lit(1), stop)
    return F.when(F.size(body) >= 3, F.array_join(body, "\n"))


def links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


def next_page(pages: DataFrame) -> DataFrame:
    """The smallest larger page number on the same host; a range frame over distinct numbers, no self-join."""
    u = pages.select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.expr(r"try_cast(nullif(regexp_extract(url, '/(\\d+)', 1), '') as bigint)").alias("n")).where("n is not null")
    numbers = u.select("host", "n").distinct()
    led = numbers.withColumn("next_number", F.lead("n").over(Window.partitionBy("host").orderBy("n")))
    return u.join(led, ["host", "n"]).where("next_number is not null").select("page_id", "next_number")


def line_segments(docs: DataFrame, most_bytes: int) -> DataFrame:
    """(doc_id, segment, bytes): whole lines grouped greedily; a longer line is a segment of its own."""
    ls = F.split("text", "(?<=\n)")

    def step(a, x):
        n = F.octet_length(x).cast("bigint")
        last = F.element_at(a, -1)
        return F.when((F.size(a) > 0) & (last + n <= most_bytes), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(last + n))).otherwise(F.concat(a, F.array(n)))

    sizes = F.filter(F.aggregate(ls, F.array().cast("array<bigint>"), step), lambda b: b > 0)
    return docs.select("doc_id", F.posexplode(sizes).alias("segment", "bytes"))


def intake_reason(t: Column) -> Column:
    """First failing reason of the intake ladder, or ``accepted``."""
    ladder = first_reason(
        (F.length(t) < 20, "too_short"), (t.rlike(r"[\x00-\x08]"), "control"), (F.contains(t, F.lit("@")), "email"), (t.rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), "ipv4"),
        (t.rlike(r"(?i)(?:token|password|secret|api_key)\s*[:=]"), "secret"), (F.regexp_count(t, F.lit(r"\p{L}")) < 0.5 * F.length(t), "alpha_fraction"),
    )
    return F.coalesce(ladder, F.lit("accepted"))
