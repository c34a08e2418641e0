"""Text functions as column expressions; Unicode normalization and case folding are Arrow UDFs."""

from __future__ import annotations

import html as _html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Code points removed before matching, and line separators of splitlines().
INVISIBLE = "\ufeff\u00ad\u200b\u200c\u200d\u2060"
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def let(value: Column, body) -> Column:
    """Bind ``value`` so that a higher-order function below evaluates it once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """``value``, guarded so that the optimizer does not copy its evaluation into every use of the column."""
    return F.when(F.rand() >= 0, value)


def _normal(form: str, fold: bool):
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else (unicodedata.normalize(form, t).casefold() if fold else unicodedata.normalize(form, t)))

    return run


nfkc, nfc, nfkc_fold = _normal("NFKC", False), _normal("NFC", False), _normal("NFKC", True)


@F.pandas_udf(StringType())
def unescape_entities(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _html.unescape(t))


def squeeze(c: Column) -> Column:
    """White space runs become one space, ends are stripped."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def contamination_text(c: Column) -> Column:
    """Natural text for overlap matching: NFKC, no invisible characters, folded, squeezed."""
    return squeeze(F.translate(nfkc_fold(c), INVISIBLE, ""))


def contamination_code(c: Column) -> Column:
    """Code for overlap matching: NFKC, no invisible characters, each line's inline space squeezed."""
    lines = F.split(unix_lines(F.translate(nfkc(c), INVISIBLE, "")), "\n")
    return F.trim(F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\t \f\x0b]+", " "))), "\n"))


def near_fold(c: Column) -> Column:
    return squeeze(nfkc_fold(c))


def full_lines(c: Column) -> Column:
    """NFKC, unix lines, space squeezed in each, empty lines dropped."""
    lines = F.transform(F.split(unix_lines(nfkc(c)), "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def nfc_text(c: Column) -> Column:
    """NFC, unix lines, stripped; null where a control character or nothing is left."""
    t = F.trim(nfc(unix_lines(c)))
    return F.when((t == "") | t.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), None).otherwise(t)


def markdown_text(c: Column) -> Column:
    """Front matter, comments and shortcodes out; links and images become their text; mark characters out."""
    t = nfkc(unix_lines(c))
    for pattern, to in (
        (r"(?s)\A---\n.*?\n---\n", ""), (r"(?s)<!--.*?-->", " "), (r"(?s)\{\{[<%].*?[%>]\}\}", " "),
        (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^[ \t]*(?:#{1,6}|>|[-*+]|\d+\.)[ \t]+", ""), (r"[`*_~]+", ""),
    ):
        t = F.regexp_replace(t, pattern, to)
    lines = F.transform(F.split(t, "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def markup_text(c: Column) -> Column:
    """Comments, CDATA marks and tags become line ends; entities are resolved, unknown ones become spaces."""
    t = F.regexp_replace(c, r"(?s)<!--.*?-->", "\n")
    t = F.regexp_replace(t, r"<!\[CDATA\[|\]\]>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "\n")
    t = F.regexp_replace(unescape_entities(t), r"&[A-Za-z0-9_.-]+;", " ")
    lines = F.transform(F.split(t, "\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(nfkc_fold(c), r"[^\p{L}\p{N}]", "")


def content_fingerprint(task: Column, answer: Column) -> Column:
    """SHA-256 of the sorted-key JSON of both, folded and squeezed."""
    return F.sha2(F.to_json(F.struct(squeeze(F.lower(answer)).alias("answer"), squeeze(F.lower(task)).alias("task"))), 256)


def lines_of(c: Column) -> Column:
    """splitlines(): no empty last line."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def generic_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"), F.lit(0))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


# The quality gate's word pattern and the code lexer's patterns and keywords.
NATURAL_WORD = r"\p{L}+(?:['’ʼ-]\p{L}+)*"
CODE_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|0[xX][0-9A-Fa-f]+|\d+(?:\.\d+)?|==|!=|<=|>=|->|=>|::|\+\+|--|&&|\|\||<<|>>|\*\*|\S"
CODE_KEYWORDS = """
and as async await break case catch class const continue def delete do else elif except export false finally for from function if import in instanceof interface lambda let
match new none not null or package pass raise return select static struct switch throw true try type var when where while with yield
""".split()


def natural_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(NATURAL_WORD), F.lit(0))


def code_skeleton(c: Column) -> Column:
    """Tokens of code with comments, strings, identifiers and numbers replaced by their kinds."""
    t = F.regexp_replace(c, r"(?s)/\*.*?\*/", " COMMENT ")
    t = F.regexp_replace(t, r"(?m)(?://|#).*$", " COMMENT ")
    t = F.regexp_replace(t, r"""(?s)'''.*?'''|\"\"\".*?\"\"\"|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*\"""", " STR ")

    def kind(x):
        return F.when(x.isin("COMMENT", "STR"), x).when(F.lower(x).isin(CODE_KEYWORDS), F.lower(x)).when(x.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), "ID").when(x.rlike(r"^(0[xX][0-9A-Fa-f]+|\d+(\.\d+)?)$"), "NUM").otherwise(x)

    return F.transform(F.regexp_extract_all(t, F.lit(CODE_TOKEN), F.lit(0)), kind)


def shingles(tokens: Column, width: int, sep: str = "\u001f") -> Column:
    """Distinct runs of ``width`` tokens; all of a shorter list as one; none of an empty one."""

    def of(t):
        n = F.size(t)
        windows = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.array_join(F.slice(t, i, F.lit(width)), sep))
        return F.array_distinct(F.when(n >= width, windows).when(n > 0, F.array(F.array_join(t, sep))).otherwise(F.array().cast("array<string>")))

    return let(tokens, of)


def char_grams(c: Column, width: int = 5) -> Column:
    n = F.length(c)
    grams = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.substring(c, i, F.lit(width)))
    return F.array_distinct(F.when(n >= width, grams).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    """0 where either is empty."""
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(n / (F.size(a) + F.size(b) - n))


def containment(a: Column, b: Column) -> Column:
    n = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(n / F.least(F.size(a), F.size(b)))


def hash_bucket(c: Column, modulus: int = 100) -> Column:
    """First 32 bits of SHA-256, modulo."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint") % modulus


def hash_bucket64(c: Column, modulus: int = 10_000) -> Column:
    """First 64 bits of SHA-256 as an unsigned number, modulo."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)") % modulus).cast("bigint")


def first_reason(*ladder: tuple[Column, str]) -> Column:
    """Name of the first condition that holds, else null."""
    out = None
    for cond, name in ladder:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def all_reasons(*tests: tuple[Column, str]) -> Column:
    """Sorted names of the conditions that hold."""
    return F.sort_array(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests])))


def script_ratio(c: Column, script: str) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters == 0, F.lit(0.0)).otherwise(F.regexp_count(c, F.lit(rf"(?=\p{{L}})\p{{Is{script}}}")) / letters)



def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, default port and fragment dropped, // and /./ in the path collapsed, query parameters sorted without tracking ones."""
    parts = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", 0)
    get = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    host = F.regexp_replace(F.lower(get(2)), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(get(3), r"/(\./)+", "/"), r"/{2,}", "/")
    path = F.when(path == "", "/").otherwise(path)
    query = F.array_join(F.sort_array(F.filter(F.split(get(4), "&"), lambda q: (q != "") & ~q.rlike(r"^utm_|^ref="))), "&")
    return F.when(parts == "", None).otherwise(F.concat(F.lower(get(1)), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
