"""File sources and sinks: strict JSON lines, gzip lines, TSV, archives, code files, XML sections, checksum lists; immutable, sharded and split sinks."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """An input breaks the contract of its source."""


def _none(bad: DataFrame, what: str) -> None:
    first = bad.limit(1).collect()
    if first:
        raise ContractError(f"{what}: {first[0].asDict()}")


def read_jsonl(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(id, text, split); blank lines are skipped; other lines must be objects with string id and text, ids unique."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    o = lines.select("value", F.from_json("value", "id string, text string", {"mode": "PERMISSIVE"}).alias("o"), F.from_json("value", "id variant, text variant").alias("v"))
    _none(o.where(F.col("o.id").isNull() | F.col("o.text").isNull() | (F.schema_of_variant("v.id") != "STRING") | (F.schema_of_variant("v.text") != "STRING")).select(F.substring("value", 1, 80).alias("line")), "not an object with string id and text")
    rows = o.select("o.id", "o.text", F.lit(split).alias("split"))
    _none(rows.groupBy("id").count().where("count > 1"), "duplicate id")
    return rows


def read_gzip_jsonl(spark: SparkSession, path: str, schema: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Objects of compressed lines; a longer line is an error. A gzip file is one task: many files, not large ones, scale."""
    lines = spark.read.text(path)
    _none(lines.where(F.octet_length("value") > most_bytes).select(F.octet_length("value").alias("bytes")), "line too long")
    return lines.where(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("o")).select("o.*")


def read_exact_parquet(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """Parquet with exactly these columns and a positive or zero unique key."""
    df = spark.read.parquet(path)
    if sorted(df.columns) != sorted(columns):
        raise ContractError(f"columns {df.columns}, expected {columns}")
    _none(df.groupBy(key).count().where(f"count > 1 or {key} < 0 or {key} is null"), "bad key")
    return df


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated fields without quoting; .bz2 files are split."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)


def read_archives(spark: SparkSession, path: str, members: str = ".*") -> DataFrame:
    """(archive, member, line_no, line) of tar and zip members whose name fits ``members``; one task an archive."""
    import re

    wanted = re.compile(members)
    kind = pa.schema([("archive", pa.string()), ("member", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])

    def files(name: str, raw: bytes):
        if zipfile.is_zipfile(io.BytesIO(raw)):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        else:
            with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for member, data in files(name, raw):
                    if wanted.fullmatch(member):
                        lines = data.decode("utf-8").splitlines()
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array([member] * len(lines)), pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], schema=kind)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, line_no long, line string")


def aligned_lines(archives: DataFrame, left: str, right: str) -> DataFrame:
    """Lines of two members paired by position."""
    side = lambda m, c: archives.where(F.col("member") == m).select("line_no", F.col("line").alias(c))
    return side(left, "left").join(side(right, "right"), "line_no")


def tree_entries(entries: DataFrame, pattern: str) -> DataFrame:
    """Blobs (path, type, size) whose path fits, largest first; a path twice is an error."""
    kept = entries.where((F.col("type") == "blob") & F.col("path").rlike(pattern))
    _none(kept.groupBy("path").count().where("count > 1"), "duplicate path")
    return kept.orderBy(F.desc("size"), "path")


def read_code(spark: SparkSession, path: str, glob: str = "*.py", most_bytes: int = 1 << 20, excluded: str = r"/(\.git|node_modules|vendor|build)/") -> DataFrame:
    """path, sha256, text, reason (null if eligible) of source files; of equal eligible ones the first path stays."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.decode("content", "UTF-8"))
    reason = (
        F.when(F.col("path").rlike(excluded), "excluded_folder").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too_large").when(~valid, "not_utf8")
        .when(F.substring(text, 1, 2000).rlike("(?i)generated by|do not edit"), "generated")
    )
    rows = f.select("path", F.sha2("content", 256).alias("sha256"), text.alias("text"), reason.alias("reason"))
    first = rows.where("reason is null").groupBy("sha256").agg(F.min("path").alias("first")).withColumnRenamed("sha256", "h")
    j = rows.join(first, F.col("sha256") == F.col("h"), "left")
    return j.select("path", "sha256", "text", F.when(F.col("reason").isNull() & (F.col("path") != F.col("first")), "exact_duplicate").otherwise(F.col("reason")).alias("reason"))


def read_sections(spark: SparkSession, path: str, tag: str = "DIV8", kind: str = "SECTION") -> DataFrame:
    """section (n, node, text) with its ancestors (tag, type, n, node, head); DTDs, entities and NUL are refused."""
    out = "n string, node string, text string, ancestors array<struct<tag:string,type:string,n:string,node:string,head:string>>"

    def run(pdfs):
        import xml.etree.ElementTree as ET

        import pandas as pd

        def walk(e, above):
            head = " ".join("".join(e.find("HEAD").itertext()).split()) if e.find("HEAD") is not None else ""
            if e.tag == tag and e.get("TYPE") == kind:
                yield (e.get("N", ""), e.get("NODE", ""), " ".join("".join(e.itertext()).split()), above)
            elif e.get("TYPE"):
                above = [*above, {"tag": e.tag, "type": e.get("TYPE"), "n": e.get("N", ""), "node": e.get("NODE", ""), "head": head}]
            for child in e:
                yield from walk(child, above)

        for pdf in pdfs:
            for raw in pdf.content:
                if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw or b"\0" in raw:
                    raise ContractError("DTD, entity or NUL")
                yield pd.DataFrame(list(walk(ET.fromstring(raw), [])), columns=["n", "node", "text", "ancestors"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, out)


def first_shards(checksums: DataFrame) -> DataFrame:
    """language, file, sha256: the first file of each language of ``sha256  language/file`` lines."""
    m = lambda k: F.regexp_extract("value", r"^([0-9a-f]{64})\s+(([a-z]{2,3})/\S+)$", k)
    return checksums.where(m(1) != "").groupBy(m(3).alias("language")).agg(F.min(m(2)).alias("file"), F.min_by(m(1), m(2)).alias("sha256"))


def read_policy(raw: str, required: dict[str, type]) -> dict:
    """A strict JSON policy: no duplicate keys, exactly the required ones, exact types (a bool is no int)."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ContractError("duplicate key")
        return dict(items)

    policy = json.loads(raw, object_pairs_hook=pairs)
    if not isinstance(policy, dict) or set(policy) != set(required):
        raise ContractError(f"keys {sorted(policy)}")
    for k, t in required.items():
        if type(policy[k]) is not t:
            raise ContractError(f"{k} is {type(policy[k]).__name__}")
    return policy


def content_hash(df: DataFrame) -> tuple[int, str]:
    """Row count and an order-independent digest."""
    h = df.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h"), F.crc32(F.to_json(F.struct(*sorted(df.columns))).cast("binary")).alias("c"))
    r = h.agg(F.count(F.lit(1)), F.sum("h"), F.sum("c")).first()
    return r[0], f"{r[1]}:{r[2]}"


def publish(df: DataFrame, path: str) -> str:
    """Write once: an existing table must hold the same rows. Returns written or unchanged."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        if content_hash(spark.read.parquet(path)) != content_hash(df):
            raise ContractError(f"{path} holds other rows")
        return "unchanged"
    df.write.mode("errorifexists").parquet(path)
    return "written"


def write_shards(blocks: DataFrame, path: str, key: str = "shard") -> DataFrame:
    """Partitioned by shard, in order inside each; returns receipts (shard, blocks, digest)."""
    blocks.repartitionByRange(key).sortWithinPartitions(key, "ordinal").write.partitionBy(key).parquet(path)
    back = blocks.sparkSession.read.parquet(path)
    return back.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.xxhash64(*sorted(c for c in back.columns if c != key)).cast("decimal(38,0)")).cast("string").alias("digest"))


def write_splits(rows: DataFrame, path: str) -> DataFrame:
    """JSON lines per split; returns a manifest (split, rows)."""
    rows.write.partitionBy("split").json(path)
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def read_batches(blocks: DataFrame, cursor: int, size: int):
    """Batches of rows from ``block_index`` >= cursor, in order; resumable."""
    batch = []
    for row in blocks.where(F.col("block_index") >= cursor).orderBy("block_index").toLocalIterator():
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
