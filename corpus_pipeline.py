"""The corpus pipeline: filters, deduplication and packing of `documents`, each stage on all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of ``documents``.

Defined cases, for every stage: null text counts as empty. Empty texts are
scored like others, are equal to one another in the exact stage, and have no
near copies. A null doc_id is a row like others in the filters and in packing; in
the exact stage it stays only if no row with an id has its text; the near stage
keeps it. Rows of one doc_id with different texts are judged each by its text.
Repeated rows become one in the two deduplications. Ties in doc_id are broken by
the text's hash. Very long texts are used whole; the classifiers alone are
fitted to bounded samples. An empty table gives an empty result. Further columns,
whatever their names, pass through all stages but the last, which leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomfield.llm import minhash, packing, recipes, rules, toxicity
from loomfield.llm.common import drop_path, scratch_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a toxicity of 0.5 or more go."""
    return toxicity.keep_civil(docs, _labels(spark, sf_dir))


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents with a quality below 0.3 go."""
    return rules.keep_good(docs, _labels(spark, sf_dir))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: of equal texts the one with the largest doc_id stays."""
    return recipes.keep_unique(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each near-duplicate component stays (five-word shingles, similarity 0.8)."""
    return minhash.keep_representatives(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the pieces of the documents and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("quality", poor_out),
    ("exact_dedup", copies_out),
    ("near_dedup", near_copies_out),
    ("packing", packed),
]

#: The classifiers' scores can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; intermediate tables go to the shared folder, and each goes once the next is written."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if held:
            drop_path(spark, held)
        docs, held = spark.read.parquet(path), path
    return docs
