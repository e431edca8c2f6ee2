"""The corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, tokens.

Every stage is one operator over all documents its predecessor kept; its result is written to the shared folder and read
again by the next one, so a lost executor costs a stage at most. All stages but the last return the columns they got;
columns that an operator works with never meet those of the documents, whatever their names.

Defined results: null and empty texts fail the word minimum of the first stage; rows repeated whole stay once behind the
second; a text from which secrets were taken has its `n_chars` counted again; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspan.llm import bpe, decontaminate, neardup, repeats, secrets, store
from talkspan.llm.queries import ORACLE as OPERATOR_ORACLE
from talkspan.llm.queries import QUERIES as OPERATOR_QUERIES
from talkspan.llm.queries import table, vocabulary


def _packed(docs: DataFrame) -> DataFrame:
    """`row` with all columns but the text, and `text`."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def _unpacked(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    own = {c: F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns} | changed
    return rows.select(*[v.alias(c) for c, v in own.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return _unpacked(repeats.with_quality(_packed(docs)).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    hits = decontaminate.with_hits(_packed(docs), table(spark, sf_dir, "benchmark"))
    return _unpacked(decontaminate.without_documents(hits), docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets taken out of their texts."""
    found = secrets.redacted(secrets.with_findings(_packed(docs), secrets.corpus_model(docs)))
    n_chars = F.when(F.size("findings") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return _unpacked(found, docs, n_chars=n_chars)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids, and whether the ids decode to the text again."""
    both = bpe.with_ids_and_text(_packed(docs), vocabulary())
    n_tokens = F.size("ids").cast("long")
    return _unpacked(both, docs, ids=F.col("ids"), n_tokens=n_tokens,
                     round_trip=F.col("decoded") == F.coalesce("text", F.lit("")))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("tokens", tokens),
]

#: Token ids and connected components can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {**OPERATOR_QUERIES, "pipeline": run}
ORACLE = dict(OPERATOR_ORACLE) | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
