"""The corpus pipeline: rules, one of each near-duplicate group, redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import jaccard, packing, quality, secrets
from foliomill.llm.queries import table, tokenizer_path
from foliomill.llm.store import materialize, small

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep.

    A document is judged by its text, repeated rows alike; one without words fails
    the base rule.  An empty table gives an empty one.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"), tuple(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the row with its smallest doc_id.

    Documents without words stay; equal rows count once; rows without a doc_id are
    grouped by their text; rows of one doc_id with different texts are documents of
    their own.  An empty table gives an empty one.
    """
    return jaccard.keep_one(docs.select(*COLUMNS), k=5, percent=80)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by its kind.

    Repeated rows and rows without a doc_id stay, each redacted; a null text becomes
    null again; ``n_chars`` follows the text.  An empty table gives an empty one.
    """
    held, ledger = secrets.update_ledger(docs)
    by_path = secrets.findings_by_path(held, ledger).filter(F.size("findings") > 0)
    hits = small(materialize(by_path.groupBy("path", "blob_id").agg(F.first("findings").alias("findings")), "hits"))
    texts = docs.select("doc_id", "text", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob"))
    found = texts.join(hits, F.col("doc_id").eqNullSafe(F.col("path")) & (F.col("blob") == F.col("blob_id")), "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            spans = [None if x is None else [(s["kind"], s["from"], s["to"]) for s in x] for x in f["findings"]]
            f["text"] = [t if s is None else secrets.redact(t, s) for t, s in zip(f["text"], spans)]
            yield f.drop(columns="findings")

    schema = "doc_id long, text string, lang string, source string"
    clean = found.select("doc_id", "text", "lang", "source", "findings").mapInPandas(run, schema)
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences; an empty table gives none."""
    return packing.best_fit_pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_redaction", secret_redaction), ("best_fit_packing", best_fit_packing)]

#: a learned list, components and packing are beyond SQL; tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
