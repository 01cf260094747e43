"""A corpus pipeline of five stages over `documents`; each one's result is written as Parquet and read again as the next one's input.

quality: documents that the classifier rejects go. near_duplicates: of each group of near copies (five-word shingles, Jaccard
similarity of 0.8 or more) the smallest doc_id stays. substrings: words of windows that started earlier go; so does a document
that loses all. decontamination: documents with a window of any benchmark item go. bpe: token ids are added.

Each stage's operator sees doc_id and text by these names and all other columns by names of their own, so that none clashes with what the
operator adds; they come back as they were. Should the input have a column token_ids, n_tokens or round_trip, the last stage's own one of
that name has "_" behind it. Null and empty texts are scored like others, are near copies of each other (one stays), lose no words,
are not contaminated and have no tokens; very long texts are whole in every stage; of ties, near copies and repeated rows one stays, that of
the smallest doc_id (a null doc_id comes last); empty tables give empty ones; without labels of both kinds every document is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.llm import bpe, decontaminate, quality, simhash, substring
from kestrelq.llm.common import Workspace, release, table


def _kept(docs: DataFrame, operate: Callable[[DataFrame], DataFrame], new: tuple[str, ...] = ()) -> DataFrame:
    """What the operator keeps, with the columns of docs, and its new ones under free names."""
    own = [c if c in ("doc_id", "text") else f"__own_{k}" for k, c in enumerate(docs.columns)]
    made = operate(docs.toDF(*own))
    taken = {c.lower() for c in docs.columns}
    free = lambda c: c if c.lower() not in taken else free(f"{c}_")
    return made.select(*(F.col(f"`{a}`").alias(c) for a, c in zip(own, docs.columns, strict=True)), *(F.col(c).alias(free(c)) for c in new))


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda own: quality.classify(own, table(spark, sf_dir, "labels")).filter("predicted = 1"))


def by_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, simhash.deduplicate)


def by_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = _kept(docs, lambda own: substring.deduplicate(own).filter("n_removed = 0 OR text <> ''"), ("n_removed",))
    removed = made.columns[-1]
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return made.drop(removed)


def by_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda own: decontaminate.clean(own, table(spark, sf_dir, "benchmark"), least_items=1))


def by_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # one worker encodes and decodes
    encode = lambda own: bpe.encode(own, checked="round_trip").withColumn("n_tokens", (F.octet_length("token_ids") / 4).cast("long"))
    return _kept(docs, encode, ("token_ids", "n_tokens", "round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", by_quality),
    ("near_duplicates", by_near_duplicates),
    ("substrings", by_substrings),
    ("decontamination", by_decontamination),
    ("bpe", by_bpe),
]

#: No SQL expresses the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
        release(spark)
    return docs
