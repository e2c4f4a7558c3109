"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows as Parquet to the shared
folder and rereads them. All stages but the last return the columns of documents, so extra columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcflow.llm import bpe, decontaminate, line_dedup, quality, simhash
from arcflow.llm.common import materialize, small_batches, table
from arcflow.llm.queries import word_bpe

#: The stages are iterative and learn from their input; run() is tested against brute force instead.
ORACLE_SQL = None


def flat(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns called by their places, and these names: no operator's own column can clash with them."""
    names = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(found: DataFrame, names: dict[str, str], text: Column | None = None) -> DataFrame:
    """The columns of docs; with a new text, n_chars follows it."""
    new = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*(new.get(c, F.col(at)).alias(c) for c, at in names.items()))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    rows, at = flat(docs)
    judged = quality.judge(rows, quality.references(docs), tuple(at.values()), at["text"], at["lang"])
    return back(judged.where("kept"), at)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines; a document of which no line is left goes."""
    small_batches(spark)
    rows, at = flat(docs)
    store = line_dedup.LineStore.build(docs.select("doc_id", "text"))
    kept = store.apply(rows, tuple(at.values()), at["text"], doc_id=at["doc_id"])
    return back(kept.where("n_dropped < n_lines"), at, F.col("kept_text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: 5-word shingles, Jaccard similarity of at least 0.8."""
    small_batches(spark)
    rows, at = flat(docs)
    found = simhash.cluster(rows, tuple(at.values()), at["text"], size=5, doc_id=at["doc_id"], similarity=(4, 5))
    return back(found.where(F.col(at["doc_id"]).eqNullSafe(F.col("component_id"))), at)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; the spans of a single benchmark item are cut out of their document."""
    small_batches(spark)
    rows, at = flat(docs)
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), tuple(at.values()), at["text"], cut=True)
    return back(found.where("not contaminated"), at, F.col("cut_text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids; a column of theirs that is called like a new one becomes input_<name>."""
    small_batches(spark)
    return bpe.encode_decode(docs, word_bpe(), keep=tuple(docs.columns), ids=True)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
