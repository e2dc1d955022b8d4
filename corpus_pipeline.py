"""From raw documents to packed training sequences: quality, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import exact_dedup, mixing, near_dup, packing, quality
from larder.llm.queries import ratings
from larder.llm.workspace import Workspace


_spaces: list[Workspace] = []


def _space(spark: SparkSession, name: str) -> Workspace:
    """Tables of a stage. Those of the stage before it go: its result is written by then, and what a stage gets is read from files."""
    while _spaces:
        _spaces.pop().delete()
    _spaces.append(Workspace(spark, name))
    return _spaces[-1]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is at least ``quality.KEEP_FROM``."""
    return quality.select_quality(docs, ratings(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text."""
    return exact_dedup.drop_duplicates(docs, _space(spark, "exact_dedup"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, similarity 0.8."""
    return near_dup.drop_near_duplicates(docs, _space(spark, "near_dup"), words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3 by name; a document comes as often as the mix takes it."""
    return mixing.mix(docs, _space(spark, "mixing"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece in sequences of 4096 tokens."""
    return packing.pack(docs, _space(spark, "packing"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Fitting, near duplicates and packing have no SQL form; tests/llm compares the run with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"stage-{i}")
        space.drop(f"stage-{i - 1}")
    return docs
