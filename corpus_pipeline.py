"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``. A stage begins by
deleting the scratch tables of the stages before it, unless ``docs`` still reads them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import op4_jaccard, op5_substrings, op8_decontaminate, op9_toxicity, op10_packing
from strata.llm.common import folders_made, keep, release, scratch_dir, table

_left: list[str] = []


def stage(f: Callable) -> Callable:
    """A stage that leaves no scratch tables behind once its result has been written."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reads = docs.inputFiles() if _left else []
        for folder in [x for x in _left if not any(x.rstrip("/").rsplit("/", 1)[-1] in r for r in reads)]:
            release(spark, folder)
            _left.remove(folder)
        with folders_made() as folders:
            out = f(spark, docs, sf_dir)
        _left.extend(folders)
        return out

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on ``docs``, rejects go; all others stay."""
    model = op9_toxicity.fitted(spark, docs, sf_dir)
    return op9_toxicity.score(docs, model).where(F.col("predicted") == 0).select(*docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row stays: that of the smallest id, of the smallest text
    where ids repeat; rows without an id come last. Documents without words are similar to none and stay,
    but of rows equal in all columns one."""
    return op4_jaccard.one_of_each(docs)


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every byte of a string of 200 bytes that occurs elsewhere in ``docs``."""
    found = op5_substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return found.withColumns(new).select(*docs.columns)


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item, edited or not, go."""
    marked = op8_decontaminate.mark_leaks(docs, table(spark, sf_dir, "benchmark"))
    return marked.where(F.size("leaks") == 0).select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return op10_packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Learning, byte-exact removal and tokenisation can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again,
    and goes when the next one's is there."""
    docs, where, before = table(spark, sf_dir, "documents"), scratch_dir(spark), None
    for name, step in STAGES[:-1]:
        docs = keep(step(spark, docs, sf_dir), where, name)
        if before is not None:
            release(spark, f"{where}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
