"""A pipeline that prepares `documents` for training: filters, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as
Parquet and read again before the next. All but the last return the columns of documents.
"""

from wareloom.llm import decontamination, near_dup, packing, quality, toxicity
from wareloom.llm.common import read_table
from wareloom.session import RunTables


def toxicity_stage(spark, docs, sf_dir):
    """Documents scored below the toxicity threshold."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality rules keep, by the limits of all documents."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "documents"))


def near_dup_stage(spark, docs, sf_dir):
    """One document, the one with the smallest id, of each group of near copies."""
    return near_dup.keep_first(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold no item of the benchmark."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark, docs, sf_dir):
    """Pieces of the documents in sequences of fixed length."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Learned scores, compression ratios and packing have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`."""
    tables = RunTables(spark, "corpus-pipeline")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = tables.write(stage(spark, rows, sf_dir), name)
    return STAGES[-1][1](spark, rows, sf_dir)
