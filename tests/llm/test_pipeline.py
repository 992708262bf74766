import corpus_reference as plain
from conftest import SF
from corpus_fixtures import no_docs, odd_docs  # noqa: F401

import __spark_entry__ as entry_points
import corpus_pipeline
from wareloom.llm import decontamination, quality, toxicity


def test_pipeline_keeps_what_each_stage_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {row.doc_id: row.text for row in docs.collect()}
    toxic = toxicity.score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {row.doc_id for row in toxic.collect() if not row.predicted}
    good = {row.doc_id for row in quality.quality_rules(docs).collect() if row.kept}
    kept &= good
    first = plain.components([(i, texts[i]) for i in kept])
    kept = {i for i in kept if first[i] == i}
    leaked = decontamination.find_contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    kept -= {row.doc_id for row in leaked.collect() if row.contaminated}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {row.doc_id for row in rows} == kept
    assert sum(row.length for row in rows) == sum(len(plain.token_ids(texts[i])) + 1 for i in kept)


def test_stages_return_documents(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, no_docs, SF).count() == 0
        assert stage(spark, rows, SF).columns == rows.columns


def test_registered():
    assert corpus_pipeline.STAGES and "pipeline" in entry_points.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in entry_points.queries()}
