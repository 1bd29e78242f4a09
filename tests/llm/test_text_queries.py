"""The registered text queries against their SQL, and the pipeline against its stages."""

import __spark_entry__ as entry_file
import corpus_pipeline
import oracle
import pytest
from tidewatch.llm import queries

SMALL = "/root/testdata/sf0.01"


def test_all_registered():
    names = entry_file.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert oracle.differences(queries.QUERIES[name](spark, SMALL), oracle.connect(SMALL), queries.SQL[name]) is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    kept, texts = [], []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == columns
        kept.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    language, lines, near, mixed = kept
    assert len(language) > 950 and sorted(language) == sorted(lines)
    assert any(texts[0][i] != texts[1][i] for i in language)
    assert len(set(near)) == len(near) < len(lines) and set(near) <= set(lines)
    assert set(mixed) <= set(near) and len(mixed) > len(set(mixed))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    starts = [p["doc_id"] for p in pieces if p["start"] == 0]
    assert sorted(starts) == sorted(mixed)
