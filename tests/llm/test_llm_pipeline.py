"""The pipeline against plain versions of its stages on the smallest table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoal.llm import decontaminate, queries, simhash
from shoal.llm.common import read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, SF, "documents")
    names = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept.append({r.doc_id: r for r in docs.collect()})
        if name != "mixing":
            assert docs.columns == names
    toxic, single, clean, masked, mixed = kept
    prints = {i: simhash.fingerprint(r.text) for i, r in toxic.items()}
    for i in toxic:  # one document of each component stays: the smallest
        part, todo = [i], set(toxic) - {i}
        for x in part:
            near = {y for y in todo if bin((prints[x] ^ prints[y]) & (1 << 64) - 1).count("1") <= 3}
            part += sorted(near)
            todo -= near
        assert (i in single) == (i == min(part))
    items = [decontaminate.normal(r.text) for r in read(spark, SF, "benchmark").collect()]
    for i, r in single.items():
        if any(t in decontaminate.normal(r.text) for t in items):
            assert i not in clean
    assert set(masked) == set(clean) and all(r.n_chars == len(r.text) for r in masked.values())
    assert not any('token = "' in r.text and "[SECRET]" not in r.text for r in masked.values())
    assert set(mixed) <= set(masked) and 0.2 < len(mixed) / len(masked) < 0.9
    assert docs.columns == [*names, "n_tokens", "topic", "weight", "probability"]
    assert all(r.text == masked[i].text for i, r in mixed.items())


def test_masked_text_is_returned(spark, tmp_path):
    """A planted secret is masked in what run() returns, beside the original columns."""
    key = "ghp_A81bC92dE03fG14hJ25kL36mN47pQ58rS69t"
    docs = read(spark, SF, "documents")
    held = docs.withColumn("text", F.when(docs.lang == "en", F.concat("text", F.concat(F.lit(f' then token = "{key}" number '), F.col("doc_id").cast("string")))).otherwise(F.col("text")))
    held.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        read(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert not any(key in (r.text or "") for r in out)
    assert sum("[SECRET]" in (r.text or "") for r in out if r.lang == "en") == sum(r.lang == "en" for r in out) > 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stage_edges(spark, edge, nothing, stage):
    """Nulls, repeated rows, empty tables and extra columns: rows kept are rows given, no column is lost."""
    name, apply = corpus_pipeline.STAGES[stage]
    got = apply(spark, edge, SF)
    assert set(edge.columns) <= set(got.columns)
    count = Counter((r.doc_id, r.source, r.lang) for r in edge.collect())
    count.subtract(Counter((r.doc_id, r.source, r.lang) for r in got.collect()))
    assert min(count.values()) >= 0
    if name in ("toxicity", "secrets"):
        assert not +count or name == "toxicity"
    assert apply(spark, nothing, SF).count() == 0


def test_registered(spark):
    import __spark_entry__ as entry

    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
