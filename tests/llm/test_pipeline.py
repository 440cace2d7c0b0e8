"""The pipeline against a brute-force version of all its stages."""

from __future__ import annotations

import pytest

pytest.importorskip("public_tokenizers")


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    import corpus_pipeline
    from redactory.llm.decontam import WORD_BYTES
    from pyspark.sql import functions as F
    from redactory.llm.mixture import mix_documents
    from redactory.llm.quality import quality_report
    from redactory.llm.simhash import shingle_hashes
    from test_operators import brute_tokens

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality_report(docs).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    # the rule of the stage: five words, an exact Jaccard similarity of 0.8 or more
    sets, label = [set(shingle_hashes(t or "", 5).tolist()) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                least, most = sorted((label[i], label[j]))
                label = [least if x == most else x for x in label]
    rows = [r for i, r in enumerate(rows) if label[i] == i]
    words = lambda t: (t or "").encode().translate(WORD_BYTES).split()
    windows = {tuple(w[k : k + min(10, len(w))]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if (w := words(r.text)) for k in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(x) for x in windows}
    rows = [(i, t) for i, t in rows if not any(tuple(w[k : k + m]) in windows for w in [words(t)] for m in sizes for k in range(len(w) - m + 1))]
    lengths = F.create_map(*(F.lit(x) for i, _, n, _ in brute_tokens(rows) for x in (i, n - 1)))  # budgets are in ids, without the end
    copies = {r.doc_id: r["__copies"] for r in mix_documents(docs.where(docs.doc_id.isin([i for i, _ in rows])), tokens=lengths[F.col("doc_id")]).collect()}
    mixed = [(i, t) for i, t in rows for _ in range(copies[i])]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == sorted(brute_tokens(mixed))
    assert 0 < len(rows) < docs.count()


def test_near_dedup_stage_equals_exact_jaccard(spark, sf_dir):
    import corpus_pipeline
    from redactory.llm.simhash import shingle_hashes

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets, label = [set(shingle_hashes(t or "", 5).tolist()) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8):
                least, most = sorted((label[i], label[j]))
                label = [least if x == most else x for x in label]
    got = sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir).collect())
    assert got == [i for k, (i, _) in enumerate(rows) if label[k] == k] and len(got) < len(rows)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
