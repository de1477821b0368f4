"""The pipeline's stages one by one against brute force, and as a whole."""

import collections

from pyspark.sql import functions as F
from test_documents import jaccard_groups


def test_stages(spark, sf, tmp_path):
    import corpus_pipeline as cp
    from factloom.llm import mixing, nbest, pii, rules

    assert [n for n, _ in cp.STAGES] == ["quality rules", "near duplicates", "private data", "mixing", "encoding"]
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(cp.STAGES):
        kept.append(docs)
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    ids = lambda df: collections.Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(kept[1]) == ids(rules.judge(kept[0]).where("kept"))
    # stages on word shingles take five words and a similarity of 0.8, unlike op9's own contract
    assert ids(kept[2]) == jaccard_groups([(r.doc_id, r.text) for r in kept[1].select("doc_id", "text").collect()])
    assert ids(kept[3]) == ids(kept[2])
    texts = {r.doc_id: r for r in kept[3].collect()}
    for r in kept[2].collect():
        found = {r.text[a:b] for a, b, kind, _ in pii.find(r.text)}
        assert not any(x in texts[r.doc_id].text for x in found) and texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
    draws = {r.doc_id: r.k for r in mixing.plan(kept[3]).select("doc_id", F.size("draws").alias("k")).collect() if r.k}
    assert ids(kept[4]) == draws
    vocabulary = nbest.Vocabulary.load()
    assert ids(docs) == draws and all(vocabulary.decode(r.ids) == texts[r.doc_id].text and r.ids == vocabulary.encoder.encode(texts[r.doc_id].text) for r in docs.collect())
    assert ids(cp.run(spark, sf)) == draws
