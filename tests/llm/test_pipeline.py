"""The pipeline's stages against brute force over what each was given."""

import corpus_pipeline
from test_llm import brute_components, brute_contained, brute_removed, words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == columns
    good = {i: r.text for i, r in seen["quality"].items()}
    assert 0 < len(good) < len(before)
    groups = brute_components(good)
    assert set(seen["near_dedup"]) == {i for i, (_, c) in groups.items() if c == i}
    one = {i: r.text for i, r in seen["near_dedup"].items()}
    for i, (n, gone, _) in brute_removed(one).items():
        if gone == n and n:
            assert i not in seen["substring_dedup"]
        else:
            assert len(words(seen["substring_dedup"][i].text)) == n - gone
            assert gone or seen["substring_dedup"][i].text == one[i]
    cut = {i: r.text for i, r in seen["substring_dedup"].items()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    leaks = {i for i, *_ in brute_contained(cut, items)}
    assert set(seen["decontamination"]) == set(cut) - leaks
    assert set(seen["bpe"]) == set(seen["decontamination"])
    assert corpus_pipeline.run(spark, SF).count() == len(seen["bpe"])


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""
    d = str(tmp_path)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("length(text) > 300 and lang is not null").orderBy("doc_id").limit(5).collect()
    odd = [(10**6 + i, t, None, None, None) for i, t in enumerate([None, "", "   ", first[0].text, first[0].text, " ".join([first[1].text] * 60)])]
    odd += [tuple(first[0]), tuple(first[0]), (None, first[3].text, None, None, None), (None, first[4].text, None, None, None)]
    odd += [(2 * 10**6, " ".join(f"{k}{i}" for i in range(60)), None, None, None) for k in "pq"]
    own = docs.limit(40).union(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'k' as kept", "1 as left", "0.5D as score", "true as gone")
    own.write.parquet(f"{d}/documents.parquet")
    before = spark.conf.get(corpus_pipeline.BATCHES)
    got = [r.doc_id for r in corpus_pipeline.run(spark, d).collect()]
    assert got and spark.conf.get(corpus_pipeline.BATCHES) == before
    assert not {10**6 + i for i in range(5)} & set(got)  # without words, or a copy of an earlier document
    rows = own
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.materialise(stage(spark, rows, d), name)
        assert rows.columns == own.columns
    none = own.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert corpus_pipeline.materialise(stage(spark, none, d), name).count() == 0
