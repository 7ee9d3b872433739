"""The pipeline's stages, each against what its operator decides, and as a whole."""

import corpus_pipeline as cp

from riftscan.llm import quality
from tests.llm import test_operators as t


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.columns == columns
        kept[name] = (before, after, docs)
        docs = after
    before, after, first = kept["quality_rules"]
    rules = quality.learn(first, spark.read.parquet(f"{sf}/labels.parquet"))
    want = {r.doc_id for r in quality.judge(first, rules).where("kept").select("doc_id").collect()}
    assert {r.doc_id for r in after.collect()} == want
    before, after, _ = kept["near_duplicates"]
    links = t.links_of(list(before.items()))
    assert {r.doc_id for r in after.collect()} == {i for i, x in before.items() if links[x][0] == i}
    before, after, _ = kept["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    scanned = dict(zip(before, t.scan_of(before.values(), items)))
    assert {r.doc_id for r in after.collect()} == {i for i, (n, hit, _) in scanned.items() if not (hit and 20 * hit >= n)}
    before, after, _ = kept["personal_data"]
    for r in after.collect():
        counts, _ = t.base_of(before[r.doc_id])
        assert sum(t.base_of(r.text)[0]) == 0 or sum(counts) == 0
        assert r.n_chars == len(r.text) and (sum(counts) > 0) <= (r.text != before[r.doc_id])
    before, after, _ = kept["packing"]
    assert t.check_pieces(after.collect(), before) < 0.02


def test_run(spark, sf):
    rows = cp.run(spark, sf).collect()
    assert rows and len({(r.doc_id, r.start) for r in rows}) == len(rows)


def test_odd_tables(spark, odd, empty, sf):
    for docs in (odd, empty):
        d = docs
        for name, stage in cp.STAGES[:-1]:
            d = stage(spark, d, sf)
            assert d.columns == docs.columns
        assert cp.STAGES[-1][1](spark, d, sf).count() >= 0
    for name, stage in cp.STAGES[1:]:
        assert stage(spark, odd, sf).count() > 0
