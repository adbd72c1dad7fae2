"""The corpus pipeline against plain versions of its decisions."""

import shutil

import corpus_pipeline
from salestide.llm import decontam, mixing
from tests.llm.test_minhash import plain_roots

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_decisions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    roots = plain_roots([r.text for r in rows])
    # of each group of near copies the smallest id stays, as ids ascend
    first = {rows[roots.index(r)].doc_id for r in set(roots)}
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    leaked = {r.doc for r in decontam.leaks(docs, bench).select("doc").collect()}
    stay = docs.where(docs.doc_id.isin([r.doc_id for r in rows if r.doc_id in first and r.doc_id not in leaked]))
    want = sorted(r.doc_id for r in mixing.mix(stay).collect())
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in got) == want
    texts = {r.doc_id: r.text for r in rows}
    assert all(r.text == texts[r.doc_id] for r in got)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_empty_documents(spark, tmp_path):
    spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 0").write.parquet(str(tmp_path / "documents.parquet"))
    shutil.copy(f"{FOLDER}/benchmark.parquet", tmp_path / "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
