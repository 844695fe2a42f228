import corpus_pipeline
from tidewater.llm import pii
from tidewater.llm.queries import QUERIES

from .fixtures import empty, odd
from .test_copies import kept_ids


def test_stages_in_turn(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    for name in ("toxicity", "near_duplicates", "personal_data", "mixing"):
        assert tables[name].columns == before.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet").join(before, "doc_id")
    kept = {r["doc_id"] for r in tables["toxicity"].collect()}
    clean = [r["doc_id"] for r in labels.filter("toxic = 0").collect()]
    assert sum(k in kept for k in clean) > 0.97 * len(clean)
    ids = sorted(r["doc_id"] for r in tables["near_duplicates"].collect())
    assert ids == kept_ids([(r["doc_id"], r["text"]) for r in tables["toxicity"].collect()])
    masked = tables["personal_data"]
    assert sorted(r["doc_id"] for r in masked.collect()) == ids and masked.filter("n_chars <> length(text)").count() == 0
    assert pii.detect(masked).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    mixed = tables["mixing"].groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in mixed} <= set(ids) and max(r["count"] for r in mixed) <= 2
    packed = tables["packing"].collect()
    assert sum(r["piece"] == 0 for r in packed) == tables["mixing"].count()
    fill = {}
    for r in packed:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 4096


def test_run_agrees_with_stages(spark):
    sf = "/root/testdata/sf0.001"
    a, b = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(a) == key(b) and a.count() > 0


def test_odd_and_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    for table in (odd(spark), empty(spark)):
        docs = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == table.columns
        docs.count()


def test_names():
    assert [f"op{n}" for n in range(1, 14)] == [q.split("_")[0] for q in sorted((q for q in QUERIES if q.startswith("op")), key=lambda q: int(q.split("_")[0][2:]))]
