import public_tokenizers

import corpus_pipeline
from marketweave.llm import byte_bpe, queries

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "byte_bpe"]
    texts = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, DATA).cache()
        seen.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "pii":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert any("[EMAIL]" in t for t in texts.values())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert seen[0] >= seen[1] > seen[2] == seen[3] and seen[5] == seen[4] > 0
    ids = docs.select("doc_id", "ids").limit(20)
    back = byte_bpe.decode(ids, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert all(bytes(r["text"]).decode() == texts[r["doc_id"]] for r in back.collect())


def test_every_operator_has_a_query():
    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14))
