"""The pipeline's stages on a small corpus."""

import pytest

import corpus_pipeline
from wayfold.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("corpus")
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(i, text(i), "en", "s", len(text(i))) for i in range(40)]
    rows += [(100, text(3), "en", "s", 1), (101, text(4) + " more", None, None, None), (102, "password=abcdefgh12 " + text(77), "en", "s", 9), (103, None, "en", None, None), (104, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = docs.cache()
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert len(seen["toxicity"]) == 45
    assert 3 not in seen["exact_dedup"] and 100 in seen["exact_dedup"] and 103 not in seen["exact_dedup"] and len(seen["exact_dedup"]) == 43
    assert 101 not in seen["near_dedup"] and 4 in seen["near_dedup"] and len(seen["near_dedup"]) == 42
    assert seen["secret_scan"][102]["text"].startswith("[SECRET] w77x0") and len(seen["secret_scan"]) == 42
    assert seen["secret_scan"][102]["n_chars"] == len(seen["secret_scan"][102]["text"])
    packed = corpus_pipeline.run(spark, folder).collect()
    own = bpe.codec(corpus_pipeline.TOKENIZER)
    want = {i: len(bpe.encode_text(r["text"] or "", own)) // 4 + 1 for i, r in seen["secret_scan"].items()}
    got = {}
    for r in packed:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want
