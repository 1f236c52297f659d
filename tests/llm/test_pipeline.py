"""The pipeline's stages on a small table, each against what it should keep and change."""

import zlib

import public_tokenizers

import corpus_pipeline
from kelpline.llm import secrets

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def clean(i):
    return " ".join(f"word{zlib.crc32(f'{i}:{j}'.encode()) % 5000:x}" for j in range(40))


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "mixing", "bpe"]
    texts = [clean(i) for i in range(40)]
    texts += [texts[3], texts[4] + " more", None, "", "12 34 --", clean(45) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "<|endoftext|> " + clean(46) + " tail tail tail tail tail tail tail tail tail tail tail tail tail"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], ROW)
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "unused").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.collect())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in seen[0]} == set(range(len(texts))) - {42, 43, 44}
    kept = {r.doc_id for r in seen[1]}
    assert kept == {r.doc_id for r in seen[0]} - {40, 41}
    masked = {r.doc_id: r for r in seen[2]}
    assert set(masked) == kept and "[SECRET]" in masked[45].text and masked[45].n_chars == len(masked[45].text)
    assert all(masked[i].text == texts[i] for i in kept - {45}) and not any(secrets.base_spans(r.text) for r in seen[2])
    total = sum(len(r.text.split()) for r in seen[2])
    taken = sum(len(r.text.split()) for r in seen[3])
    assert abs(taken - total) <= 3 * max(len(r.text.split()) for r in seen[2])
    assert {r.text for r in seen[3]} <= {r.text for r in seen[2]}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(seen[4]) == len(seen[3])
    for r in seen[4]:
        assert r.text == masked[r.doc_id].text and r.n_tokens == len(tokenizer.encode(r.text, add_special_tokens=False).ids) == len(r.ids) // 4


def test_stages_of_nothing_and_of_nulls(spark, tmp_path):
    nulls = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (3, "one two", None, None, None), (None, clean(1), None, "s", 5), (None, clean(1), None, "s", 5)], ROW)
    for name, docs in (("empty", nulls.limit(0)), ("nulls", nulls)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, "unused").write.parquet(str(tmp_path / name / str(i)))
            docs = spark.read.parquet(str(tmp_path / name / str(i)))
        assert docs.columns == ["doc_id", "n_tokens", "ids", "text"]
    assert docs.count() == 0  # without any language to learn from, every document is rejected
    some = spark.createDataFrame([(i, clean(i % 9), "en", None, None) for i in range(30)] + [(None, clean(2), None, None, 1)] * 3, ROW)
    kept = corpus_pipeline.near_duplicates(spark, some, "unused").collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in kept if r.doc_id is not None) == [(False, i) for i in range(9)] and len(kept) == 12


def test_run_stores_the_last_stage(spark, tmp_path):
    spark.createDataFrame([(i, clean(i), "en", f"s{i % 2}", 9) for i in range(20)], ROW).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= set(range(20)) and all(r.text == clean(r.doc_id) for r in rows) and len(rows) >= 18


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert {"op1_sharding", "op2_mixing", "op5_jaccard_join", "op6_embedding_dedup", "op7_url_filter", "op8_topk_search"} <= set(__spark_entry__.oracle_sql())
