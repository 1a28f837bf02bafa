"""The last stage of the pipeline returns token ids and decoded texts."""

import hashlib

import public_tokenizers

import corpus_pipeline


def test_encode_gives_ids_and_text(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["parse the graph node", "it's café 12 3.5", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in corpus_pipeline.encode(spark, docs, "").collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert len(r["ids"]) == r["n_tokens"] and hashlib.sha256(r["decoded"].encode()).hexdigest() == r["decoded_sha256"]
