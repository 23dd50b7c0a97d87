import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from occugrid.llm import queries, tokens

TEXTS = [
    "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|endoftext|> b.", "plain <|endoftext|",
    "  <|endoftext|>  x", " \n" * 3000 + "<|endoftext|>" + "\t" * 2500 + "c", "", "é.<|endoftext|>\n\nß",
]


@pytest.fixture(scope="module")
def loaded():
    """The tokenizer as its file has it."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_loaded_tokenizer(loaded):
    vocabulary = tokens.default_vocabulary()
    for text in TEXTS:
        assert tokens.encode_with_added(text, vocabulary).tolist() == loaded(text)


def test_queries_read_the_added_token(spark, make_docs, tmp_path, loaded):
    docs = make_docs([(i, text, "s") for i, text in enumerate(TEXTS)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {i: np.array([*loaded(text), 0], "<u4").tobytes() for i, text in enumerate(TEXTS)}
    found = {i: b"" for i in wanted}
    for d in sorted(queries.op1_packed_sequences(spark, str(tmp_path)).collect(), key=lambda d: d["start"]):
        i, first, last = d["doc_id"], 4 * d["start"], 4 * (d["start"] + d["length"])
        assert d["doc_tokens"] == len(wanted[i]) // 4
        assert d["ids_crc32"] == zlib.crc32(wanted[i][first:last])
        found[i] += wanted[i][first:last]
    assert found == wanted
    pieces = corpus_pipeline.packed_sequences(spark, docs, str(tmp_path)).collect()
    whole = {i: b"" for i in wanted}
    for p in sorted(pieces, key=lambda p: p["start"]):
        whole[p["doc_id"]] += bytes(p["ids"])
    assert whole == wanted
