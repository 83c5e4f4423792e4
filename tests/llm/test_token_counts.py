import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkgraph.llm.token_counts import Encoder, count_tokens

BITS = ["a", "B", " ", "  ", "\n", "\t", "<|endoftext|>", "'s", " 't", "é", "́", " ", "\x1c", "½", "1", ".", "日本", "😀", "​", " x "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_whole_text_encoding(name):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 60))) for _ in range(2000)] + ["word " * 30000]
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.no_truncation()
    want = [len(plain.encode(x, add_special_tokens=False)) for x in texts]
    assert Encoder(public_tokenizers.path(name), most_known=50).counts(texts, 1000) == want


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "Hello world", 7), (1, "Hello world", 8), (None, None, 9), (2, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), limit=1).collect(), key=str)
    assert [tuple(x) for x in got] == [(1, 11, 2, True), (1, 11, 2, True), (2, 0, 0, False), (None, 0, 0, False)]
    assert count_tokens(df.where(F.lit(False)), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_sentencepiece_model(spark):
    df = spark.createDataFrame([(1, "hello  world"), (2, None)], "doc_id long, text string")
    got = {x.doc_id: x.n_tokens for x in count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert got[1] >= 2 and got[2] == 0
