import random

import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from acctpulse.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def both(library, texts):
    n_bytes, n_tokens = token_counts.counter(token_counts.read_vocabulary(PATH))(texts)
    assert n_bytes.tolist() == [len(t.encode()) for t in texts]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    wrong = [(t, a, b) for t, a, b in zip(texts, n_tokens.tolist(), expected) if a != b]
    assert not wrong, wrong[:3]


def test_hand_picked_texts(library):
    both(library, [
        "", " ", "a", "it's we're I'll 'sabc ''s .'s x 's\t's'd'm",  "a  b   c\n\n d \n", "  ", "\n\n", "end  ", "tab\t\tword",
        "12345 a1b2 ½ Ⅷ", "naïve Éçole ñ über ß", "日本語 テスト 한국어 🙂🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "!!!!!!!! ---- ====",
        "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>x ", "'<|endoftext|>s", " x  y　\x1cz\x85", "can't'VE 'Re 're",
    ])


def test_random_texts(library):
    rng = random.Random(3)
    signs = "abcdest 'lmrv  \n\t.,!1234é漢🙂ſ́​"
    both(library, ["".join(rng.choice(signs) for _ in range(rng.randint(0, 200))) for _ in range(400)])


def test_long_pre_tokens(library):
    rng = random.Random(4)
    both(library, ["".join(rng.choice("etaoin") for _ in range(20000)), "ab" * 10000, "x" * 9999, " " * 5000 + "a"])


def test_frame(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: (r.tc_bytes, r.tc_tokens) for r in token_counts.count_tokens(docs, PATH).collect()}
    rows = docs.collect()
    assert got == {r.doc_id: (len(r.text.encode()), len(library.encode(r.text, add_special_tokens=False).ids)) for r in rows}


def test_nulls_and_clashing_columns(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])
    docs = spark.createDataFrame([(1, None, "x"), (None, "two words", None), (1, "", "y"), (1, None, "x")], schema)
    got = sorted((r.tc_tokens, r.n_tokens or "") for r in token_counts.count_tokens(docs, PATH).collect())
    assert got == [(0, "x"), (0, "x"), (0, "y"), (2, "")]
    assert token_counts.count_tokens(docs.limit(0), PATH).count() == 0
