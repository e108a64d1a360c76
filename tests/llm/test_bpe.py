"""Ids against the public library, and back."""

import random

import pytest

from basewise.llm import bpe

PATH = f"{bpe.FOLDER}/byte_bpe_50k.json"
tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None, "", " ", "\n\n  x\n y 's ' s it's<|endoftext|> z　x   z", "a\x1cb c\x1d \x85x\x0b\x0c y", "日本語\n\n foo\n\tbar", "٣٤ Ⅷ x²", "\U0001f680 a\n b", "x \n\n y\n", "\r\n\r\nabc\r\n  d",
    "abc" * 5000, "-" * 3000, "é\n\x1c\nb", "x" * 70 + " " + "x" * 70, "a" + " " * 500 + "b",
]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_texts(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(df, PATH).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == (library.encode(t, add_special_tokens=False).ids if t else [])
        assert bpe.vocabulary(PATH).decode(got[i]) == (t or "")
    assert bpe.encode_texts(df.where("false"), PATH).count() == 0


def test_random_texts(library):
    rnd = random.Random(7)
    letters = " \n\t\r'stredlmv09aé日　\xa0\x1c\x85.-́"
    for _ in range(3000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40)))
        assert bpe.encode(t, PATH) == library.encode(t, add_special_tokens=False).ids


def test_corpus(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in bpe.encode_texts(df, PATH).collect():
        assert r["ids"] == (library.encode(texts[r["doc_id"]], add_special_tokens=False).ids if texts[r["doc_id"]] else [])
