"""Encoding by trees of any shape equals plain encoding; decoding gives the text back."""

import random

import pytest

from tests.conftest import rows
from tremolith.llm import tokens
from tremolith.llm.tokens import decode_documents, encode_documents, join, leaf, load, token_counts, tree

PATH = f"{tokens.TOKENIZERS}/{tokens.BYTE_BPE}"
TEXTS = [
    "", " ", "   \n\n  x", "it's we'll they've 'tis rock'n'roll", "a" * 700, " " * 300 + "b", "<|endoftext|> <|endoftext|>", "\x00\x1b[31mred\r\n\tend",
    "日本語のテキスト、カタカナ。" * 9, "👩‍💻🤦🏽‍♀️ ok 👍" * 7, "Straße 12345 mm² ½ № ①", "x" * 50 + "'" + "re" * 3 + "'" * 90, "the end   ", "　\xa0   wide", "12 " * 200,
]


def plain(text):
    return load(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf_chars,window", [(1, 1), (2, 3), (7, 2), (64, 8)])
def test_trees_of_any_leaf_size(leaf_chars, window):
    for text in TEXTS:
        if text:
            assert tree(load(PATH), text, leaf_chars, window).ids.tolist() == plain(text), text


def test_random_texts_and_cuts():
    r = random.Random(1)
    alphabet = ["a", "b", "'", "s", "'re", "'ll", " ", "  ", "\n", "1", "9", ".", "-", "é", "日", "👍", "\r\n", "\t", "The", " of"]
    for _ in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(1, 40)))
        cut = r.randrange(0, len(text) + 1)
        parts = [p for p in (text[:cut], text[cut:]) if p]
        whole = leaf(load(PATH), parts[0])
        for p in parts[1:]:
            whole = join(load(PATH), whole, leaf(load(PATH), p), r.choice([1, 2, 64]))
        assert whole.ids.tolist() == plain(text), (text, cut)
        assert whole.ends.tolist() == leaf(load(PATH), text).ends.tolist()


@pytest.mark.parametrize("segment", [16, 262_144])
def test_documents(spark, segment):
    data = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(100, None, "x"), (None, "no id", "x"), (3, TEXTS[3], "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, id string")
    got = encode_documents(df, segment=segment)
    assert rows(got) == sorted(((i, plain(t) if t else []) for i, t, _ in data), key=repr)
    assert rows(decode_documents(got)) == sorted(((i, t or "") for i, t, _ in data), key=repr)
    assert rows(token_counts(df)) == sorted(((i, len(plain(t)) if t else 0) for i, t, _ in data), key=repr)


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_counts_keep_columns_and_take_segments(spark):
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, tokens string")
    got = token_counts(df.withColumnRenamed("tokens", "source"), keep=["source"], segment=16)
    assert rows(got) == sorted(((i, f"s{i % 3}", len(plain(t)) if t else 0) for i, t in enumerate(TEXTS)), key=repr)


def test_ranks_give_the_same_ids_as_merges():
    encoder = tokens._by_rank(PATH)
    assert encoder is not None
    for text in TEXTS:
        assert encoder.encode_ordinary(text) == plain(text)


def test_a_tokenizer_with_a_normalizer_encodes_texts_whole(spark):
    path = f"{tokens.TOKENIZERS}/word_bpe_49k.json"
    texts = [t for t in TEXTS if t] + ["Some WORDS " * 900]
    assert not tokens.byte_level(load(path)) and tokens._by_rank(path) is None
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = dict(map(tuple, encode_documents(df, tokenizer="word_bpe_49k.json", leaf_chars=16, segment=64).collect()))
    assert got == {i: load(path).encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
