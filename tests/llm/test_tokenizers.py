"""op4 and op8 against the libraries whose results they must give."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries, sp_codec, token_count

RANKS = sp_codec.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r'sdrevml<|endoftext|>aéß1\x85\xa0 \x1c")), max_size=60)


@pytest.fixture(scope="module")
def brute():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def word_json():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(word_json):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(word_json)


def digests(ids):
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_codec_gives_the_librarys_ids_and_bytes(brute):
    codec = sp_codec.Codec(sp_codec.serialise_model(RANKS), public_tokenizers.PATTERN, cache_size=50)

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def check(text):
        ids = codec.encode(text)
        assert ids == brute.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()

    check()


def test_op4_over_documents(spark, docs, odd, empty, brute):
    for df in (docs, odd):
        rows = sp_codec.encode_decode(df, RANKS, public_tokenizers.PATTERN).collect()
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = brute.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), digests(ids), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert sp_codec.encode_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert sp_codec.encode_decode(odd, RANKS, public_tokenizers.PATTERN, with_ids=True).where("doc_id = 1").first().decoded.startswith(b"The quick")


def test_counts_are_the_librarys(word_json, library):
    counter = token_count.Counts(word_json, {"the": 1}, cache_size=20)

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def check(text):
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)

    check()


def test_op8_over_documents(spark, docs, odd, empty, word_json, library):
    for df in (docs, odd):
        rows = token_count.count_tokens(df, word_json).collect()
        want = []
        for r in df.select("doc_id", "text").collect():
            n = len(library.encode(r.text or "", add_special_tokens=False).ids)
            want.append((r.doc_id, len((r.text or "").encode()), n, n > 2048))
        assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert token_count.count_tokens(empty, word_json).count() == 0


def test_a_tokenizer_whose_tokens_span_space_is_refused(spark):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        model = file.read()
    with pytest.raises(ValueError, match="span white space"):
        token_count.count_tokens(spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string"), model)


def test_registered(spark, sf, docs):
    assert queries.QUERIES["op4_byte_bpe"](spark, sf).count() == docs.count()
