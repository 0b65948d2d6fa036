"""op12 against whole texts, their tokens and all pairs of them."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import alignment, queries, sp_codec

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \t\n\n.,!\r'sdrevml<|endoftext|>aéß1\x85\xa0 \x1c▁\x00")), max_size=60)


@pytest.fixture(scope="module")
def models():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


def tokens(text, models, cache={}):  # noqa: B006
    """[(id, bytes)] of each side over the whole text; nothing where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not cache:
        cache["a"] = Tokenizer.from_str(models[0])
        cache["a"].encode_special_tokens = True
        cache["b"] = sentencepiece.SentencePieceProcessor(model_proto=models[1])
        cache["letters"] = {c: i for i, c in enumerate(sp_codec.byte_letters())}
    if not text:
        return [], []
    found = cache["a"].encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(cache["letters"][c] for c in t)) for i, t in zip(found.ids, found.tokens)]
    b = []
    for i in cache["b"].encode(text):
        piece = cache["b"].id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and piece.endswith(">") else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    return a, b


def spans(toks):
    out, at = [], 0
    for i, raw in toks:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def linked(a, b):
    return [(i, j) for i, s, e in spans(a) for j, t, f in spans(b) if s < f and t < e]


def grouped(a, b):
    out, i, j = [], 0, 0
    sa, sb = spans(a), spans(b)
    for cut in sorted({e for *_, e in sa} & {e for *_, e in sb}):
        k, m = i, j
        while k < len(sa) and sa[k][2] <= cut:
            k += 1
        while m < len(sb) and sb[m][2] <= cut:
            m += 1
        out.append(",".join(str(x[0]) for x in sa[i:k]) + "|" + ",".join(str(x[0]) for x in sb[j:m]))
        i, j = k, m
    return out


def brute(rows, models):
    both = [(d, *tokens(t or "", models)) for d, t in rows]
    links = [linked(a, b) for _, a, b in both]
    count = Counter(p for x in links for p in set(x))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for (d, a, b), x in zip(both, links):
        g = grouped(a, b)
        out.append((d, len(a), len(b), len(g), len(x), sum(count[p] == top[p[0]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""))
    return out, count


def short(df):
    """Rows whose texts the quadratic version can take."""
    from pyspark.sql import functions as F

    return df.where(F.length("text").isNull() | (F.length("text") < 3_000))


def test_units_give_the_whole_texts_tokens(models):
    units = alignment.Units(alignment.Pair(*models), size=50)
    assert units.pair.cuts

    @settings(max_examples=400, deadline=None)
    @given(TEXTS)
    def check(text):
        a, b = tokens(text, models)
        n, places = units.of([text])
        sums = units.sums(n, places)[:, 0].tolist()
        assert sums[1:5] == [len(a), len(b), len(grouped(a, b)), len(linked(a, b))]
        if a:
            assert ";".join(units.groups[p] for p in places) == ";".join(grouped(a, b))

    check()


def test_over_documents(spark, docs, odd, empty, models):
    for df in (docs, odd):
        df = short(df)
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        want, count = brute(rows, models)
        got = alignment.align(df.repartition(7), *models).select(*COLUMNS).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        pairs = {(r.a, r.b): r.n for r in alignment.pair_counts(df, *models).collect()}
        assert pairs == dict(count)
    assert alignment.align(empty, *models).count() == 0
    groups = alignment.align(odd, *models, with_groups=True).where("doc_id = 7").first()  # a very long text
    assert groups.n_groups == groups.groups.count(";") + 1 and groups.n_a == groups.n_b == 30_001


def test_blocks_passed_on_early(spark, docs, models):
    """The bound of the held keys changes nothing."""
    want = {tuple(r) for r in alignment.pair_counts(short(docs), *models).collect()}
    assert {tuple(r) for r in alignment.pair_counts(short(docs), *models, held=500).collect()} == want


def test_a_vocabulary_that_crosses_spaces_takes_whole_texts(models):
    a = models[0].replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false')
    pair = alignment.Pair(a, models[1])
    assert not pair.cuts and pair.units("a b c") == [" a b c"]
    assert alignment.Pair(*models).units("a b, c.d!\ne") == [" a", " b", ",", " c", ".d!", "\n", "e"]


def test_registered(spark, sf, docs):
    assert queries.QUERIES["op12_tokenizer_alignment"](spark, sf).count() == docs.count()
