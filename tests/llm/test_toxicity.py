"""op9: the automaton against plain edit distance, contexts, and held-out accuracy."""

import math
import random

import pytest

from tessera.llm import toxicity as tox

TERMS = {"idiot": 1.0, "scum": 1.0, "worthless": 0.9, "pathetic": 0.8, "moron": 1.0}


def osa(a, b):
    """Edit distance with swaps of adjacent letters (each letter edited once)."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_edit_distance():
    lexicon, rng = tox.Lexicon(TERMS), random.Random(2)
    words = ["", "idoit", "idiott", "scm", "wortless", "wrothles", "patetic", "mroon", "thetic"]
    for _ in range(3000):
        w = list(rng.choice(list(TERMS)))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 2)] = rng.sample("abcdeiotrswz", rng.randint(0, 2))
        words.append("".join(w))
    for w in words:
        near = [(osa(w, t), t) for t in TERMS if osa(w, t) <= tox.allowance(t)]
        got = lexicon.match(w)
        assert (got is None) == (not near), w
        if got:
            assert got[1] == min(near)[0] and osa(w, got[0]) == got[1]


def test_context_tells_quotation_from_abuse():
    scan = tox.Scanner(tox.Lexicon(TERMS)).features
    at = {n: i for i, n in enumerate(tox.FEATURES)}
    abuse, quoted, named = scan("you are an IDIOT, really"), scan('they wrote “you idiot” on it'), scan("the word idiot is old")
    assert abuse[at["hits"]] > 0 and abuse[at["addressed"]] > 0
    assert quoted[at["hits"]] == 0 < quoted[at["quoted"]]
    assert named[at["hits"]] == 0 < named[at["reported"]]
    assert 0 < scan("you idoit")[at["hits"]] < scan("you idiot")[at["hits"]] and scan("clean words only") is None
    assert tox.Scanner(tox.Lexicon(TERMS, frozenset(["idiot"]))).features("you idoit") is None


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, tox.fit(docs, labels)


def test_held_out_accuracy(trained):
    docs, labels, model = trained
    rows = tox.toxicity(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.93


def plain_score(model, text):
    """The score from its definition: every word against every term by edit distance."""
    tokens = text.split()
    inside = tox.quoted_tokens(tokens)
    hit, reported, quoted, addressed, kinds, strength = 0.0, 0.0, 0.0, 0.0, set(), 0.0
    for i, token in enumerate(tokens):
        word = tox.plain(token)
        near = [(osa(word, t), -w, t) for t, w in model.terms.items() if not t.endswith("*") and abs(len(word) - len(t)) <= 2]
        near = [x for x in near if x[0] <= (0 if x[2] in model.exact else tox.allowance(x[2]))]
        if near:
            edits, _, term = min(near)
        elif len(word) > tox.STEM and word[: tox.STEM] + "*" in model.terms:
            edits, term = 0, word[: tox.STEM] + "*"
        else:
            continue
        weight = model.terms[term] * 0.6**edits
        context = {tox.plain(t) for t in tokens[max(0, i - tox.WINDOW) : i + tox.WINDOW + 1]}
        kinds.add(term)
        strength = max(strength, weight)
        quoted += weight * inside[i]
        reported += weight * (not inside[i] and bool(context & tox.REPORT))
        hit += weight * (not inside[i] and not context & tox.REPORT)
        addressed += weight * bool(context & tox.ADDRESS)
    z = model.weights[0]
    if kinds:
        x = [math.log1p(hit), math.log1p(quoted), math.log1p(reported), math.log1p(addressed), math.log1p(len(kinds)), hit / (len(tokens) + 20) * 20, strength]
        z += sum(a * b for a, b in zip(model.weights[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_are_those_of_the_plain_version(trained):
    docs, labels, model = trained
    toxic = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi").where("length(text) < 2000").limit(25)
    some = toxic.unionByName(docs.where("length(text) < 800").limit(25))
    texts = [r.text or "" for r in some.collect()]
    got = sorted(r.score for r in tox.toxicity(some, model).collect())
    assert got == pytest.approx(sorted(plain_score(model, t) for t in texts), rel=1e-9)


def test_clearing_the_automaton_changes_nothing(monkeypatch):
    words = ["idoit", "scm", "wortless", "patetic", "mroon", "xx", "idiot"] * 3
    want = [tox.Lexicon(TERMS).match(w) for w in words]
    monkeypatch.setattr(tox, "STATES", 3)
    lexicon = tox.Lexicon(TERMS)
    assert [lexicon.match(w) for w in words] == want and len(lexicon.states) < 30


def test_misspelled_terms_are_caught(trained):
    _, _, model = trained
    scan = tox.Scanner(model.lexicon()).features
    assert "idiot" in model.terms
    assert model.score(scan("you are an idoit and a worthles morron")) > 0.5 > model.score(None)


def test_defined_for_odd_and_empty(spark, odd, empty, trained):
    docs, labels, model = trained
    rows = tox.toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert tox.toxicity(empty, model).count() == 0
    assert tox.reject_toxic(odd, model).columns == odd.columns
    none = tox.fit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.terms == {} and none.score(None) < 0.5


def test_labels_and_ids_are_not_inputs(spark, trained):
    from pyspark.sql import functions as F

    docs, _, model = trained
    few = docs.limit(50)
    other = few.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    a = {r.doc_id + 1000: r.score for r in tox.toxicity(few, model).collect()}
    assert a == {r.doc_id: r.score for r in tox.toxicity(other, model).collect()}


def test_terms_hold_at_any_size_and_with_copies(spark):
    """A term's preceding words saturate: 400 toxic texts share 60 of them, and one of them has 300 copies."""
    rng = random.Random(4)
    words = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    talk = lambda n: " ".join(rng.choices(words, k=n))
    texts = [(f"{talk(9)} {words[i % 60]} grobian {talk(5)}", 1) for i in range(400)]
    texts += [("zuvor kopie " + texts[0][0], 1)] * 300 + [(talk(15), 0) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    assert "grobian" in model.terms and "kopie" not in model.terms
