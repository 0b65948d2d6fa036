"""Toxicity scores from a lexicon matched by Levenshtein automata, weighed by its context.

The lexicon is learned: words that stand in many more toxic than other training documents, after many
different words (near copies of one toxic document repeat its other words after the same one), and
so do stems, the first STEM letters of longer words, which catch inflections. Copies of a text count
once, and how many different words must go before is a share of all toxic texts, not of the term's own:
distinct words saturate, so a share of those would fall with the size of the training data. Its
terms form a trie; the trie is run against the Levenshtein automaton of each word of a text, as one
automaton whose states, sets of (trie node, edits), are made on demand and kept, so a word costs a
lookup a letter and is dropped where no term can follow. Short terms match exactly, terms of
FUZZY letters or more with one edit, of LONG or more with two (an adjacent swap is one edit).

A hit's context window tells quotation and report from abuse: quotation marks around it, words of
saying or naming near it, or words of address. A logistic regression on a document's hit
features, fitted on the driver, gives the score; it does not see doc_id, lang, source or labels.

Null and empty texts have no hits and get the score of such a text. Rows map one to one; other
columns are ignored; empty tables and tables without labels give a model without lexicon.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialise, steps

#: The classifier is fitted on this many labelled rows at most (the ones of the least hash).
TRAIN_ROWS = 20_000
#: Letters from which one and two edits are allowed.
FUZZY, LONG = 5, 9
#: The automaton's states and a scanner's words that a worker keeps; beyond them it starts afresh.
STATES, CACHE = 20_000, 50_000
#: Letters of a stem; a term "abcde*" matches any word that begins so, without edits.
STEM = 5
#: Words of context on either side of a hit.
WINDOW = 8

# Words that report or name an expression, words that address somebody, quotation marks.
REPORT = frozenset("said says say called calls word words term terms quote quoted quotes wrote writes mean means meaning example slur sagte nannte wort zitat heißt dit appelé mot terme citation dijo llamó palabra término cita".split())
ADDRESS = frozenset("you your you're youre u ur du dein dich ihr euch tu toi ton vous votre tú ti vosotros usted eres".split())
QUOTES = "\"'“”„‟‘’«»‹›"
EDGE = ".,;:!?()[]{}<>*_~#|/\\+=-—–…`" + QUOTES
FEATURES = ("hits", "quoted", "reported", "addressed", "kinds", "density", "strength")
#: A term matches with edits unless such matches stand in more than this share of clean training documents.
CLEAN_FUZZY = 0.0005


class Lexicon:
    """Terms with weights in (0, 1], and the automaton over them."""

    def __init__(self, terms: dict[str, float], exact: frozenset[str] = frozenset()):
        self.terms = terms
        #: Edits of each term: none for those in `exact`.
        self.edits = {t: 0 if t in exact else allowance(t) for t in terms}
        self.children: list[dict[str, int]] = [{}]
        self.term_at: list[str | None] = [None]
        #: Edits that the longest and the shortest term under a node allow.
        self.allowed: list[int] = [0]
        for term in (t for t in terms if not t.endswith("*")):
            node, edits = 0, self.edits[term]
            self.allowed[0] = max(self.allowed[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term_at.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
            self.term_at[node] = term
        self.letters = frozenset(c for t in terms for c in t if c != "*")
        self._clear()

    def _clear(self) -> None:
        """Forget the states made so far; they are made again on demand."""
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple[str, int] | None] = []
        self.numbers: dict[frozenset, int] = {}
        self.start = self._state({(0, 0, "")})
        self.dead = self._state(set())

    def _state(self, places: set[tuple[int, int, str]]) -> int:
        """The number of a set of (node, edits, letter owed by a swap), closed under left-out letters."""
        least: dict[tuple[int, str], int] = {}
        stack = list(places)
        while stack:
            node, edits, owed = stack.pop()
            if edits > self.allowed[node] or least.get((node, owed), 99) <= edits:
                continue
            least[node, owed] = edits
            if not owed and edits < self.allowed[node]:
                stack += [(child, edits + 1, "") for child in self.children[node].values()]
        whole = frozenset((n, e, o) for (n, o), e in least.items())
        if whole not in self.numbers:
            self.numbers[whole] = len(self.states)
            self.states.append(whole)
            self.steps.append({})
            ends = [(e, self.term_at[n]) for n, e, o in whole if not o and self.term_at[n] is not None and e <= self.edits[self.term_at[n]]]
            best = min(ends, key=lambda x: (x[0], -self.terms[x[1]], x[1]), default=None)
            self.final.append(None if best is None else (best[1], best[0]))
        return self.numbers[whole]

    def _step(self, state: int, c: str) -> int:
        places = set()
        for node, edits, owed in self.states[state]:
            if owed:
                if owed == c:
                    places.add((node, edits, ""))
                continue
            children = self.children[node]
            if c in children:
                places.add((children[c], edits, ""))
            if edits < self.allowed[node]:
                places.add((node, edits + 1, ""))  # a letter too many
                for x, child in children.items():
                    if x != c:
                        places.add((child, edits + 1, ""))  # another letter
                        if c in self.children[child]:  # two letters swapped
                            places.add((self.children[child][c], edits + 1, x))
        return self._state(places)

    def match(self, word: str) -> tuple[str, int] | None:
        """The closest term and its edits, or None."""
        if len(self.states) > STATES:
            self._clear()
        state, steps, dead = self.start, self.steps, self.dead
        for c in word:
            if c not in self.letters:
                c = "\0"
            following = steps[state].get(c)
            if following is None:
                following = steps[state][c] = self._step(state, c)
            if following == dead:
                state = dead
                break
            state = following
        found = self.final[state]
        if found is None and len(word) > STEM and (stem := word[:STEM] + "*") in self.terms:
            return stem, 0
        return found


def allowance(term: str) -> int:
    return 0 if len(term) < FUZZY else 1 if len(term) < LONG else 2


def plain(token: str) -> str:
    return token.strip(EDGE).lower()


class Scanner:
    """A worker's scanner: texts to hit features, with a bounded cache of words."""

    def __init__(self, lexicon: Lexicon, cache_size: int = CACHE):
        self.lexicon, self.cache, self.cache_size = lexicon, {}, cache_size

    def _learn(self, tokens: set[str]) -> None:
        if len(self.cache) + len(tokens) > self.cache_size:
            self.cache.clear()
        match = self.lexicon.match
        self.cache.update((t, match(plain(t))) for t in tokens)

    def features(self, text: str) -> list[float] | None:
        """None for a text without hits."""
        tokens = text.split()
        cache = self.cache
        try:
            found = [cache[t] for t in tokens]
        except KeyError:
            kinds = set(tokens)
            self._learn(kinds.difference(cache))
            if len(kinds.difference(cache)):
                self._learn(kinds)
            found = [cache[t] for t in tokens]
        hits = [i for i, x in enumerate(found) if x is not None]
        return self._weigh(tokens, found, hits) if hits else None

    def fuzzy_terms(self, text: str) -> set[str]:
        """The terms that the text's words match with edits only."""
        kinds = set(text.split())
        self._learn(kinds.difference(self.cache))
        if kinds.difference(self.cache):
            self._learn(kinds)
        return {x[0] for x in map(self.cache.__getitem__, kinds) if x is not None and x[1]}

    def _weigh(self, tokens: list[str], found: list, hits: list[int]) -> list[float]:
        sums = dict.fromkeys(FEATURES, 0.0)
        kinds, inside = set(), quoted_tokens(tokens)
        for i in hits:
            term, edits = found[i]
            weight = self.lexicon.terms[term] * 0.6**edits
            near = [plain(t) for t in tokens[max(0, i - WINDOW) : i + WINDOW + 1]]
            kinds.add(term)
            sums["strength"] = max(sums["strength"], weight)
            if inside[i]:
                sums["quoted"] += weight
            elif any(w in REPORT for w in near):
                sums["reported"] += weight
            else:
                sums["hits"] += weight
            sums["addressed"] += weight * any(w in ADDRESS for w in near)
        abuse = sums["hits"]
        for name in ("hits", "quoted", "reported", "addressed"):
            sums[name] = float(np.log1p(sums[name]))
        sums["kinds"] = float(np.log1p(len(kinds)))
        sums["density"] = abuse / (len(tokens) + 20.0) * 20.0
        return [sums[n] for n in FEATURES]


def quoted_tokens(tokens: list[str]) -> list[bool]:
    """Tokens inside quotation marks: a token that opens one, up to a token that closes it within
    40 tokens."""
    inside = [False] * len(tokens)
    opened = -1
    for i, t in enumerate(tokens):
        if opened < 0 and t[0] in QUOTES:
            opened = i
        if opened >= 0:
            end = t.rstrip(".,;:!?)")
            if len(end) > (i == opened) and end[-1:] and end[-1] in QUOTES:
                inside[opened : i + 1] = [True] * (i + 1 - opened)
                opened = -1
            elif i - opened > 40:
                opened = -1
    return inside


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    exact: frozenset[str] = frozenset()
    weights: list[float] = field(default_factory=lambda: [0.0] * (len(FEATURES) + 1))

    def lexicon(self) -> Lexicon:
        return Lexicon(self.terms, self.exact)

    def score(self, features: list[float] | None) -> float:
        z = self.weights[0]
        if features is not None:
            z += float(np.dot(self.weights[1:], features))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def held_out(id_col: str):
    """crc32 of doc_id as text, modulo 5, is 0 (a null doc_id is the empty text's: held out)."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(_text, _toxic) of the training rows, `rows` labels at most, those of the least hash; a row for
    each distinct text, toxic if any of its copies is."""
    known = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where("_id is not null and _toxic is not null")
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    known = known.orderBy(F.xxhash64("_id", F.lit("train")), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(known), "_id")  # `rows` labels: bounded
    return found.groupBy("_text").agg(F.max("_toxic").alias("_toxic"))


def learn_terms(train: DataFrame) -> dict[str, float]:
    """Words by evidence: in how many toxic and other documents they stand, after how many words.

    A term stands in at least a two-hundredth of the toxic training texts, so there are at most 200
    times as many terms as such a text has different words and stems on average, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "_text"):
            words, before, toxic = [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                last, seen = "", {}
                for token in text.split():
                    word = plain(token)
                    if len(word) > 2 and word not in seen and "*" not in word:
                        seen[word] = last
                        if len(word) > STEM:
                            seen.setdefault(word[:STEM] + "*", last)
                    last = word
                words += seen
                before += [zlib.crc32(x.encode()) for x in seen.values()]
                toxic += [label] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.int64()), pa.array(toxic, pa.int32())], names=["word", "last", "toxic"])

    sizes = train.agg(F.count(F.lit(1)), F.sum("_toxic")).first()
    n, n_toxic = int(sizes[0]), int(sizes[1] or 0)
    if not n_toxic or n_toxic == n:
        return {}
    # Counts first, in two numbers a word; only words with the evidence are looked at for what goes before them.
    found = train.mapInArrow(run, "word string, last long, toxic int")
    counts = found.groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    # the rate among toxic documents must be many times the rate among the others
    rate = (F.col("t") + 0.5) / (n_toxic + 1.0)
    other = (F.col("n") - F.col("t") + 0.5) / (n - n_toxic + 1.0)
    least = max(3, n_toxic // 200)
    able = materialise(counts.where((F.col("t") >= least) & (F.log(rate / other) > 2.0)), "able-words")
    after = found.where("toxic = 1").join(able.select("word"), "word", "left_semi").select("word", "last").distinct()
    around = after.groupBy("word").agg(F.count(F.lit(1)).alias("around")).where(F.col("around") >= least)
    good = able.join(around, "word").orderBy("word").collect()  # see the docstring for the bound
    return {r.word: min(1.0, max(0.1, (r.t / r.n))) for r in good}


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    train = materialise(_training(docs, labels, id_col, text_col, rows), "train")  # `rows` texts, read four times
    model = Model(learn_terms(train))

    def fuzzy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Lexicon(model.terms))
        for batch in steps(batches, "_text"):
            found = [t for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if not y for t in scanner.fuzzy_terms(text)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["term"])

    if model.terms:
        clean = train.where("_toxic = 0").count()
        seen = train.mapInArrow(fuzzy, "term string").groupBy("term").count().collect()  # a row a term
        model.exact = frozenset(r.term for r in seen if r["count"] > CLEAN_FUZZY * clean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model.lexicon())
        for batch in steps(batches, "_text"):
            rows_ = [scanner.features(t) or [0.0] * len(FEATURES) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows_, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    found = train.mapInArrow(run, "x array<double>, y int").collect()  # `rows` rows of eight numbers at most
    y = np.array([r.y for r in found], dtype=float)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        model.weights[0] = 4.0 if rate == 1 else -4.0
        return model
    model.weights = logistic(np.array([r.x for r in found]), y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 60) -> list[float]:
    """Ridge logistic regression by Newton steps; the classes' sums of weights are made equal by half."""
    a = np.hstack([np.ones((len(x), 1)), x])
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y == 1, (0.5 / share) ** 0.5, (0.5 / (1 - share)) ** 0.5)
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + penalty @ w
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def toxicity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """Each row's id_col, held_out, score and predicted; with `carry`, df's columns and the score under that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # terms: see learn_terms
    empty = model.score(None)

    def scores(batch: pa.RecordBatch, scanner: Scanner) -> list[float]:
        column = batch.column(batch.schema.get_field_index(text_col if carry else "_text"))
        found = (scanner.features(t) if t else None for t in column.to_pylist())
        return [empty if f is None else shared.value.score(f) for f in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value.lexicon())
        for batch in steps(batches, text_col if carry else "_text"):
            score = pa.array(scores(batch, scanner), pa.float64())
            head = list(batch.columns) if carry else [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*head, score], names=[*(batch.schema.names if carry else [id_col, "held_out"]), carry or "score"])

    if carry:
        from pyspark.sql.types import DoubleType, StructType

        return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(carry, DoubleType()))
    slim = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def reject_toxic(docs: DataFrame, model: Model, *, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs with a score under `limit`, all columns."""
    score = fresh(docs, "_score")
    return toxicity(docs, model, text_col=text_col, carry=score).where(F.col(score) < limit).drop(score)
