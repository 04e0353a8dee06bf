from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termwarden.llm import language_model as lm
from termwarden.llm import toxicity
from termwarden.llm.common import fold_of
from tests.llm.conftest import AWKWARD


def tokens(text):
    return [*(text or "").encode().lower().split(), b"</s>"]


class PlainModel:
    """The model by dictionaries, from the formulas alone."""

    def __init__(self, texts, order=2):
        self.order, self.count = order, Counter()
        raw = [Counter() for _ in range(order + 1)]
        for text in texts:
            line = [b"<s>", *tokens(text)]
            self.count.update(line[1:])
            for end in range(2, len(line) + 1):
                for size in range(2, order + 1):
                    if end >= size:
                        raw[size][tuple(line[end - size : end])] += 1
        self.adjusted = {order: raw[order]}
        for size in range(order - 1, 1, -1):
            before = Counter(g[1:] for g in raw[size + 1])
            self.adjusted[size] = {g: c if g[0] == b"<s>" else before[g] for g, c in raw[size].items()}
        self.before = Counter(w for _, w in raw[2])
        self.types = len(raw[2])
        self.followers = {size: defaultdict(list) for size in self.adjusted}
        for size, found in self.adjusted.items():
            for g, c in found.items():
                self.followers[size][g[:-1]].append(c)
        of = lambda found: lm.discounts(*(sum(c == k for c in found.values()) for k in (1, 2, 3, 4)))
        self.discounts = [of(self.before), *(of(self.adjusted[size]) for size in range(2, order + 1))]
        self.n, self.v = sum(self.count.values()), len(self.count)

    def base(self, w):
        return (self.count[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def off(self, size, c):
        return 0 if not c else self.discounts[size - 1][min(c, 3) - 1]

    def probability(self, context, w):
        if not context:
            if not self.types:
                return 1 / (self.v + 1)
            spare = sum(self.off(1, c) for c in self.before.values()) / self.types
            return max(self.before[w] - self.off(1, self.before[w]), 0) / self.types + spare / (self.v + 1)
        size, shorter = len(context) + 1, self.probability(context[1:], w)
        seen = self.followers[size].get(context)
        if not seen:
            return shorter
        c = self.adjusted[size].get((*context, w), 0)
        spare = sum(self.off(size, x) for x in seen) / sum(seen)
        return (c - self.off(size, c)) / sum(seen) + spare * shorter

    def score(self, text):
        line, out = [b"<s>", *tokens(text)], 0.0
        for end in range(1, len(line)):
            out += math.log10(self.probability(tuple(line[max(0, end - self.order + 1) : end]), line[end]))
        return out


def corpus():
    random.seed(4)
    words = [f"w{int(random.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 1000, t) for i, (_, t) in enumerate(AWKWARD)]
    return rows


def test_contexts_are_not_looked_up_again(spark, monkeypatch):
    texts = [f"w{i % 7} w{i % 5} w{i % 3} again w{i % 11}" for i in range(60)] + ["", "one"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    model, asked, look_up = lm.train(frame, order=3), [], lm.Reader.look_up

    def counted(reader, level, keys):
        asked.append(len(keys))
        return look_up(reader, level, keys)

    monkeypatch.setattr(lm.Reader, "look_up", counted)
    found = model.reader().score(pa.array(texts, pa.large_string()))
    # Of a token's three n-grams each, and the two contexts that texts begin with.
    assert sum(asked) == 3 * found["n_tokens"].sum() + 2 * len(texts)
    plain = PlainModel(texts, 3)
    assert found["score"] == pytest.approx([plain.score(t) for t in texts])


def test_words_are_lowered_in_slices_as_in_whole():
    texts = ["AZ@[`{ az", "ÄÖ Σ İ K", "", "x" * 40 + " É"] * 3
    whole = pa.array(texts, pa.large_string())
    for start, length in ((0, 12), (1, 5), (3, 1), (2, 1), (5, 0)):
        part = whole.slice(start, length)
        expected = [t.encode().lower().decode() for t in texts[start : start + length]]
        assert lm._lowered(part).to_pylist() == expected
        assert list(lm._each(part)) == [t.encode() for t in texts[start : start + length]]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_are_those_of_the_formulas(docs_of, order):
    rows = corpus()
    docs = docs_of(rows).select("doc_id", "text")
    held = {r.doc_id: r.f for r in docs.select("doc_id", fold_of(F.col("doc_id")).alias("f")).collect()}
    assert held[0] == __import__("zlib").crc32(b"0") % 5
    plain = PlainModel([t for d, t in rows if held[d] != 1], order)
    model = lm.train(docs.where(fold_of(F.col("doc_id")) != 1), order)
    assert (model.tokens, model.distinct, model.types) == (plain.n, plain.v, plain.types)
    for found, expected in zip(model.discounts, plain.discounts, strict=True):
        assert found == pytest.approx(expected)
    found = {r.doc_id: r for r in lm.scored(docs, model).collect()}
    for doc_id, text in rows:
        r, parts = found[doc_id], tokens(text)
        assert (r.n_tokens, r.n_known) == (len(parts), sum(plain.count[w] > 0 for w in parts))
        assert r.base_score == pytest.approx(sum(math.log10(plain.base(w)) for w in parts))
        assert r.score == pytest.approx(plain.score(text))
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_add_up(docs_of, order):
    plain = PlainModel([t for _, t in corpus()], order)
    vocabulary = [*plain.count, b"never seen"]
    for context in [(b"<s>",), (b"w1",), (b"w2",), (b"never seen",), (b"w1", b"w1"), (b"<s>", b"w1")]:
        if len(context) < order:
            assert sum(plain.probability(context, w) for w in vocabulary) == pytest.approx(1)


def test_files_out_of_reach_are_an_error(docs_of):
    docs = docs_of(corpus()).select("doc_id", "text")
    model = lm.train(docs, 3)
    assert lm.scored(docs, model).count() > 0
    model.delete()
    with pytest.raises(Exception, match="out of reach"):
        lm.scored(docs, model).collect()
    with pytest.raises(ValueError, match="two words"):
        lm.train(docs, 1)


def test_flushes_of_held_bigrams_change_nothing(docs_of, monkeypatch):
    docs = docs_of(corpus()).select("doc_id", "text")
    whole = lm.train(docs)
    monkeypatch.setattr(lm, "HELD", 50)
    parts = lm.train(docs)
    assert (whole.tokens, whole.distinct, whole.types) == (parts.tokens, parts.distinct, parts.types)
    texts = pa.array(["w1 w2 w3 w1", "w9 unknown"], pa.large_string())
    assert parts.reader().score(texts)["score"] == pytest.approx(whole.reader().score(texts)["score"])


def test_models_of_nothing(docs_of):
    docs = docs_of([(1, "a b"), (2, None)]).select("doc_id", "text")
    model = lm.train(docs.limit(0))
    found = {r.doc_id: r for r in lm.scored(docs, model).collect()}
    assert (model.tokens, found[1].n_tokens, found[2].n_tokens, found[1].n_known) == (0, 3, 1, 0)
    assert found[1].score == found[1].base_score == 0
    assert lm.scored(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="mounted"):
        lm.local_path("hdfs://somewhere/else")


@pytest.mark.parametrize(
    ("word", "plain"),
    [
        ("Idiot", "idiot"), ("1d10t", "idiot"), ("***idiot!!!", "idiot"), ("tr@sh", "trash"),
        ("іdіоt", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("id\u200biot", "idiot"), ("2024", "2024"),
        ("...", ""), ("$tupid", "stupid"), ("scum$$$", "scum"), ("a/b", "a b"), ("Ärger", "ärger"),
    ],
)
def test_folding(word, plain):
    assert toxicity.folded(word) == plain


def labelled_corpus(n=600):
    random.seed(8)
    words = ["".join(random.choice("bcdfglmnprstv") + random.choice("aeiou") for _ in range(3)) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = [random.choice(words) for _ in range(random.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            text[random.randrange(len(text))] = random.choice(["grumblo", "Gr1mblo", "zzorkfin", "zzorkmal", "zzorkel"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_toxicity(docs_of, labels_of):
    rows, labels = labelled_corpus()
    docs = docs_of(rows)
    model = toxicity.learn(docs, labels_of(labels))
    found = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    fold = {r.doc_id: r.f for r in docs.select("doc_id", fold_of(F.col("doc_id")).alias("f")).collect()}
    held_out = [(found[d].predicted, t) for d, _, t in labels if fold[d] == 0]
    assert sum(p == t for p, t in held_out) >= 0.97 * len(held_out)
    assert any(t.startswith("zzo") for t in model.weights)
    assert all(0 <= r.score <= 1 for r in found.values())


def plain_terms(text):
    words = [w for w in map(toxicity.folded, (text or "").split()) if w]
    return {t for w in words for t in (w, *(f"{w[:k]}*" for k in toxicity.PREFIXES if len(w) >= k))}


def plain_hits(text, weights, exceptions):
    """Weights and neighbours of the terms that begin a word, outside exception phrases."""
    words = " ".join(filter(None, map(toxicity.folded, (text or "").split()))).split()
    safe = {i + k for e in exceptions for i in range(len(words)) if words[i : i + len(e.split())] == e.split() for k in range(len(e.split()))}
    out = []
    for i, word in enumerate(words):
        found = [w for t, w in weights.items() if t == word or t.endswith("*") and word.startswith(t[:-1])]
        if found and i not in safe:
            left = f"{words[i - 1]} {word}" if i else ""
            right = f"{word} {words[i + 1]}" if i + 1 < len(words) else ""
            out.append((max(found), left, right))
    return out


def plain_model(rows, given=()):
    """Lexicon and exceptions by sets and loops, from `(text, toxic)` rows."""
    toxic, clean = ([plain_terms(t) for t, x in rows if x == kind] for kind in (1, 0))
    weights = {}
    for term in set().union(*toxic):
        n, m = (sum(term in s for s in side) for side in (toxic, clean))
        odds = math.log((n + 0.5) / (len(toxic) + 1)) - math.log((m + 0.5) / (len(clean) + 1))
        if n >= toxicity.LEAST_DOCS and odds >= toxicity.LEAST_WEIGHT:
            weights[term] = (odds, n)
    order = sorted(weights, key=lambda t: (weights[t][1] * weights[t][0], t), reverse=True)
    chosen, left = {}, toxic
    while True:
        gain = {t: sum(t in s for s in left) for t in order}
        best = max(
            (t for t in order if gain[t] >= toxicity.LEAST_DOCS),
            key=lambda t: gain[t] * weights[t][0],
            default=None,
        )
        if best is None:
            break
        chosen[best] = weights[best][0]
        left = [s for s in left if best not in s]
    seen = defaultdict(lambda: [0, 0])
    for text, x in rows:
        for phrase in {p for h in plain_hits(text, chosen, given) for p in h[1:] if p}:
            seen[phrase][x] += 1
    harmless = {
        p for p, (m, n) in seen.items()
        if m >= toxicity.LEAST_DOCS and (n + 0.5) / (len(toxic) + 1) <= (m + 0.5) / (len(clean) + 1)
    }
    return chosen, harmless


@pytest.mark.parametrize("seed", range(3))
def test_the_lexicon_is_that_of_a_plain_count(docs_of, labels_of, seed):
    random.seed(seed)
    words = ["".join(random.choice("bdgk") + random.choice("aeo") for _ in range(random.randint(1, 4))) for _ in range(60)]
    rows, labels = [], []
    for i in range(260):
        text, toxic = [random.choice(words) for _ in range(random.randint(1, 25))], int(i % 3 == 0)
        if toxic:
            text.insert(random.randrange(len(text) + 1), random.choice(["Gr1mblo", "zzorka", "zzorke", "vex", "vex", "vex"]))
        elif i % 20 == 0:
            text += ["Vex", "bulb"]  # what is harmless beside a certain word
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    docs = docs_of(rows)
    fold = {r.doc_id: r.f for r in docs.select("doc_id", fold_of(F.col("doc_id")).alias("f")).collect()}
    training = [(t, labels[i][2]) for i, t in rows if fold[i] != 0]
    chosen, harmless = plain_model(training)
    model = toxicity.learn(docs, labels_of(labels), exceptions=())
    assert model.weights == pytest.approx(chosen) and len(chosen) >= 3
    assert set(model.exceptions) == harmless
    if "vex" in chosen:
        assert "vex bulb" in harmless
    found = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    b = model.coefficients
    for i, text in rows:
        level = math.log1p(sum(h[0] for h in plain_hits(text, chosen, harmless)))
        size = sum(bool(toxicity.folded(w)) for w in text.split())
        z = b[0] + b[1] * level + b[2] * level / math.log(math.e + size)
        assert found[i] == pytest.approx(1 / (1 + math.exp(-z)))


def test_rare_terms_are_learned_however_many_toxic_rows_there_are(docs_of, labels_of):
    """Three documents of two thousand toxic ones are enough for a term."""
    random.seed(1)
    rows = [(i, f"common grimblo text {random.randrange(50)}") for i in range(2000)]
    rows += [(3000 + i, f"common text quazzle {random.randrange(50)}") for i in range(6)]
    rows += [(5000 + i, f"common text {random.randrange(50)}") for i in range(2000)]
    labels = [(i, 1, int(i < 5000)) for i, _ in rows]
    model = toxicity.learn(docs_of(rows), labels_of(labels))
    assert any("quazzle".startswith(t.rstrip("*")) for t in model.weights)


def test_matches_are_whole_words_or_beginnings_outside_exceptions():
    model = toxicity.ToxicityModel({"trash": 3.0, "zork*": 2.0}, ("trash can",), (0.0, 1.0, 0.0))
    found = lambda text: toxicity.matched_weight(model.automaton(), text)
    assert found("trash") == 3 and found("trashy") == 0 and found("a trash can b") == 0
    assert found("zorkel trash trash") == 8 and found("azork") == 0
    assert toxicity.matched_weight(toxicity.ToxicityModel({}, (), (0, 0, 0)).automaton(), "x") == 0


def test_toxicity_of_awkward_rows(awkward, docs_of, labels_of):
    docs = awkward.withColumns({"score": F.lit("clash"), "predicted": F.lit("x")})
    model = toxicity.learn(docs, labels_of([(1, 1, None), (None, 1, 1), (77, 0, 1), (2, 1, 0)]))
    found = toxicity.scored(docs, model)
    assert found.count() == len(AWKWARD) and {r.predicted for r in found.collect()} == {0}
    assert dict(found.dtypes)["score"] == "double"
    nothing = toxicity.learn(docs.limit(0), labels_of([]))
    assert nothing.weights == {} and toxicity.scored(docs.limit(0), nothing).count() == 0
