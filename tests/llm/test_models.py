import math
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import documents, empty, rows, sentence

from tidewash.llm import lm_scoring, quality, toxicity
from tidewash.llm.words import cut_words, stretch_hashes

FOLDER = "/root/testdata/sf0.01"


def read(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_words_and_hashes_of_joined_texts():
    texts = ["a bb  a\n", "", " \t", "ccc", "bb a", "über\x0bä"]
    words = cut_words([t.encode() for t in texts])
    cut = [bytes(words.buffer[a:b]) for a, b in zip(words.starts, words.ends, strict=True)]
    expected = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    assert cut == [w for ws in expected for w in ws]
    assert list(words.owner) == [k for k, ws in enumerate(expected) for _ in ws]
    assert list(words.first) == [0, *np.cumsum([len(ws) for ws in expected])]
    for seed in (1, 2):
        hashes = words.hashes(seed)
        assert len({(w, h) for w, h in zip(cut, hashes, strict=True)}) == len(set(cut))
        assert len(set(hashes.tolist())) == len(set(cut))
        alone = cut_words([b"xyz " + cut[1]]).hashes(seed)[1]  # the same at any place
        assert alone == hashes[1]


def test_stretch_hashes_tell_lengths_and_places_apart():
    values = np.array([0, 0, 5, 0, 0, 5, 7], np.uint64)
    starts, ends = np.array([0, 0, 1, 2, 4, 3]), np.array([1, 2, 3, 3, 6, 5])
    a, b, c, d, e, f = stretch_hashes(values, starts, ends).tolist()
    assert len({a, b, c, d}) == 4 and c == e and b == f


def test_ordinal_regression_finds_grades_and_ordered_thresholds():
    pick = np.random.default_rng(5)
    weights = pick.normal(size=30) * 3
    x = pick.normal(size=(3000, 30))
    score = x @ weights / 5 + pick.logistic(size=3000)
    grades = np.digitize(score, [-2.0, 0.5, 3.0])
    row, feature = np.nonzero(np.ones_like(x))
    model = quality.fit_ordinal(row, feature, x.ravel(), grades, 4, 30, rounds=400, step=0.1)
    assert np.all(np.diff(model.thresholds) > 0)
    assert np.allclose(model.thresholds, [-2.0, 0.5, 3.0], atol=0.35)
    assert np.corrcoef(model.weights, weights)[0, 1] > 0.98
    tails = model.tails(x @ model.weights)
    assert np.all(np.diff(tails, axis=1) <= 0)
    assert abs(tails.sum(axis=1).mean() - grades.mean()) < 0.05


def test_ordinal_regression_without_rows_or_with_one_grade():
    none = np.zeros(0, np.int64)
    model = quality.fit_ordinal(none, none, none.astype(float), none, 3, 10)
    assert model.tails(np.zeros(1)).shape == (1, 2)
    one = quality.fit_ordinal(
        np.arange(5), np.zeros(5, int), np.ones(5), np.full(5, 2), 3, 10, rounds=50
    )
    assert np.isfinite(one.thresholds).all()


def test_quality_on_held_out_documents(spark):
    labels = quality.graded_labels(read(spark, "labels"))
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    docs = read(spark, "documents")
    model = quality.fit_quality(docs, train)
    found = quality.score_quality(docs, model).join(test, "doc_id").collect()
    right = [(r.tails[0] >= 0.5) == (r.grade >= 1) for r in found]
    assert sum(right) / len(right) > 0.95
    by_grade = {g: [r.expected_grade for r in found if r.grade == g] for g in (0, 2)}
    assert np.mean(by_grade[2]) > np.mean(by_grade[0]) + 1
    kept = quality.select_quality(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == sum(
        r.tails[0] >= 0.5 for r in quality.score_quality(docs, model).collect()
    )


def test_samples_are_bounded_with_null_and_repeated_ids(spark):
    given = [(None, k) for k in range(500)] + [(7, k) for k in range(500)]
    given += [(100 + k, k) for k in range(50)]
    ratings = spark.createDataFrame(given, "id long, grade int").repartition(3)
    found = quality.rated_sample(ratings, "id", 20).collect()
    assert len(found) == 20 == len({r.id for r in found})
    assert all((r.id, r.grade) in given and r.id is not None for r in found)
    everything = quality.rated_sample(ratings, "id", 10**6).collect()
    assert len(everything) == 51 == len({r.id for r in everything})


def test_models_are_fitted_on_one_document_per_label(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(k % 3, sentence(k, 30)) for k in range(300)], "doc_id long, text string"
    )
    ratings = spark.createDataFrame(
        [(0, 0, 0), (0, 0, 0), (1, 2, 1), (2, 2, 0), (None, 1, 0)], "doc_id long, grade int, toxic int"
    )
    sizes = []
    fit = quality.fit_ordinal

    def counted(row, feature, value, grades, *rest):
        sizes.append(len(grades))
        return fit(row, feature, value, grades, *rest)

    monkeypatch.setattr(quality, "fit_ordinal", counted)
    quality.fit_quality(docs, ratings)
    chain = toxicity.fit_chain

    def chained(row, hashes, labels, fold):
        sizes.append(len(labels))
        return chain(row, hashes, labels, fold)

    monkeypatch.setattr(toxicity, "fit_chain", chained)
    toxicity.fit_toxicity(docs, ratings, ["toxic"])
    assert sizes == [3, 3]


def test_quality_of_odd_documents(spark):
    docs = documents(spark)
    ratings = spark.createDataFrame(
        [(100, 2), (97, 0), (96, 1), (None, 1), (95, None), (1, 7), (555, 2)],
        "doc_id long, grade int",
    )
    model = quality.fit_quality(docs, ratings)
    found = quality.score_quality(docs, model)
    assert found.count() == len(rows())
    blank = [r for r in found.collect() if r.doc_id in (94, 93, 92, 91)]
    assert len({tuple(r.tails) for r in blank}) == 1
    assert quality.score_quality(empty(spark), model).count() == 0
    assert quality.select_quality(empty(spark), model).count() == 0
    assert quality.select_quality(docs, model, least=0.0).schema == docs.schema
    unfitted = quality.fit_quality(docs, ratings.where("false"))
    assert quality.score_quality(docs, unfitted).first().expected_grade == 1.0


def plain(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), text or ""))


def test_target_like_text_scores_higher(spark):
    given = [(k, sentence(k, 200)) for k in range(20)]
    given += [(100 + k, " ".join(f"zz{(k * j) % 50}" for j in range(200))) for k in range(20)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    found = lm_scoring.score_corpus(docs, docs.where("doc_id < 100")).collect()
    assert min(r.score for r in found if r.doc_id < 100) > max(
        r.score for r in found if r.doc_id >= 100
    )


@pytest.mark.parametrize("range_words", [1 << 20, 500])
@pytest.mark.parametrize("block_words", [100, lm_scoring.BLOCK_WORDS])
def test_corpus_scores_count_every_word_and_pair_apart(spark, block_words, range_words):
    given = [(r[0], r[1]) for r in rows()]
    # More pairs than any table of fixed size here would tell apart.
    given += [(500 + k, " ".join(f"w{(k * j * j + j) % 9000}" for j in range(3000))) for k in range(20)]
    good = {100, 96, 95, 777} | set(range(500, 507))
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(i,) for i in [*good, 100, None]], "doc_id long")

    def counts(chosen):
        one, two, context = Counter(), Counter(), Counter()
        for i, text in given:
            if i in chosen:
                ws = plain(text)
                one.update(ws)
                two.update(zip(["", *ws], ws, strict=False))
                context.update(["", *ws][: len(ws)])
        return one, two, context, one.total()

    models = counts(good), counts({i for i, _ in given})
    size = len(models[1][0])

    def loss(ws, one, two, context, total):
        found = 0.0
        for before, own in zip(["", *ws], ws, strict=False):
            alone = (one[own] + 1) / (total + size)
            found -= math.log(
                (two[before, own] + lm_scoring.PRIOR * alone) / (context[before] + lm_scoring.PRIOR)
            )
        return found / max(1, len(ws))

    expected = []
    for i, text in given:
        ws = plain(text)
        a, b = (loss(ws, *m) for m in models)
        expected.append((str(i), len(ws), a, b, b - a))
    got = [
        (str(r.doc_id), *r[1:])
        for r in lm_scoring.score_corpus(
            docs, target, block_words=block_words, range_words=range_words
        ).collect()
    ]
    assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(expected)]
    assert np.allclose([r[2:] for r in sorted(got)], [r[2:] for r in sorted(expected)], atol=1e-9)


def test_corpus_scores_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_scoring.score_corpus(empty(spark), none).count() == 0
    found = lm_scoring.score_corpus(documents(spark), none).collect()
    assert len(found) == len(rows())
    assert all(r.score == 0 for r in found if r.n_tokens == 0)


@pytest.fixture(scope="module")
def chain(spark):
    labels = read(spark, "labels").where("doc_id % 4 <> 0")
    conditions = [
        toxicity.lexicon_condition(toxicity.INSULTS),
        toxicity.lexicon_condition(toxicity.DEMEANING),
        "toxic",
    ]
    return toxicity.fit_toxicity(read(spark, "documents"), labels, conditions)


def test_toxicity_on_held_out_documents(spark, chain):
    docs = read(spark, "documents")
    labels = read(spark, "labels").where("doc_id % 4 = 0")
    found = toxicity.score_toxicity(docs, chain).join(labels, "doc_id").collect()
    clean = [r.p[2] >= 0.5 for r in found if r.toxic == 0]
    toxic = [r.p[2] >= 0.5 for r in found if r.toxic == 1]
    assert sum(clean) == 0
    # Only a few dozen toxic documents are there to learn from at this size.
    assert sum(toxic) / len(toxic) > 0.6


def test_toxicity_of_odd_documents(spark, chain):
    found = toxicity.score_toxicity(documents(spark), chain)
    assert found.count() == len(rows())
    assert all(0 <= p <= 1 and not math.isnan(p) for r in found.collect() for p in r.p)
    assert toxicity.score_toxicity(empty(spark), chain).count() == 0


def test_chain_uses_earlier_categories():
    # The second category is the first one, seen through features of other documents.
    pick = np.random.default_rng(2)
    n = 400
    first = pick.random(n) < 0.4
    feature = np.where(first, 11, 12).astype(np.uint64)
    labels = np.column_stack((first, first & (pick.random(n) < 0.95))).astype(int)
    chain = toxicity.fit_chain(np.arange(n), feature, labels, np.arange(n) % toxicity.FOLDS)
    assert chain.links[1][0] > 0.5
    p = chain.probabilities(np.arange(2), np.array([11, 12], np.uint64), 2)
    assert p[0].min() > 0.8 and p[1].max() < 0.2


def test_chain_without_labels_or_features():
    none = np.zeros(0, np.int64)
    chain = toxicity.fit_chain(none, none.astype(np.uint64), np.zeros((0, 2), int), none)
    assert chain.probabilities(none, none.astype(np.uint64), 3).shape == (3, 2)


def plain_logistic(rows, extra, y, size, rounds=300, shrink=1e-3):
    """The same loss and steps, one document after another."""
    from math import exp, log, sqrt

    n, dense = len(y), len(extra[0])
    p = [0.0] * (size + dense + 1)
    rate = min(max(sum(y) / n, 1e-3), 1 - 1e-3)
    p[-1] = log(rate / (1 - rate))
    first, second = [0.0] * len(p), [0.0] * len(p)

    def chance(own, also):
        score = sum(p[f] for f in own) + sum(a * w for a, w in zip(also, p[size:-1])) + p[-1]
        return 1 / (1 + exp(-score))

    for turn in range(1, rounds + 1):
        slope = [0.0] * len(p)
        for own, also, target in zip(rows, extra, y):
            error = (chance(own, also) - target) / n
            for f in own:
                slope[f] += error
            for k, a in enumerate(also):
                slope[size + k] += error * a
            slope[-1] += error
        step = 0.2 if turn < 0.7 * rounds else 0.02
        for i in range(len(p)):
            if i < len(p) - 1:
                slope[i] += shrink / 10 * p[i]
            first[i] = 0.9 * first[i] + 0.1 * slope[i]
            second[i] = 0.999 * second[i] + 0.001 * slope[i] ** 2
            p[i] -= step * (first[i] / (1 - 0.9**turn)) / (sqrt(second[i] / (1 - 0.999**turn)) + 1e-8)
    return chance


def plain_telling(rows, labels):
    n, found = len(rows), set()
    for k in range(len(labels[0])):
        positive = sum(label[k] for label in labels)
        for f in {f for own in rows for f in own}:
            count = sum(f in own for own in rows)
            hit = sum(f in own and label[k] for own, label in zip(rows, labels))
            spread = max(1, count * (n - count) * positive * (n - positive))
            chi2 = n * (hit * n - count * positive) ** 2 / spread
            if chi2 >= toxicity.LEAST_CHI2 and hit >= 3 and hit * n > count * positive:
                found.add(f)
    return found


def test_chain_is_that_of_plain_loops():
    pick = np.random.default_rng(8)
    n = 220
    rows = [sorted(set(pick.integers(0, 40, 6).tolist())) for _ in range(n)]
    labels = [[int(3 in own or 5 in own), int(5 in own or 7 in own)] for own in rows]
    fold = (np.arange(n) * 7) % toxicity.FOLDS
    row = np.repeat(np.arange(n), [len(own) for own in rows])
    hashes = np.array([f for own in rows for f in own], np.uint64)
    chain = toxicity.fit_chain(row, hashes, np.array(labels), fold)
    found = chain.probabilities(row, hashes, n)

    def restrict(some, keep):
        names = {f: i for i, f in enumerate(sorted(keep))}
        return [[names[f] for f in own if f in names] for own in some]

    keep = plain_telling(rows, labels)
    assert sorted(chain.features.tolist()) == sorted(keep)
    guess = [0.0] * n
    for f in range(toxicity.FOLDS):
        train = [i for i in range(n) if fold[i] != f]
        own = plain_telling([rows[i] for i in train], [labels[i] for i in train])
        inner = restrict(rows, own)
        model = plain_logistic(
            [inner[i] for i in train], [[]] * len(train), [labels[i][0] for i in train], len(own)
        )
        for i in range(n):
            if fold[i] == f:
                guess[i] = model(inner[i], [])
    kept = restrict(rows, keep)
    one = plain_logistic(kept, [[]] * n, [label[0] for label in labels], len(keep))
    two = plain_logistic(kept, [[g] for g in guess], [label[1] for label in labels], len(keep))
    for i in range(n):
        p = one(kept[i], [])
        assert found[i] == pytest.approx([p, two(kept[i], [p])], abs=1e-6)


def test_labels_may_have_any_columns(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} text") for i in range(40)], "`my.id` long, text string")
    ratings = spark.createDataFrame(
        [(i, i % 2, "x", 3, "y") for i in range(40)],
        "doc_id long, toxic int, text string, id int, words string",
    )
    chain = toxicity.fit_toxicity(docs, ratings, ["toxic"], id="my.id")
    assert len(chain.weights) == 1
    scored = toxicity.score_toxicity(docs, chain, id="my.id")
    assert scored.columns[0] == "my.id" and scored.count() == 40
