import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulgrid.llm.nbsvm import NbSvm, fit_nbsvm, indicators, nbsvm_scores
from haulgrid.llm.ngrams import calibrate, labelled_sample
from haulgrid.llm.queries import QUERIES
from haulgrid.llm.quality_rules import fit_quality_model, quality_rules, repeat_words

SCHEMA = "doc_id bigint, text string, kept int, score string, n_words string"
ODD = ["", " ", "one", "a\n\n\na\na", "# * $ %&|<>", "x " * 60, "a b c a b c a b c", "line\r\nline\r\n", " nbsp word", "word\x1cword", "日本 語\n日本 語"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", "w") for i, t in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, text string")


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    cover = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search("[^\x20\x09-\x0d]", line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), dup, len(cover)


def test_base_counts_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [*enumerate(ODD), (50, None), (None, "null id"), (51, "twin"), (51, "twin")]
    rows += [(100 + i, "".join(rnd.choice(["a ", "b ", "c", "\n", "#", "\t", "é "]) for _ in range(300))) for i in range(40)]
    got = quality_rules(frame(spark, rows), None).collect()
    want = sorted((i or -1, *brute(t)) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed) and r.probability is None
    assert quality_rules(frame(spark, []), None).count() == 0


def test_repeat_words_with_ids_too_wide_for_one_key():
    ids = np.array([5, 6, 7, 5, 6, 7]) + (1 << 40)
    assert repeat_words(ids) == 6


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    good = [" ".join(rnd.choice(["the", "house", "runs", "with", "green", "ideas."]) + rnd.choice(["", "s"]) for _ in range(rnd.randint(5, 200))) for _ in range(150)]
    bad = [" ".join(rnd.choice(["buy", "now", "house", "the"]).upper() + "!!" for _ in range(rnd.randint(5, 200))) for _ in range(60)]
    bad += [" ".join(w for w in rnd.sample(["the", "house", "runs", "with"], 4) for _ in range(20)) for _ in range(40)]
    return [(i, t, int(i < 150)) for i, t in enumerate(good + bad)]


def test_both_models_learn(spark, corpus):
    docs = frame(spark, [(i, t) for i, t, _ in corpus])
    lab = labels(spark, [(i, y, "clash") for i, _, y in corpus] + [(None, 1, ""), (3, None, "")])
    truth = {i: y for i, _, y in corpus}
    where = F.col("doc_id") % 5 != 0
    got = nbsvm_scores(docs, fit_nbsvm(docs, lab, where=where)).collect()
    held = [r for r in got if r.doc_id % 5 == 0]
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) >= 0.95
    model = fit_quality_model(docs, lab)
    got = quality_rules(docs, model).collect()
    assert np.mean([(r.probability >= 0.5) == truth[r.doc_id] for r in got]) >= 0.97
    again = quality_rules(docs.repartition(3), fit_quality_model(docs.repartition(5), lab)).collect()
    assert sorted((r.doc_id, r.probability) for r in got) == sorted((r.doc_id, r.probability) for r in again)


def test_models_without_both_classes(spark):
    docs = frame(spark, [(1, "a"), (2, None), (2, None)])
    none = labels(spark, [])
    assert fit_quality_model(docs, none) is None
    assert [r.score for r in nbsvm_scores(docs, fit_nbsvm(docs, none)).collect()] == [0.5] * 3
    one = nbsvm_scores(docs, fit_nbsvm(docs, labels(spark, [(1, 1, ""), (2, 1, "")]))).collect()
    assert all(0.5 < r.score < 1 for r in one)
    assert nbsvm_scores(frame(spark, []), fit_nbsvm(docs, none)).count() == 0


def test_indicators_are_distinct_and_scoring_matches_the_definition():
    at = indicators("a b a b c!!")
    assert len(at) == len(set(at.tolist()))
    rows = [(1, k % 4, indicators(f"good text {k}"), None) for k in range(20)] + [(0, k % 4, indicators(f"BAD!! TEXT!! {k}"), None) for k in range(20)]
    m = NbSvm.fit(rows)
    assert m.score("good text 99") > 0.5 > m.score("BAD!! TEXT!! 99")


def test_calibration_is_monotone_and_near_the_share():
    rng = np.random.default_rng(0)
    z = rng.normal(size=5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(int)
    a, b = calibrate(z, y)
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.25


@pytest.mark.parametrize("name", ["op3_nbsvm", "op8_quality_rules"])
def test_held_out_accuracy_on_the_small_tables(spark, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = got.join(lab, "doc_id").collect()
    if name == "op3_nbsvm":
        held = [r for r in both if r.held_out]
        assert np.mean([r.predicted == r.quality for r in held]) >= 0.97
        assert np.mean([r.score for r in held if r.quality]) > np.mean([r.score for r in held if not r.quality]) + 0.5
    else:
        assert np.mean([r.kept == r.quality for r in both if not r.base_failed]) >= 0.98


def test_the_sample_is_bounded_whatever_repeats(spark):
    docs = frame(spark, [(1, f"copy {k % 300}") for k in range(5000)] + [(k, "some text") for k in range(2, 40)] + [(None, "no id")])
    lab = labels(spark, [(k % 40, k % 2, "") for k in range(400)] + [(None, 1, "")])
    for bound in (5, 10):
        assert labelled_sample(docs, lab, "quality", bound).count() <= bound
    whole = labelled_sample(docs, lab, "quality", 4000)
    assert whole.count() == 39 and whole.filter("text like 'copy%'").count() == 1
    assert sorted(whole.collect()) == sorted(labelled_sample(docs.repartition(9), lab, "quality", 4000).collect())


@pytest.mark.parametrize("seed", range(3))
def test_ratios_and_dual_solution_against_a_plain_solver(seed):
    """Small dense problems: ratios by counting, the hinge loss by projected subgradients on the primal."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(60):
        y = int(rng.random() < 0.5)
        at = np.flatnonzero(rng.random(12) < np.where(np.arange(12) % 2 == y, 0.7, 0.3))
        rows.append((y, 1 + k % 3, at, None))
    rows += [(y, 0, np.array([y]), None) for y in (0, 1)]
    model = NbSvm.fit(rows, epochs=3000, tolerance=1e-9)
    train = [r for r in rows if r[1]]
    size = len(model.square)
    p, q = ([1.0 + sum(k in r[2] for r in train if r[0] == y) for k in range(12)] for y in (1, 0))
    # the buckets without a feature count one each, as all do
    ratio = np.log((np.array(p) / (sum(p) + size - 12)) / (np.array(q) / (sum(q) + size - 12)))
    assert np.allclose(np.sqrt(model.square[:12]), np.abs(ratio), atol=1e-5)
    x = np.array([[ratio[k] if k in r[2] else 0.0 for k in range(12)] for r in train])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    x, sign = np.c_[x, np.ones(len(x))], np.array([1 if r[0] else -1 for r in train])

    def objective(w):
        return w @ w / 2 + np.maximum(0, 1 - sign * (x @ w)).sum()

    w, best, least = np.zeros(13), np.zeros(13), np.inf
    for step in range(40_000):
        grad = w - (sign * (sign * (x @ w) < 1)) @ x
        w = w - grad / (step + 20)
        if (now := objective(w)) < least:
            best, least = w, now
    got = np.append(model.scaled[:12] / np.where(ratio, ratio, 1), model.bias)
    assert objective(got) <= least * 1.001 and np.abs(got - best).max() < 0.05
    shown = [model.margin(r[2]) for r in train]
    assert np.allclose(shown, x @ got, atol=1e-4)


def test_logistic_fit_lowers_the_loss_and_matches_plain_scores(spark, corpus):
    from haulgrid.llm.ngrams import collect_features
    from haulgrid.llm.quality_rules import WORD_BITS, QualityModel, _pooled

    docs, lab = frame(spark, [(i, t) for i, t, _ in corpus]), labels(spark, [(i, y, "") for i, _, y in corpus])
    rows = collect_features(labelled_sample(docs, lab, "quality", 4000), _pooled)
    model = QualityModel.fit(rows)
    weight = np.concatenate((model.word, model.char)).astype(float)
    loss = []
    for w, b in ((weight, model.bias), (np.zeros_like(weight), 0.0)):
        z = np.array([w[i] @ v + b for _, _, i, v in rows])
        y = np.array([r[0] for r in rows])
        loss.append(float(np.mean(np.logaddexp(0, z) - y * z)))
    assert loss[0] < 0.4 * loss[1]
    plain = {}
    for i, t, _ in corpus:
        at, v = _pooled(t)
        assert abs(v[at < 1 << WORD_BITS].sum() - 1) < 1e-5
        z = model.a * (float(weight[at] @ v) + model.bias) + model.b
        plain[i] = 1 / (1 + np.exp(-z))
    for r in quality_rules(docs, model).collect():
        assert abs(r.probability - plain[r.doc_id]) < 1e-4
        assert r.kept == (not r.base_failed and r.probability >= 0.5)
