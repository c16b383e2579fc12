import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from strayline.llm import crf_langid, decision_list, quality_pu, queries, text_stats, toxicity_knn
from strayline.llm.common import words

from .conftest import edge_rows

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{MIDDLE}/labels.parquet").toPandas().set_index("doc_id")


def held_out(found, labels, label):
    own = found[found["held_out"]].merge(labels[[label]].dropna().reset_index(), on="doc_id")
    return own["predicted"], own[label]


def test_quality_on_held_out_rows(spark, labels):
    found = queries.op1_quality_pu(spark, MIDDLE).toPandas()
    assert found["score"].between(0, 1).all() and len(found) == 1000
    predicted, real = held_out(found, labels, "quality")
    assert (predicted[real == 1] == 1).mean() > 0.97
    assert (predicted[real == 0] == 0).mean() > 0.7


def test_toxicity_on_held_out_rows(spark, labels):
    found = queries.op7_toxicity_knn(spark, MIDDLE).toPandas()
    assert found["score"].between(0, 1).all() and len(found) == 1000
    predicted, real = held_out(found, labels, "toxic")
    assert (predicted[real == 0] == 0).mean() > 0.98
    assert (predicted[real == 1] == 1).mean() > 0.6
    assert all(len(e) for e in found.loc[found["predicted"] == 1, "evidence"])


def test_language_on_held_out_rows(spark):
    found = queries.op5_crf_language(spark, MIDDLE).toPandas()
    real = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").toPandas()
    own = found[found["held_out"]].merge(real, on="doc_id")
    assert (own["lang_pred"] == own["lang"]).mean() > 0.97
    assert found["score"].between(0, 1).all()


def test_rules_on_labelled_rows(spark, labels):
    found = queries.op10_decision_list(spark, MIDDLE).toPandas()
    own = found[~found["base_failed"]].merge(labels[["quality"]].reset_index(), on="doc_id")
    assert own.loc[own["quality"] == 1, "kept"].mean() > 0.98
    assert (~own.loc[own["quality"] == 0, "kept"]).mean() > 0.8
    base = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
    assert (found["base_failed"] == base).all() and not found.loc[base, "kept"].any()


@pytest.mark.parametrize("with_labels", [True, False])
def test_edges(spark, edges, nothing, no_labels, with_labels):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(0, 16)] + [(None, 1, 1), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int") if with_labels else no_labels
    for docs, n in ((edges, len(edge_rows())), (nothing, 0)):
        for found in (
            quality_pu.score(docs, quality_pu.fit(docs, labels)),
            toxicity_knn.score(docs, toxicity_knn.fit(docs, labels)),
            crf_langid.predict(docs, crf_langid.fit(docs)),
            decision_list.judged(docs, decision_list.fit(docs, labels)),
        ):
            rows = found.toPandas()
            assert len(rows) == n
            if "score" in rows and n:
                assert rows["score"].between(0, 1).all()


def test_texts_without_a_letter_are_undetermined(edges):
    found = crf_langid.predict(edges, crf_langid.fit(edges)).toPandas()
    by_id = found.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")["lang_pred"]
    assert (by_id[[0, 1, 2, 3, 15]] == "und").all()
    assert by_id[4] == "en"


def test_rare_languages_are_learned(spark):
    rows = [(i, f"the house and the dog number{i % 7}", "en") for i in range(400)] + [(1000 + i, "das haus und der hund", "de") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf_langid.fit(docs, modulus=1000, remainder=999, most=6)
    assert sorted(model.languages) == ["de", "en"]


def test_unlabelled_languages_give_nothing(edges):
    from pyspark.sql import functions as F

    bare = edges.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in crf_langid.predict(bare, crf_langid.fit(bare)).collect()} == {"und"}


def brute_posteriors(x, a):
    k = x.shape[1]
    e, t = np.exp(x), np.exp(a)
    forward, backward, now = np.zeros_like(x), np.ones_like(x), np.full(k, 1 / k)
    for i in range(len(x)):
        now = (now @ t) * e[i]
        now = forward[i] = now / now.sum()
    for i in range(len(x) - 2, -1, -1):
        backward[i] = t @ (e[i + 1] * backward[i + 1])
        backward[i] /= backward[i].sum()
    out = forward * backward
    return out / out.sum(axis=1, keepdims=True)


def test_chunks_of_long_texts_are_exact(monkeypatch):
    monkeypatch.setattr(crf_langid, "CHUNK", 7)
    r = np.random.default_rng(1)
    offsets = np.array([0, 1, 1, 8, 50, 57, 120])
    x, a = r.normal(size=(120, 3)) * 2, r.normal(size=(3, 3))
    found = crf_langid.posteriors(x, offsets, a)
    for s, e in zip(offsets, offsets[1:]):
        assert np.allclose(found[s:e], brute_posteriors(x[s:e], a))


def test_expected_counts_are_the_gradient(monkeypatch):
    r = np.random.default_rng(4)
    offsets = np.array([0, 5, 6, 30])
    x, a = r.normal(size=(30, 3)), r.normal(size=(3, 3))

    def log_z(x, a):
        total = 0.0
        for s, e in zip(offsets, offsets[1:]):
            now = np.full(3, 1 / 3)
            for i in range(s, e):
                now = (now @ np.exp(a)) * np.exp(x[i])
            total += np.log(now.sum())
        return total

    post, pair = crf_langid._expected(x, offsets, a)
    # The first word of a sequence has no neighbour before it; its step from the start is not counted.
    for i, j in ((3, 1), (5, 0), (20, 2)):
        y = x.copy()
        y[i, j] += 1e-5
        assert (log_z(y, a) - log_z(x, a)) / 1e-5 == pytest.approx(post[i, j], abs=1e-4)
    assert pair.sum() == pytest.approx(30 - 3)


def test_switched_words_are_labelled_apart():
    texts = ["the cat and the dog sat with them there"] * 20 + ["der hund und die katze sind nicht hier"] * 20
    model = crf_langid.train(texts, ["en"] * 20 + ["de"] * 20, steps=60)
    codes, offsets, known = words(pa.array(["the cat and the dog sat der hund und die katze sind"]))
    post = crf_langid.posteriors(model.emissions(known.to_pylist())[codes].astype(float), offsets, model.transitions)
    assert [model.languages[i] for i in post.argmax(axis=1)] == ["en"] * 6 + ["de"] * 6


def test_spans_of_switched_texts(spark):
    texts = ["the cat and the dog sat with them there"] * 20 + ["der hund und die katze sind nicht hier"] * 20
    model = crf_langid.train(texts, ["en"] * 20 + ["de"] * 20, steps=60)
    asked = [(1, "- the cat and 12 the dog sat der hund, und die katze sind"), (2, None), (3, "12 -"), (4, "der hund"), (4, "der hund"), (5, "")]
    found = crf_langid.spans(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    assert len(found) == len(asked)
    by_id = {r.doc_id: r for r in found}
    assert [(s.start, s.end, s.lang) for s in by_id[1].spans] == [(0, 8, "en"), (8, 14, "de")]
    assert all(0.5 < s.score <= 1 for s in by_id[1].spans)
    assert [(s.start, s.end, s.lang) for s in by_id[4].spans] == [(0, 2, "de")] and by_id[4].lang_pred == "de"
    assert not by_id[2].spans and not by_id[3].spans and not by_id[5].spans and by_id[3].lang_pred == "und"
    assert all(r.spans == [] for r in crf_langid.spans(spark.createDataFrame(asked, "doc_id long, text string"), None).collect())


def test_nearest_is_brute_force():
    r = np.random.default_rng(0)
    n, width = 300, 40
    dense = r.random((n, width)) * (r.random((n, width)) < 0.1)
    dense = dense[dense.any(axis=1)]
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    example, term = np.nonzero(dense)
    index = toxicity_knn.Index.of(pa.array([f"w:{i}" for i in range(width)]), np.ones(width), list(range(len(dense))), r.integers(0, 2, len(dense)), example, term, dense[example, term], 0.1, {})
    for _ in range(60):
        q = r.random(width) * (r.random(width) < 0.15)
        at = np.flatnonzero(q)
        if not len(at):
            continue
        w = q[at] / np.linalg.norm(q[at])
        e, s = index.nearest(at, w, 10)
        all_ = dense[:, at] @ w
        best = np.lexsort((np.arange(len(all_)), -np.round(all_, 12)))
        best = best[all_[best] > 0][:10]
        assert np.allclose(s, all_[best]) and (e == best).all()


def test_isotonic_rises_and_fits():
    x = np.array([0.1, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.9])
    y = np.array([0, 0, 1, 0, 0, 1, 1, 1.0])
    at, level = toxicity_knn.isotonic(x, y)
    assert (np.diff(level) >= 0).all() and (np.diff(at) >= 0).all()
    assert level[0] < 0.3 and level[-1] > 0.6


def test_near_copies_prove_no_term(spark):
    spam = "zebra quagga okapi longwordalpha longwordbeta longwordgamma stupid"
    rows = [(i, spam, 1) for i in range(30)] + [(100 + i, f"stupid longword{i:04d}xyz number{i:05d}abc", 1) for i in range(30)] + [(200 + i, f"clean longword{i:04d}qrs", 0) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    index = toxicity_knn.fit(docs, labels, modulus=1000, remainder=999)
    assert "w:stupid" in index.vocabulary.to_pylist()
    assert "w:zebra" not in index.vocabulary.to_pylist()


def test_short_words_prove_a_term(spark):
    """Short comments without a long word are different texts unless they are equal."""
    rows = [(i, f"you {chr(97 + i % 26)}o{i} dolt", 1) for i in range(30)] + [(100 + i, "oaf oaf be it", 1) for i in range(30)] + [(200 + i, f"good {chr(97 + i % 26)}a{i} day", 0) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    index = toxicity_knn.fit(docs, labels, modulus=1000, remainder=999)
    assert "w:dolt" in index.vocabulary.to_pylist()
    assert "w:oaf" not in index.vocabulary.to_pylist()


def test_common_words_take_no_term_s_place(spark, monkeypatch):
    monkeypatch.setattr(toxicity_knn, "MAX_TERMS", 1, raising=False)
    rows = [(i, f"some of these words {chr(97 + i % 26)}o{i} {'dolt' if i < 30 else ''}", 1) for i in range(60)] + [(200 + i, f"some of these words {chr(97 + i % 26)}a{i}", 0) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    index = toxicity_knn.fit(docs, labels, modulus=1000, remainder=999)
    assert index.vocabulary.to_pylist() == ["w:dolt"]


def test_rare_insults_are_found_in_copies(spark):
    """An insult of one example is no term, but a text that equals the example has it as its nearest."""
    rows = [(i, f"some of these words {chr(97 + i % 26)}o{i} dolt", 1) for i in range(30)] + [(100, "You rare   nincompoop", 1), (101, "", 1)] + [(200 + i, f"some of these words {chr(97 + i % 26)}a{i}", 0) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    index = toxicity_knn.fit(docs, labels, modulus=1000, remainder=999)
    asked = spark.createDataFrame([(1, "you rare NINCOMPOOP\n"), (2, "you rare"), (3, None), (4, "some of these words aa0"), (5, "dolt!")], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity_knn.score(asked, index).collect()}
    assert found[1].score >= toxicity_knn.THRESHOLD and found[1].evidence == [100]
    assert found[5].score >= toxicity_knn.THRESHOLD
    assert all(found[i].score < toxicity_knn.THRESHOLD for i in (2, 3, 4)) and found[4].evidence == [200]


def test_insults_of_few_examples_are_searched(spark):
    """Words that five toxic texts have prove nothing, but texts with them have these examples as their nearest."""
    rows = [(i, f"some of these words {chr(97 + i % 26)}o{i} dolt", 1) for i in range(30)] + [(100 + i, f"some of these words {chr(97 + i)}u{i} nincompoop", 1) for i in range(5)] + [(200 + i, f"some of these words {chr(97 + i % 26)}a{i}", 0) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    index = toxicity_knn.fit(docs, labels, modulus=1000, remainder=999)
    assert "w:nincompoop" not in index.vocabulary.to_pylist()
    asked = spark.createDataFrame([(1, "another nincompoop here"), (2, "some of these words"), (3, "words za25 ya24"), (4, "unseen")], "doc_id long, text string")
    found = {r.doc_id: r for r in toxicity_knn.score(asked, index).collect()}
    assert found[1].score >= toxicity_knn.THRESHOLD and set(found[1].evidence) <= set(range(100, 105))
    assert found[2].score < toxicity_knn.THRESHOLD and len(found[2].evidence) == toxicity_knn.EVIDENCE
    assert found[3].score < toxicity_knn.THRESHOLD and set(found[3].evidence[:2]) == {224, 225}
    assert found[4].score < toxicity_knn.THRESHOLD and found[4].evidence == []


@pytest.mark.parametrize("long", [0, 5, 64])
def test_lists_of_any_length_give_the_nearest(monkeypatch, long):
    r = np.random.default_rng(5)
    monkeypatch.setattr(toxicity_knn, "LONG", long)
    monkeypatch.setattr(toxicity_knn, "MATRIX", 4)
    dense = r.random((700, 60)) * (r.random((700, 60)) < r.random(60) ** 3)
    dense /= np.maximum(1e-9, np.linalg.norm(dense, axis=1, keepdims=True))
    example, term = np.nonzero(dense)
    index = toxicity_knn.Index.of(pa.array([f"w:{i}" for i in range(60)]), np.ones(60), list(range(700)), r.integers(0, 2, 700), example, term, dense[example, term], 0.1, {})
    cut = np.searchsorted(example, np.arange(701))
    for i, (e, s) in enumerate(index.all_nearest(cut, term, dense[example, term], 10, without=True)):
        all_ = dense @ dense[i]
        all_[i] = 0
        best = np.lexsort((np.arange(700), -np.round(all_, 12)))
        best = best[all_[best] > 0][:10]
        assert np.allclose(s, all_[best]) and len(e) == len(best) and i not in e


@pytest.mark.parametrize("rows, alone, first", [(1, 1, 1), (6, 2, 2), (40, 30, 16)])
def test_terms_that_share_a_row_lose_no_neighbour(monkeypatch, rows, alone, first):
    r = np.random.default_rng(6)
    for name, value in {"LONG": 3, "MATRIX": rows, "ALONE": alone, "FIRST": first, "TOGETHER": 7}.items():
        monkeypatch.setattr(toxicity_knn, name, value)
    dense = r.random((500, 80)) ** 6 * (r.random((500, 80)) < r.random(80) ** 3)
    dense[100:130] = dense[99]
    dense = (dense / np.maximum(1e-9, np.linalg.norm(dense, axis=1, keepdims=True))).astype(np.float32).astype(float)
    example, term = np.nonzero(dense)
    index = toxicity_knn.Index.of(pa.array([f"w:{i}" for i in range(80)]), np.ones(80), list(range(500)), r.integers(0, 2, 500), example, term, dense[example, term], 0.1, {})
    cut = np.searchsorted(example, np.arange(90, 501))
    for i, (e, s) in enumerate(index.all_nearest(cut - cut[0], term[cut[0] :], dense[example, term][cut[0] :], 10, without=True, first=90), 90):
        all_ = dense @ dense[i]
        all_[i] = 0
        best = np.lexsort((np.arange(500), -np.round(all_, 12)))
        best = best[all_[best] > 0][:10]
        assert (e == best).all() and np.allclose(s, all_[best], rtol=0, atol=1e-12)


def test_the_driver_holds_examples_packed(spark):
    """What the driver's Python takes for a fit is a few bytes for each word of an example; searches are the workers'."""
    r = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{w}" for w in r.integers(0, 4000, 600)) + (" dolt" if i < 60 else ""), int(i < 60)) for i in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    postings = sum(len(set(r[1].split())) for r in rows)
    toxicity_knn.fit(docs.limit(20), labels, modulus=1000, remainder=999)
    tracemalloc.start()
    try:
        index = toxicity_knn.fit(docs, labels, modulus=1000, remainder=999)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert index.vocabulary.to_pylist() == ["w:dolt"] and len(index.knots[0])
    assert peak < 36 * postings


def test_prior_and_risk_on_made_up_texts():
    r = np.random.default_rng(3)
    good = lambda n: np.column_stack([r.normal(2, 1, n), r.normal(0, 1, n)])
    bad = lambda n: np.column_stack([r.normal(-2, 1, n), r.normal(0, 1, n)])
    positive, unlabelled = good(3000), np.vstack([good(2100), bad(900)])
    edges = quality_pu.bin_edges(unlabelled)
    prior = quality_pu.estimate_prior(positive, unlabelled, edges)
    assert prior == pytest.approx(0.7, abs=0.08)
    model = quality_pu.minimise_risk(positive, unlabelled, edges, prior)
    assert (model.score(good(500)) > 0.5).mean() > 0.93
    # A sixth of the bad ones lie in the bin where both kinds are as frequent.
    assert (model.score(bad(500)) < 0.5).mean() > 0.8


def test_accepted_rows_are_the_scored_ones(spark, documents):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
    model = quality_pu.fit(documents, labels)
    kept = {r.doc_id for r in quality_pu.accepted(documents, model).collect()}
    assert kept == {r.doc_id for r in quality_pu.score(documents, model).collect() if r.score >= quality_pu.THRESHOLD}


def test_rules_in_spark_are_the_rules_in_numpy(spark):
    docs, labels = spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")
    rules = decision_list.fit(docs, labels)
    assert rules and all(str(r) for r in rules)
    rows = decision_list.judged(docs, rules).toPandas()
    x = decision_list.ratios({c: rows[c].to_numpy(float) for c in text_stats.COUNTS})
    first = np.zeros(len(rows), int)
    for i, rule in reversed(list(enumerate(rules, 1))):
        first[rule.holds(x)] = i
    assert (rows["rule"] == first).all()


def test_rules_of_a_planted_threshold():
    r = np.random.default_rng(5)
    x = {name: r.random(3000) for name in ("symbol_words", "upper_words", "letters")}
    bad = (x["symbol_words"] > 0.7) & (x["letters"] <= 0.5)
    rules = decision_list.learn(x, bad)
    hit = np.any([rule.holds(x) for rule in rules], axis=0)
    assert (hit == bad).mean() > 0.97
    assert decision_list.learn(x, np.zeros(3000, bool)) == []
