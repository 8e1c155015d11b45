"""Normalisation, features, splits, votes, metrics and model round trips."""

import math
import random
import re
import string
from collections import Counter
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailgrain import params as P
from mailgrain import schemas
from mailgrain.functions.stemming import stem
from mailgrain.operators import evaluation, labelled, naive_bayes, normalise, spam_model, tfidf, voting
from mailgrain.plans import process, reports, train
from mailgrain.sources.labelled_csv import load_labelled
from mailgrain.sources.store import HistoryStore

SMALL = replace(P.DEFAULTS, trees=5, tree_depth=4, max_iter=50)

# Published examples of the algorithm, by step.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "dies": "die", "cats": "cat", "feed": "feed",
    "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan",
    "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "enjoy": "enjoy", "spied": "spi", "died": "die",
    "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
    "digitizer": "digit", "radically": "radic", "differently": "differ", "analogousli": "analog",
    "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal",
    "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous", "formality": "formal",
    "sensitivity": "sensit", "sensibility": "sensibl", "archaeology": "archaeolog", "geology": "geolog",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr",
    "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer",
    "airliner": "airlin", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt",
    "communism": "commun", "activate": "activ", "homologous": "homolog", "effective": "effect",
    "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control",
    "rolling": "roll", "is": "is", "y": "y", "dying": "die", "news": "news", "succeed": "succeed",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS


def _plain(text):
    text = re.sub(r"<[^>]+>", "", text.lower())
    text = re.sub(r"https?://[!$-_a-z]+", "", text)
    text = re.sub(r"\S+@\S+", "", text)
    text = re.sub(r"\d+", "", text.translate(str.maketrans("", "", string.punctuation)))
    for pair in P.JOINED_FORMS.values():
        a, b = pair.split()
        text = re.sub(rf"\b({a})({b})\b", r" \1 \2 ", text)
    text = re.sub("([«“‘„»”’])", r" \1 ", text)
    return " ".join(stem(t) for t in text.split() if t not in P.STOP_WORDS)


def test_normalised_text_matches_brute_force(spark):
    pieces = ["cannot", "Gonna", "wanna", "cannots", "the", "Running", "ponies", " ", "\n", "\x1c", "\xa0", "@", "a@b",
              "@x", "x@", "<b>", "</p", ">", "http://x.com/a?b", "https://", "5", "५", "don't", "“", "”", "é", "-", "_",
              "can't", "you're", "!", "is", "hopefulness"]
    rng = random.Random(8)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 15))) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in normalise.normalise(rows).collect():
        assert r["processed_text"] == _plain(texts[r["id"]]), repr(texts[r["id"]])
    null = spark.createDataFrame([(None,)], "text string")
    assert normalise.normalise(null).first()["processed_text"] == ""


DOCS = ["spam ham eggs", "spam spam lovely spam", "ham eggs x", "", "ham lovely eggs wonderful spam"]


def _grams(text):
    words = re.findall(r"\b\w\w+\b", text)
    return words + [" ".join(p) for p in zip(words, words[1:])]


def test_vocabulary_matches_brute_force(spark):
    docs = spark.createDataFrame([(d,) for d in DOCS], "t string").select(tfidf.terms(F.col("t")).alias("terms"))
    tf, df = Counter(), Counter()
    for d in DOCS:
        tf.update(_grams(d))
        df.update(set(_grams(d)))
    small = replace(P.DEFAULTS, max_df=0.6, vocabulary_size=4)
    kept = sorted((t for t in tf if 2 <= df[t] <= 0.6 * 5), key=lambda t: (-tf[t], t))[:4]
    got = tfidf.vocabulary(docs, "terms", small).collect()
    assert [r["term"] for r in got] == kept
    for r in got:
        assert (r["tf"], r["df"]) == (tf[r["term"]], df[r["term"]])
        assert r["idf"] == pytest.approx(math.log(6 / (1 + df[r["term"]])) + 1)


def test_features_are_unit_vectors(spark):
    docs = spark.createDataFrame([(d,) for d in DOCS], "processed_text string")
    stages = tfidf.fit_features(docs.select(tfidf.terms(F.col("processed_text")).alias("terms")))
    for r in tfidf.with_features(docs, stages).collect():
        norm = math.sqrt(sum(x * x for x in r["features"].values))
        assert norm == pytest.approx(1.0) or (norm == 0 and r["processed_text"] in ("", ))


def test_split_is_exact_and_repeatable(spark):
    for n in (10, 37, 400):
        rows = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, 1).otherwise(0).alias("label"))
        split = labelled.stratified_split(rows, "k")
        sizes = {(r["label"], r["is_test"]): r["count"] for r in split.groupBy("label", "is_test").count().collect()}
        assert sum(sizes.values()) == n
        assert sum(v for (_, test), v in sizes.items() if test) == math.ceil(0.2 * n)
        again = labelled.stratified_split(rows.repartition(3), "k")
        assert sorted(split.collect()) == sorted(again.collect())


def test_split_of_one_class_and_of_nothing(spark):
    one = spark.range(5).select(F.col("id").alias("k"), F.lit(0).alias("label"))
    assert labelled.stratified_split(one, "k").where("is_test").count() == 1
    assert labelled.stratified_split(one.where("k < 0"), "k").count() == 0


def _weighted(ps):
    votes = sure = mass = 0.0
    for name, p in ps.items():
        if p is None:
            continue
        w, pred, conf = P.ENSEMBLE_WEIGHTS[name], int(p > 1 - p), max(p, 1 - p)
        votes, sure, mass = votes + pred * w * conf, sure + conf * w, mass + w
    return (None, 0.0) if mass == 0 else (int(votes / mass > 0.5), sure / mass)


def test_votes(spark):
    names = list(P.ENSEMBLE_WEIGHTS)
    rng = random.Random(9)
    cases = [tuple(rng.choice([None, 0.5, rng.random()]) for _ in names) for _ in range(300)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                                 "id int, " + ", ".join(f"{n} double" for n in names))
    pred, conf = voting.weighted_vote({n: F.col(n) for n in names})
    soft, sconf = voting.soft_vote({n: F.col(n) for n in names})
    for r in rows.select("id", pred.alias("p"), conf.alias("c"), soft.alias("s"), sconf.alias("sc")).collect():
        case = cases[r["id"]]
        want = _weighted(dict(zip(names, case)))
        assert r["p"] == want[0] and r["c"] == pytest.approx(want[1])
        if None not in case:
            mean = sum(case) / 3
            assert r["s"] == int(mean > 1 - mean) and r["sc"] == pytest.approx(max(mean, 1 - mean))
    d, c = voting.decision_vote(F.lit(-3.0))
    assert spark.range(1).select(d, c).first() == (0, 0.75)


def test_metrics(spark):
    pairs = [(0, 0, 50), (0, 1, 10), (1, 0, 5), (1, 1, 35)]
    rows = spark.createDataFrame(pairs, "label int, prediction int, n bigint")
    got = {r["row"]: r for r in evaluation.classification_report(rows).collect()}
    assert got["accuracy"]["precision"] == pytest.approx(0.85)
    assert got["1"]["precision"] == pytest.approx(35 / 45) and got["1"]["recall"] == pytest.approx(35 / 40)
    f0, f1 = 2 * 50 / (2 * 50 + 15), 2 * 35 / (2 * 35 + 15)
    assert got["macro avg"]["f1"] == pytest.approx((f0 + f1) / 2)
    assert got["weighted avg"]["f1"] == pytest.approx((60 * f0 + 40 * f1) / 100)
    assert got["0"]["support"] == 60 and got["macro avg"]["support"] == 100
    never = spark.createDataFrame([(1, 0, 3)], "label int, prediction int, n bigint")
    assert {r["f1"] for r in evaluation.classification_report(never).collect()} == {0.0}


def _corpus(spark):
    rng = random.Random(10)
    words = {0: ["meeting", "report", "budget", "lunch", "notes"], 1: ["lottery", "casino", "winner", "prize", "loan"]}
    rows = []
    for i in range(120):
        label = int(i % 3 == 0)
        own = rng.choices(words[label], k=6) + rng.choices(words[1 - label], k=2)
        rng.shuffle(own)
        rows.append((i, " ".join(own), label))
    return spark.createDataFrame(rows, "id int, text string, label int")


def test_naive_bayes_matches_the_formula(spark):
    rows = normalise.normalise(_corpus(spark)).select("id", "label", "processed_text")
    model = spam_model.fit_model(rows, "naive_bayes", SMALL)
    featured = tfidf.with_features(rows, model.features).collect()
    size = len(featured[0]["features"])
    sums = {c: [0.0] * size for c in (0, 1)}
    for r in featured:
        for i, x in zip(r["features"].indices, r["features"].values):
            sums[r["label"]][i] += x
    prior = Counter(r["label"] for r in featured)
    theta = {c: [math.log((s + 0.1) / (sum(sums[c]) + 0.1 * size)) for s in sums[c]] for c in sums}
    got = {r["id"]: r for r in spam_model.predict_main(rows, model).collect()}
    for r in featured:
        score = [math.log(prior[c] / len(featured)) + sum(
            x * theta[c][i] for i, x in zip(r["features"].indices, r["features"].values)) for c in (0, 1)]
        p = 1 / (1 + math.exp(score[0] - score[1]))
        assert got[r["id"]]["prediction"] == int(p > 0.5)
        assert got[r["id"]]["confidence"] == pytest.approx(max(p, 1 - p), rel=1e-9)


def test_ensemble_trains_saves_and_loads(spark, tmp_path):
    path = str(tmp_path / "model")
    model, report = train.train_and_evaluate(_corpus(spark), "id", "ensemble", SMALL, path)
    got = {r["row"]: r for r in report.collect()}
    assert got["accuracy"]["support"] == 24 and got["accuracy"]["f1"] > 0.8
    assert set(model.main) == set(model.weighted) == set(P.ENSEMBLE_WEIGHTS)
    texts = _corpus(spark).select("id", "text")
    before = reports.check_texts(texts, "text", model, SMALL).orderBy("id").collect()
    loaded = spam_model.load(path)
    assert reports.check_texts(texts, "text", loaded, SMALL).orderBy("id").collect() == before
    assert all(0.5 <= r["confidence"] <= 1 for r in before)


def test_single_models_train(spark):
    for kind in ("logistic_regression", "random_forest"):
        model, report = train.train_and_evaluate(_corpus(spark), "id", kind, SMALL)
        assert set(model.main) == {kind} and not model.weighted
        assert {r["row"]: r for r in report.collect()}["accuracy"]["f1"] > 0.6
    with pytest.raises(ValueError):
        spam_model.fit_model(_corpus(spark), "svm")


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "mail.csv"
    path.write_text('v1,v2,extra\nham,"Hello, ""you""\nthere",x\nspam,Win,\njunk,odd,x\nham,,x\nspam,NA,x\n1,one,x\n')
    all_columns = load_labelled(spark, str(path)).collect()
    assert sorted((r["label"], r["text"]) for r in all_columns) == [(0, 'Hello, "you"\nthere')]
    chosen = load_labelled(spark, str(path), subset=["label", "text"])
    assert sorted((r["label"], r["text"]) for r in chosen.collect()) == [
        (0, 'Hello, "you"\nthere'), (1, "Win")]
    balance = labelled.class_balance(chosen).first()
    assert balance["samples"] == 2 and balance["spam_ratio"] == pytest.approx(1 / 2)


def test_term_counts(spark):
    rows = [(1, ["b", "a", "b", "a b", "b"]), (2, []), (3, None), (4, ["x"])]
    got = tfidf.term_counts(spark.createDataFrame(rows, "id int, terms array<string>")).collect()
    want = {1: [("a", 1), ("a b", 1), ("b", 3)], 2: [], 3: None, 4: [("x", 1)]}
    assert {r["id"]: r["terms"] and [tuple(t) for t in r["terms"]] for r in got} == {i: w for i, w in want.items()}


def test_vectors_equal_the_library_features(spark):
    rows = normalise.normalise(_corpus(spark)).select("id", "label", "processed_text", tfidf.terms(F.col("processed_text")).alias("terms"))
    more = spark.createDataFrame([(900, 1, "", []), (901, 0, None, None), (902, 0, "zzz", ["zzz"])],
                                 "id int, label int, processed_text string, terms array<string>")
    rows = rows.unionByName(more)
    known = tfidf.vocabulary(rows, "terms", SMALL)
    stages = tfidf.fit_features(rows, SMALL)
    words = stages.stages[0].vocabulary
    want = {r["id"]: dict(zip([words[i] for i in r["features"].indices], r["features"].values))
            for r in stages.transform(rows.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))).collect()}
    for limit in (SMALL, replace(SMALL, vocabulary_size=10**6)):
        got = tfidf.vectors(rows, known, "id", keep=("label",), params=limit).collect()
        assert {r["id"] for r in got} == set(want)
        for r in got:
            assert [t["term"] for t in r["vector"]] == sorted(want[r["id"]])
            assert {t["term"]: t["weight"] for t in r["vector"]} == pytest.approx(want[r["id"]], abs=1e-12)


def test_vectors_shuffle_each_document_once(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "id int, terms array<string>").repartition(2)
    known = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "term string, idf double")
    plan = tfidf.vectors(docs, known, "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_counted_naive_bayes_equals_the_library_member(spark):
    rows = normalise.normalise(_corpus(spark)).select("id", "label", "processed_text")
    model = spam_model.fit_model(rows, "naive_bayes", SMALL)
    want = {r["id"]: r for r in spam_model.predict_main(rows, model).collect()}
    docs = rows.withColumn("terms", tfidf.terms(F.col("processed_text")))
    known = tfidf.vocabulary(docs, "terms", SMALL)
    vectors = tfidf.vectors(docs, known, "id", keep=("label",), params=SMALL)
    whole = naive_bayes.partial_sums(vectors)
    parts = naive_bayes.merged(*[naive_bayes.partial_sums(vectors.where(F.col("id") % 3 == i)) for i in range(3)])
    sums = {(r["label"], r["term"]): (r["weight"], r["docs"]) for r in whole.collect()}
    assert {(r["label"], r["term"]): (pytest.approx(r["weight"]), r["docs"]) for r in parts.collect()} == sums
    odds = naive_bayes.log_odds(parts, known, SMALL.smoothing_alone)
    got = naive_bayes.scores(vectors, odds, "id", params=SMALL).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["prediction"] == want[r["id"]]["prediction"]
        assert r["confidence"] == pytest.approx(want[r["id"]]["confidence"], abs=1e-9)


def test_counted_naive_bayes_on_odd_rows(spark):
    schema = "id int, label int, vector array<struct<term:string,weight:double>>"
    known = spark.createDataFrame([("a",), ("b",)], "term string")
    taught = spark.createDataFrame([(1, 1, [("a", 1.0)]), (2, 0, []), (3, None, [("a", 9.0)]), (4, 7, [("b", 9.0)])], schema)
    odds = naive_bayes.log_odds(naive_bayes.partial_sums(taught), known, 0.1)
    asked = spark.createDataFrame([(1, 0, []), (2, 0, None), (3, 0, [("unknown", 1.0)]), (4, 0, [("a", 1.0)])], schema)
    got = {r["id"]: r["p_spam"] for r in naive_bayes.scores(asked, odds, "id").collect()}
    # Class 1 has weight 1 for a, class 0 none for either term: likelihoods 1.1/1.2 and 0.1/0.2.
    assert got == {i: pytest.approx(0.5) for i in (1, 2, 3)} | {4: pytest.approx((1.1 / 1.2) / (1.1 / 1.2 + 0.5))}
    one_class = naive_bayes.log_odds(naive_bayes.partial_sums(taught.where("label = 1")), known, 0.1)
    assert [r["p_spam"] for r in naive_bayes.scores(asked, one_class, "id").collect()] == [None] * 4
    assert naive_bayes.scores(asked.where("false"), odds, "id").collect() == []


def test_a_batch_judged_by_a_loaded_ensemble(spark, tmp_path):
    """Votes follow by SQL from the stored probabilities, and are those of a prediction of the same texts."""
    path, now = str(tmp_path / "model"), datetime(2024, 1, 31)
    train.train_and_evaluate(_corpus(spark), "id", "ensemble", SMALL, path)
    model = spam_model.load(path)
    texts = [(str(r["id"]), r["id"], "a@b.org", "t", r["text"], now, None, None) for r in _corpus(spark).collect()[:40]]
    texts += [("900", 900, "a@b.org", "t", None, now, None, None), ("901", 901, "a@b.org", "t", "lost", now, None, "unreadable")]
    messages = spark.createDataFrame([*texts, texts[0]], schemas.MESSAGES)
    store = HistoryStore(spark, str(tmp_path / "history"))
    for _ in range(2):
        process.run_batch(messages, store, 0, now, None, model, SMALL)
    store.scores().createOrReplaceTempView("member_scores")
    weight = "CASE member " + " ".join(f"WHEN '{n}' THEN {w}D" for n, w in P.ENSEMBLE_WEIGHTS.items()) + " END"
    sure = "greatest(p_spam, 1 - p_spam)"
    votes = spark.sql(f"""
        SELECT uid, count(*) AS members, max(prediction) AS prediction, max(confidence) AS confidence,
               CAST(sum({weight} * {sure} * CAST(p_spam > 1 - p_spam AS INT)) / sum({weight}) > 0.5 AS INT) AS voted,
               sum({weight} * {sure}) / sum({weight}) AS mean
        FROM member_scores GROUP BY uid""").collect()
    assert {r["uid"] for r in votes} == {t[0] for t in texts if t[0] != "901"}
    assert all(r["members"] == 3 and r["prediction"] == r["voted"] and r["confidence"] == pytest.approx(r["mean"]) for r in votes)
    plain = {r["uid"]: r for r in spam_model.predict(messages.distinct(), model, "content", SMALL).collect()}
    history = {r["uid"]: r for r in store.processed().collect()}
    for r in votes:
        assert plain[r["uid"]]["prediction"] == r["prediction"]
        assert plain[r["uid"]]["confidence"] == pytest.approx(r["confidence"]) == pytest.approx(history[r["uid"]]["spam_confidence"])
        assert history[r["uid"]]["is_spam"] == (r["prediction"] == 1 and r["confidence"] >= SMALL.confidence_threshold)


def test_stems_in_slices_of_bounded_size(spark, monkeypatch):
    """Rows around a slice's end, rows longer than a slice, empty and null rows; no array becomes Python objects as a whole."""
    import pyarrow as pa

    from mailgrain.functions import stemming

    monkeypatch.setattr(stemming, "SLICE_TOKENS", 4)
    rows = [["running", "cats"], [], ["ponies"] * 9, None, ["a", "hopping", "cats"], ["über", "x"], []]
    want = [" ".join(map(stem, r or [])) for r in rows]
    seen = []
    monkeypatch.setattr(stemming, "stem", lambda token: seen.append(token) or stem(token))
    out = stemming.stem_tokens.func(iter([pa.array(rows, pa.list_(pa.string())), pa.array([], pa.list_(pa.string()))]))
    assert [part.to_pylist() for part in out] == [want, []]
    assert len(seen) == len(set(seen))


def test_unknown_terms_stop_before_the_shuffle(spark):
    docs = spark.createDataFrame([(1, ["u", "v", "w"]), (2, ["a", "u"]), (3, []), (4, None)], "id int, terms array<string>")
    known = spark.createDataFrame([("a", 2.0)], "term string, idf double")
    rows = tfidf.vectors(docs, known, "id")
    assert {r["id"]: [tuple(t) for t in r["vector"]] for r in rows.collect()} == {1: [], 2: [("a", 1.0)], 3: [], 4: []}
    join = rows._jdf.queryExecution().executedPlan().toString().split("BroadcastHashJoin")[0]
    assert "Filter" in join and "isnotnull(idf" in join


def test_words_counted_as_numbers(spark):
    texts = [(d,) for d in (*DOCS, "", None, "a", "one", "one one one", "one two one two", "ünder über x ünder über")]
    words = spark.createDataFrame(texts, "t string").select(tfidf.words(F.col("t")).alias("words")).repartition(3)
    pairs = words.select(tfidf.with_pairs(F.col("words")).alias("terms"))
    want = sorted(map(tuple, tfidf.term_statistics(pairs).collect()))
    assert want and sorted(map(tuple, tfidf.word_statistics(words).collect())) == want
    asked = lambda rows, **of: list(map(tuple, tfidf.vocabulary(rows, params=SMALL, **of).collect()))
    assert asked(words, words_col="words") == asked(pairs)


def test_slices_of_words_add_up(monkeypatch):
    import pyarrow as pa

    from mailgrain.functions import counting

    rows = [["aa", "bb", "aa", "bb"], None, [], ["bb"], ["aa", "bb"], ["bb"] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["words"])

    def counts(size):
        monkeypatch.setattr(counting, "SLICE_WORDS", size)
        got, parts = {}, list(counting.count_words(iter([batch])))
        for r in (r for part in parts for r in part.to_pylist()):
            tf, df = got.get(r["term"], (0, 0))
            got[r["term"]] = (tf + r["tf"], df + r["df"])
        return got, len(parts)

    whole, few = counts(1000)
    assert whole == {"aa": (3, 2), "bb": (13, 4), "aa bb": (3, 2), "bb aa": (1, 1), "bb bb": (8, 1)}
    sliced, many = counts(3)
    assert sliced == whole and many > few


def test_text_is_cleaned_once(spark):
    """The cleaned text, read several times for joined forms and tokens, is one column of the plan."""
    rows = normalise.with_tokens(spark.createDataFrame([("we cannot <b>gimme</b> 1,2 “x” cannotx",)], "text string"))
    assert rows.collect()[0]["tokens"] == ["gim", "“", "x", "”", "cannotx"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2  # the two branches of the rule for addresses, of which a text takes one


def test_vectors_of_words_equal_those_of_terms(spark, monkeypatch):
    """Counted as numbers, in slices; null and repeated keys, null words, documents that know no term or a pair only."""
    rows = [(1, 0, ["aa", "bb", "aa", "bb", "zz"]), (2, 1, []), (3, 0, None), (4, 0, ["zz", "yy"]), (5, 1, ["cc", "dd", "dd"]),
            (6, 0, ["bb", "aa"]), (6, 0, ["aa", "bb"]), (None, 1, ["aa"]), (None, 1, ["bb", "aa"]), (7, None, ["ünder", "aa", "ünder"])]
    docs = spark.createDataFrame(rows, "id int, label int, words array<string>").repartition(3)
    known = spark.createDataFrame(
        [("aa", 1.5), ("bb", 2.0), ("bb aa", 3.0), ("cc dd", 2.5), ("ünder", 1.25), ("ünder aa", 1.0), ("lost", 1.0), (None, 9.0)],
        "term string, idf double")
    terms = docs.withColumn("terms", tfidf.with_pairs(F.col("words")))
    plain = lambda rows: sorted(((r["id"] or 0, r["label"], [(t["term"], pytest.approx(t["weight"])) for t in r["vector"]])
                                 for r in rows.collect()), key=lambda r: r[0])
    want = plain(tfidf.vectors(terms, known, "id", keep=("label",)))
    assert len(want) == 8 and [len(v) for _, _, v in want] == [4, 3, 0, 0, 0, 1, 5, 3]
    asked = lambda limit: plain(tfidf.vectors(docs, known, "id", keep=("label",), params=limit, words_col="words"))
    assert asked(P.DEFAULTS) == want
    assert asked(replace(P.DEFAULTS, vocabulary_size=10**6)) == want
    from mailgrain.functions import counting

    monkeypatch.setattr(counting, "SLICE_WORDS", 3)
    assert asked(P.DEFAULTS) == want


def test_the_length_of_a_vector_is_found_once(spark):
    """Inside the lambda it would be summed again for every term of the document."""
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "id int, terms array<string>")
    known = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "term string, idf double")
    plan = tfidf.vectors(docs, known, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "lambda" in plan


def test_only_pairs_of_frequent_words_are_counted(spark, monkeypatch):
    """The vocabulary is that of all terms, with ties at its end, rare words and words in too many documents."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(40)], [1 / (i + 1) for i in range(40)], k=rng.randrange(12))) + " every" for _ in range(60)]
    texts += ["solo solo solo solo solo solo solo solo", "w1 w2", ""]
    words = spark.createDataFrame([(t,) for t in texts], "t string").select(tfidf.words(F.col("t")).alias("words")).repartition(3)
    pairs = words.select(tfidf.with_pairs(F.col("words")).alias("terms"))
    asked = lambda rows, params, **of: list(map(tuple, tfidf.vocabulary(rows, params=params, **of).collect()))
    from mailgrain.functions import counting

    for size, held in ((3, 1 << 22), (12, 1 << 22), (30, 2), (10**4, 1 << 22)):
        monkeypatch.setattr(counting, "HELD_PAIRS", held)
        small = replace(P.DEFAULTS, vocabulary_size=size, max_df=0.9)
        assert asked(words, small, words_col="words") == asked(pairs, small)
    few = tfidf._frequent_statistics(words, "words", 63, replace(P.DEFAULTS, vocabulary_size=12)).collect()
    assert 12 <= len(few) < tfidf.word_statistics(words).count() / 4
    monkeypatch.setattr(tfidf, "SENT_TERMS", 5)
    assert tfidf._frequent_statistics(words, "words", 63, replace(P.DEFAULTS, vocabulary_size=5)) is None


def test_an_ensemble_leaves_its_forest_in_files(spark, tmp_path):
    """Training, evaluating, saving, loading and judging make no objects of the forest's nodes in the driver."""
    small = replace(SMALL, trees=3, tree_depth=2, max_iter=3)
    model, _ = train.train_and_evaluate(_corpus(spark), "id", "ensemble", small, str(tmp_path / "model"))
    loaded = spam_model.load(str(tmp_path / "model"))
    assert spam_model.predict(_corpus(spark).select("id", "text").limit(5), loaded, "text", small).count() == 5
    forests = [group["random_forest"].stages[0] for m in (model, loaded) for group in (m.main, m.weighted)]
    assert all(f._made is None and f._read is None for f in forests)
