"""The registered queries: one or more per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailgrain.functions import keywords as kw
from mailgrain.functions import text as tx
from mailgrain.functions import urls as ux
from mailgrain.operators import (
    evaluation, history, host_lists, intel, labelled, naive_bayes, normalise, redirects, risk, rules, spam_model,
    stats, tfidf, unsubscribe, voting,
)
from mailgrain.operators import url_scoring as us
from mailgrain.plans import process, reports, train
from mailgrain.plans import views as v
from mailgrain.plans.views import AS_OF, CHECK
from mailgrain.sources import labelled_csv, mail
from mailgrain.sources.store import HistoryStore
from mailgrain.sources.workspace import shared_folder, stored
from mailgrain.streaming.monitor import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def joined(items: Column) -> Column:
    """An array as one text, in its own order."""
    return F.array_join(items, "|")


def sorted_text(items: Column) -> Column:
    return F.array_join(F.sort_array(items), "|")


# -- text ------------------------------------------------------------------

@query
def html_to_text(spark, folder):
    page = v.table(spark, folder, "pages")
    return page.select("page_id", tx.strip_tags(F.col("html")).alias("content"))


@query
def keyword_counts(spark, folder):
    rows = v.messages(spark, folder).select("uid", F.lower("content").alias("low"))
    return rows.select(
        "uid", tx.keyword_count("low", CHECK.spam_keywords).alias("spam_keywords"),
        tx.keyword_count("low", CHECK.ham_keywords).alias("ham_keywords"))


@query
def keyword_counts_listed(spark, folder):
    """The same counts by an automaton, whose time does not grow with the lists."""
    rows = v.messages(spark, folder).select("uid", F.lower("content").alias("low"))
    return rows.select(
        "uid", kw.keyword_count(F.col("low"), CHECK.spam_keywords).alias("spam_keywords"),
        kw.keyword_count(F.col("low"), CHECK.ham_keywords).alias("ham_keywords"))


@query
def phishing_words_listed(spark, folder):
    """Phishing keywords that each message holds, and the names that its URLs' hosts mimic."""
    rows = v.messages(spark, folder).select(
        "uid", kw.held_keywords(F.lower("content"), CHECK.phishing_keywords).alias("words"))
    return rows.select("uid", F.size("words").alias("points"), joined(F.col("words")).alias("words"))


@query
def mimicked_names(spark, folder):
    hosts = us.with_url_parts(v.probe_urls(spark, folder))
    return hosts.select("url", joined(kw.mimicked_names(F.col("host"), CHECK.trusted_names)).alias("names"))


@query
def suspicious_patterns(spark, folder):
    rows = v.messages(spark, folder).select("uid", "content", F.lower("content").alias("low"))
    score = rules.suspicious_score("content", "low", CHECK)
    return rows.select("uid", score.alias("score"))


@query
def unsubscribe_patterns(spark, folder):
    rows = v.messages(spark, folder).select("uid", F.lower("content").alias("low"))
    return rows.select("uid", rules.opt_out_score("low", CHECK).alias("score"))


@query
def has_unsubscribe(spark, folder):
    rows = rules.with_lowered(v.messages(spark, folder), "content")
    offer = rules.offers_unsubscribe("_low", "list_unsubscribe", CHECK)
    return rows.select("uid", offer.alias("has_unsubscribe"))


@query
def sender_reputation(spark, folder):
    rows = v.messages(spark, folder)
    return rows.select("uid", "sender", rules.sender_score("sender", CHECK).alias("score"))


@query
def rule_score(spark, folder):
    scored = rules.score_rules(v.messages(spark, folder), "content", "sender", CHECK)
    return scored.select(
        "uid", "rule_is_spam", "rule_confidence", "rule_score", "spam_keywords", "ham_keywords",
        "suspicious_patterns", "unsubscribe_patterns", "sender_reputation", "text_length")


@query
def spam_gate(spark, folder):
    predicted = rules.predict_by_rules(v.messages(spark, folder), "content", CHECK)
    return rules.score_messages(predicted, "content", CHECK).select(
        "uid", "text_preview", "prediction", "confidence", "is_spam", "threshold")


@query
def check_texts(spark, folder):
    turns = v.table(spark, folder, "conversations")
    checked = reports.check_texts(turns, "text", None, CHECK)
    return checked.select("conv_id", "turn", "text_preview", "prediction", "confidence", "is_spam")


@query
def normalise_text(spark, folder):
    docs = normalise.normalise(v.table(spark, folder, "documents"), "text", "processed_text", CHECK)
    return docs.select("doc_id", "processed_text")


@query
def normalise_tokens(spark, folder):
    docs = normalise.with_tokens(v.messages(spark, folder), "content", CHECK)
    return docs.select("uid", F.array_join("tokens", " ").alias("tokens"))


# -- URLs ------------------------------------------------------------------

@query
def extract_urls(spark, folder):
    found = us.explode_urls(us.with_urls(v.messages(spark, folder)))
    return found.where(F.col("url").isNotNull())


@query
def distinct_urls(spark, folder):
    return us.distinct_urls(us.explode_urls(us.with_urls(v.messages(spark, folder))))


@query
def url_parts(spark, folder):
    urls = v.probe_urls(spark, folder).unionByName(v.bracket_urls(spark, folder))
    return us.with_url_parts(urls).select("url", "scheme", "netloc", "host", "path", "query", "fragment", "malformed")


@query
def url_structure(spark, folder):
    scored = us.score_structure(us.with_url_parts(v.probe_urls(spark, folder)), CHECK)
    return scored.select(
        "url", F.col("structure_score").alias("score"), joined(F.col("structure_flags")).alias("flags"))


@query
def url_phishing(spark, folder):
    rows = us.with_urls(rules.with_lowered(v.messages(spark, folder), "content")).select(
        "uid", "urls", us.content_points("_low", CHECK).alias("points"),
        us.content_indicators("_low", CHECK).alias("signs"))
    found = us.explode_urls(rows, keep=("points", "signs")).where(F.col("url").isNotNull())
    scored = us.score_phishing(us.with_url_parts(found), CHECK, "points", "signs")
    return scored.select(
        "uid", "url", F.col("phishing_score").alias("score"), F.col("phishing_level").alias("level"),
        joined(F.col("phishing_indicators")).alias("indicators"))


@query
def url_phishing_probe(spark, folder):
    scored = us.score_phishing(us.with_url_parts(v.probe_urls(spark, folder)), CHECK)
    return scored.select(
        "url", F.col("phishing_score").alias("score"), F.col("phishing_level").alias("level"),
        joined(F.col("phishing_indicators")).alias("indicators"))


@query
def typosquat(spark, folder):
    parts = us.with_url_parts(v.page_urls(spark, folder))
    hits = tx.names_of((us.typosquat("host", p), p) for p in CHECK.popular_hosts)
    return parts.select("url", "host", joined(hits).alias("targets"))


@query
def near_hosts(spark, folder):
    """Hosts of all probed URLs that are near misses of hosts in a table: the pages' own and the popular ones."""
    split = us.with_url_parts(v.probe_urls(spark, folder))
    # Not a filter: that would be pushed down and split every URL once more for each time it reads the parts.
    found = split.select(F.explode(F.when(~F.col("malformed"), F.array("host"))).alias("host"))
    known = us.with_url_parts(v.page_urls(spark, folder)).select(F.col("host").alias("target"))
    popular = spark.createDataFrame([(p,) for p in CHECK.popular_hosts], known.schema)
    return host_lists.near_hosts(found, known.unionByName(popular))


@query
def near_targets(spark, folder):
    """The default list of popular hosts as a table: the same rows as ``typosquat``."""
    parts = us.with_url_parts(v.page_urls(spark, folder))
    popular = spark.createDataFrame([(p,) for p in CHECK.popular_hosts], "target string")
    found = host_lists.with_near_targets(parts, popular)
    return found.select("url", "host", joined(F.col("near_targets")).alias("targets"))


@query
def host_suffixes(spark, folder):
    """The longest listed suffix of every probed host; listed are the pages' parent hosts, with their pages, and the default ones."""
    found = us.with_url_parts(v.probe_urls(spark, folder)).select("url", "host")
    parent = F.regexp_extract("host", r"\A[^.]*\.(.+)\z", 1)
    parents = us.with_url_parts(v.page_urls(spark, folder)).select(parent.alias("suffix")).where("suffix <> ''")
    counted = parents.groupBy("suffix").agg(F.count(F.lit(1)).alias("pages"))
    default = spark.createDataFrame([(t, 0) for t in CHECK.suspicious_tlds], "suffix string, pages long")
    return host_lists.with_longest_suffix(found, counted.unionByName(default))


@query
def redirect_chains(spark, folder):
    chains = redirects.follow_redirects(
        us.distinct_urls(v.page_urls(spark, folder)), v.redirect_hops(spark, folder), CHECK)
    return redirects.chain_steps(chains)


@query
def redirect_flags(spark, folder):
    chains = redirects.follow_redirects(
        us.distinct_urls(v.page_urls(spark, folder)), v.redirect_hops(spark, folder), CHECK)
    return redirects.score_redirects(chains).select(
        "url", "final_url", "redirect_count", F.col("redirect_score").alias("score"),
        joined(F.col("redirect_flags")).alias("flags"), F.col("redirect_level").alias("level"))


@query
def resolve_locations(spark, folder):
    hops = v.redirect_hops(spark, folder).where(F.col("location").isNotNull())
    return hops.select(
        "url", "location", ux.resolve_location(F.col("url"), F.col("location")).alias("target"))


@query
def intel_risk(spark, folder):
    urls = us.distinct_urls(v.page_urls(spark, folder))
    rows = intel.attach_intel(urls, v.intel_reports(spark, folder))
    return rows.select(
        "url", "intel_status", "positives", "total", "intel_risk", "intel_level",
        sorted_text(F.col("detected_engines")).alias("detected_engines"),
        sorted_text(F.col("clean_engines")).alias("clean_engines"))


@query
def url_risk(spark, folder):
    urls = us.distinct_urls(v.page_urls(spark, folder)).withColumn("uid", F.col("url"))
    found = risk.url_reports(
        urls, v.redirect_hops(spark, folder), v.intel_reports(spark, folder), CHECK)
    scored = risk.score_urls(urls, found, CHECK)
    return scored.select(
        "url", "structure_score", "phishing_score", "redirect_score", "intel_risk", "intel_status",
        "overall_risk_score", "overall_risk_level")


@query
def recommendations(spark, folder):
    urls = us.distinct_urls(v.probe_urls(spark, folder)).withColumn("uid", F.col("url"))
    scored = risk.score_urls(urls, None, CHECK)
    return scored.select(
        "url", "overall_risk_level", joined(F.col("recommendations")).alias("recommendations"))


@query
def url_report(spark, folder):
    rows = reports.analyse_urls(v.probe_urls(spark, folder), None, None, CHECK)
    return rows.withColumn("recommendations", joined(F.col("recommendations")))


@query
def url_report_joined(spark, folder):
    """The reports with redirects and threat intelligence."""
    rows = reports.analyse_urls(
        v.page_urls(spark, folder), v.redirect_hops(spark, folder), v.intel_reports(spark, folder), CHECK)
    return rows.withColumn("recommendations", joined(F.col("recommendations")))


@query
def url_verdict(spark, folder):
    """Full verdicts with every lookup, their nested parts side by side."""
    rows = reports.url_verdicts(
        v.page_urls(spark, folder), v.redirect_hops(spark, folder), v.intel_reports(spark, folder), CHECK)
    part = lambda column, field, name: F.col(f"{column}.{field}").alias(name)
    return rows.select(
        "url", part("structure_analysis", "domain", "domain"), part("structure_analysis", "suspicious_score", "structure_score"),
        joined(F.col("structure_analysis.flags")).alias("structure_flags"),
        part("phishing_check", "phishing_score", "phishing_score"), part("phishing_check", "risk_level", "phishing_level"),
        joined(F.col("phishing_check.indicators")).alias("phishing_indicators"),
        part("redirect_analysis", "redirect_count", "redirect_count"), part("redirect_analysis", "score", "redirect_score"),
        joined(F.col("redirect_analysis.redirect_flags")).alias("redirect_flags"),
        part("redirect_analysis", "final_url", "final_url"), part("threat_intel", "status", "intel_status"),
        part("threat_intel", "risk_score", "intel_risk"), "overall_risk_score", "overall_risk_level",
        joined(F.col("recommendations")).alias("recommendations"))


@query
def message_url_summary(spark, folder):
    return _summary_text(risk.summarise_messages(v.messages(spark, folder), params=CHECK))


@query
def message_url_summary_joined(spark, folder):
    facts = stored(risk.url_facts(v.messages(spark, folder), "content", CHECK), "facts")
    reports = stored(risk.url_reports(
        us.distinct_urls(us.explode_urls(facts)), v.redirect_hops(spark, folder),
        v.intel_reports(spark, folder), CHECK), "reports")
    return _summary_text(risk.summarise_urls(facts, reports, CHECK))


@query
def message_analyses(spark, folder):
    """The list of verdicts of every message, opened up again, with every lookup."""
    messages = v.messages(spark, folder)
    urls = us.distinct_urls(us.explode_urls(us.with_urls(messages)))
    found = stored(risk.url_reports(urls, v.redirect_hops(spark, folder), v.intel_reports(spark, folder), CHECK), "reports")
    rows = risk.analyse_messages(messages, found, CHECK).select("uid", F.posexplode("analyses").alias("pos", "a"))
    return rows.select(
        "uid", "pos", "a.url", F.col("a.structure_analysis.suspicious_score").alias("structure_score"),
        joined(F.col("a.structure_analysis.flags")).alias("structure_flags"), "a.phishing_check.phishing_score",
        joined(F.col("a.phishing_check.indicators")).alias("phishing_indicators"), "a.redirect_analysis.redirect_count",
        joined(F.col("a.redirect_analysis.redirect_flags")).alias("redirect_flags"), "a.redirect_analysis.final_url",
        F.col("a.threat_intel.status").alias("intel_status"), F.round("a.threat_intel.risk_score", 6).alias("intel_risk"),
        F.round("a.overall_risk_score", 6).alias("overall_risk_score"), "a.overall_risk_level",
        joined(F.col("a.recommendations")).alias("recommendations"))


def _summary_text(rows: DataFrame) -> DataFrame:
    return rows.select(
        "uid", "urls_found", F.round("max_risk_score", 6).alias("max_risk_score"),
        F.round("average_risk_score", 6).alias("average_risk_score"), "highest_risk_level",
        sorted_text(F.col("high_risk_urls")).alias("high_risk_urls"), "summary")


# -- unsubscribe -----------------------------------------------------------

def _offered(spark, folder) -> DataFrame:
    rows = us.with_urls(rules.with_lowered(v.messages(spark, folder), "content")).withColumn(
        "has_unsubscribe", rules.offers_unsubscribe("_low", "list_unsubscribe", CHECK))
    return unsubscribe.with_candidates(rows, CHECK).select("uid", "has_unsubscribe", "candidates")


@query
def unsubscribe_urls(spark, folder):
    return unsubscribe.explode_candidates(_offered(spark, folder)).where(
        F.col("url").isNotNull()).select("uid", "url")


@query
def unsubscribe_plan(spark, folder):
    offered = stored(_offered(spark, folder), "offered")
    judged = unsubscribe.judge_candidates(offered, v.outcomes(spark, folder), None, CHECK)
    return unsubscribe.plan_results(judged, offered)


@query
def unsubscribe_log(spark, folder):
    judged = unsubscribe.judge_candidates(
        _offered(spark, folder), v.outcomes(spark, folder), None, CHECK)
    return judged.where(F.col("url").isNotNull()).select(
        "uid", "pos", "url", "success", "reason", "error_message")


# -- batches and history ---------------------------------------------------

@query
def recent_batch(spark, folder):
    return history.recent_batch(v.mailbox(spark, folder), AS_OF, CHECK).select("uid", "seq")


@query
def recent_batch_per_mailbox(spark, folder):
    small = replace(CHECK, batch_size=5)
    rows = history.recent_batch(v.mailbox(spark, folder), AS_OF, small, per="mailbox")
    return rows.select("mailbox", "uid", "seq")


@query
def unprocessed(spark, folder):
    known = v.processed(spark, folder).where("is_spam")
    return history.unprocessed(v.mailbox(spark, folder), known).select("uid", "seq")


@query
def upsert_history(spark, folder):
    """History keyed by sender and type, updated by the events of the last ten days."""
    keyed = v.processed(spark, folder).withColumn("uid", F.concat_ws("/", "sender", "subject"))
    cut = F.lit("2024-01-20").cast("timestamp")
    merged = history.upsert(
        history.latest(keyed.where(F.col("processed_date") < cut), "uid", ("processed_date",)),
        keyed.where(F.col("processed_date") >= cut))
    return merged.select(
        "uid", F.date_format("processed_date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("processed_date"),
        "is_spam", "spam_confidence", "url_count")


def _dated_batches(spark, folder, rows: DataFrame, daily: bool = False) -> HistoryStore:
    """A store with the rows in three batches by date, the first two merged before the third came."""
    store = HistoryStore(spark, shared_folder(spark, "history"), daily=daily)
    days = [F.lit(d).cast("timestamp") for d in ("2024-01-10", "2024-01-20")]
    when = F.col("processed_date")
    for number, chosen in enumerate((when < days[0], (when >= days[0]) & (when < days[1]), when >= days[1])):
        store.write("processed_emails", history.latest(rows.where(chosen), "uid", ("processed_date",)), number)
        if number == 1:
            store.compact(1)
    return store


@query
def unprocessed_indexed(spark, folder):
    """As above, with the history in a store: its merged uids and those of the last batch are looked up by bucket."""
    store = _dated_batches(spark, folder, v.processed(spark, folder).where("is_spam"))
    batch = v.mailbox(spark, folder)
    return history.unprocessed(batch, store.known_among(batch)).select("uid", "seq")


@query
def upsert_history_compacted(spark, folder):
    """History keyed by sender and type, read from a base of two batches and a newer one."""
    keyed = v.processed(spark, folder).withColumn("uid", F.concat_ws("/", "sender", "subject"))
    return _dated_batches(spark, folder, keyed).processed().select(
        "uid", F.date_format("processed_date", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("processed_date"),
        "is_spam", "spam_confidence", "url_count")


@query
def message_attempts(spark, folder):
    rows = history.with_attempts(v.processed(spark, folder), v.attempts(spark, folder))
    return rows.select("uid", "sender", "is_spam", "unsubscribe_url", "success")


@query
def history_stats(spark, folder):
    return _rounded_stats(stats.history_stats(v.processed(spark, folder), v.sessions(spark, folder), AS_OF, 20))


@query
def history_stats_daily(spark, folder):
    """As above from the daily sums of a store: a base of two batches, one more, and a last one that holds their spam again."""
    rows = v.processed(spark, folder)
    store = _dated_batches(spark, folder, rows, daily=True)
    store.write("processed_emails", rows.where("is_spam"), 3)
    sums = store.message_sums(AS_OF - timedelta(days=20))
    return _rounded_stats(stats.history_stats_of_sums(sums, v.sessions(spark, folder), AS_OF, 20))


def _rounded_stats(rows: DataFrame) -> DataFrame:
    rounded = ("average_spam_confidence", "average_processing_time", "spam_percentage",
               "unsubscribe_success_rate")
    return rows.select(*[
        F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in rows.columns])


@query
def batch_stats(spark, folder):
    done = v.processed(spark, folder)
    batch = v.mailbox(spark, folder)
    failed = batch.where(F.col("seq") % 100 == 99)
    counted = stats.batch_stats(
        batch, history.unprocessed(done, failed).where(F.col("has_unsubscribe")), failed)
    rated = stats.run_rates(counted)
    return rated.withColumns({c: F.round(c, 6) for c in ("spam_rate", "success_rate")})


# -- models ----------------------------------------------------------------

@query
def label_balance(spark, folder):
    rows = labelled.class_balance(v.labelled_texts(spark, folder))
    return rows.withColumn("spam_ratio", F.round("spam_ratio", 9))


@query
def csv_labels(spark, folder):
    """Labelled documents written as CSV and read back as a training set."""
    path = shared_folder(spark, "labelled-csv")
    rows = v.labelled_texts(spark, folder)
    label = F.when(F.col("doc_id") % 20 == 9, "junk").when(F.col("doc_id") % 20 == 19, "1").when(F.col("label") == 1, "spam").otherwise("ham")
    text = F.when(F.col("doc_id") % 10 != 8, F.col("text"))
    rows.select(label.alias("v1"), text.alias("v2"), F.col("doc_id").alias("note")).write.csv(
        path, header=True, quote='"', escape='"', quoteAll=True)
    loaded = labelled_csv.load_labelled(spark, path)
    return loaded.select(
        F.col("note").cast("bigint").alias("doc_id"), "label", F.length("text").alias("n_chars"))


@query
def stratified_split(spark, folder):
    split = labelled.stratified_split(v.labelled_texts(spark, folder), "doc_id", "label", CHECK)
    return split.select("doc_id", "label", "is_test")


@query
def tfidf_idf(spark, folder):
    docs = normalise.with_tokens(v.table(spark, folder, "documents"), "text", CHECK)
    words = docs.select(tfidf.words(F.array_join("tokens", " ")).alias("words"))
    return tfidf.vocabulary(words, params=CHECK, words_col="words").withColumn("idf", F.round("idf", 9))


def _stemmed_terms(spark, folder) -> DataFrame:
    """doc_id, words and terms of all documents; the words are stored for the several passes over them."""
    docs = normalise.normalise(v.table(spark, folder, "documents"), "text", "processed_text", CHECK)
    words = stored(docs.select("doc_id", tfidf.words(F.col("processed_text")).alias("words")), "words")
    return words.withColumn("terms", tfidf.with_pairs(F.col("words")))


@query
def tfidf_vectors(spark, folder):
    """The weighted, normalised terms of every stemmed document, one row each."""
    docs = _stemmed_terms(spark, folder)
    known = stored(tfidf.vocabulary(docs, "terms", CHECK, "words"), "vocabulary")
    rows = tfidf.vectors(docs, known, "doc_id", params=CHECK, words_col="words")
    return rows.select("doc_id", F.explode("vector").alias("t")).select(
        "doc_id", "t.term", F.round("t.weight", 9).alias("weight"))


@query
def naive_bayes_scores(spark, folder):
    """Counted on the train part in two halves, which are merged; scores of every document."""
    docs = _stemmed_terms(spark, folder)
    split = labelled.stratified_split(v.labelled_texts(spark, folder).select("doc_id", "label"), "doc_id", "label", CHECK)
    labels = stored(split.where("not is_test").select("doc_id", "label"), "labels")
    trained = stored(docs.select("doc_id", "words").join(labels, "doc_id"), "trained")
    known = stored(tfidf.vocabulary(trained, params=CHECK, words_col="words"), "vocabulary")
    vectors = stored(tfidf.vectors(docs, known, "doc_id", params=CHECK, words_col="words"), "vectors")
    taught = stored(vectors.join(labels, "doc_id"), "taught")
    halves = [naive_bayes.partial_sums(taught.where(F.col("doc_id") % 2 == i)) for i in (0, 1)]
    odds = stored(naive_bayes.log_odds(stored(naive_bayes.merged(*halves), "sums"), known, CHECK.smoothing_alone), "odds")
    return naive_bayes.scores(vectors, odds, "doc_id", params=CHECK).select(
        "doc_id", F.round("p_spam", 6).alias("p_spam"), "prediction", F.round("confidence", 6).alias("confidence"))


@query
def soft_vote(spark, folder):
    rows = v.model_scores(spark, folder)
    prediction, confidence = voting.soft_vote({n: F.col(n) for n in voting.ENSEMBLE_WEIGHTS})
    return rows.select(
        "doc_id", prediction.alias("prediction"), F.round(confidence, 9).alias("confidence"))


@query
def weighted_vote(spark, folder):
    return _weighted(spark, folder).select(
        "doc_id", "prediction", F.round("confidence", 9).alias("confidence"))


def _weighted(spark, folder) -> DataFrame:
    rows = v.model_scores(spark, folder)
    prediction, confidence = voting.weighted_vote({n: F.col(n) for n in voting.ENSEMBLE_WEIGHTS})
    return rows.withColumns({"prediction": prediction, "confidence": confidence})


@query
def decision_vote(spark, folder):
    rows = v.model_scores(spark, folder)
    prediction, confidence = voting.decision_vote(F.col("naive_bayes") * 4 - 2)
    return rows.select("doc_id", prediction.alias("prediction"), confidence.alias("confidence"))


@query
def confusion_matrix(spark, folder):
    return evaluation.confusion(_weighted(spark, folder).where("prediction is not null"))


@query
def classification_report(spark, folder):
    pairs = evaluation.confusion(_weighted(spark, folder).where("prediction is not null"))
    rows = evaluation.classification_report(pairs)
    return rows.select("row", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def _train(spark, folder, kind: str) -> DataFrame:
    _, report = train.train_and_evaluate(v.labelled_texts(spark, folder), "doc_id", kind)
    return report


@query
def train_ensemble(spark, folder):
    return _train(spark, folder, "ensemble")


@query
def train_naive_bayes(spark, folder):
    return _train(spark, folder, "naive_bayes")


@query
def train_logistic_regression(spark, folder):
    return _train(spark, folder, "logistic_regression")


@query
def train_random_forest(spark, folder):
    return _train(spark, folder, "random_forest")


@query
def predict_saved_model(spark, folder):
    """Train, save, load, and predict every document with the loaded model."""
    path = shared_folder(spark, "spam-model")
    train.train_and_evaluate(v.labelled_texts(spark, folder), "doc_id", "naive_bayes", save_to=path)
    docs = v.table(spark, folder, "documents").select("doc_id", "text")
    predicted = spam_model.predict(docs, spam_model.load(path), "text")
    return predicted.select("doc_id", "prediction", F.round("confidence", 6).alias("confidence"))


# -- ingest, jobs and streams ----------------------------------------------

def _raw_mail(spark, folder) -> DataFrame:
    """Documents and pages as RFC 822 bytes."""
    doc, page = v.table(spark, folder, "documents"), v.table(spark, folder, "pages")
    header = lambda *lines: F.concat_ws("\r\n", *lines)
    lit, text = F.lit, lambda c: F.col(c).cast("string")
    plain = F.concat(
        header(F.concat(lit("From: "), "source", lit("@example.org")),
               F.concat(lit("Subject: =?utf-8?b?"), F.base64(F.encode("lang", "utf-8")), lit("?= mail")),
               lit("Date: Fri, 05 Jan 2024 10:00:00 +0200"),
               lit("Content-Type: text/plain; charset=utf-8"), lit("")),
        lit("\r\n"), "text")
    multi = F.concat(
        header(lit("From: news@example.org"), lit("Subject: page"), lit("Date: no date"),
               F.concat(lit("List-Unsubscribe: <"), "url", lit(">")),
               lit('Content-Type: multipart/mixed; boundary="cut-here"'), lit(""),
               lit("--cut-here"), lit("Content-Type: text/html"), lit("Content-Transfer-Encoding: base64"),
               lit("")),
        lit("\r\n"), F.base64(F.encode("html", "utf-8")),
        header(lit(""), lit("--cut-here"), lit("Content-Type: text/plain"),
               lit("Content-Disposition: attachment"), lit(""), lit("not this"), lit("--cut-here--"), lit("")))
    named = lambda rows, prefix, key, bytes_: rows.select(
        F.concat(lit(f"mem:/{prefix}"), text(key), lit(".eml")).alias("path"),
        lit(AS_OF).cast("timestamp").alias("modificationTime"),
        F.length(F.encode(bytes_, "utf-8")).cast("bigint").alias("length"),
        F.encode(bytes_, "utf-8").alias("content"))
    return named(doc, "d", "doc_id", plain).unionByName(named(page, "p", "page_id", multi))


@query
def ingest_eml(spark, folder):
    rows = mail.parse_mail(_raw_mail(spark, folder))
    return rows.select(
        "uid", "sender", "subject", F.md5("content").alias("content_md5"),
        F.date_format("received_date", "yyyy-MM-dd HH:mm:ss").alias("received_date"),
        "list_unsubscribe", "error")


@query
def process_batch(spark, folder):
    """One batch over all messages with every lookup table, as written to the history."""
    store = HistoryStore(spark, shared_folder(spark, "history"))
    tables = process.Tables(
        v.redirect_hops(spark, folder), v.intel_reports(spark, folder), v.outcomes(spark, folder))
    process.run_batch(v.messages(spark, folder), store, 0, AS_OF, tables, None, CHECK)
    return store.processed().select(
        "uid", "is_spam", "spam_confidence", "has_unsubscribe", "unsubscribe_attempted",
        "unsubscribe_successful", "url_count", "high_risk_urls")


@query
def process_batch_model(spark, folder):
    """A batch of all messages judged by a saved and loaded ensemble: its members' probabilities, its votes, the history."""
    path = shared_folder(spark, "spam-model")
    train.train_and_evaluate(v.labelled_texts(spark, folder), "doc_id", "ensemble", CHECK, save_to=path)
    store = HistoryStore(spark, shared_folder(spark, "history"))
    process.run_batch(v.messages(spark, folder), store, 0, AS_OF, process.Tables(), spam_model.load(path), CHECK)
    member = lambda name: F.max(F.when(F.col("member") == name, F.col("p_spam")))
    said = store.scores().groupBy("uid").agg(
        *[F.round(member(n), 6).alias(f"p_{n}") for n in voting.ENSEMBLE_WEIGHTS],
        F.first("prediction").alias("prediction"), F.round(F.first("confidence"), 6).alias("confidence"))
    return store.processed().select("uid", "is_spam", "has_unsubscribe", "url_count", "high_risk_urls").join(said, "uid")


def _repeated_batch(spark, folder) -> HistoryStore:
    """The store after one whole batch that ran on two days; the second run replaced the first."""
    store = HistoryStore(spark, shared_folder(spark, "history"))
    tables = process.Tables(
        v.redirect_hops(spark, folder), v.intel_reports(spark, folder), v.outcomes(spark, folder))
    for day in (AS_OF, AS_OF + timedelta(days=1)):
        process.run_batch(v.messages(spark, folder), store, 0, day, tables, None, CHECK)
    return store


@query
def stored_attempts(spark, folder):
    return _repeated_batch(spark, folder).attempts().drop("attempt_date")


@query
def stored_sessions(spark, folder):
    return _repeated_batch(spark, folder).sessions().drop("session_date", "processing_time", "batch_id")


@query
def stream_history(spark, folder):
    """All messages through the stream, written once more as repeats; equals one batch."""
    root = shared_folder(spark, "stream")
    v.messages(spark, folder).write.parquet(f"{root}/landing")
    v.messages(spark, folder).write.mode("append").parquet(f"{root}/landing")
    landing = spark.readStream.schema(v.messages(spark, folder).schema).option(
        "maxFilesPerTrigger", 8).parquet(f"{root}/landing")
    store = HistoryStore(spark, f"{root}/history")
    running = monitor(landing, store, f"{root}/checkpoint", None, None, None, CHECK, lambda: AS_OF)
    running.awaitTermination()
    return store.processed().select(
        "uid", "is_spam", "spam_confidence", "has_unsubscribe", "url_count", "high_risk_urls")
