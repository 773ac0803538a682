"""The registered queries: one per operator group of the inventory.

Each query takes ``(spark, sf_dir)``, reads the driver tables and returns a
DataFrame whose column names match the oracle SQL in ``oracle.py``.  Operators
that fit something (label maps, splits, ranks, IDF, naive Bayes) run jobs while
the query is built; the rest is lazy.
Floating results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.functions.text import join_columns
from lexiframe.operators import features as feat
from lexiframe.operators.epochs import place_in_epoch
from lexiframe.operators import labels as lab
from lexiframe.operators import metrics as met
from lexiframe.operators import naive_bayes as nb
from lexiframe.operators import ranking as rk
from lexiframe.operators import tables as tab
from lexiframe.session import scratch_path
from lexiframe.sources.positions import PositionIndex
from lexiframe.plans.common import (SEED, TEST_SIZE, VAL_SIZE, SplitFeatures, doc_split, documents,
                                    quote_table, table)

R = 6  # digits kept for floating results


# --------------------------------------------------------------------------
# Step 1: tables and labels
# --------------------------------------------------------------------------

def class_sizes(spark: SparkSession, d: str) -> DataFrame:
    return tab.class_sizes(documents(spark, d), "lang")


def min_class_size(spark: SparkSession, d: str) -> DataFrame:
    return rk.min_class_size(documents(spark, d), "lang")


def label_map_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return lab.fit_label_map(documents(spark, d), "lang", pos="doc_id", order="first_seen")


def encode_decode(spark: SparkSession, d: str) -> DataFrame:
    """Map fit once on the training split, applied to every document and decoded back."""
    split = doc_split(spark, d)
    lm = lab.fit_label_map(split.filter(F.col("split") == "train"), "label", pos="doc_id")
    docs = documents(spark, d).select("doc_id", "lang")
    enc = lab.encode_labels(docs, lm, label="lang", out="label_id")
    return lab.decode_labels(enc, lm, id_col="label_id", out="decoded")


def encode_fixed_map(spark: SparkSession, d: str) -> DataFrame:
    """A fixed map instead of a learned one; labels outside it are an error."""
    lm = lab.fixed_label_map(spark, {"en": 0, "de": 1, "fr": 2, "es": 3})
    return lab.encode_labels(documents(spark, d).select("doc_id", "lang"), lm, label="lang", out="label_id")


def split_null_label(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their quality label where there is one: documents
    without are a stratum of their own, split like any other."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = documents(spark, d).select("doc_id").join(labels, "doc_id", "left")
    return rk.stratified_split(docs, "doc_id", "label", SEED, TEST_SIZE, VAL_SIZE)


def nb_confusion_classes(spark: SparkSession, d: str) -> DataFrame:
    """Confusion over configured classes, one of which never occurs."""
    return met.confusion_long(_nb_fit_predict(spark, d)[1], "label", "prediction", labels=["de", "en", "es", "fr", "other"])


def filter_isin(spark: SparkSession, d: str) -> DataFrame:
    return tab.filter_isin(documents(spark, d), "lang", ["en", "fr"]).select("doc_id", "lang", "source")


def dropna_project(spark: SparkSession, d: str) -> DataFrame:
    """Cut to the first 7 columns, drop rows with any NULL, keep text+key."""
    wide = tab.drop_columns(quote_table(spark, d), from_position=7)
    out = tab.dropna_then_project(wide, wide.columns, ["conv_id", "quote_1"])
    return tab.rename(out, {"quote_1": "text"})


def fillna_concat(spark: SparkSession, d: str) -> DataFrame:
    """Fill NULL quotes with '' and join the ten quotes with a space."""
    wide = tab.fill_empty(quote_table(spark, d), "")
    quotes = [f"quote_{i}" for i in range(1, 11)]
    return tab.concat_columns(wide, quotes, "text", " ").select("conv_id", "text")


def rename_drop(spark: SparkSession, d: str) -> DataFrame:
    nation = tab.drop_columns(table(spark, d, "nation"), ["n_regionkey"])
    return tab.rename(nation, {"n_nationkey": "id", "n_name": "name"})


def cast_concat_sep(spark: SparkSession, d: str) -> DataFrame:
    """LIAR-style text: metadata columns cast to string and joined with ' [SEP] ',
    missing values printed as 'nan'."""
    conv = table(spark, d, "conversations")
    docs = documents(spark, d).select("doc_id", "text", "lang", "source", "n_chars")
    first_turn = conv.filter(F.col("turn") == 0).select(F.col("conv_id").alias("doc_id"), F.col("role"))
    joined = tab.attach_by_key(docs, first_turn, "doc_id", ["role"])
    cols = ["text", "source", "role", "n_chars"]
    return joined.select("doc_id", F.col("lang").alias("label"), join_columns(cols, " [SEP] ", "nan").alias("text"))


def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text", "lang")
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return tab.union_by_name(docs, bench)


# --------------------------------------------------------------------------
# Step 2: ranking, sampling, splits
# --------------------------------------------------------------------------

def head_per_label(spark: SparkSession, d: str) -> DataFrame:
    out = rk.head_per_label(documents(spark, d), "lang", "doc_id", k=20)
    return out.select("lang", "doc_id", F.col("rank_in_label").cast("int").alias("rank_in_label"))


def row_at(spark: SparkSession, d: str) -> DataFrame:
    fr = tab.filter_equals(documents(spark, d), "lang", "fr")
    return rk.row_at(fr, "doc_id", 30).select("doc_id", "lang", "text")


def row_by_position(spark: SparkSession, d: str) -> DataFrame:
    """A slice of the whole table by position, read from the files that hold it."""
    index = PositionIndex.build(spark, f"{d.rstrip('/')}/documents.parquet")
    return index.rows_between(100, 132).select("pos", "doc_id", "lang", "text")


def epoch_orders(spark: SparkSession, d: str) -> DataFrame:
    """Batches of two epochs of the documents, each row's place from its position alone."""
    index = PositionIndex.build(spark, f"{d.rstrip('/')}/documents.parquet")
    rows = index.with_positions("pos").select("pos", "doc_id").withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    place = place_in_epoch(F.col("pos"), index.rows, F.col("epoch"), SEED)
    return rows.withColumn("place", place).select("epoch", "doc_id", "place", F.floor(F.col("place") / 8).cast("bigint").alias("batch_id"))


def first_n(spark: SparkSession, d: str) -> DataFrame:
    return rk.first_n(documents(spark, d).select("doc_id", "text"), "doc_id", 8)


def shuffle(spark: SparkSession, d: str) -> DataFrame:
    return rk.seeded_shuffle(documents(spark, d).select("doc_id"), "doc_id", SEED)


def split_two_way(spark: SparkSession, d: str) -> DataFrame:
    return rk.split_two_way(documents(spark, d).select("doc_id"), "doc_id", SEED, train_size=0.7)


def split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return doc_split(spark, d)


def downsample_balanced(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", F.col("lang").alias("label"))
    return rk.balanced_downsample(docs, "doc_id", "label", SEED)


def split_balanced(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", F.col("lang").alias("label"))
    return rk.balanced_split(docs, "doc_id", "label", SEED, TEST_SIZE, VAL_SIZE)


def stage_rows(spark: SparkSession, d: str) -> DataFrame:
    return rk.select_stage(doc_split(spark, d), "fit")


# --------------------------------------------------------------------------
# Step 3: tokens and bag-of-words features
# --------------------------------------------------------------------------

def mean_word_count(spark: SparkSession, d: str) -> DataFrame:
    out = feat.mean_word_count(documents(spark, d))
    return out.select(F.round("mean_words", R).alias("mean_words"), "n_rows")


def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    return feat.token_count(documents(spark, d), "doc_id")


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return feat.term_counts(documents(spark, d), "doc_id")


def vocab(spark: SparkSession, d: str) -> DataFrame:
    sf = SplitFeatures(spark, d)
    return feat.vocabulary(sf.tc("train"), "doc_id", with_ids=True)


def known_terms(spark: SparkSession, d: str) -> DataFrame:
    sf = SplitFeatures(spark, d)
    v = feat.vocabulary(sf.tc("train"), "doc_id")
    return feat.known_terms(sf.tc("test"), v)


def _train_idf(sf: SplitFeatures):
    return feat.idf_table(sf.docs_of("train"))


def tfidf(spark: SparkSession, d: str) -> DataFrame:
    sf = SplitFeatures(spark, d)
    w = feat.tfidf(sf.tc("test"), _train_idf(sf), "doc_id")
    return w.select("doc_id", "token", F.round("weight", R).alias("weight"))


# --------------------------------------------------------------------------
# Step 4: naive Bayes and evaluation
# --------------------------------------------------------------------------

def _nb_fit(sf: SplitFeatures, weights: str = "tf"):
    """The model and what its prediction needs: test features and the value column."""
    if weights == "tf":
        train_x, test_x, value = feat.occurrences(sf.docs_of("train"), ["label"]), feat.occurrences(sf.docs_of("test"), ["doc_id"]), "tf"
    else:
        idf = _train_idf(sf)
        train_x = feat.tfidf(sf.tc("train", with_label=True, gathered=True), idf, "doc_id")
        test_x = feat.tfidf(sf.tc("test", gathered=True), idf, "doc_id")
        value = "weight"
    return nb.fit_naive_bayes(train_x, sf.labels_of("train"), "doc_id", "label", value=value), test_x, value


def _nb_fit_predict(spark: SparkSession, d: str, weights: str = "tf"):
    sf = SplitFeatures(spark, d)
    model, test_x, value = _nb_fit(sf, weights)
    return model, nb.predict_naive_bayes(model, test_x, sf.labels_of("test"), "doc_id", value=value)


def nb_model(spark: SparkSession, d: str) -> DataFrame:
    model, _, _ = _nb_fit(SplitFeatures(spark, d))
    return model.classes.select("label", "class_index", "n_docs", F.round("log_prior", R).alias("log_prior"),
                                F.round("base_rate", R).alias("base_rate"))


def nb_predict(spark: SparkSession, d: str) -> DataFrame:
    return _nb_fit_predict(spark, d)[1].select("doc_id", "label", "prediction")


def nb_tfidf_predict(spark: SparkSession, d: str) -> DataFrame:
    return _nb_fit_predict(spark, d, weights="tfidf")[1].select("doc_id", "label", "prediction")


def nb_confusion(spark: SparkSession, d: str) -> DataFrame:
    return met.confusion_long(_nb_fit_predict(spark, d)[1], "label", "prediction")


def nb_metrics(spark: SparkSession, d: str) -> DataFrame:
    ev = met.evaluate(_nb_fit_predict(spark, d)[1], "label", "prediction")
    return ev.select(F.round("accuracy", R).alias("accuracy"), F.round("macro_f1", R).alias("macro_f1"),
                     "n", "n_classes")


def nb_metrics_observed(spark: SparkSession, d: str) -> DataFrame:
    """``nb_metrics`` counted while the predictions are written: one pass over them."""
    model, pred = _nb_fit_predict(spark, d)
    classes = [r["label"] for r in model.classes.select("label").collect()]  # one value per class
    _, grid = met.write_with_metrics(pred, scratch_path(spark, "predictions"), classes)
    return met.metrics_of(grid).select(F.round("accuracy", R).alias("accuracy"), F.round("macro_f1", R).alias("macro_f1"), "n", "n_classes")


def nb_saved(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of the saved and reloaded naive Bayes model."""
    sf = SplitFeatures(spark, d)
    model, test_x, value = _nb_fit(sf)
    path = scratch_path(spark, "nb")
    model.save(path)
    back = nb.NaiveBayesModel.load(spark, path)
    return nb.predict_naive_bayes(back, test_x, sf.labels_of("test"), "doc_id", value=value).select("doc_id", "label", "prediction")


QUERIES = {
    "nb_metrics_observed": nb_metrics_observed,
    "nb_saved": nb_saved,
    "class_sizes": class_sizes,
    "min_class_size": min_class_size,
    "label_map_first_seen": label_map_first_seen,
    "encode_decode": encode_decode,
    "encode_fixed_map": encode_fixed_map,
    "split_null_label": split_null_label,
    "nb_confusion_classes": nb_confusion_classes,
    "filter_isin": filter_isin,
    "dropna_project": dropna_project,
    "fillna_concat": fillna_concat,
    "rename_drop": rename_drop,
    "cast_concat_sep": cast_concat_sep,
    "union_by_name": union_by_name,
    "head_per_label": head_per_label,
    "row_at": row_at,
    "row_by_position": row_by_position,
    "epoch_orders": epoch_orders,
    "first_n": first_n,
    "shuffle": shuffle,
    "split_two_way": split_two_way,
    "split_stratified": split_stratified,
    "downsample_balanced": downsample_balanced,
    "split_balanced": split_balanced,
    "stage_rows": stage_rows,
    "mean_word_count": mean_word_count,
    "word_tokens": word_tokens,
    "term_counts": term_counts,
    "vocab": vocab,
    "known_terms": known_terms,
    "tfidf": tfidf,
    "nb_model": nb_model,
    "nb_predict": nb_predict,
    "nb_tfidf_predict": nb_tfidf_predict,
    "nb_confusion": nb_confusion,
    "nb_metrics": nb_metrics,
}


def nb_quality_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Naive Bayes on the labelled documents (documents joined with labels,
    2-class ``quality`` with one dominant class), stratified split, evaluated."""
    labelled = documents(spark, d).join(
        table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "inner")
    split = rk.stratified_split(labelled.select("doc_id", "label", "text"), "doc_id", "label",
                                SEED, TEST_SIZE, VAL_SIZE)
    train = split.filter(F.col("split") == "train")
    test = split.filter(F.col("split") == "test")
    model = nb.fit_naive_bayes(feat.occurrences(train, ["label"]), train.select("doc_id", "label"), "doc_id", "label")
    pred = nb.predict_naive_bayes(model, feat.occurrences(test, ["doc_id"]), test.select("doc_id", "label"), "doc_id")
    ev = met.evaluate(pred, "label", "prediction")
    return ev.select(F.round("accuracy", R).alias("accuracy"), F.round("macro_f1", R).alias("macro_f1"),
                     "n", "n_classes")


QUERIES["nb_quality_metrics"] = nb_quality_metrics
