"""Registered queries, second half: batches, vectors and losses, augmentation,
sinks round trips, the dataset registry, MLlib models and batch scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiframe.functions.text import attention_mask, join_columns, truncate, with_prefix, word_tokens
from lexiframe.functions.vectors import argmax, first_element, l2_normalize, round_all, softmax
from lexiframe.operators import augment as aug
from lexiframe.operators import batching as bt
from lexiframe.operators import contrastive as con
from lexiframe.operators import features as feat
from lexiframe.operators import kernel_maps as km
from lexiframe.operators import labels as lab
from lexiframe.operators import linear as lin
from lexiframe.operators import metrics as met
from lexiframe.operators import ranking as rk
from lexiframe.operators import scoring as sc
from lexiframe.operators import svm
from lexiframe.operators import tables as tab
from lexiframe.operators import translation_memory as tm
from lexiframe.operators.perfect_vocabulary import PerfectVocabulary
from lexiframe.operators.pooling import pool_states
from lexiframe.plans.common import SEED, SplitFeatures, documents, quote_table, table
from lexiframe.session import cut_lineage, scratch_path
from lexiframe.sinks import writers as wr
from lexiframe.sources import delimited as dl
from lexiframe.sources.registry import DatasetSpec, Registry
from lexiframe.sources.workbook import read_sheet

R = 6


def _logits(df: DataFrame) -> DataFrame:
    """Logits over the labels from the whole vector: its dot product with each label's mean."""
    return sc.mean_logits(df, "embedding", sc.class_means(df, "embedding", "label"))


# --------------------------------------------------------------------------
# Step 5: batches
# --------------------------------------------------------------------------

def batches(spark: SparkSession, d: str) -> DataFrame:
    return rk.assign_batches(documents(spark, d).select("doc_id"), "doc_id", 10)


def batch_max_len(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", F.size(word_tokens("text")).alias("n_tokens"))
    b = rk.assign_batches(docs, "doc_id", 8)
    out = b.withColumn("batch_max_len", F.max("n_tokens").over(Window.partitionBy("batch_id")))
    return out.select("doc_id", "batch_id", "n_tokens", "batch_max_len")


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The training texts' tokens with their ids, without an exchange by (document, token)."""
    return feat.with_term_ids(feat.document_frequency(SplitFeatures(spark, d).docs_of("train")).select("token"))


def _token_ids(spark: SparkSession, d: str) -> DataFrame:
    v = _vocabulary(spark, d)
    return bt.token_ids(documents(spark, d).select("doc_id", "text"), "doc_id", v)


def token_ids(spark: SparkSession, d: str) -> DataFrame:
    return _token_ids(spark, d)


def token_ids_hashed(spark: SparkSession, d: str) -> DataFrame:
    """``token_ids`` through a minimal perfect hash of the vocabulary (the join beyond its checked size)."""
    v = cut_lineage(_vocabulary(spark, d).select("token", "term_id"), "vocabulary")
    docs = documents(spark, d).select("doc_id", "text")
    hashed = PerfectVocabulary.build(v)
    return hashed.token_ids(docs, "doc_id") if hashed else bt.token_ids(docs, "doc_id", v)


def truncate_pad_mask(spark: SparkSession, d: str) -> DataFrame:
    # batches are made of the ids alone; the token arrays are attached afterwards
    b = rk.assign_batches(documents(spark, d).select("doc_id"), "doc_id", 8).join(_token_ids(spark, d), "doc_id")
    return bt.pad_batches(b, "batch_id", "input_ids", 512).select("doc_id", "batch_id", "input_ids",
                                                                  "attention_mask")


def step_epoch_accuracy(spark: SparkSession, d: str) -> DataFrame:
    emb = _logits(table(spark, d, "embeddings")).withColumn("prediction", argmax("logits"))
    b = rk.assign_batches(emb, "vec_id", 10).withColumn("run", F.lit("probe"))
    out = met.step_and_epoch(b, "run", "batch_id", "label", "prediction")
    return out.select("run", "batch_id", F.round("accuracy", R).alias("accuracy"), "n", "grain")


# --------------------------------------------------------------------------
# Step 6: vectors, similarities, losses
# --------------------------------------------------------------------------

def l2_normalise(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    return emb.select("vec_id", round_all(l2_normalize("embedding"), R).alias("embedding"))


def cosine_in_batch(spark: SparkSession, d: str) -> DataFrame:
    b = rk.assign_batches(table(spark, d, "embeddings"), "vec_id", 10)
    pairs = con.in_batch_pairs(b, "batch_id", "vec_id", "label", "embedding")
    return pairs.select("batch_id", "a_pos", "b_pos", "a_label", "same_label", F.round("sim", R).alias("sim"))


def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    emb = _logits(table(spark, d, "embeddings"))
    return emb.select("vec_id", argmax("logits").alias("prediction"), round_all(softmax("logits"), R).alias("probs"))


def cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    out = met.cross_entropy(_logits(table(spark, d, "embeddings")), "logits", "label")
    return out.select(F.round("cross_entropy", R).alias("cross_entropy"), "n")


def supcon_loss(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    b = rk.assign_batches(emb, "vec_id", 10, seed=SEED, key="vec_id")
    loss = con.supcon_loss(b, "batch_id", "vec_id", "label", "embedding", con.DEFAULT_TEMPERATURE)
    return loss.select("batch_id", "n", F.round("loss", R).alias("loss"))


def embedding_union(spark: SparkSession, d: str) -> DataFrame:
    """Raw vectors tagged 'vf' and their normalised projection tagged 'xf',
    labels prefixed by the tag, concatenated by name."""
    emb = table(spark, d, "embeddings")
    raw = emb.select(F.lit("vf").alias("source"), "vec_id", with_prefix("vf", "label").alias("label"),
                     F.col("embedding").cast("array<double>").alias("embedding"))
    proj = emb.select(F.lit("xf").alias("source"), "vec_id", with_prefix("xf", "label").alias("label"),
                      round_all(l2_normalize("embedding"), R).alias("embedding"))
    return raw.unionByName(proj)


# --------------------------------------------------------------------------
# Step 7: augmentation and pairs
# --------------------------------------------------------------------------

def augment_swap(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    return aug.swap_words(docs, "text", "doc_id", "augmented", SEED).select("doc_id", F.col("augmented").alias("text"))


def augment_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    return aug.delete_words(docs, "text", "doc_id", "augmented", SEED).select("doc_id", F.col("augmented").alias("text"))


def augment_pick(spark: SparkSession, d: str) -> DataFrame:
    """Anchor = first turn; one of the other nine (the translated views) picked per row."""
    q = quote_table(spark, d)
    cands = [f"quote_{i}" for i in range(2, 11)]
    return q.select("conv_id", F.col("quote_1").alias("anchor"), aug.pick_one(cands, "conv_id", SEED).alias("pick"))


def contrastive_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each document with one augmentation (swap or deletion, picked per row),
    batched 5 anchors at a time in seeded order, flattened to 2 views."""
    docs = documents(spark, d).select("doc_id", F.col("lang").alias("label"), "text")
    both = aug.swap_and_delete(docs, "text", "doc_id", "_swap", "_delete", SEED)
    withaug = both.withColumn("augmented", aug.pick_one(["_swap", "_delete"], "doc_id", SEED)).drop("_swap", "_delete")
    b = rk.assign_batches(withaug, "doc_id", 5, seed=SEED, key="doc_id").drop("pos_in_batch")
    return con.contrastive_views(b, "doc_id", "text", "augmented", "label")


# Target languages of the translation augmentation.
TARGET_LANGS = ("en", "tl", "vi", "th", "zh")


def tagging_translator(texts: list[str], lang: str) -> list[str]:
    """Stand-in for a translation client: marks each text with the language."""
    return [f"[{lang}] {t}" for t in texts]


def translations_wide(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text", F.col("lang").alias("label"))
    return aug.translate_wide(docs, "text", TARGET_LANGS, tagging_translator)


def translations_resumed(spark: SparkSession, d: str) -> DataFrame:
    """English documents first, then all, then all again through one memory;
    ``sent_again`` counts the texts of the last run."""
    docs = documents(spark, d).select("doc_id", "text", F.col("lang").alias("label"))
    memory = scratch_path(spark, "memory")
    tm.fill_memory(docs.filter("label = 'en'"), "text", TARGET_LANGS, tagging_translator, memory)
    tm.fill_memory(docs, "text", TARGET_LANGS, tagging_translator, memory)
    out, again = tm.translate_with_memory(docs, "text", TARGET_LANGS, tagging_translator, memory)
    return out.withColumn("sent_again", F.lit(again).cast("bigint"))


# --------------------------------------------------------------------------
# Step 8: sources and sinks round trips, metric log, registry
# --------------------------------------------------------------------------

def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    wr.write_delimited(documents(spark, d).select("doc_id", "text", "lang"), path, sep=",")
    back = dl.read_csv(spark, path, ["doc_id", "text", "lang"], multi_line=True)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")


def csv_split_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Texts with line breaks and quote signs in quoted cells, each file read by as many tasks as it has splits."""
    path = scratch_path(spark, "csv")
    wr.write_delimited(documents(spark, d).select("doc_id", "text", "lang"), path, sep=",")
    back = dl.read_csv(spark, path, ["doc_id", "text", "lang"], multi_line="split")
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")


def csv_by_name(spark: SparkSession, d: str) -> DataFrame:
    """A file with more columns, in another order, read by two names (splittable)."""
    path = scratch_path(spark, "csv")
    wr.write_delimited(documents(spark, d).select("n_chars", "lang", "doc_id", "source"), path, sep=",")
    back = dl.read_csv(spark, path, ["doc_id", "lang"])
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang")


def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    conv = table(spark, d, "conversations")
    wr.write_delimited(conv, path, sep="\t")
    back = dl.read_tsv(spark, path, ["conv_id", "turn", "role", "text"], multi_line=True)
    return back.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       "role", "text")


def liar_layout(spark: SparkSession, d: str) -> DataFrame:
    """Write a headerless 14-column TSV, read it back positionally and build
    the LIAR text: columns 3..14 joined with ' [SEP] ', missing -> 'nan'."""
    docs = documents(spark, d)
    roles = table(spark, d, "conversations").filter(F.col("turn") == 0).select(
        F.col("conv_id").alias("doc_id"), "role")
    labels = table(spark, d, "labels")
    null = F.lit(None).cast("string")
    rows = (docs.join(roles, "doc_id", "left").join(labels, "doc_id", "left")
            .select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), F.col("text").alias("statement"),
                    F.col("source").alias("subjects"), F.col("role").alias("speaker"), null.alias("job_title"),
                    null.alias("state"), null.alias("party"), F.col("quality").alias("barely_true_n"),
                    F.col("toxic").alias("false_n"), null.alias("half_true_n"), null.alias("mostly_true_n"),
                    null.alias("pants_on_fire_n"), F.col("source").alias("context")))
    path = scratch_path(spark, "liar")
    wr.write_delimited(rows, path, sep="\t", header=False)
    back = dl.read_liar(spark, path, multi_line=True)
    text = join_columns(list(dl.LIAR_COLUMNS[2:]), " [SEP] ", "nan")
    return back.select(F.col("id").cast("bigint").alias("id"), "label", text.alias("text"))


def embedding_export(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "emb")
    wr.export_embeddings(table(spark, d, "embeddings"), path, "vf", "vec_id", "label", "embedding")
    return spark.read.parquet(path).select("tag", "key", "label", "embedding")


def embedding_tsv_pair(spark: SparkSession, d: str) -> DataFrame:
    """The exported vector and metadata files, read back line for line."""
    path = scratch_path(spark, "emb")
    wr.export_embeddings(table(spark, d, "embeddings"), path, "vf", "vec_id", "label", "embedding", tsv_pair=True)
    back = wr.read_tsv_pair(spark, path, "vf")
    return back.select(F.col("key").cast("bigint").alias("key"), "label", round_all("embedding", R).alias("embedding"))


RATINGS = ["FALSE", "FAKE", "MISLEADING", "TRUE"]


def workbook_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as workbooks with a rating (by the id) and ten
    quotes, read back: three ratings kept, missing quotes filled, quotes joined."""
    quotes = [f"QUOTE {i}" for i in range(1, 11)]
    wide = quote_table(spark, d).toDF("conv_id", *quotes)
    rated = wide.withColumn("RATING", F.element_at(F.array(*[F.lit(r) for r in RATINGS]), (F.col("conv_id") % 4 + 1).cast("int")))
    path = scratch_path(spark, "books")
    wr.write_workbooks(rated, path, "rated_with_quotes", ["conv_id", "RATING", *quotes])
    back = read_sheet(spark, f"{path}/*.xlsx", "rated_with_quotes", ["conv_id", "RATING", *quotes])
    kept = tab.fill_empty(tab.filter_isin(back, "RATING", ["FALSE", "FAKE", "MISLEADING"]), "")
    out = tab.concat_columns(kept, quotes, "text", " ")
    return out.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("RATING").alias("rating"), "text")


def _metric_log(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    rows = ev.select(F.col("user_id").cast("string").alias("run"), F.lit("val").alias("split"),
                     F.col("event_id").alias("step"), F.floor(F.col("event_id") / 100).alias("epoch"),
                     F.col("event_type").alias("metric"), "value")
    path = scratch_path(spark, "metrics")
    wr.append_metrics(rows, path)
    return spark.read.parquet(path)


def metric_log_topk(spark: SparkSession, d: str) -> DataFrame:
    log = _metric_log(spark, d)
    return met.top_k_runs(log, "run", "step", "value", k=2, mode="max", metric="metric")


def dataset_registry(sf_dir: str) -> Registry:
    """Driver tables registered as labelled-text datasets."""
    reg = Registry()
    reg.register(DatasetSpec(
        "documents_lang",
        lambda s: table(s, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text",
                                                       F.col("lang").alias("label")), 4))
    reg.register(DatasetSpec(
        "documents_quality",
        lambda s: table(s, sf_dir, "documents").join(table(s, sf_dir, "labels"), "doc_id", "inner")
        .select(F.col("doc_id").alias("key"), "text", F.col("quality").cast("string").alias("label")), 2))
    reg.register(DatasetSpec(
        "benchmark_items",
        lambda s: table(s, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text",
                                                       F.lit("benchmark").alias("label")), 1))
    return reg


def registry(spark: SparkSession, d: str) -> DataFrame:
    reg = dataset_registry(d)
    parts = []
    for name in reg.names():
        spec = reg.spec(name)
        df = reg.load(spark, name, view=False)
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("label").alias("n_labels"))
                     .select(F.lit(name).alias("dataset"), "n_rows", "n_labels",
                             F.lit(spec.num_classes).alias("num_classes")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------------
# Step 9: MLlib models and batch scoring (row checks)
# --------------------------------------------------------------------------

def _emb_split(spark: SparkSession, d: str) -> DataFrame:
    emb = table(spark, d, "embeddings")
    return rk.stratified_split(emb, "vec_id", "label", SEED, test_size=0.3, val_size=None)


def _floor(pred: DataFrame, label: str) -> DataFrame:
    """One row: test rows, and whether accuracy beats always guessing the commonest label."""
    right = (F.col(label) == F.col("prediction")).cast("long")
    per = pred.groupBy(label).agg(F.count("*").alias("c"), F.sum(right).alias("r"))
    return per.agg(F.sum("c").alias("n"), (F.sum("r") > F.max("c")).alias("beats_majority"))


def linear_probe(spark: SparkSession, d: str) -> DataFrame:
    """Trained linear head: the table's labels carry no signal, so the fit is
    checked, not its accuracy (loss under that of guessing, gradient near 0)."""
    s = _emb_split(spark, d)
    train = s.filter(F.col("split") == "train")
    model = lin.fit_linear_probe(train, "embedding", "label")
    return lin.probe_optimality(model, train, "embedding", "label").select(
        "n", (F.col("loss") < F.log(F.col("n_classes"))).alias("loss_below_guessing"),
        (F.col("gradient") < 0.01).alias("gradient_near_zero"))


def model_round_trip(spark: SparkSession, d: str) -> DataFrame:
    s = _emb_split(spark, d)
    model = lin.fit_linear_probe(s.filter(F.col("split") == "train"), "embedding", "label")
    path = scratch_path(spark, "model")
    lin.save_model(model, path)
    test = s.filter(F.col("split") == "test")
    before = lin.apply_linear_probe(model, test, "embedding", keep=["vec_id"])
    after = lin.apply_linear_probe(lin.load_model(path), test, "embedding", keep=["vec_id"]).withColumnRenamed("prediction", "after")
    return before.join(after, "vec_id").select("vec_id", (F.col("prediction") == F.col("after")).alias("same"))


def _doc_label_split(spark: SparkSession, d: str):
    """Train and test documents; the label map is fit on the training rows alone."""
    docs = SplitFeatures(spark, d).docs
    train = docs.filter(F.col("split") == "train")
    lm = lab.fit_label_map(train, "label", order="alphabetical")
    enc = lab.encode_labels(docs, lm, "label", "label_id", on_unknown="skip")
    return enc.filter(F.col("split") == "train"), enc.filter(F.col("split") == "test")


def _bag(docs: DataFrame, idf: DataFrame | None) -> DataFrame:
    tc = feat.term_counts(docs, "doc_id")
    weighted = feat.tfidf(tc, idf, "doc_id") if idf is not None else tc.withColumnRenamed("tf", "weight")
    return weighted.select("doc_id", "token", "weight")


def _proved(pred: DataFrame, rows: DataFrame, model: svm.LinearModel) -> DataFrame:
    """Floor of the predictions, and whether the written weights and dual variables
    prove every task's objective to be within 1 % of the optimum."""
    proof = svm.certificate(rows, model)
    gap = proof.select((F.col("feasible") & (F.col("gap") <= 0.01 + 1e-9)).alias("v")).scalar()
    return _floor(pred, "label_id").withColumn("gap_within_percent", gap)


def _table_svm(spark: SparkSession, d: str, weighting: str) -> DataFrame:
    train, test = _doc_label_split(spark, d)
    idf = feat.idf_table(train) if weighting == "tfidf" else None
    rows, classes = svm.training_rows(_bag(train, idf), train, "doc_id", "label_id", "weight")
    model = svm.fit_svm(rows, classes, against="rest")
    pred = svm.predict_svm(model, _bag(test, idf), test.select("doc_id", "label_id"), "doc_id", "weight")
    return _proved(pred, rows, model)


def linear_svm(spark: SparkSession, d: str) -> DataFrame:
    return _table_svm(spark, d, "count")


def svm_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return _table_svm(spark, d, "tfidf")


def _mapped_svm(spark: SparkSession, d: str, **kw) -> DataFrame:
    train, test = _doc_label_split(spark, d)
    model, rows = km.fit_kernel_svm(train, "doc_id", "text", "label_id", **kw)
    return _proved(model.predict(test, "doc_id", "text", keep=["label_id"]), rows, model.linear)


def rff_svm(spark: SparkSession, d: str) -> DataFrame:
    return _mapped_svm(spark, d, kind="fourier", weighting="tfidf", gamma=1.0, against="rest")


def rff_svm_counts(spark: SparkSession, d: str) -> DataFrame:
    return _mapped_svm(spark, d, kind="fourier", weighting="count", gamma=1e-4, against="rest")


def kernel_svm(spark: SparkSession, d: str) -> DataFrame:
    """RBF kernel of scaled width on term counts by landmarks, one against one."""
    return _mapped_svm(spark, d, kind="landmarks", weighting="count", against="pairs")


def kernel_svm_saved(spark: SparkSession, d: str) -> DataFrame:
    """Per test row: whether the saved and reloaded kernel machine predicts as before."""
    train, test = _doc_label_split(spark, d)
    model, _ = km.fit_kernel_svm(train, "doc_id", "text", "label_id", weighting="tfidf")
    path = scratch_path(spark, "model")
    model.save(path)
    before = model.predict(test, "doc_id", "text")
    after = km.KernelModel.load(spark, path).predict(test, "doc_id", "text", out="after")
    return before.join(after, "doc_id").select("doc_id", (F.col("prediction") == F.col("after")).alias("same"))


def score_batch(spark: SparkSession, d: str) -> DataFrame:
    """The batch scoring seam with a caller's model (a linear read-out of the whole vector)."""
    emb = table(spark, d, "embeddings")
    means = sc.class_means(emb, "embedding", "label")
    scored = sc.score_vectors(emb, "embedding", sc.means_model(means), means.count(), dim=64)
    return scored.select("vec_id", argmax("logits").alias("prediction"))


def _residue_model():
    """A caller's model over token ids: four logits, each the share of unmasked
    ids that leave this remainder (times four)."""
    import numpy as np

    def predict(ids, mask):
        n = np.maximum(mask.sum(axis=1), 1)
        return np.stack([((ids % 4 == j) & (mask == 1)).sum(axis=1) * 4.0 / n for j in range(4)], axis=1)

    return predict


def score_from_text(spark: SparkSession, d: str) -> DataFrame:
    """Text to ids and mask, logits, probabilities and the label's name."""
    docs = _token_ids(spark, d).withColumn("input_ids", truncate("input_ids", 512))
    docs = docs.withColumn("attention_mask", attention_mask("input_ids", F.size("input_ids")))
    out = sc.score_text(docs, "input_ids", "attention_mask", _residue_model, 4, ["de", "en", "es", "fr"], keep=["doc_id"])
    return out.select("doc_id", round_all("probs", R).alias("probs"), "prediction")


PROJECTION = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(8)]


def pool_project(spark: SparkSession, d: str) -> DataFrame:
    """First-token pooling and a linear projection: the vectors of a label in
    order stand for a sequence of hidden states, whose first state is projected."""
    emb = table(spark, d, "embeddings")
    first = emb.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("state"))
    pooled = first.select("label", first_element(F.array("state")).alias("pooled"))
    return pooled.select("label", round_all(sc.project("pooled", PROJECTION), R).alias("projected"))


def pool_sequences(spark: SparkSession, d: str) -> DataFrame:
    """All vectors as sequences of up to eight states in order: the projected first
    state, and the mean of the states that a mask leaves."""
    emb = table(spark, d, "embeddings").withColumn("seq", F.floor(F.col("vec_id") / 8).cast("bigint")).withColumn("mask", (F.col("label") != 0).cast("int"))
    first = pool_states(emb, "seq", "vec_id", "embedding", 64)
    mean = pool_states(emb, "seq", "vec_id", "embedding", 64, "mean", "mask", out="mean").drop("n_states")
    both = first.join(mean, "seq")
    return both.select("seq", "n_states", round_all(sc.project("pooled", PROJECTION), R).alias("projected"), round_all("mean", R).alias("mean"))


QUERIES = {
    "pool_sequences": pool_sequences,
    "batches": batches,
    "batch_max_len": batch_max_len,
    "token_ids": token_ids,
    "token_ids_hashed": token_ids_hashed,
    "truncate_pad_mask": truncate_pad_mask,
    "step_epoch_accuracy": step_epoch_accuracy,
    "l2_normalise": l2_normalise,
    "cosine_in_batch": cosine_in_batch,
    "softmax_argmax": softmax_argmax,
    "cross_entropy": cross_entropy,
    "supcon_loss": supcon_loss,
    "embedding_union": embedding_union,
    "augment_swap": augment_swap,
    "augment_delete": augment_delete,
    "augment_pick": augment_pick,
    "contrastive_pairs": contrastive_pairs,
    "translations_wide": translations_wide,
    "translations_resumed": translations_resumed,
    "csv_round_trip": csv_round_trip,
    "csv_split_quotes": csv_split_quotes,
    "csv_by_name": csv_by_name,
    "tsv_round_trip": tsv_round_trip,
    "liar_layout": liar_layout,
    "embedding_export": embedding_export,
    "embedding_tsv_pair": embedding_tsv_pair,
    "workbook_quotes": workbook_quotes,
    "metric_log_topk": metric_log_topk,
    "registry": registry,
    "linear_probe": linear_probe,
    "model_round_trip": model_round_trip,
    "linear_svm": linear_svm,
    "svm_tfidf": svm_tfidf,
    "rff_svm": rff_svm,
    "rff_svm_counts": rff_svm_counts,
    "kernel_svm": kernel_svm,
    "kernel_svm_saved": kernel_svm_saved,
    "score_batch": score_batch,
    "score_from_text": score_from_text,
    "pool_project": pool_project,
}
