"""Quality rules by robust multivariate outlier detection (native: DataFrame functions only).

Every document gets plain counts (words, symbols, repeated lines, repeated
5-word windows) and a vector of transformed rates.  Per language and source a
minimum-covariance-determinant estimate (Rousseeuw and Van Driessen 1999,
deterministic starts after Hubert et al. 2012, regularised by a floor on every
scale) gives a centre and a scatter that outliers cannot pull; a document goes
when its Mahalanobis distance is past the cutoff.

Only sums per group are ever gathered: rates are stored as whole numbers of
1 / ``GRID``, so sums and products are exact and the result does not depend on
how rows are partitioned; the h nearest rows of a group are found from a
histogram of distance classes.  A source that holds a third of all rows is
summed in every task before anything is shuffled.

Defined results: a NULL text has no words (base_failed); a NULL language or
source is a group of its own; groups under ``MIN_GROUP`` rows that pass the
base rules share their language's estimate and, below that, the overall one;
with no usable estimate only the base rules decide; repeated ids keep their
rows; an empty table gives an empty table; other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.presence import split_by
from lexiframe.llm.storage import table, written

WHITE, NOT_WHITE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
WINDOW = 5
#: Base rules: at least so many words, at most so many percent of them in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Whole numbers per unit of a transformed rate.
GRID = 1024
#: Words of the usual rates that every document is given besides its own, so that
#: the rates of very short texts do not stray by chance; their mean length.
PRIOR_WORDS, PRIOR_LENGTH = 50, 5
#: Rows that a group needs for an estimate of its own.
MIN_GROUP = 60
#: Share of a group's rows that the estimate rests on (the h of the h-subset).
SUBSET = 0.75
#: Fixed values for five dimensions: consistency factor of the scatter at this
#: share, and the chi-square quantile 0.9999.
CONSISTENCY, CUTOFF = 1.41, 25.74
#: Smallest scale of each dimension (the regularisation).
FLOORS = {"x_length": 0.08, "x_symbols": 0.10, "x_marks": 0.10, "x_repeats": 0.05, "x_lines": 0.02}
X = list(FLOORS)
#: Concentration steps, and distance classes per doubling.
STEPS, CLASSES = 3, 16


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(text, WHITE), "")


def repeat_pairs(windows: Column) -> Column:
    """``(hash, start)`` of the windows in order of their hash, or NULL if no two are equal."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs)


def with_counts(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` plus the base counts and ``base_failed``."""
    out = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_raw"))
    names = out.columns[:-1]
    out = out.withColumn("_words", words_of(F.col("_raw"))).withColumn(
        "_signs", F.regexp_replace("_raw", r"[^#*$%&|<>!?]+", "")).withColumn(
        "_lines", F.filter(F.split("_raw", "\n"), lambda x: x.rlike(NOT_WHITE)))
    w = F.col("_words")
    out = out.withColumn("_windows", F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")))
    out = out.select(
        *names,
        F.size(w).cast("long").alias("n_words"),
        (F.length("_raw") - F.length(F.regexp_replace("_raw", NOT_WHITE, ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_signs", "[!?]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_signs", "[^!?]+", "")).cast("long").alias("n_marks"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeat_pairs(F.col("_windows")).alias("_pairs"))
    p, n = F.col("_pairs"), F.size("_pairs")
    same = lambda j, k: F.coalesce(F.get(p, j)["h"] == F.get(p, k)["h"], F.lit(False))
    out = out.withColumn("_at", F.when(p.isNotNull(), F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), n - 1), lambda j: same(j, j - 1) | same(j, j + 1)), lambda j: F.get(p, j)["i"]))))
    at = F.col("_at")
    covered = F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0).cast("long"), lambda acc, k: acc + F.least(
        F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - F.get(at, k), F.lit(WINDOW))).cast("long"))
    out = out.withColumn("n_repeat_words", F.when(at.isNull(), F.lit(0).cast("long")).otherwise(covered)).drop("_pairs", "_at")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def with_rates(counted: DataFrame) -> DataFrame:
    """Adds the vector of transformed rates as whole numbers of 1 / ``GRID``."""
    n = F.col("n_words") + PRIOR_WORDS
    rates = {
        "x_length": F.log((F.col("word_chars") + PRIOR_WORDS * PRIOR_LENGTH) / n),
        "x_symbols": F.log1p(10 * F.col("n_symbols") / n),
        "x_marks": F.log1p(10 * F.col("n_marks") / n),
        "x_repeats": F.col("n_repeat_words") / n,
        "x_lines": F.col("n_dup_lines") / n,
    }
    return counted.withColumns({k: F.round(v * GRID).cast("long") for k, v in rates.items()})


def with_groups(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Adds ``_group``: language and source; small groups are pooled per
    language, pools that are still small all together; NULL if even that is small."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    rows = rows.withColumns({"_lang": name(lang), "_pair": F.concat(name(lang), F.lit("\x01"), name(source))})
    pairs = rows.filter(~F.col("base_failed")).groupBy("_lang", "_pair").agg(F.count("*").alias("_n"))
    small = F.col("_n") < MIN_GROUP
    pool = F.sum(F.when(small, F.col("_n"))).over(Window.partitionBy("_lang"))
    pairs = pairs.withColumn("_group", F.when(~small, F.col("_pair")).when(pool >= MIN_GROUP, F.concat(F.lit("*"), F.col("_lang"))).otherwise(F.lit("**")))
    size = pairs.groupBy("_group").agg(F.sum("_n").alias("_m"))
    groups = pairs.join(size, "_group").select("_pair", F.when(F.col("_m") >= MIN_GROUP, F.col("_group")).alias("_group"))
    groups = written(groups, "group-names")  # its size is then known, and the rows stay where they are if it is small
    return rows.join(groups, "_pair", "left").drop("_lang", "_pair")


def _products() -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(X) for b in X[: i + 1]]


def with_factor(sums: DataFrame) -> DataFrame:
    """From ``n``, sums ``s_*`` and sums of products ``p_*``: centre ``m_*`` and
    the Cholesky factor ``l_*`` of the regularised scatter, and its ``log_det``."""
    n = F.col("n")
    out = sums.withColumns({f"m_{a}": F.col(f"s_{a}") / n / GRID for a in X})
    factor: dict[tuple[str, str], Column] = {}
    for i, a in enumerate(X):  # column expressions over the columns added so far
        for b in X[: i + 1]:
            cov = (F.col(f"p_{a}_{b}") / n / GRID / GRID - F.col(f"m_{a}") * F.col(f"m_{b}")) * CONSISTENCY
            if a == b:
                cov = F.greatest(cov, F.lit(0.0)) + FLOORS[a] ** 2
            dot = reduce(lambda s, c: s + factor[a, c] * factor[b, c], X[: X.index(b)], F.lit(0.0))
            rest = cov - dot
            rest = F.sqrt(F.greatest(rest, F.lit(FLOORS[a] ** 2 / 100))) if a == b else rest / factor[b, b]
            out = out.withColumn(f"l_{a}_{b}", rest)
            factor[a, b] = F.col(f"l_{a}_{b}")
    return out.withColumn("log_det", 2 * reduce(lambda s, a: s + F.log(F.col(f"l_{a}_{a}")), X, F.lit(0.0)))


def distance() -> Column:
    """Squared Mahalanobis distance of a row joined with its estimate (forward substitution)."""
    z: dict[str, Column] = {}
    for i, a in enumerate(X):
        rest = reduce(lambda s, b: s - F.col(f"l_{a}_{b}") * z[b], X[:i], F.col(a) / GRID - F.col(f"m_{a}"))
        z[a] = rest / F.col(f"l_{a}_{a}")
    return reduce(lambda s, a: s + z[a] * z[a], X, F.lit(0.0))


ESTIMATE = ["_group", "_start", "log_det", *[f"m_{a}" for a in X], *[f"l_{a}_{b}" for a, b in _products()]]


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(a).alias(f"s_{a}") for a in X],
            *[F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in _products()]]


def _starts(rows: DataFrame) -> DataFrame:
    """Two deterministic starts per group: the plain mean and scatter, and the
    medians with the median deviations (grid values are few, so medians are exact)."""
    plain = with_factor(rows.groupBy("_group").agg(*_sums())).withColumn("_start", F.lit(0))
    middle = written(rows.groupBy("_group").agg(*[F.percentile(a, 0.5).alias(f"c_{a}") for a in X]), "medians")
    around = rows.join(middle, "_group").groupBy("_group").agg(
        *[F.first(f"c_{a}").alias(f"c_{a}") for a in X],
        *[F.percentile(F.abs(F.col(a) - F.col(f"c_{a}")), 0.5).alias(f"d_{a}") for a in X])
    robust = around.withColumns({f"m_{a}": F.col(f"c_{a}") / GRID for a in X}).withColumns({
        f"l_{a}_{b}": F.sqrt(F.pow(1.4826 * F.col(f"d_{a}") / GRID, 2) + FLOORS[a] ** 2) if a == b else F.lit(0.0)
        for a, b in _products()}).withColumn("_start", F.lit(1)).withColumn("log_det", F.lit(0.0))
    return plain.select(*ESTIMATE).unionByName(robust.select(*ESTIMATE))


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step for all groups and starts: the rows of the nearest
    distance classes that hold at least ``SUBSET`` of the group give the next estimate."""
    d = rows.join(estimate, "_group").withColumn("_class", F.floor(CLASSES * F.log2(distance() + 1e-6)))
    keys = ["_group", "_start"]
    classes = d.groupBy(*keys, "_class").agg(*_sums())
    nearer = Window.partitionBy(*keys).orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    kept = classes.withColumn("_before", F.coalesce(F.sum("n").over(nearer), F.lit(0))).withColumn(
        "_all", F.sum("n").over(Window.partitionBy(*keys))).filter(F.col("_before") < SUBSET * F.col("_all"))
    total = kept.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ["n", *[f"s_{a}" for a in X], *[f"p_{a}_{b}" for a, b in _products()]]])
    return with_factor(total).select(*ESTIMATE)


def fit_estimates(rated: DataFrame) -> DataFrame:
    """The minimum-determinant estimate of every group, from rows that pass the base rules."""
    rows = rated.filter(~F.col("base_failed") & F.col("_group").isNotNull()).select("_group", *X)
    estimate = written(_starts(rows), "scatter")
    for _ in range(STEPS):
        estimate = written(_concentrate(rows, estimate), "scatter")
    best = F.row_number().over(Window.partitionBy("_group").orderBy("log_det", "_start"))
    return estimate.withColumn("_best", best).filter("_best = 1").drop("_best", "_start", "log_det")


def with_verdicts(docs: DataFrame, keep: list[Column], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``keep`` plus the counts, ``base_failed``, ``distance`` and ``kept``."""
    # other columns may have any name: they travel in one struct
    rows = docs.select(F.struct(*keep).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_l"), F.col(source).alias("_s"))
    counted = with_counts(rows, "_text", [F.col(c) for c in ("_row", "_l", "_s")])
    rated = written(with_groups(written(with_rates(counted), "counts"), "_l", "_s"), "rated")
    judged = rated.join(fit_estimates(rated), "_group", "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), distance()))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return judged.withColumn("kept", kept)


def op2_robust_rules(spark, sf_dir):
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return with_verdicts(docs, [F.col("doc_id")]).select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def quality_stage(spark, docs, sf_dir):
    """Pipeline stage: documents that the rules reject go.

    A verdict is a function of text, language and source, so rows meet the rejected
    ones by a key of these three (96 bits of hash and which of them are NULL); only
    keys and counts are written, never texts, and only rows that may be rejected move."""
    parts = [F.col(c) for c in ("text", "lang", "source")]
    key = F.struct(F.xxhash64(*parts, *[c.isNull() for c in parts]).alias("a"), F.hash(*parts).alias("b"))
    judged = with_verdicts(docs, [key.alias("key")])
    gone = written(judged.filter(~F.col("kept")).select(F.col("_row.key").alias("_gone")).distinct(), "rejected")
    may, stay = split_by(docs, key, gone, "_gone")
    return stay.unionByName(may.join(gone, key == F.col("_gone"), "left_anti"))
