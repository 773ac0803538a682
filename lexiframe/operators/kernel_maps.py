"""Kernel support-vector machines through explicit feature maps.

A map sends a document's terms to a short dense vector whose inner products stand
for an RBF kernel ``exp(-gamma |x - y|^2)``; the table SVM (``operators.svm``) is
then fitted on these vectors.

* Nystroem landmarks: ``MOST_LANDMARKS`` training rows with the smallest seeded
  hashes (a bottom-k sketch: the same rows however the table is dealt); a row's
  kernel values against the landmarks, times the inverse root of the landmarks'
  own kernel matrix.  With all rows as landmarks it is the exact kernel.
* Random Fourier features (Rahimi and Recht 2007): the random direction of a term is
  derived from a hash of the term and the seed, so no matrix of terms exists anywhere.

Landmarks have at most ``LONGEST`` terms each, so what is shipped to the tasks is
bounded by the parameters, not by the data.  Documents are mapped whole.

Defined results: rows without terms are the zero vector's image; rows with more
than ``LONGEST`` terms are no landmarks; without any row to choose the map is empty
and the bias decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiframe.functions.text import word_tokens
from lexiframe.functions.worker import frugal
from lexiframe.operators import svm
from lexiframe.operators.features import idf_table, term_counts, tfidf
from lexiframe.session import cut_lineage

#: Landmarks and the terms of the longest; components that stand for the kernel in random features.
MOST_LANDMARKS, LONGEST, RFF_COMPONENTS = 256, 4096, 256
#: Terms of an IDF table that is shipped to the tasks; rows that are packed or mapped at once; numbers of
#: directions made for them at once, by so many terms.
SHIPPED_TERMS, PIECE_ROWS, NUMBERS, NEAR_ROWS = 4_000_000, 512, 1 << 22, 64
#: Eigenvalues below this share of the largest are left out of the inverse root.
FLOOR = 1e-10


def _lists(lengths, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(values))


def _pieces(batches):
    return (batch.slice(i, PIECE_ROWS) for batch in batches for i in range(0, batch.num_rows, PIECE_ROWS))


def _packed(table: DataFrame, key: str, *steps) -> DataFrame:
    """``(key, ids, values)``: each step makes new rows' places, ids and values of some rows' ones."""
    def each(batches):
        for piece in _pieces(batches):
            n, ids = piece.num_rows, piece.column("ids")
            now = np.repeat(np.arange(n), ids.value_lengths().to_numpy(zero_copy_only=False)), ids.flatten().to_numpy(), piece.column("values").flatten().to_numpy() if "values" in piece.schema.names else None
            for step in steps:
                now = step(n, *now)
            lengths = np.bincount(now[0], minlength=n)
            yield pa.RecordBatch.from_arrays([piece.column(key), _lists(lengths, now[1]), _lists(lengths, now[2])], names=[key, "ids", "values"])

    kind = table.schema[key].dataType.simpleString()
    return table.mapInArrow(frugal(each), f"`{key}` {kind}, ids array<bigint>, values array<double>")


def _counted(n, row, ids, _):
    order = np.lexsort((ids, row))
    ids, row = ids[order], row[order]
    first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])]) if len(ids) else np.zeros(0, np.int64)
    return row[first], ids[first], np.diff(np.r_[first, len(ids)]).astype(float)


def _weights(shared, others: bool = False):
    """Counts times IDF, 0 for terms that are not shipped; or the counts of those."""
    def run(n, row, ids, tf):
        known, idf = shared.value
        at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
        held = known[at] == ids if len(known) else np.zeros(len(ids), bool)
        if others:
            return row[~held], ids[~held], tf[~held]
        return row, ids, np.where(held, tf * idf[at], 0.0) if len(known) else np.zeros(len(ids))

    return run


def _normalised(n, row, ids, weight):
    held = weight > 0
    row, ids, weight = row[held], ids[held], weight[held]
    return row, ids, weight / np.sqrt(np.bincount(row, weights=weight * weight, minlength=n)[row])


def _tfidf_rows(hashed: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """Weights of rows ``(key, ids)`` whose keys are distinct.  The commonest terms, at most ``SHIPPED_TERMS``,
    are shipped to the tasks; only the rows' other terms are joined."""
    coded = idf.groupBy(F.xxhash64("token").alias("_lf_i")).agg(F.min("idf").alias("_lf_idf"))
    last = None
    if idf.count() > SHIPPED_TERMS:
        # one row per document frequency: about the root of all occurrences at most
        sizes = idf.groupBy("idf").count().orderBy("idf").collect()
        shipped = [r["idf"] for r, n in zip(sizes, np.cumsum([r["count"] for r in sizes]), strict=True) if n <= SHIPPED_TERMS]
        last = shipped[-1] if shipped else -1.0
    held = (coded if last is None else coded.filter(F.col("_lf_idf") <= last)).orderBy("_lf_i").toArrow()  # at most SHIPPED_TERMS rows of two numbers
    shared = hashed.sparkSession.sparkContext.broadcast((held.column("_lf_i").to_numpy(), held.column("_lf_idf").to_numpy()))
    if last is None:
        return _packed(hashed, key, _counted, _weights(shared), _normalised)
    counts = cut_lineage(_packed(hashed, key, _counted), "counts")
    other = _packed(counts, key, _weights(shared, others=True)).select(F.col(key).alias("_lf_k"), F.explode(F.arrays_zip("ids", "values")).alias("c"))
    weighed = other.select("_lf_k", F.col("c.ids").alias("_lf_i"), F.col("c.values").alias("_lf_tf")).join(coded.filter(F.col("_lf_idf") > last), "_lf_i")
    found = weighed.groupBy("_lf_k").agg(F.collect_list(F.struct(F.col("_lf_i").alias("id"), (F.col("_lf_tf") * F.col("_lf_idf")).alias("w"))).alias("_lf_o"))
    both = _packed(counts, key, _weights(shared)).join(found, F.col(key) == F.col("_lf_k"), "left")
    ids, values = (F.coalesce(F.col("_lf_o")[x], F.array().cast(f"array<{kind}>")) for x, kind in (("id", "bigint"), ("w", "double")))
    return _packed(both.select(key, F.concat("ids", ids).alias("ids"), F.concat("values", values).alias("values")), key, _normalised)


def packed_rows(df: DataFrame, key: str, text: str, idf: DataFrame | None = None) -> DataFrame:
    """``(key, ids, values)``: 64-bit hashes of a row's terms with counts, or with
    normalised TF-IDF weights if ``idf`` is given.

    Every row is packed where it lies.  Rows that share a key share one bag of weighted
    terms, and rows without a key have none: tables with such rows are joined by term."""
    ids = F.transform(word_tokens(F.coalesce(text, F.lit(""))), lambda t: F.xxhash64(t))
    hashed = df.select(key, ids.alias("ids"))
    if idf is None:
        return _packed(hashed, key, _counted)
    odd = df.groupBy(key).agg(F.count(F.lit(1)).alias("_lf_n")).filter((F.col("_lf_n") > 1) | F.col(key).isNull())
    if odd.isEmpty():
        return _tfidf_rows(hashed, key, idf)
    weighted = tfidf(term_counts(df, key, text), idf, key)
    per = weighted.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("_lf_t"))
    pairs = F.coalesce("_lf_t", F.array().cast("array<struct<token:string,weight:double>>"))
    return df.select(key).join(per, key, "left").select(
        key, F.transform(pairs, lambda p: F.xxhash64(p["token"])).alias("ids"), F.transform(pairs, lambda p: p["weight"]).alias("values"))


def scale_gamma(packed: DataFrame) -> float:
    """``1 / (terms * variance of all cells)`` of the rows-by-terms matrix."""
    cells = packed.select(F.explode(F.arrays_zip("ids", "values")).alias("c")).agg(
        F.count_distinct("c.ids").alias("v"), F.sum("c.values").alias("s"), F.sum(F.col("c.values") * F.col("c.values")).alias("q")).first()
    size = packed.count() * cells["v"]
    variance = cells["q"] / size - (cells["s"] / size) ** 2 if size else 0.0
    return 1.0 / (cells["v"] * variance) if variance > 0 else 1.0


def _mapped(packed: DataFrame, key: str, images, weights: np.ndarray | None) -> DataFrame:
    """``(key, value)``: the dense image of every row, from starts, ids and values of some rows;
    or its product with ``weights``, made in the same worker."""

    def run(batches):
        for piece in _pieces(batches):
            ids = piece.column("ids")
            starts = np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            out = images(starts, ids.flatten().to_numpy(), piece.column("values").flatten().to_numpy())
            if weights is not None:
                out = out[:, :len(weights)] @ weights
            yield pa.RecordBatch.from_arrays([piece.column(key), _lists(np.full(piece.num_rows, out.shape[1]), out.ravel())], names=[key, "value"])

    kind = packed.schema[key].dataType.simpleString()
    return packed.select(key, "ids", "values").mapInArrow(frugal(run), f"`{key}` {kind}, value array<double>")


@dataclass
class Landmarks:
    """Bounded by ``MOST_LANDMARKS`` rows of ``LONGEST`` terms: terms in order, for
    each the landmarks that hold it and its value there, the squared lengths, and
    the inverse root."""

    terms: np.ndarray
    begins: np.ndarray
    owner: np.ndarray
    value: np.ndarray
    square: np.ndarray
    root: np.ndarray
    gamma: float

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], gamma: float) -> Landmarks:
        term = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
        value = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        order = np.lexsort((owner, term))
        terms, first = np.unique(term[order], return_index=True)
        square = np.array([(r[1] * r[1]).sum() for r in rows])
        out = cls(terms, np.r_[first, len(term)].astype(np.int64), owner[order], value[order], square, np.eye(len(rows)), gamma)
        if rows:
            kernel = np.stack([out.against(*r) for r in rows])
            size, axes = np.linalg.eigh((kernel + kernel.T) / 2)
            keep = size > FLOOR * size.max()
            out.root = axes[:, keep] / np.sqrt(size[keep]) @ axes[:, keep].T
        return out

    def against(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Kernel values of a row and all landmarks."""
        at = np.searchsorted(self.terms, ids)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == ids if len(self.terms) else np.zeros(len(ids), bool)
        lo, n = self.begins[at[known]], (self.begins[at[known] + 1] - self.begins[at[known]]) if known.any() else np.zeros(0, np.int64)
        place = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if known.any() else np.zeros(0, np.int64)
        inner = np.bincount(self.owner[place], weights=np.repeat(values[known], n) * self.value[place], minlength=len(self.square))
        return np.exp(-self.gamma * np.maximum(0.0, self.square + (values * values).sum() - 2 * inner))

    def images(self, starts, ids, values):
        rows = [self.against(ids[lo:hi], values[lo:hi]) for lo, hi in zip(starts, starts[1:])]
        return np.stack(rows) @ self.root

    def map(self, packed: DataFrame, key: str, weights: np.ndarray | None = None) -> DataFrame:
        shared = packed.sparkSession.sparkContext.broadcast(self)
        return _mapped(packed, key, lambda *some: shared.value.images(*some), weights)


def choose_landmarks(packed: DataFrame, key: str, most: int, gamma: float, seed: int) -> Landmarks:
    short = packed.filter(F.size("ids") <= LONGEST)
    chosen = short.orderBy(F.xxhash64(F.lit(seed), key), key).limit(most).collect()  # at most `most` rows of LONGEST terms
    return Landmarks.of([(np.array(r["ids"], dtype=np.int64), np.array(r["values"], dtype=float)) for r in chosen], gamma)


@dataclass
class FourierFeatures:
    """``sqrt(2 / D) cos(x W + b)`` with ``W ~ N(0, 2 gamma)``, a row of W per term
    from the term's hash."""

    width: int
    gamma: float
    seed: int

    def directions(self, ids: np.ndarray) -> np.ndarray:
        """A row per term: pairs of normal numbers (Box and Muller) from 24 bits each of a hash."""
        half = (self.width + 1) // 2
        out = np.empty((len(ids), 2 * half), np.float32)
        for i in range(0, len(ids), NEAR_ROWS):
            cell = ids[i:i + NEAR_ROWS].astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(half, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            x = _hashed(cell + np.uint64(self.seed))
            far = np.sqrt(np.float32(-4 * self.gamma) * np.log(_share(x >> np.uint64(40))))
            angle = np.float32(2 * np.pi) * _share(x & np.uint64(0xFFFFFF))
            np.multiply(far, np.cos(angle), out=out[i:i + NEAR_ROWS, :half])
            np.multiply(far, np.sin(angle), out=out[i:i + NEAR_ROWS, half:])
        return out[:, :self.width]

    def images(self, starts, ids, values):
        shift = 2 * np.pi * _uniform(np.arange(self.width, dtype=np.uint64) + np.uint64(self.seed + 77))
        out = np.tile(shift, (len(starts) - 1, 1))
        step = max(1, NUMBERS // self.width)
        for a in range(0, len(ids), step):
            b = min(a + step, len(ids))
            some, at = np.unique(ids[a:b], return_inverse=True)  # a term's direction is made once for these values
            directions = self.directions(some)
            for r in range(np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b, "left")):
                lo, hi = max(starts[r], a), min(starts[r + 1], b)
                if lo < hi:
                    out[r] += values[lo:hi] @ directions[at[lo - a:hi - a]]
        return np.sqrt(2 / self.width) * np.cos(out)

    def map(self, packed: DataFrame, key: str, weights: np.ndarray | None = None) -> DataFrame:
        return _mapped(packed, key, self.images, weights)


def _hashed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit integers."""
    return ((_hashed(x) >> np.uint64(11)).astype(np.float64) + 1) / 2.0 ** 53


def _share(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 24-bit integers."""
    return (bits.astype(np.int32) + 1).astype(np.float32) * np.float32(2.0 ** -24)


@dataclass
class KernelModel:
    """A fitted map, the IDF table of its terms (None for counts), and the linear model on its images."""

    kind: str
    map: Landmarks | FourierFeatures
    idf: DataFrame | None
    linear: svm.LinearModel

    def images(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``(key, value)``, the image as an array."""
        return self.map.map(packed_rows(df, key, text, self.idf), key)

    def features(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """``(key, token, value)``: the images in long form."""
        return self.images(df, key, text).select(key, F.posexplode("value").alias("token", "value")).withColumn("token", F.col("token").cast("string"))

    def predict(self, df: DataFrame, key: str, text: str, keep=(), out: str = "prediction") -> DataFrame:
        weights = svm.image_weights(self.linear)[:-1] if self.linear.tasks else None
        margins = self.map.map(packed_rows(df, key, text, self.idf), key, weights)
        return svm.predict_svm(self.linear, margins, df.select(key, *keep), key, "value", out=out)

    def save(self, path: str) -> None:
        spark = self.linear.weights.sparkSession
        arrays = {k: v.tolist() for k, v in vars(self.map).items() if isinstance(v, np.ndarray) and k != "root"}
        if self.kind == "landmarks":
            arrays |= {"root": self.map.root.ravel().tolist()}
        rows = [(k, [float(x) for x in v] if k in ("value", "square", "root") else None, None if k in ("value", "square", "root") else v) for k, v in arrays.items()]
        spark.createDataFrame(rows, "name string, d array<double>, l array<long>").coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")
        numbers = [(self.kind, self.map.gamma, getattr(self.map, "width", 0), getattr(self.map, "seed", 0), self.idf is not None)]
        spark.createDataFrame(numbers, "kind string, gamma double, width int, seed long, idf boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/map")
        if self.idf is not None:
            self.idf.write.mode("overwrite").parquet(f"{path}/idf")
        self.linear.save(f"{path}/linear")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KernelModel:
        one = spark.read.parquet(f"{path}/map").first()
        idf = spark.read.parquet(f"{path}/idf") if one["idf"] else None
        if one["kind"] == "landmarks":
            a = {r["name"]: np.array(r["d"] if r["d"] is not None else r["l"], dtype=float if r["d"] is not None else np.int64) for r in spark.read.parquet(f"{path}/arrays").collect()}
            m = len(a["square"])
            fitted = Landmarks(a["terms"], a["begins"], a["owner"], a["value"], a["square"], a["root"].reshape(m, m), one["gamma"])
        else:
            fitted = FourierFeatures(one["width"], one["gamma"], one["seed"])
        return cls(one["kind"], fitted, idf, svm.LinearModel.load(spark, f"{path}/linear"))


def fit_kernel_svm(train: DataFrame, key: str, text: str, label: str, kind: str = "landmarks", weighting: str = "count", width: int | None = None,
                   gamma: float | str = "scale", against: str = "pairs", c: float = 1.0, seed: int = 42, **kw) -> tuple[KernelModel, DataFrame]:
    """The model and its training rows (for ``svm.certificate``)."""
    idf = idf_table(train, text) if weighting == "tfidf" else None
    packed = cut_lineage(packed_rows(train, key, text, idf), "packed")
    g = scale_gamma(packed) if gamma == "scale" else float(gamma)
    fitted = choose_landmarks(packed, key, width or MOST_LANDMARKS, g, seed) if kind == "landmarks" else FourierFeatures(width or RFF_COMPONENTS, g, seed)
    rows, classes = svm.training_rows(fitted.map(packed, key), train, key, label, "value")
    return KernelModel(kind, fitted, idf, svm.fit_svm(rows, classes, against, c, **kw)), rows
