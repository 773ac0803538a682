"""Global positions, seeded shuffles, exact splits, sampling and batching.

A global ``row_number()`` over an un-partitioned window moves every row into
one task.  Positions are computed without one, in two ways:

* seeded orders: the md5 rank key is uniform, so its leading 16 bits are a
  *bucket* (at most 65,536 per stratum); a histogram of the buckets gives
  offsets, and rows are numbered inside their bucket;
* orders of the data's own keys: rows are range-partitioned by the key (bounds
  sampled from the data, so outliers, gaps and scripts do not matter) and
  numbered where they lie; a count per partition gives offsets.

Both equal a single global sort.  NULL keys sort first and keep their rows;
NULL labels are a stratum of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.functions.hashing import hex_bucket, seeded_md5
from lexiframe.session import cut_lineage

# Fixed value: leading hex digits of the md5 rank key used as bucket (16 bits).
BUCKET_HEX_DIGITS = 4
MAX_BUCKETS = 16 ** BUCKET_HEX_DIGITS

_B, _N, _OFF, _TOT = "_lf_bucket", "_lf_n", "_lf_offset", "_lf_total"


def _cols(cols) -> list:
    if cols is None:
        return []
    if isinstance(cols, (str, Column)):
        return [cols]
    return list(cols)


def global_row_number(df: DataFrame, order_cols, bucket: Column, out: str = "rn",
                      partition_cols: Sequence[str] = (), total_col: str | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (within ``partition_cols``).

    ``bucket`` must be monotone in the order: if row a sorts before row b then
    bucket(a) <= bucket(b).  ``total_col`` optionally receives the row count of
    the row's partition (stratum).
    """
    parts = list(partition_cols)
    keyed = df.withColumn(_B, bucket)
    grp = parts + [_B]
    hist = keyed.groupBy(*grp).agg(F.count(F.lit(1)).alias(_N))
    before = Window.partitionBy(*parts).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(*grp, F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_OFF),
                          *( [F.sum(_N).over(Window.partitionBy(*parts)).alias(_TOT)] if total_col else []))
    if not parts:
        # At most MAX_BUCKETS rows of (int, long): a proven bound, so broadcast.
        offsets = F.broadcast(offsets)
    # With strata the table is bounded by strata x buckets; AQE broadcasts it
    # at runtime when it is small and shuffles it otherwise.
    ranked = null_safe_join(keyed, offsets, grp)
    within = Window.partitionBy(*grp).orderBy(*_cols(order_cols))
    ranked = ranked.withColumn(out, (F.col(_OFF) + F.row_number().over(within) - 1).cast("bigint"))
    if total_col:
        ranked = ranked.withColumnRenamed(_TOT, total_col)
    return ranked.drop(_B, _OFF)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the keys appear once."""
    names = {k: f"_lf_right_{i}" for i, k in enumerate(keys)}
    renamed = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(renamed, reduce(lambda x, y: x & y, on), how).drop(*names.values())


def range_rank(df: DataFrame, order_cols, out: str = "rn") -> DataFrame:
    """Dense 0-based position of each row in ``order_cols`` order, for keys of
    any distribution.

    Runs two jobs: the rows are range-partitioned, sorted, numbered where they
    lie and written once (a second evaluation might sample other bounds);
    offsets come from one row per partition.  Pass only the columns needed.
    Rows with equal keys are numbered in any order.
    """
    cols = _cols(order_cols)
    at = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_lf_at", F.monotonically_increasing_id())
    # monotonically_increasing_id: partition in the upper 31 bits, place in the lower 33
    placed = (at.withColumn("_lf_part", F.shiftright("_lf_at", 33))
              .withColumn("_lf_place", F.col("_lf_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_lf_at"))
    placed = cut_lineage(placed, "range-rank")
    sizes = placed.groupBy("_lf_part").agg(F.count(F.lit(1)).alias(_N))
    before = Window.orderBy("_lf_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_lf_part", F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_OFF))
    ranked = placed.join(offsets, "_lf_part")
    return ranked.withColumn(out, (F.col(_OFF) + F.col("_lf_place")).cast("bigint")).drop("_lf_part", "_lf_place", _OFF)


def md5_rank(df: DataFrame, key: str, seed, out: str = "rank",
             partition_cols: Sequence[str] = (), total_col: str | None = None) -> DataFrame:
    """Position in the seeded permutation ordered by md5('seed:key'), then key."""
    h = "_lf_h"
    keyed = df.withColumn(h, seeded_md5(seed, key))
    bucket = F.coalesce(hex_bucket(F.col(h), BUCKET_HEX_DIGITS), F.lit(-1))  # NULL keys sort first
    ranked = global_row_number(keyed, [F.col(h), F.col(key)], bucket,
                               out=out, partition_cols=partition_cols, total_col=total_col)
    return ranked.drop(h)


def position_rank(df: DataFrame, pos: str, out: str = "rn") -> DataFrame:
    """Dense 0-based position of each row by a key of the data."""
    return range_rank(df, pos, out)


# --------------------------------------------------------------------------
# Shuffle, fetch, head
# --------------------------------------------------------------------------

def seeded_shuffle(df: DataFrame, key: str, seed=42, out: str = "shuffle_rank") -> DataFrame:
    """Seeded full permutation: ``out`` is each row's place in the new order."""
    return md5_rank(df, key, seed, out=out)


def row_at(df: DataFrame, pos: str, i: int) -> DataFrame:
    """The row at 0-based position ``i`` in ``pos`` order (``iloc[i]``).

    Only the keys are ranked; the row is fetched by its key (one row, so
    broadcast).  Of rows that share the key, the one that comes first is taken.
    """
    at = range_rank(df.select(pos), pos, "_lf_rn").filter(F.col("_lf_rn") == i).select(F.col(pos).alias("_lf_key"))
    return df.join(F.broadcast(at), F.col(pos).eqNullSafe(F.col("_lf_key"))).drop("_lf_key").limit(1)


def first_n(df: DataFrame, order_cols, n: int) -> DataFrame:
    """First ``n`` rows in order (``head(n)``): a bounded top-n, per-task then merged."""
    return df.orderBy(*_cols(order_cols)).limit(n)


def head_per_label(df: DataFrame, label: str, pos: str, k: int = 20, out: str = "rank_in_label") -> DataFrame:
    """First ``k`` rows of every label in ``pos`` order.

    Planned as a partial WindowGroupLimit before the shuffle, so a hot label
    sends at most k rows per input partition through the exchange.
    """
    w = Window.partitionBy(label).orderBy(pos)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


# --------------------------------------------------------------------------
# Exact-size splits and balanced sampling
# --------------------------------------------------------------------------

def _n_from_fraction(fraction: float, n: Column, rounding: str) -> Column:
    x = F.lit(float(fraction)) * n.cast("double")
    return (F.ceil(x) if rounding == "ceil" else F.floor(x)).cast("bigint")


_H, _K = "_lf_h", "_lf_k"


def _split_hash(seed, key: str) -> Column:
    """The rank key of a split; a row without a key has no place, which is an error."""
    missing = F.raise_error(F.lit(f"NULL in split key {key}")).cast("string")
    return F.coalesce(seeded_md5(seed, key), missing)


def rank_boundaries(df: DataFrame, key: str, seed, label: str | None,
                    cuts: Callable[[Column], dict]) -> DataFrame:
    """Per stratum, the (hash, key) of the row at each cut rank.

    ``cuts(n)`` maps a cut name to a 0-based rank expression given the
    stratum size ``n``; a row lies before cut c exactly when its
    (md5, key) is smaller than the boundary (NULL boundary = cut at or past
    the end).  Only the ids are read; of the rows, only the bucket holding
    each cut is sorted, so the work is a histogram plus a few small sorts.
    """
    parts = [label] if label else []
    keyed = df.select(*parts, F.col(key).alias(_K), _split_hash(seed, key).alias(_H))
    keyed = keyed.withColumn(_B, hex_bucket(F.col(_H), BUCKET_HEX_DIGITS))
    hist = keyed.groupBy(*parts, _B).agg(F.count(F.lit(1)).alias(_N))
    before = Window.partitionBy(*parts).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(*parts, _B, _N, F.coalesce(F.sum(_N).over(before), F.lit(0)).alias(_OFF),
                          F.sum(_N).over(Window.partitionBy(*parts)).alias(_TOT))
    cut_map = cuts(F.col(_TOT))
    names = list(cut_map)
    cut_rows = F.explode(F.array(*[F.struct(F.lit(nm).alias("cut"), cut_map[nm].cast("bigint").alias("r"))
                                   for nm in names]))
    targets = (offsets.select(*parts, _B, _N, _OFF, cut_rows.alias("_lf_c"))
               .select(*parts, _B, _OFF, "_lf_c.cut", "_lf_c.r", _N)
               .filter((F.col("r") >= F.col(_OFF)) & (F.col("r") < F.col(_OFF) + F.col(_N))))
    # The target table (strata x cuts rows) is written first so the planner
    # broadcasts it by its measured size: the join is then a local filter and
    # only the rows of the few hit buckets reach the window's shuffle.
    targets = cut_lineage(targets.select(*parts, _B, "cut", "r", _OFF), "rank-targets")
    hit = null_safe_join(keyed, targets, parts + [_B])
    w = Window.partitionBy(*parts, _B, "cut").orderBy(_H, _K)
    at = (hit.withColumn("_lf_rn", F.col(_OFF) + F.row_number().over(w) - 1)
          .filter(F.col("_lf_rn") == F.col("r"))
          .select(*parts, "cut", F.struct(F.col(_H).alias("h"), F.col(_K).alias("k")).alias("at")))
    # A stratum (or cut) without a boundary row has its cut at or past its end:
    # the left join in _attach turns the missing boundary into NULL = "before".
    # NULL labels are a stratum with boundaries like any other.
    wide = at.groupBy(*parts).pivot("cut", names).agg(F.first("at"))
    return wide.select(*parts, *names)


def _before(boundary: Column, h: Column, k: Column) -> Column:
    """Row (h, k) sorts before the boundary; a NULL boundary means 'everything'."""
    return boundary.isNull() | (F.struct(h.alias("h"), k.alias("k")) < boundary)


def _attach(df: DataFrame, bounds: DataFrame, label: str | None) -> DataFrame:
    # With strata: the boundary table (one row per stratum, computed from the
    # ids only) is written to the shared checkpoint folder first.  The planner
    # then knows its real size: it is broadcast when under the broadcast
    # threshold, so the rows (with their text) never move, and joined by a
    # shuffle otherwise.  Without strata the single row is attached by a
    # scalar subquery per cut instead of a join.
    if label:
        return null_safe_join(df, cut_lineage(bounds, "split-bounds"), [label], "left")
    out = df
    for c in bounds.columns:
        out = out.withColumn(c, bounds.select(c).scalar())
    return out


def split_two_way(df: DataFrame, key: str, seed=42, test_size: float | None = None,
                  train_size: float | None = None, out: str = "split") -> DataFrame:
    """Seeded two-way split with exact sizes.

    ``test_size`` gives ``ceil(test_size*n)`` test rows; ``train_size`` alone
    gives ``floor(train_size*n)`` train rows; the rest go to the other side.
    Both computed in DOUBLE arithmetic.  The first rows of the seeded order
    are the test rows.
    """
    if test_size is None and train_size is None:
        test_size = 0.25

    def cuts(n):
        if test_size is not None:
            return {"_lf_c1": _n_from_fraction(test_size, n, "ceil")}
        return {"_lf_c1": n - _n_from_fraction(train_size, n, "floor")}

    bounds = rank_boundaries(df, key, seed, None, cuts)
    h = _split_hash(seed, key)
    tagged = _attach(df, bounds, None)
    return (tagged.withColumn(out, F.when(_before(F.col("_lf_c1"), h, F.col(key)), "test").otherwise("train"))
            .drop("_lf_c1"))


def stratified_split(df: DataFrame, key: str, label: str, seed=42, test_size: float = 0.3,
                     val_size: float | None = 2 / 7, out: str = "split") -> DataFrame:
    """Per-label exact split: test first, then validation out of the rest.

    For a label with n rows: ``n_test = ceil(test_size*n)``,
    ``n_val = ceil(val_size*(n-n_test))``, the rest is train, following the
    seeded md5 order inside the label.  The rows themselves are never
    shuffled: each compares its own (md5, key) with its label's two
    boundaries (see ``rank_boundaries``).
    """
    def cuts(n):
        n_test = _n_from_fraction(test_size, n, "ceil")
        c = {"_lf_c1": n_test}
        if val_size is not None:
            c["_lf_c2"] = n_test + _n_from_fraction(val_size, n - n_test, "ceil")
        return c

    bounds = rank_boundaries(df, key, seed, label, cuts)
    h = _split_hash(seed, key)
    tagged = _attach(df, bounds, label)
    split = F.when(_before(F.col("_lf_c1"), h, F.col(key)), "test")
    if val_size is not None:
        split = split.when(_before(F.col("_lf_c2"), h, F.col(key)), "val")
    cols = [c for c in ("_lf_c1", "_lf_c2") if c in bounds.columns]
    return tagged.withColumn(out, split.otherwise("train")).drop(*cols)


def min_class_size(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("min_class_size"))


def balanced_downsample(df: DataFrame, key: str, label: str, seed=42) -> DataFrame:
    """Every label cut to the smallest label's size by the seeded order."""
    m = min_class_size(df, label).scalar()
    bounds = rank_boundaries(df, key, seed, label, lambda n: {"_lf_c1": m})
    tagged = _attach(df, bounds, label)
    return tagged.filter(_before(F.col("_lf_c1"), _split_hash(seed, key), F.col(key))).drop("_lf_c1")


def balanced_split(df: DataFrame, key: str, label: str, seed=42, test_size: float = 0.3,
                   val_size: float | None = 2 / 7, out: str = "split") -> DataFrame:
    """Balanced down-sample, then the stratified split of the kept rows."""
    kept = balanced_downsample(df, key, label, seed)
    return stratified_split(kept, key, label, seed, test_size, val_size, out)


def select_stage(df: DataFrame, stage: str, split_col: str = "split") -> DataFrame:
    """fit -> train and val rows; test / predict -> test rows."""
    wanted = {"fit": ["train", "val"], "validate": ["val"], "test": ["test"], "predict": ["test"]}[stage]
    return df.filter(F.col(split_col).isin(wanted))


# --------------------------------------------------------------------------
# Batches
# --------------------------------------------------------------------------

def assign_batches(df: DataFrame, pos: str, batch_size: int, out: str = "batch_id",
                   seed=None, key: str | None = None) -> DataFrame:
    """``batch_id = floor(position / batch_size)``; the last batch may be short.

    Position is the ``pos`` order, or the seeded permutation of ``key`` when a
    seed is given (a shuffled epoch).
    """
    if seed is None:
        ranked = position_rank(df, pos, out="_lf_pos")
    else:
        ranked = md5_rank(df, key or pos, seed, out="_lf_pos")
    return (ranked.withColumn(out, F.floor(F.col("_lf_pos") / batch_size).cast("bigint"))
            .withColumn("pos_in_batch", (F.col("_lf_pos") % batch_size).cast("int"))
            .drop("_lf_pos"))
