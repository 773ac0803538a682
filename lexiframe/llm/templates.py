"""Benchmark decontamination by template windows (native: DataFrame functions only).

Texts become templates: every run of other characters is one space, letters
and digits make tokens, and tokens are typed - numbers, names (a capital
followed by small letters) and units after a number become placeholders, the
rest is lower-cased.  Every token is hashed once, and the hashes of ``WINDOW``
tokens in a row are made by doubling (of two, four, eight), for the template and for
the text's own words (in small letters).

A window of the benchmark with at least ``MIN_LITERALS`` tokens that are not
placeholders meets documents by its template, so a question with other numbers,
names or units still meets its original; such a meeting counts only if its slots
agree: within one copy (document, item, distance between the two places) each value
of the original must stand for one value of the document.  Any other window meets by
its own words only, so tables of numbers do not all meet.  An item is leaked when
windows that meet cover ``MIN_COVERAGE`` of its windows, or of those with enough
literals, or when ``RUN`` of its own words in a row stand in a document (windows of
own words that meet one after the other), whatever its length.

Items shorter than a window are searched as one window of their own length; items of
fewer than ``WHOLE`` tokens are leaked only by a document that has no other tokens.

Scale: windows leave their document as a hash and a place.  They meet the benchmark's
distinct hashes first (broadcast up to a checked number, beyond it by shuffle: the
same join, the same rows) and the few that remain its windows; the texts of the few documents that meet are read once more for
their slots.

Defined results: NULL and empty texts meet nothing; rows that share an id (or have
none) are judged apart unless their texts are equal too, and equal rows are one
document; repeated items are one, items that share an id are reported each; of tied
slot values the smallest counts; very long texts are searched whole; an empty table
on either side gives no rows; other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiframe.llm.presence import split_by
from lexiframe.llm.storage import table, written

WINDOW, MIN_LITERALS, MIN_COVERAGE, RUN, WHOLE = 8, 5, 0.4, 13, 4
#: Kinds of windows: by template, by own words.
TYPED, WORDS = 0, 1
#: At most so many hashes of benchmark windows (8 bytes each) are broadcast; more are joined by shuffle, with the same rows.
BROADCAST_HASHES = 2_000_000
#: Unit words (lower case), typed as units after a number.
UNITS = ("cm dm ft g gb h hz in kb kg km l lb lbs m mb mg min ml mm mph ms oz s sec t tb yd "
         "cent cents day days dollar dollars euro euros feet foot gram grams hour hours inch inches "
         "kilogram kilograms kilometer kilometers kilometre kilometres liter liters litre litres meter meters "
         "metre metres mile miles minute minutes month months percent pound pounds second seconds "
         "ton tons usd week weeks yard yards year years").split()
NUMBER, NAME, UNIT = "#n", "#p", "#u"
_EDGE = r"(?<![\p{L}\p{N}])"


def clean(text: Column) -> Column:
    """Letters and digits with single spaces between; marks inside a number go."""
    joined = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?<=[0-9])[.,](?=[0-9])", "")
    return F.trim(F.regexp_replace(joined, r"[^\p{L}\p{N}]+", " "))


def template(cleaned: Column) -> Column:
    """The typed text: as many tokens as ``cleaned``."""
    numbers = F.regexp_replace(cleaned, _EDGE + r"[0-9][\p{L}\p{N}]*", NUMBER)
    units = F.regexp_replace(numbers, rf"(?<={NUMBER} )(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.lower(F.regexp_replace(units, r"(?<![\p{L}\p{N}#])\p{Lu}\p{Ll}[\p{L}\p{N}]*", NAME))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def hashes(t: Column, kind) -> Column:
    """Token hashes that differ between the kinds of windows."""
    return F.transform(t, lambda x: F.xxhash64(x, kind))


def longer(h: Column, size: int, other: Column, other_size: int) -> Column:
    """Hashes of windows of ``size + other_size`` tokens from those of the two parts."""
    n = F.size(h) - other_size
    pair = F.zip_with(F.slice(h, 1, F.greatest(n, F.lit(0))), F.slice(other, size + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(n > 0, pair).otherwise(F.array().cast("array<bigint>"))


def with_window_hashes(rows: DataFrame, column: str, sizes: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """Add, per size, the hashes of all windows of token hashes in ``column``;
    sizes are put together from powers of two, so a power is made once."""
    at = {1: column}
    for size in [k for k in (2, 4, 8) if k <= max(sizes)]:
        half = F.col(at[size // 2])
        rows = rows.withColumn(f"{column}{size}", longer(half, size // 2, half, size // 2))
        at[size] = f"{column}{size}"
    for size in sizes:
        if size not in at:
            high = 4 if size > 4 else 2
            low = size - high
            if low not in at:
                rows = rows.withColumn(f"{column}{low}", longer(F.col(at[2]), 2, F.col(at[1]), 1))
                at[low] = f"{column}{low}"
            rows = rows.withColumn(f"{column}{size}", longer(F.col(at[high]), high, F.col(at[low]), low))
            at[size] = f"{column}{size}"
    return rows, at


def is_slot(token: Column) -> Column:
    return F.substring(token, 1, 1) == "#"


def places(h: Column, size: int, kind: int) -> Column:
    return F.transform(h, lambda x, i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.lit(kind).alias("kind"), x.alias("hash")))


def typed_tokens(rows: DataFrame) -> DataFrame:
    """Add template tokens ``_t`` and own words ``_r`` of the clean text ``_c``."""
    return rows.withColumn("_t", tokens(template(F.col("_c")))).withColumn("_r", tokens(F.lower("_c")))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(hash, size, kind, counts, item_id, item_key, item_at, item_tokens, item_raw,
    item_windows, item_typed)``; the two arrays hold the window's template and its own
    words, ``counts`` says that a window by own words is one without enough
    literals, and the last columns count the item's windows."""
    t = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("_x")).distinct()
    t = typed_tokens(t.select("item_id", F.xxhash64("_x").alias("item_key"), clean(F.col("_x")).alias("_c")))
    size = F.least(F.size("_t"), F.lit(WINDOW))
    starts = F.when(size > 0, F.sequence(F.lit(0), F.size("_t") - size)).otherwise(F.array().cast("array<int>"))
    t = t.withColumn("size", size).withColumn("item_at", F.explode(starts)).select(
        "item_id", "item_key", "size", "item_at", F.slice("_t", F.col("item_at") + 1, F.col("size")).alias("item_tokens"),
        F.slice("_r", F.col("item_at") + 1, F.col("size")).alias("item_raw"))
    few = F.size(F.filter("item_tokens", lambda x: ~is_slot(x))) < MIN_LITERALS
    one = t.groupBy("item_id", "item_key").agg(F.count("*").alias("item_windows"), F.count_if(~few).alias("item_typed")).select(
        F.col("item_id").alias("_i"), F.col("item_key").alias("_k"), "item_windows", "item_typed")
    t = t.join(one, F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("item_key") == F.col("_k"))).drop("_i", "_k")
    kinds = F.array(F.struct(F.lit(TYPED).alias("kind"), (~few).alias("use")), F.struct(F.lit(WORDS).alias("kind"), F.lit(True).alias("use")))
    t = t.withColumn("_q", F.explode(F.filter(kinds, lambda x: x["use"]))).select("*", F.col("_q.kind").alias("kind"), few.alias("counts"))
    t = t.withColumn("_h", hashes(F.when(F.col("kind") == TYPED, F.col("item_tokens")).otherwise(F.col("item_raw")), F.col("kind")))
    out = None
    for k in range(1, WINDOW + 1):
        part, at = with_window_hashes(t.filter(F.col("size") == k), "_h", [k])
        part = part.withColumn("hash", F.get(at[k], F.lit(0))).drop("_q", *[c for c in part.columns if c.startswith("_h")])
        out = part if out is None else out.unionByName(part)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, doc_key, _x)``; equal ids and texts share a key, and their verdict."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text).alias("doc_key"), text.alias("_x"))


def meetings(docs: DataFrame, id_col: str, text_col: str, bench: DataFrame) -> DataFrame:
    """``(doc_id, doc_key, at, raw, item ...)``: one row per window of a document that meets one of the benchmark."""
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect()) or [WINDOW]  # at most WINDOW values
    d = keyed(docs, id_col, text_col)
    h = typed_tokens(d.select("doc_id", "doc_key", clean(F.col("_x")).alias("_c"))).select(
        "doc_id", "doc_key", hashes(F.col("_t"), F.lit(TYPED)).alias("_t"), hashes(F.col("_r"), F.lit(WORDS)).alias("_r"))
    every = []
    for column, kind in (("_t", TYPED), ("_r", WORDS)):
        use = [k for k in sizes if kind == WORDS or k >= MIN_LITERALS]
        if not use:
            continue
        h, at = with_window_hashes(h, column, use)
        for k in use:
            p = places(F.col(at[k]), k, kind)
            every.append(p if k >= WHOLE else F.when(F.size("_t") == k, p))
    empty = F.array().cast("array<struct<at:int,size:int,kind:int,hash:bigint>>")
    lean = h.select("doc_id", "doc_key", F.explode(F.concat(*[F.coalesce(p, empty) for p in every])).alias("_w")).select("doc_id", "doc_key", "_w.*")
    keys = written(bench.select("hash").distinct(), "benchmark-hashes")
    known = F.broadcast(keys) if keys.count() <= BROADCAST_HASHES else keys
    met = written(lean.join(known, "hash", "left_semi").join(bench, ["hash", "size", "kind"]).drop("hash"), "met")
    # the texts of documents that meet by template, once each
    keys = written(met.filter(F.col("kind") == TYPED).select("doc_key").distinct(), "met-keys")  # its size is known to the planner
    texts = written(d.join(keys, "doc_key", "left_semi").select("doc_key", "_x").distinct(), "met-texts")
    texts = texts.select("doc_key", tokens(F.lower(clean(F.col("_x")))).alias("_r"))
    typed = met.filter(F.col("kind") == TYPED).join(texts, "doc_key").withColumn("raw", F.slice("_r", F.col("at") + 1, F.col("size"))).drop("_r")
    return typed.unionByName(met.filter(F.col("kind") == WORDS).withColumn("raw", F.col("item_raw")))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that leaked into it."""
    bench = written(benchmark_windows(items, item_col, item_text), "benchmark-windows")
    met = written(meetings(docs, id_col, text_col, bench), "meetings")
    found = ["doc_id", "doc_key", "item_id", "item_key"]
    copy = [*found, "_shift"]

    def same(p: str, q: str, columns: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{p}.{c}").eqNullSafe(F.col(f"{q}.{c}")) for c in columns])

    met = met.withColumn("_shift", F.col("at") - F.col("item_at"))
    slot = F.filter(F.arrays_zip(F.col("item_tokens").alias("t"), F.col("item_raw").alias("was"), F.col("raw").alias("now")),
                    lambda x: is_slot(x["t"]))
    typed = met.filter(F.col("kind") == TYPED)
    pairs = typed.select(*copy, "item_at", F.explode(slot).alias("s")).select(*copy, "item_at", "s.was", "s.now")
    # the value that stands for each original value most often in this copy; windows with another value do not count
    votes = pairs.groupBy(*copy, "was", "now").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*copy, "was").orderBy(F.desc("n"), "now")
    lost = votes.withColumn("_r", F.row_number().over(order)).filter("_r > 1").drop("_r", "n")
    bad = pairs.alias("p").join(lost.alias("q"), same("p", "q", [*copy, "was", "now"]), "left_semi").select(*copy, "item_at").distinct()
    good = typed.alias("p").join(bad.alias("q"), same("p", "q", [*copy, "item_at"]), "left_anti")
    # own words in a row: windows of a copy that follow each other
    words = met.filter((F.col("kind") == WORDS))
    steps = words.filter(F.col("size") == WINDOW).select(*copy, "item_at").distinct()
    island = F.col("item_at") - F.row_number().over(Window.partitionBy(*copy).orderBy("item_at"))
    runs = steps.withColumn("_island", island).groupBy(*copy, "_island").agg(F.count("*").alias("n")).filter(F.col("n") > RUN - WINDOW)
    row = words.alias("p").join(runs.alias("q"), same("p", "q", copy), "left_semi").withColumn("_row", F.lit(True))
    good = good.unionByName(words.filter("counts")).withColumn("_row", F.lit(False)).unionByName(row)
    changed = F.exists(F.zip_with("item_raw", "raw", lambda a, b: a != b), lambda x: x)
    met_at = F.when((F.col("kind") == TYPED) | F.col("counts"), F.col("item_at"))
    out = good.groupBy(*found).agg(
        F.max("item_windows").alias("item_windows"), F.count_distinct(met_at).alias("windows_met"),
        F.min("at").cast("long").alias("first_token"), F.max(changed).alias("reparameterised"),
        F.max("item_typed").alias("_typed"), F.count_distinct(F.when(F.col("kind") == TYPED, F.col("item_at"))).alias("_typed_met"),
        F.max("_row").alias("_row"))
    enough = F.col("windows_met") >= MIN_COVERAGE * F.col("item_windows")
    enough_typed = (F.col("_typed_met") > 0) & (F.col("_typed_met") >= MIN_COVERAGE * F.col("_typed"))
    return out.filter(enough | enough_typed | F.col("_row")).drop("_typed", "_typed_met", "_row")


def op10_template_leaks(spark, sf_dir):
    """Every document and benchmark item that leaked into it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("doc_key", "item_key")


def decontaminated(spark, docs, sf_dir):
    """Pipeline stage: documents into which an item leaked go; rows that share an id
    (or have none) are judged by their own texts."""
    found = leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")).distinct()
    found, key = written(found, "leaked"), F.xxhash64("doc_id", F.col("text").cast("string"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (key == F.col("_key"))
    may, stay = split_by(docs, key, found, "_key")  # only rows that may hold a leak move
    return stay.unionByName(may.join(found, same, "left_anti"))
