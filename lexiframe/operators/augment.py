"""Text augmentation: word swap, word deletion, random choice among
candidates, and translation through a caller-supplied batch translator.

Positions are chosen per row by rank of ``md5('seed:key:i')`` over the word
positions i: the ``n = max(1, floor(pct * words))`` lowest-ranked positions
are chosen (exactly n, reproducible, independent of partitioning).
  * swap: the chosen words rotate one step, in position order (each chosen
    position takes the next chosen position's word; the last takes the
    first's); the multiset of words is unchanged.
  * deletion: the chosen words are removed.
Everything is array higher-order functions on the row, O(words log words):
one sort of (hash, position, word) structs; the chosen words are its prefix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiframe.functions.hashing import hex_to_long, seeded_md5
from lexiframe.functions.text import whitespace_tokens
from lexiframe.operators.batching import pieces

# Share of words changed, and texts per translation request.
DEFAULT_PCT = 0.3
TRANSLATE_CHUNK = 32
#: Requests' worth of rows that a task turns into Python texts at a time.
PIECE_CHUNKS = 8


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ranked_words(text, key, seed) -> Column:
    """Words as structs ``(h, i, w)`` sorted by their seeded hash ``h``.

    The chosen words are then a prefix of this array and the rest its suffix,
    so no lambda has to look anything up outside its own element.
    """
    words = whitespace_tokens(text)
    return F.sort_array(F.transform(
        words, lambda w, i: F.struct(seeded_md5(seed, _c(key), i).alias("h"), i.alias("i"), w.alias("w"))))


def _n_chosen(n_words: Column, pct: float) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(float(pct)) * n_words.cast("double")).cast("int"))


def _by_position(structs: Column) -> Column:
    return F.sort_array(F.transform(structs, lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w"))))


def _join_words(structs: Column) -> Column:
    return F.array_join(F.transform(structs, lambda x: x["w"]), " ")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def _rotated(chosen: Column, rest: Column) -> Column:
    k = F.size(chosen)
    rotated = F.concat(F.slice(chosen, 2, F.greatest(k - 1, F.lit(0))), F.slice(chosen, 1, 1))
    moved = F.zip_with(chosen, rotated, lambda a, b: F.struct(a["i"].alias("i"), b["w"].alias("w")))
    return _join_words(F.sort_array(F.concat(moved, rest)))


def _swap_from_ranked(ranked: Column, pct: float) -> Column:
    size = F.size(ranked)
    n = _n_chosen(size, pct)
    # the last sort orders the rest as well
    rest = F.transform(F.slice(ranked, n + 1, F.greatest(size - n, F.lit(0))), lambda x: F.struct(x["i"].alias("i"), x["w"].alias("w")))
    swapped = _bound(_by_position(F.slice(ranked, 1, n)), lambda chosen: _rotated(chosen, rest))
    return F.when(size > 0, swapped).otherwise(F.lit(""))


def _delete_from_ranked(ranked: Column, pct: float) -> Column:
    size = F.size(ranked)
    n = _n_chosen(size, pct)
    rest = _by_position(F.slice(ranked, n + 1, F.greatest(size - n, F.lit(0))))
    return F.when(size > 0, _join_words(rest)).otherwise(F.lit(""))


_RANKED = "_lf_ranked"


def swap_words(df: DataFrame, text: str, key: str, out: str, seed=42, pct: float = DEFAULT_PCT) -> DataFrame:
    """Add ``out``: whitespace words with the chosen ones rotated, joined with
    single spaces.  The ranked word array is computed once per row (its own
    projection) and read several times."""
    ranked = df.withColumn(_RANKED, _ranked_words(text, key, seed))
    return ranked.withColumn(out, _swap_from_ranked(F.col(_RANKED), pct)).drop(_RANKED)


def delete_words(df: DataFrame, text: str, key: str, out: str, seed=42, pct: float = DEFAULT_PCT) -> DataFrame:
    """Add ``out``: whitespace words without the chosen ones."""
    ranked = df.withColumn(_RANKED, _ranked_words(text, key, seed))
    return ranked.withColumn(out, _delete_from_ranked(F.col(_RANKED), pct)).drop(_RANKED)


def swap_and_delete(df: DataFrame, text: str, key: str, swap_out: str, delete_out: str, seed=42,
                    pct: float = DEFAULT_PCT) -> DataFrame:
    """Both augmentations from one ranking of the words."""
    ranked = df.withColumn(_RANKED, _ranked_words(text, key, seed))
    return (ranked.withColumn(swap_out, _swap_from_ranked(F.col(_RANKED), pct))
            .withColumn(delete_out, _delete_from_ranked(F.col(_RANKED), pct)).drop(_RANKED))


def pick_one(candidates: Sequence, key, seed=42, salt: str = "pick") -> Column:
    """One of the non-NULL candidates, chosen by ``md5('seed:key:salt')``.

    The index is ``pmod(h, k)`` with h the digest's leading 32 bits and k the
    number of non-NULL candidates; NULL when there is none.
    """
    arr = F.filter(F.array(*[_c(c) for c in candidates]), lambda x: x.isNotNull())
    k = F.size(arr)
    h = hex_to_long(seeded_md5(seed, _c(key), F.lit(salt)))
    return F.when(k > 0, F.element_at(arr, (F.pmod(h, F.greatest(k, F.lit(1))) + 1).cast("int")))


def translate_wide(df: DataFrame, text: str, langs: Sequence[str],
                   translate: Callable[[list[str], str], list[str]], chunk: int = TRANSLATE_CHUNK,
                   prefix: str = "augmented_") -> DataFrame:
    """Add one ``augmented_<lang>`` column per language.

    ``translate(texts, lang)`` is called on chunks of ``chunk`` texts in row
    order within each partition, once per language, and must return one
    output per input; NULL texts are not sent and stay NULL.  All columns of
    ``df`` are kept and rows are emitted wide directly, so no pivot or join
    (and no shuffle) is needed.  The translator is a pure function of its
    input, so a retried task gives the same rows.
    """
    langs = list(langs)
    out_cols = [f"{prefix}{lang}" for lang in langs]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.StringType()) for c in out_cols]])

    def run(batches):
        for batch in pieces(batches, PIECE_CHUNKS * chunk):
            texts = batch.column(text).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            columns = []
            for lang in langs:
                translated: list = [None] * len(texts)
                for s in range(0, len(at), chunk):
                    part = at[s:s + chunk]
                    got = list(translate([texts[i] for i in part], lang))
                    if len(got) != len(part):
                        raise ValueError(f"translator returned {len(got)} texts for {len(part)}")
                    for i, t in zip(part, got, strict=True):
                        translated[i] = t
                columns.append(pa.array(translated, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *out_cols])

    return df.mapInArrow(run, schema)
