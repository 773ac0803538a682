"""Text column functions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's text rules.
# Bag-of-words token: a run of two or more word characters after lowercasing.
# Letters, digits and underscore only (combining marks excluded, as Python's
# str-based word class does).
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Whitespace split as Python's str.split() with no argument.
WHITESPACE_PATTERN = r"(?U)\s+"
# Separator used to join LIAR's statement and metadata columns.
SEP_TOKEN = " [SEP] "
# Text printed for a missing value when columns are joined as strings.
MISSING_TEXT = "nan"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_columns(cols, sep: str = " ", null_as: str | None = "") -> Column:
    """Join several columns with ``sep``; NULLs print as ``null_as``.

    ``concat_ws`` alone skips NULLs, which would shift the layout, so every
    input is coalesced first.  ``null_as=None`` keeps the skip behaviour.
    """
    parts = [_c(c).cast("string") for c in cols]
    if null_as is not None:
        parts = [F.coalesce(p, F.lit(null_as)) for p in parts]
    return F.concat_ws(sep, *parts)


def word_tokens(text) -> Column:
    """Lowercased word tokens (two or more word characters)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 0)


def whitespace_tokens(text) -> Column:
    """Whitespace split with empty pieces removed (Python ``str.split()``)."""
    return F.filter(F.split(_c(text), WHITESPACE_PATTERN), lambda x: x != "")


def word_count(text) -> Column:
    return F.size(whitespace_tokens(text))


def truncate(seq, max_length: int | None) -> Column:
    """Keep the first ``max_length`` elements; ``None`` keeps everything."""
    seq = _c(seq)
    return seq if max_length is None else F.slice(seq, 1, max_length)


def pad_to(seq, length, pad_value=0) -> Column:
    """Right-pad an array to ``length`` with ``pad_value``."""
    seq = _c(seq)
    missing = F.greatest(_c(length) - F.size(seq), F.lit(0))
    return F.concat(seq, F.array_repeat(F.lit(pad_value), missing))


def attention_mask(seq, length) -> Column:
    """1 for real positions, 0 for padding, total ``length``."""
    n = F.size(_c(seq))
    missing = F.greatest(_c(length) - n, F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), missing))


def with_prefix(prefix: str, c) -> Column:
    return F.concat(F.lit(prefix), _c(c).cast("string"))


def term_frequencies(text) -> Column:
    """The word tokens of a text with their counts, ``array<struct<token, tf>>`` in
    order of token: tokens are sorted inside the row and equal ones counted by
    the places where they begin, without an exchange."""
    def counted(tokens):
        n = F.size(tokens)
        begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(tokens, i - 1) != F.get(tokens, i - 2)))
        # the array is bound once more, so that each place sees the next
        return F.transform(F.array(begins), lambda b: F.transform(b, lambda i, k: F.struct(
            F.get(tokens, i - 1).alias("token"), (F.coalesce(F.get(b, k + 1), n + 1) - i).cast("long").alias("tf"))))[0]

    tokens = F.array_sort(word_tokens(text))
    empty = F.array().cast("array<struct<token:string,tf:bigint>>")
    return F.transform(F.array(tokens), lambda t: F.when(F.size(t) > 0, counted(t)).otherwise(empty))[0]
