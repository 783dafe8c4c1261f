"""Area-name normalisation as column expressions.

* :func:`norm_name` - key normaliser: drop variation selectors, fold
  full-width ASCII and the ideographic space (the part of NFKC that area
  names use), strip spaces, kanji block number before the block suffix to
  digits, fold small kana and variant characters.
* :func:`norm_name_nfkc` - the same with complete NFKC; NFKC has no
  built-in, so it runs as an Arrow-batched pandas UDF and is meant for the
  distinct names of a dimension, joined back.
* :func:`kanji_number` - kanji numeral 1-99 to int (NULL when malformed).
* :func:`search_norm` - search-box normaliser: whitespace removed, a single
  kanji numeral before the block suffix anywhere becomes a digit.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from .. import constants as K

_DIGITS = K.KANJI_DIGITS
_NUMERAL_CLASS = f"[{K.KANJI_DIGITS}{K.KANJI_TEN}]"
# Full-width ASCII block U+FF01..U+FF5E -> U+0021..U+007E, ideographic space -> space.
_FW_FROM = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_FW_TO = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
_VARIATION_SELECTORS = "[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]"


def fold_width(c: Column) -> Column:
    return F.translate(c, _FW_FROM, _FW_TO)


def kanji_number(k: Column) -> Column:
    """'三' -> 3, '十' -> 10, '二十一' -> 21, '十五' -> 15; else NULL."""
    def digit(x: Column) -> Column:
        return F.when(F.length(x) == 1, F.instr(F.lit(_DIGITS), x))

    tens_s = F.substring_index(k, K.KANJI_TEN, 1)
    ones_s = F.substring_index(k, K.KANJI_TEN, -1)
    n_ten = F.length(k) - F.length(F.replace(k, F.lit(K.KANJI_TEN), F.lit("")))
    tens = F.when(tens_s == "", F.lit(1)).otherwise(digit(tens_s))
    ones = F.when(ones_s == "", F.lit(0)).otherwise(digit(ones_s))
    with_ten = F.when((tens > 0) & (ones >= 0) & ~((ones_s != "") & (ones == 0)),
                      tens * 10 + ones)
    single = F.when(digit(k) > 0, digit(k))
    return (F.when(n_ten == 1, with_ten).when(n_ten == 0, single)).cast("int")


def _block_to_digits(s: Column) -> Column:
    """Trailing '<kanji numeral>丁目' -> '<digits>丁目' (unchanged if malformed)."""
    pat = f"({_NUMERAL_CLASS}+){K.BLOCK_SUFFIX}$"
    num = F.regexp_extract(s, pat, 1)
    val = kanji_number(num)
    stem = F.regexp_replace(s, pat, "")
    return F.when((num != "") & val.isNotNull(),
                  F.concat(stem, val.cast("string"), F.lit(K.BLOCK_SUFFIX))).otherwise(s)


def _fold_tail(s: Column) -> Column:
    frm = "".join(a for a, _ in K.NAME_KANA_FOLDS + K.NAME_VARIANTS)
    to = "".join(b for _, b in K.NAME_KANA_FOLDS + K.NAME_VARIANTS)
    return F.translate(s, frm, to)


def _strip_spaces(s: Column) -> Column:
    return F.regexp_replace(F.trim(s), "[ 　]", "")


def norm_name(c: Column) -> Column:
    s = F.regexp_replace(c.cast("string"), _VARIATION_SELECTORS, "")
    s = fold_width(s)
    s = _strip_spaces(s)
    return _fold_tail(_block_to_digits(s))


@F.pandas_udf(Ty.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def norm_name_nfkc(c: Column) -> Column:
    s = F.regexp_replace(c.cast("string"), _VARIATION_SELECTORS, "")
    s = nfkc(s)
    s = F.regexp_replace(s, "^\\s+|\\s+$", "")
    s = F.regexp_replace(s, "[ 　]", "")
    return _fold_tail(_block_to_digits(s))


def display_name(c: Column) -> Column:
    """Display form: ideographic spaces removed, trimmed."""
    return F.trim(F.replace(c, F.lit("　"), F.lit("")))


def search_norm(c: Column) -> Column:
    s = nfkc(c.cast("string"))
    s = F.regexp_replace(s, "[\\s　]", "")
    values = list(_DIGITS) + [K.KANJI_TEN]
    for i, ch in enumerate(values, start=1):
        s = F.regexp_replace(s, f"(?<!{_NUMERAL_CLASS}){ch}{K.BLOCK_SUFFIX}",
                             f"{i}{K.BLOCK_SUFFIX}")
    return s


def ward_of(name: Column, wards) -> Column:
    """First ward name (in list order) that prefixes ``name``, else NULL."""
    import re
    alt = "|".join(re.escape(w) for w in wards)
    w = F.regexp_extract(name, f"^({alt})", 1)
    return F.when(w != "", w)


def with_norm_name(df, src: str, out: str):
    """:func:`norm_name` as successive columns: the cleaned text and the
    block numeral are computed once each (small generated code)."""
    pat = f"({_NUMERAL_CLASS}+){K.BLOCK_SUFFIX}$"
    d = df.withColumn("_nn_s", _strip_spaces(nfkc(
        F.regexp_replace(F.col(src).cast("string"), _VARIATION_SELECTORS, ""))))
    d = d.withColumn("_nn_num", F.regexp_extract("_nn_s", pat, 1))
    d = d.withColumn("_nn_val", kanji_number(F.col("_nn_num")))
    blk = F.when((F.col("_nn_num") != "") & F.col("_nn_val").isNotNull(),
                 F.concat(F.regexp_replace("_nn_s", pat, ""), F.col("_nn_val").cast("string"),
                          F.lit(K.BLOCK_SUFFIX))).otherwise(F.col("_nn_s"))
    return d.withColumn(out, _fold_tail(blk)).drop("_nn_s", "_nn_num", "_nn_val")
