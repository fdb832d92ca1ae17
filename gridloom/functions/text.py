"""Text helpers for which Spark has no expression."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def exact_text(c: Column) -> Column:
    """Composed characters, runs of blanks as one, none outside. Only texts beyond ASCII go to Python."""
    nfc = F.pandas_udf(_nfc, StringType())
    composed = F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), nfc(c)).otherwise(c)
    return F.trim(F.regexp_replace(composed, r"[ \t\n\r]+", " "))


def _plain_upper(texts: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(texts)
    made = []
    for t in distinct:
        apart = unicodedata.normalize("NFKD", t.replace("ı", "i").replace("İ", "I"))
        made.append("".join(c for c in apart if not unicodedata.combining(c)).upper())
    made.append(None)
    return pd.Series([made[i] for i in codes], index=texts.index, dtype=object)


def plain_upper(c: Column) -> Column:
    """Compatibility forms apart, marks off, dotless and dotted i as one, upper case; once per distinct
    value of a batch. Only texts beyond ASCII go to Python."""
    plain = F.pandas_udf(_plain_upper, StringType())
    return F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), plain(c)).otherwise(F.upper(c))
