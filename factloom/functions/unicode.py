"""Unicode normalisation, which Spark has no function for."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import columns as C

#: Characters without which a text is in NFC: marks, Hangul letters that join, and characters that have a canonical form elsewhere.
UNSTABLE = (
    r"[\p{M}\x{0374}\x{037E}\x{0387}\x{0958}-\x{095F}\x{09DC}-\x{09DF}\x{0A33}-\x{0A5E}\x{0B5C}-\x{0B5D}\x{0F43}-\x{0FB9}\x{1100}-\x{11FF}\x{1F00}-\x{1FFF}\x{2000}-\x{2001}\x{2126}-\x{212B}"
    r"\x{2329}-\x{232A}\x{2ADC}\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4E}\x{11000}-\x{11FFF}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]"
)


def nfc(s: Column) -> Column:
    """The text in NFC. Only texts that hold one of the ``UNSTABLE`` characters go to Python; null stays null."""

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(normal(F.when(s.rlike(UNSTABLE), s)), s)


def clean_text(s: Column) -> Column:
    return C.clean_text(nfc(s))
