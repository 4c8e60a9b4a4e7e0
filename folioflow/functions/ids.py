"""Identifiers of pages, volumes and members in their canonical spelling."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def narrow(text: Column) -> Column:
    """Full-width ASCII variants as ASCII, without leaving the JVM."""
    return F.translate(text, _WIDE, _NARROW)


def page_key(identifier: Column) -> Column:
    """A page identifier without letter case and separators; null stays null, blank becomes null."""
    key = F.regexp_replace(F.lower(narrow(identifier)), "[^0-9a-z\\p{L}]+", "")
    return F.when(key != "", key)


def volume_key(identifier: Column) -> Column:
    """The volume of a page identifier: its key without the page suffix."""
    return F.regexp_replace(page_key(identifier), "p[0-9]{1,4}$", "")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC (Spark has no built-in normaliser)."""
    return text.map(lambda t: t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def member_key(path: Column) -> Column:
    """An archive member path apart from slash direction, letter case and Unicode form."""
    return F.lower(nfc(F.replace(path, F.lit("\\"), F.lit("/"))))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)
