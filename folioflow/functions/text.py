"""Text normalisation and tokens. Unicode forms need Python (Spark has no normaliser); all else stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions.ids import nfc

_BLANKS = "(?U)\\s+"
#: Signs that count as valid recognition output besides letters, digits and Hangul (fixed values).
VALID_SIGNS = ".,·:;!?%+-/()[]{}<>₩원년월일시분초"


@F.pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, " "))


def label_text(text: Column) -> Column:
    """A label in NFC with collapsed white space; null as empty."""
    return collapse(nfc(text))


def characters(text: Column) -> Column:
    """NFC without any white space."""
    return F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), _BLANKS, "")


def words(text: Column) -> Column:
    """NFC words between white space."""
    return F.regexp_extract_all(nfc(F.coalesce(text, F.lit(""))), F.lit("((?U)\\S+)"), 1)


def alphanumeric_tokens(text: Column) -> Column:
    """Runs of letters and digits in NFKC without case; ``_`` separates."""
    return F.regexp_extract_all(nfkc_casefold(F.coalesce(text, F.lit(""))), F.lit("([\\p{L}\\p{N}]+)"), 1)


#: A number with inner separators and an optional percent sign (fixed value).
NUMBER = "((?U)\\d+(?:[.,:/-]\\d+)*%?)"


def numeric_tokens(text: Column) -> Column:
    """Numbers with inner separators and an optional percent sign."""
    return F.regexp_extract_all(nfkc_casefold(F.coalesce(text, F.lit(""))), F.lit(NUMBER), 1)


#: Rewrites of Markdown to plain text, in order: images, links, tags, code blocks, headings, list marks, emphasis (fixed values).
MARKDOWN = (
    ("!\\[[^\\]]*\\]\\([^)]*\\)", " "),
    ("\\[([^\\]]+)\\]\\([^)]*\\)", "$1"),
    ("<[^>]+>", " "),
    ("(?s)```.*?```", " "),
    ("(?m)^\\s{0,3}#{1,6}\\s*", ""),
    ("(?m)^\\s*[-+>]\\s+", ""),
    ("[`*_~|]+", " "),
)


def markdown_text(markdown: Column) -> Column:
    """Plain text of Markdown: links and emphasis keep their text, white space is collapsed; null as empty."""
    text = nfc(F.coalesce(markdown, F.lit("")))
    for pattern, to in MARKDOWN:
        text = F.regexp_replace(text, pattern, to)
    return collapse(text)


def visible_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, ""))


def valid_ratio(text: Column) -> Column:
    """Share of visible characters that are letters, digits or usual signs; 0 for blank text."""
    signs = "".join("\\" + c if c in "[]{}()+-/.?^\\" else c for c in VALID_SIGNS)
    visible = F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, "")
    valid = F.length(F.regexp_replace(visible, f"[^\\p{{L}}\\p{{N}}{signs}]", ""))
    return F.coalesce(F.try_divide(valid, F.length(visible)), F.lit(0.0))


def result_text(result: Column) -> Column:
    """The Markdown of a recogniser's JSON result: an object's ``markdown_texts`` (a list is joined by line breaks), or the text itself."""
    listed = F.from_json(F.get_json_object(result, "$.markdown_texts"), "array<string>")
    single = F.get_json_object(result, "$.markdown_texts")
    whole = F.when(F.ltrim(result).startswith("{"), F.when(F.ltrim(single).startswith("["), F.array_join(listed, "\n")).otherwise(F.coalesce(single, F.lit(""))))
    return whole.otherwise(F.coalesce(result, F.lit("")))
