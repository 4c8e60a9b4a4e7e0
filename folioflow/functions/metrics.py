"""Recognition metrics: character and word error rates, order-independent token scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import alphanumeric_tokens, characters, numeric_tokens, words


#: Distinct tokens of a pair that characters below the surrogates can stand for (from U+0100 on).
MOST_TOKENS = 0xD800 - 0x100


def error_rate(distance: Column, reference_size: Column, hypothesis_size: Column) -> Column:
    """distance / reference size; an empty reference gives 0 for an empty hypothesis, else 1. May exceed 1."""
    return F.when(reference_size == 0, F.when(hypothesis_size == 0, 0.0).otherwise(1.0)).otherwise(distance / reference_size)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    a, b = characters(reference), characters(hypothesis)
    return error_rate(F.levenshtein(a, b), F.length(a), F.length(b))


def _as_characters(tokens: Column, known: Column) -> Column:
    """Tokens as one character each, by their place among the distinct tokens of both sides."""
    return F.array_join(F.transform(tokens, lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, t) + 255), 4, "0")), "UTF-16BE")), "")


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance over tokens: distinct tokens are mapped to characters, then compared by the built-in function.

    A pair with more than MOST_TOKENS distinct tokens is an error.
    """
    known = F.array_distinct(F.concat(a, b))
    distance = F.levenshtein(_as_characters(a, known), _as_characters(b, known))
    return F.when(F.size(known) > MOST_TOKENS, F.raise_error(F.lit(f"a pair of more than {MOST_TOKENS} distinct tokens has no token distance")).cast("int")).otherwise(distance)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Of word arrays (columns that hold ``words`` of both texts)."""
    return error_rate(token_distance(reference, hypothesis), F.size(reference), F.size(hypothesis))


def f_scores(matched: Column, references: Column, hypotheses: Column) -> list[Column]:
    """precision, recall, f1. A side without tokens scores 1 if the other has none either, else 0; f1 is 0 if both are."""
    precision = F.when(hypotheses == 0, F.when(references == 0, 1.0).otherwise(0.0)).otherwise(matched / hypotheses)
    recall = F.when(references == 0, F.when(hypotheses == 0, 1.0).otherwise(0.0)).otherwise(matched / references)
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / F.when(precision + recall == 0, 1.0).otherwise(precision + recall))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def multiset_scores(pairs: DataFrame, key: list[str], reference: Column, hypothesis: Column) -> DataFrame:
    """(key, precision, recall, f1, matched, references, hypotheses) of token multisets, however many tokens a pair has.

    Tokens are counted by (key, token) with map-side combining; pairs without tokens keep their row. Keys are unique.
    """
    tagged = pairs.select(*key, F.explode_outer(F.concat(F.transform(reference, lambda t: F.struct(t.alias("t"), F.lit(1).alias("r"), F.lit(0).alias("h"))), F.transform(hypothesis, lambda t: F.struct(t.alias("t"), F.lit(0).alias("r"), F.lit(1).alias("h"))))).alias("_k"))
    counted = tagged.groupBy(*key, "_k.t").agg(F.sum(F.coalesce("_k.r", F.lit(0))).alias("_r"), F.sum(F.coalesce("_k.h", F.lit(0))).alias("_h"))
    summed = counted.groupBy(*key).agg(F.sum(F.least("_r", "_h")).alias("matched"), F.sum("_r").alias("references"), F.sum("_h").alias("hypotheses"))
    return summed.select(*key, *f_scores(F.col("matched"), F.col("references"), F.col("hypotheses")), "matched", "references", "hypotheses")


def word_scores(pairs: DataFrame, key: list[str], reference: str, hypothesis: str) -> DataFrame:
    return multiset_scores(pairs, key, alphanumeric_tokens(F.col(reference)), alphanumeric_tokens(F.col(hypothesis)))


def numeric_scores(pairs: DataFrame, key: list[str], reference: str, hypothesis: str) -> DataFrame:
    return multiset_scores(pairs, key, numeric_tokens(F.col(reference)), numeric_tokens(F.col(hypothesis)))


def score_bundle(pairs: DataFrame, key: list[str], reference: str, hypothesis: str, elapsed_ms: str) -> DataFrame:
    """cer, wer, word_f1, numeric_f1 (4 digits), ms (2 digits) and visible characters of each pair."""
    rates = pairs.select("*", words(F.col(reference)).alias("_r"), words(F.col(hypothesis)).alias("_h")).select(
        *key, F.round(character_error_rate(F.col(reference), F.col(hypothesis)), 4).alias("cer"), F.round(word_error_rate(F.col("_r"), F.col("_h")), 4).alias("wer"),
        F.round(elapsed_ms, 2).alias("ms"), F.length(characters(F.col(hypothesis))).alias("characters"),
    )
    by_word = word_scores(pairs, key, reference, hypothesis).select(*key, F.round("f1", 4).alias("word_f1"))
    by_number = numeric_scores(pairs, key, reference, hypothesis).select(*key, F.round("f1", 4).alias("numeric_f1"))
    return rates.join(by_word, key).join(by_number, key)
