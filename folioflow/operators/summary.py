"""Extractive summaries with citations, numbered prompts, citation cleaning and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that mark a line as something to do (fixed values).
ACTION_WORDS = ("신청", "접수", "제출", "문의", "기간")


def page_lines(lines: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """(keys, lines): a page's lines as an array of (id, text), ids from 1 in reading order; repeats count once."""
    grouped = lines.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("text")))).alias("_lines"))
    return grouped.select(*keys, F.transform("_lines", lambda x, i: F.struct((i + 1).alias("id"), x["text"].alias("text"))).alias("lines"))


def numbered_prompt(lines: Column) -> Column:
    """Lines as ``[id] text``, one below the other."""
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit("["), x["id"].cast("string"), F.lit("] "), x["text"])), "\n")


def extractive_summary(pages: DataFrame) -> DataFrame:
    """``pages`` (with lines) plus title, overview, overview_ids, key_points and actions, all cited by line id.

    Lines of empty text are not used. The title is the first line (80 characters), the overview the first three (500),
    key points are lines two to five, actions the first four lines with an action word. Pages without text get nulls
    and empty lists.
    """
    used = pages.withColumn("_used", F.filter("lines", lambda x: x["text"] != "")).withColumn("_used", F.transform("_used", lambda x: F.struct(x["id"].alias("id"), F.trim(x["text"]).alias("text"))))
    acts = F.filter("_used", lambda x: x["text"].rlike("|".join(ACTION_WORDS)))
    fact = lambda xs: F.transform(xs, lambda x: F.struct(x["text"].alias("text"), F.array(x["id"]).alias("ids")))
    first = F.slice("_used", 1, 3)
    return used.select(
        *pages.columns, F.substring(F.get("_used", F.lit(0))["text"], 1, 80).alias("title"),
        F.when(F.size("_used") > 0, F.substring(F.array_join(F.transform(first, lambda x: x["text"]), " "), 1, 500)).alias("overview"),
        F.transform(first, lambda x: x["id"]).alias("overview_ids"), fact(F.slice("_used", 2, 4)).alias("key_points"), fact(F.slice(acts, 1, 4)).alias("actions"),
    )


def clean_ids(ids: Column, line_count: Column) -> Column:
    """Cited ids that exist, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: (i >= 1) & (i <= line_count))))


def clean_facts(facts: Column, line_count: Column, most: int = 6) -> Column:
    """Facts (text, ids) with clean ids; those without text or ids are dropped, the first ``most`` kept."""
    cleaned = F.transform(facts, lambda f: F.struct(F.trim(f["text"]).alias("text"), clean_ids(f["ids"], line_count).alias("ids")))
    return F.slice(F.filter(cleaned, lambda f: (f["text"] != "") & (F.size(f["ids"]) > 0)), 1, most)


def citation_coverage(overview_ids: Column, key_points: Column, actions: Column) -> Column:
    """Percentage of overview, key points and actions that cite a line, one digit; null without a summary."""
    cited = F.when(F.size(overview_ids) > 0, 1).otherwise(0) + F.size(F.filter(key_points, lambda f: F.size(f["ids"]) > 0)) + F.size(F.filter(actions, lambda f: F.size(f["ids"]) > 0))
    return F.round(100 * cited / (1 + F.size(key_points) + F.size(actions)), 1)


def cited_lines(facts: DataFrame, lines: DataFrame, keys: list[str], ids: str, line_id: str) -> DataFrame:
    """(keys, fact, lines columns): the lines that each fact cites, by an equi join on the exploded ids.

    ``facts`` has a column ``fact`` that names it within the page; ids without a line give no row.
    """
    each = facts.select(*keys, "fact", F.explode(ids).alias(line_id))
    return each.join(lines, [*keys, line_id])
