"""Keyword clean-up, comma lists and sentence building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text_field(text: Column, keywords: list[str], case_sensitive: bool = False) -> Column:
    """The first keyword (in list order) found in the text, else the stripped text; missing -> ''."""
    body = strip(text)
    hay = body if case_sensitive else F.lower(body)
    hits = [F.when(F.contains(hay, F.lit(k if case_sensitive else k.lower())), F.lit(k)) for k in keywords]
    return F.when(text.isNull() | (text == ""), F.lit("")).otherwise(F.coalesce(*hits, body))


def list_items(text: Column) -> Column:
    """Items of a comma list, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")


def option_in_text(text: Column, option: str) -> Column:
    """True when the option is a whole item of the comma list."""
    return F.coalesce(F.array_contains(list_items(text), option), F.lit(False))


def option_column(prefix: str, option: str) -> str:
    return f"{prefix}_{option.replace(' ', '_').replace('-', '_')}"


def multi_hot(df: DataFrame, column: str, options: list[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 column per predefined option; items outside the list are ignored."""
    items = df.withColumn("_items", F.coalesce(list_items(F.col(column)), F.array().cast("array<string>")))
    cols = [
        F.array_contains("_items", o).cast("int").alias(option_column(prefix or column, o)) for o in options
    ]
    return items.select(*df.columns, *cols)


def condition_text(conditions: Column, digits: int = 3) -> Column:
    """'a <= 0.500 AND b > 1.000' from an array of (feature, op, threshold)."""
    return F.array_join(
        F.transform(conditions, lambda x: F.format_string(f"%s %s %.{digits}f", x["feature"], x["op"], x["threshold"])),
        " AND ",
    )


def format_rule(conditions: Column, prediction: Column, confidence: Column, support: Column) -> Column:
    return F.concat(
        F.lit("IF "),
        condition_text(conditions),
        F.format_string(
            " THEN cash_break = %d (confidence: %.2f%%, support: %d samples)", prediction, confidence * 100, support
        ),
    )


def rule_label(items: Column) -> Column:
    """First three items joined by ' + ', with '...' when there are more."""
    return F.concat(
        F.array_join(F.slice(items, 1, 3), " + "), F.when(F.size(items) > 3, F.lit("...")).otherwise(F.lit(""))
    )


def strip_item_suffix(items: Column, suffix: str = "_changed") -> Column:
    """Items that carry the suffix, without it."""
    return F.transform(
        F.filter(items, lambda x: F.contains(x, F.lit(suffix))), lambda x: F.replace(x, F.lit(suffix), F.lit(""))
    )


def composite_rule_text(feature, op, threshold, change, confidence, support) -> Column:
    return F.format_string(
        "Cash break is likely when:\n1. %s %s %.2f (indicates %s will change)\n"
        "2. This leads to %.1f%% chance of cash break\n3. This pattern occurred %d times historically",
        feature,
        op,
        threshold,
        change,
        confidence * 100,
        support,
    )


def interaction_rule_text(conditions: Column, joint: Column, synergy: Column) -> Column:
    return F.concat(
        F.lit("When "),
        condition_text(conditions, 2),
        F.format_string(
            ", cash break probability increases to %.1f%% (synergy effect: +%.1f%%)", joint * 100, synergy * 100
        ),
    )
