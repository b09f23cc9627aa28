"""Column types of text tables, decided from all values in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Cell texts that count as missing.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# A cast to double alone would also take suffixes, so that "12D" became a number.
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"

_TRUTH_TEXTS = ["True", "False", "TRUE", "FALSE", "true", "false"]


def present(text: Column) -> Column:
    return F.when(~text.isin(MISSING_TEXTS), text)


def infer_types(texts: DataFrame, columns: list[str], *also: Column) -> tuple[dict[str, str], tuple]:
    """bigint, double or boolean for a column whose every value fits, else string; and what else is asked in that pass.

    Whole numbers with gaps become double. Dates stay text, so that odd ones
    reach the profile.
    """
    checks = []
    for i, name in enumerate(columns):
        text = F.col(f"`{name}`")
        checks.append(
            F.struct(
                F.count(text).alias("values"),
                F.count_if(text.isNull()).alias("gaps"),
                F.every(text.rlike(r"^\s*[+-]?\d+\s*$") & text.try_cast("bigint").isNotNull()).alias("whole"),
                F.every((text.rlike(_NUMBER) & text.try_cast("double").isNotNull()) | text.isNull()).alias("number"),
                F.every(text.isin(_TRUTH_TEXTS)).alias("truth"),
            ).alias(f"c{i}")
        )
    facts = texts.agg(*checks, *[a.alias(f"a{i}") for i, a in enumerate(also)]).first()

    def chosen(fact) -> str:
        if not fact["values"]:
            return "string"
        if fact["number"]:
            return "bigint" if fact["whole"] and not fact["gaps"] else "double"
        return "boolean" if fact["truth"] and not fact["gaps"] else "string"

    return {name: chosen(facts[i]) for i, name in enumerate(columns)}, tuple(facts)[len(columns) :]


def as_type(text: Column, data_type: str) -> Column:
    return text if data_type == "string" else text.try_cast(data_type)
