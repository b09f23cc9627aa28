from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from ledgerlake.errors import SchemaMismatch


def normalise_header(name: str) -> str:
    """Trimmed, lower case; space, dot and hyphen become underscore."""
    return re.sub(r"[ .\-]", "_", str(name).strip()).lower()


def table_name(filename: str) -> str:
    """Part before the first dot, lower case; space and hyphen become underscore."""
    return re.sub(r"[ \-]", "_", filename.split(".")[0].lower())


def _rename(df: DataFrame, names: list[str]) -> DataFrame:
    clashes = sorted(n for n, times in Counter(names).items() if times > 1)
    if clashes:
        raise SchemaMismatch(f"columns share a name after normalising: {', '.join(clashes)}")
    return df.toDF(*names)


def normalise_headers(df: DataFrame) -> DataFrame:
    return _rename(df, [normalise_header(c) for c in df.columns])


def lower_case_columns(df: DataFrame) -> DataFrame:
    return _rename(df, [c.lower() for c in df.columns])
