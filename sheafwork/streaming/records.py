"""The same cleaning on a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import cleaning as c
from sheafwork.functions.names import quoted


def cleaned_stream(records: DataFrame, kinds: dict[str, str], this_year: int | None = None) -> DataFrame:
    """Text columns of a streaming (or batch) table cleaned by kinds given beforehand, as a stream has no whole column:
    number, date or text. Stateless, so it needs no watermark; what doesn't parse is null."""
    out = {}
    for name, kind in kinds.items():
        value = F.col(quoted(name))
        plain = {"number": c.parse_number, "date": lambda x: c.parse_date(x, this_year), "text": c.clean_text}[kind](value)
        out[name] = F.when(~c.is_empty(value), plain)
    return records.withColumns(out)
