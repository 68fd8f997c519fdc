"""Masks for personal data in texts and results, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.names import quoted


def mask_id_card(text: Column) -> Column:
    """18 digits (the last may be X) and the older 15: the first four and the last four (three) stay."""
    long = F.regexp_replace(text, r"(?<![0-9])([0-9]{4})[0-9]{10}([0-9]{3}[0-9Xx])(?![0-9])", "$1" + "*" * 10 + "$2")
    return F.regexp_replace(long, r"(?<![0-9])([0-9]{4})[0-9]{8}([0-9]{3})(?![0-9])", "$1" + "*" * 8 + "$2")


def mask_phone(text: Column) -> Column:
    """138****5678."""
    return F.regexp_replace(text, r"(?<![0-9])(1[3-9][0-9])[0-9]{4}([0-9]{4})(?![0-9])", "$1****$2")


def mask_bank_card(text: Column, strict: bool = False) -> Column:
    """16 to 19 digits in groups of four, the last group longer: twelve stars and that group, separators dropped. strict
    shows no more than four digits."""
    head = r"(?<![0-9])[0-9]{4}[\s-]?[0-9]{4}[\s-]?[0-9]{4}[\s-]?"
    tail = r"[0-9]{0,3}([0-9]{4})(?![0-9])" if strict else r"([0-9]{4,7})(?![0-9])"
    return F.regexp_replace(text, head + tail, "*" * 12 + "$1")


def mask_email(text: Column) -> Column:
    """z***@example.com."""
    return F.regexp_replace(text, r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***$2")


def mask_name(text: Column, star: str = "*") -> Column:
    """The first character and a star for each further one."""
    return F.when(F.char_length(text) > 0, F.concat(F.substring(text, 1, 1), F.repeat(F.lit(star), F.char_length(text) - 1))).otherwise(text)


#: In the order in which they must act: an id card number would otherwise be taken for a bank card's.
MASKS = {"mask_id_card": mask_id_card, "mask_phone": mask_phone, "mask_bank_card": mask_bank_card, "mask_email": mask_email}


def mask_text(text: Column, enabled: set[str] | None = None) -> Column:
    """All masks, or those named in enabled, in their order."""
    for name, mask in MASKS.items():
        if enabled is None or name in enabled:
            text = mask(text)
    return text


def is_name_field(name: str) -> bool:
    return "姓名" in name or "名字" in name


def mask_rows(df: DataFrame, enabled: set[str] | None = None, mask_names: bool = False) -> DataFrame:
    """Every value as text and masked, NULL as an empty text; names too if asked for."""
    out = []
    for field in df.columns:
        value = F.coalesce(df[quoted(field)].cast("string"), F.lit(""))
        value = mask_name(value) if mask_names and is_name_field(field) else mask_text(value, enabled)
        out.append(value.alias(field))
    return df.select(*out)


def masked_samples(values: Column, limit: int, enabled: set[str] | None = None) -> Column:
    """The first so many distinct values of an array of texts, masked before they are compared, blanks left out."""
    filled = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.array_distinct(F.transform(filled, lambda x: mask_text(x, enabled))), 1, max(limit, 0)) if limit > 0 else F.array().cast("array<string>")
