"""Functions on field names: normal forms, likeness, kinds, fingerprints. Column and Python forms share the constants."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell what kind of field a name is, names that need no field, and the least likeness.
GROUP_HINTS = ("单位", "部门", "学院", "院系", "科室", "学校", "班级", "年级")
IDENTITY_HINTS = ("姓名", "学号", "工号", "编号", "序号", "代码", "证件", "身份证")
IGNORABLE = r"^(序号|编号|no\.?|备注|说明|填表说明|注)$"
LEAST_LIKENESS = 0.6
IGNORE, UNKNOWN = "__IGNORE__", "__UNKNOWN__"

_STEPS = ((r"[\s　]+", ""), (r"[（(].*?[)）]", ""), (r"[·\-_/、,，.。:：]", ""))


def quoted(name: str) -> str:
    """A column's name as an expression has it."""
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, taken: Iterable[str]) -> str:
    """name, with as many underscores behind it as it takes that it is none of the taken ones in either case."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def numbered(names: list[str], reserved: Iterable[str] = ()) -> list[str]:
    """names with a number behind each that Spark couldn't tell from an earlier or reserved one: a, A, a become a, A_2,
    a_3. Empty names stay."""
    taken, out = {x.lower() for x in reserved}, []
    later = {x.lower() for x in names}  # a number must not make a name that comes anyway
    for name in names:
        new, k = name, 2
        while name and (new.lower() in taken or k > 2 and new.lower() in later):
            new, k = f"{name}_{k}", k + 1
        taken.add(new.lower())
        out.append(new)
    return out


def normal_name(name: Column) -> Column:
    for pattern, to in _STEPS:
        name = F.regexp_replace(name, pattern, to)
    return F.lower(name)


def normal_name_of(name: str) -> str:
    for pattern, to in _STEPS:
        name = re.sub(pattern, to, name)
    return name.casefold()


def likeness(a: Column, b: Column) -> Column:
    """The share of characters that two names have in common; 0 for names of one character."""
    one, two = F.array_remove(F.split(a, ""), ""), F.array_remove(F.split(b, ""), "")
    shared, both = F.size(F.array_intersect(one, two)), F.size(F.array_union(one, two))
    return F.when((F.char_length(a) < 2) | (F.char_length(b) < 2), F.lit(0.0)).otherwise(shared / both)


def likeness_of(a: str, b: str) -> float:
    return 0.0 if min(len(a), len(b)) < 2 else len({*a} & {*b}) / len({*a} | {*b})


def is_group(name: Column) -> Column:
    return name.rlike("|".join(GROUP_HINTS))


def is_group_of(name: str) -> bool:
    return any(hint in name for hint in GROUP_HINTS)


def is_identity(name: Column) -> Column:
    return name.rlike("|".join(IDENTITY_HINTS) + "|(?i)(?<![a-z])id(?![a-z])")


def is_identity_of(name: str) -> bool:
    return any(hint in name for hint in IDENTITY_HINTS) or re.search(r"(?<![a-z])id(?![a-z])", name.casefold()) is not None


def signature_of(names: list[str]) -> str:
    filled = sorted(x for x in ("".join(name.split()).lower() for name in names) if x)
    return hashlib.sha256("\x1f".join(filled).encode()).hexdigest()[:32]


def signature(names: Column) -> Column:
    """A fingerprint of a header: order, case and white space don't matter."""
    filled = F.filter(F.transform(names, lambda x: F.lower(F.regexp_replace(x, r"[\s　]+", ""))), lambda x: x != "")
    return F.left(F.sha2(F.array_join(F.array_sort(filled), "\x1f"), 256), F.lit(32))
