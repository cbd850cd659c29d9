"""Normalising texts, flags, lists and column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for true and for no value.
TRUE_TEXTS = ("true", "t", "yes", "y", "1")


def lenient_bool(c: Column, kind: str) -> Column:
    """A flag from a boolean, a number (not 0) or a text (in TRUE_TEXTS); null is false."""
    if kind == "boolean":
        said = c
    elif kind == "string":
        said = F.lower(F.trim(c)).isin(*TRUE_TEXTS)
    else:
        said = (c != 0) & ~F.isnan(c.cast("double"))
    return F.coalesce(said, F.lit(False))


def _gate(c: Column, ok: Column, what: str) -> Column:
    return F.when(ok, c).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(c, F.lit("null")))).cast("string"))


def day_label(c: Column) -> Column:
    """'{n}d' of the first number before a d or after 'day'; empty without one."""
    n = F.regexp_extract(c, r"(?i)(?:day ?([0-9]+)|([0-9]+) ?d(?![a-z]))", 0)
    n = F.regexp_extract(n, r"([0-9]+)", 1)
    return F.when(n == "", F.lit("")).otherwise(F.concat(n, F.lit("d")))


def cell_id(c: Column, prefix: str = "MP-") -> Column:
    """A cell id without its prefix, '<barcode>-<number>' as '<number>_<barcode>'; an error where it has another form."""
    bare = F.regexp_replace(c, f"^{prefix}", "")
    return F.regexp_replace(_gate(bare, bare.rlike(r"^[A-Z]+-[0-9]+$"), "no cell id"), r"^([A-Z]+)-([0-9]+)$", "$2_$1")


def replicate_label(c: Column, suffixes: dict[str, str], default: str = "r1") -> Column:
    """The label of the first suffix that fits, else 'v{n}' of a '-v{n}-', else the default."""
    out = None
    for end, label in suffixes.items():
        out = F.when(c.endswith(end), label) if out is None else out.when(c.endswith(end), label)
    version = F.regexp_extract(c, r"(?i)-v(\d+)-", 1)
    rest = F.when(version != "", F.concat(F.lit("v"), version)).otherwise(F.lit(default))
    return rest if out is None else out.otherwise(rest)


def patient(c: Column) -> Column:
    """'Pt' with its number at the start of a sample id; an error without one."""
    found = F.regexp_extract(c, r"^(Pt[0-9]+)", 1)
    return F.when(found != "", found).otherwise(F.raise_error(F.concat(F.lit("no patient in "), F.coalesce(c, F.lit("null")))).cast("string"))


def either_pattern(c: Column, first: str, second: str, names: list[str]) -> dict[str, Column]:
    """The groups of the first pattern, or where it doesn't match those of the second; null where neither does."""
    return {n: F.coalesce(F.nullif(F.regexp_extract(c, first, k + 1), F.lit("")), F.nullif(F.regexp_extract(c, second, k + 1), F.lit(""))) for k, n in enumerate(names)}


def exploded(df: DataFrame, key: str, packed: str, separator: str = ";") -> DataFrame:
    """key, item of a separated list, and whether the item belongs to one key only."""
    rows = df.select(key, F.explode(F.split(packed, F.lit(separator))).alias("item")).withColumn("item", F.trim("item")).filter("item <> ''").distinct()
    n = rows.groupBy("item").agg((F.count(F.lit(1)) == 1).alias("unambiguous"))
    return rows.join(n, "item").select(key, "item", "unambiguous")


def column_of(df: DataFrame, *candidates: str) -> str:
    """The first candidate that is a column of df, case aside; an error where none is."""
    at = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in at:
            return at[c.lower()]
    raise KeyError(f"none of {candidates} in {df.columns}")


def floats(c: Column, separator: str = ";") -> Column:
    """array<double> of a separated list; parts that are no numbers are null."""
    return F.transform(F.split(c, F.lit(separator)), lambda x: x.try_cast("double"))


def one_hot(c: Column, names: list[str]) -> Column:
    return F.array(*(F.coalesce(c == n, F.lit(False)).cast("int") for n in names))


def tile(c: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(c, times))


def roll(c: Column, by: int) -> Column:
    """The array turned by so many places to the right."""
    n = F.size(c)
    k = F.pmod(F.lit(by), F.greatest(n, F.lit(1)))
    return F.when(n == 0, c).otherwise(F.concat(F.slice(c, n - k + 1, k), F.slice(c, 1, n - k)))


def ranges(c: Column) -> Column:
    """array<int> of '1-3,7' lists: every number, in order."""
    part = lambda p: F.split(F.trim(p), "-")
    return F.flatten(F.transform(F.split(c, ","), lambda p: F.sequence(F.get(part(p), F.lit(0)).cast("int"), F.coalesce(F.get(part(p), F.lit(1)), F.get(part(p), F.lit(0))).cast("int"))))


def padded(c: Column, size: int, fill: int = -1) -> Column:
    """The first numbers of an array, filled up to the size."""
    return F.slice(F.concat(c, F.array_repeat(F.lit(fill), size)), 1, size)
