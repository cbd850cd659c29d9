"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Vocabularies of flags and of missing text.
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y", "1"), ("false", "f", "no", "n", "0")
MISSING_WORDS = ("", "nan", "none", "na")


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, null where the denominator isn't positive."""
    return F.when(den > 0, num / den)


def parse_bool(text: Column) -> Column:
    """Flags by vocabulary; any other non-null text is an error."""
    word = F.lower(F.trim(text.cast("string")))
    bad = F.raise_error(F.concat(F.lit("not a flag: "), word)).cast("boolean")
    return F.when(word.isNull(), F.lit(None).cast("boolean")).when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(bad)


def valid_text(text: Column) -> Column:
    return text.isNotNull() & ~F.lower(F.trim(text)).isin(*MISSING_WORDS)


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def hash_fold(text: Column, folds: int) -> Column:
    """The first eight bytes of SHA-256, little-endian, modulo folds."""
    digest = F.sha2(text, 256)
    turned = F.concat(*(F.substring(digest, 15 - 2 * i, 2) for i in range(8)))
    return F.pmod(F.conv(turned, 16, 10).cast("decimal(20,0)"), F.lit(folds)).cast("int")


def hash_uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1) from 52 bits of the SHA-256 of the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sign_band(x: Column, tolerance: float) -> Column:
    return F.when(F.abs(x) <= tolerance, 0).otherwise(F.signum(x)).cast("int")


def log_loss(p: Column) -> Column:
    return -F.log(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1.0)))


def brier(probs: Column, label: Column) -> Column:
    """Half the squared distance of a probability array to the label's indicator."""
    return F.aggregate(F.transform(probs, lambda x, i: F.pow(x - F.when(i == label, 1.0).otherwise(0.0), 2)), F.lit(0.0), lambda a, x: a + x) / 2


def average_rank(value: Column, *group: str, descending: bool = False) -> Column:
    """Rank within the group, ties sharing their mean rank."""
    order = value.desc() if descending else value.asc()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
    return F.rank().over(Window.partitionBy(*group).orderBy(order)) + (ties - 1) / 2.0


def day_token(text: Column) -> Column:
    """'...d7...' or 'day 7' as '7d'; null without one."""
    found = F.regexp_extract(text, r"(?i)day\s*([0-9]+)|\bd([0-9]+)\b", 0)
    return F.when(found != "", F.concat(F.regexp_extract(found, "([0-9]+)", 1), F.lit("d")))


def drop_last_token(text: Column, sep: str = "_") -> Column:
    return F.regexp_replace(text, f"{sep}[^{sep}]*$", "")


def treatment(text: Column) -> Column:
    """[('drug', 5.0, 'uM')] as struct(drug, concentration, unit); null unless exactly one triple."""
    pattern = r"^\s*\[\s*\(\s*'([^']*)'\s*,\s*([-+0-9.eE]+)\s*,\s*'([^']*)'\s*\)\s*\]\s*$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("drug"), part(2).cast("double").alias("concentration"), part(3).alias("unit")))


def join_distinct(value: Column, sep: str = "|") -> Column:
    """Aggregate: sorted distinct values in one string."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def line_digest(value: Column) -> Column:
    """Aggregate: SHA-256 of the sorted values, a line each."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(value)), "\n"), 256)


def signed_split(xs: Column) -> Column:
    """Positive parts, then negative parts, of an array."""
    return F.concat(F.transform(xs, lambda x: F.greatest(x, F.lit(0.0))), F.transform(xs, lambda x: F.greatest(-x, F.lit(0.0))))


def outer(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def bits(mask: Column, size: int) -> Column:
    """Positions of the set bits of a mask."""
    return F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.getbit(mask, i) == 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def at_least(value: Column, seen: Column) -> Column:
    """value >= seen, where a difference in the last bits, which hangs on the order of a sum, is none."""
    return value >= seen - 1e-9 * F.greatest(F.lit(1.0), F.abs(seen))
