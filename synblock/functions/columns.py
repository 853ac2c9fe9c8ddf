"""Column expressions for gene tables; all of them stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chromosome_number(c: Column) -> Column:
    """All digits of a chromosome's name as one number; null without digits."""
    return F.regexp_replace(c, "[^0-9]+", "").try_cast("double") if hasattr(Column, "try_cast") else F.expr("null")


def round_to(x: Column, to: float) -> Column:
    """The nearest multiple of ``to``, halves to the even one."""
    return F.bround(x / to, 0) * to


def blank_to_null(c: Column) -> Column:
    """Empty strings and the literal NA are missing."""
    return F.when(~c.isin("", "NA"), c)


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def only_dna(c: Column) -> Column:
    """Whether a sequence is made of A, C, G, T and N alone."""
    return F.length(F.regexp_replace(F.upper(c), "[ACGTN]", "")) == 0


def strip_marks(c: Column, marks: str = ".-") -> Column:
    """A sequence without stop and gap marks."""
    return F.translate(c, marks, "")


def justified(df: DataFrame, column: str, right: bool = True) -> Column:
    """A column padded with blanks to the length of its longest value, which is sought first."""
    longest = df.agg(F.max(F.length(column))).first()[0] or 0
    return F.lpad(column, longest, " ") if right else F.rpad(column, longest, " ")


def scale_between(x: Column, low: float, high: float, by: list[Column], one_to_mean: bool = True) -> Column:
    """Linear rescaling of each group to [low, high]; a group with one value gets the mean of the two, or ``high``."""
    w = Window.partitionBy(*by)
    a, b = F.min(x).over(w), F.max(x).over(w)
    single = F.lit((low + high) / 2 if one_to_mean else float(high))
    return F.when(b > a, (x - a) / (b - a) * (high - low) + low).when(x.isNotNull(), single)


def labelled(*parts: Column | str) -> Column:
    """Parts joined by a blank, missing ones as NA."""
    cols = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("NA")) for p in parts]
    return F.concat_ws(" ", *cols)


def any_true(c: Column) -> Column:
    """As an aggregate: whether a group has a true value, false if it has none but nulls."""
    return F.coalesce(F.bool_or(c), F.lit(False))
