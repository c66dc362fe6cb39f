"""Column expressions shared by the operators. All stay on the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted spellings of a flag.
TRUE_WORDS = ("true", "t", "1", "yes")
FALSE_WORDS = ("false", "f", "0", "no")

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def stripped(c: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.btrim(c.cast("string"), F.lit(WHITE_SPACE))


def clean_text(c: Column) -> Column:
    """Stripped text, blank becomes NULL."""
    return F.nullif(stripped(c), F.lit(""))


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Projection whose results later filters use as they are.

    Catalyst pushes a filter below a plain projection by repeating its
    expressions in the filter. It does not push through a generator, so costly
    parsing in ``columns`` runs once per row.
    """
    return df.select(F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def to_flag(c: Column, dtype: str, stripped_already: bool = False) -> Column:
    """Boolean from its usual spellings, NULL when the text is none of them.

    Casting to text first makes booleans and 0/1 numbers take the same path. Only a
    column of numbers may print as ``1.0`` or ``0.0``; as a text these are no flags.
    """
    word = F.lower(c if stripped_already else stripped(c))
    text = dtype in ("string", "varchar", "char")
    return (
        F.when(word.isin(*TRUE_WORDS, *([] if text else ["1.0"])), F.lit(True))
        .when(word.isin(*FALSE_WORDS, *([] if text else ["0.0"])), F.lit(False))
    )


def to_number(c: Column, dtype: str, stripped_already: bool = False) -> Column:
    """Double, NULL where a text does not spell a plain number or is NaN.

    The cast also takes Java spellings (``1d``, ``1.5f``, ``0x1p3``), which are
    no numbers in a data file.
    """
    if dtype not in ("string", "varchar", "char"):
        return no_nan(c.cast("double"))
    text = c if stripped_already else stripped(c)
    low = F.lower(text)
    java = low.endswith("d") | (low.endswith("f") & ~low.endswith("inf")) | low.contains("x")
    return F.when(~java, no_nan(text.try_cast("double")))


def no_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the given columns coerced by :func:`to_number`."""
    types = dict(df.dtypes)
    return df.withColumns({c: to_number(F.col(c), types[c]) for c in columns if c in types})


def ratio(a: Column, b: Column) -> Column:
    """Division that gives NULL on a zero divisor instead of failing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even(c: Column, digits: int) -> Column:
    """Round half to even; adding zero turns -0.0 into 0.0."""
    unit = F.lit(float(10**digits))
    return F.rint(c * unit) / unit + F.lit(0.0)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are set; NULL for a constant side.

    ``corr`` divides by zero on a constant column, which fails under ANSI.
    """
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(
        F.covar_pop(x, y),
        F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)),
    )


def _constant_or(c: Column, value: Column) -> Column:
    return F.when(F.min(c) == F.max(c), F.lit(0.0)).otherwise(value)


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness; 0 for a constant column, NULL below 3 values."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(
        n >= 3, _constant_or(c, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    )


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis; NULL below 4 values."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    scale = ratio(n - 1, (n - 2) * (n - 3))
    return F.when(n >= 4, _constant_or(c, scale * ((n + 1) * g2 + 6)))


def search_tree(c: Column, edges: Sequence[float], right_closed: bool) -> Column:
    """Index of the interval of ``edges`` that holds ``c``, as a binary search.

    The nested CASE has log2(len) comparisons per row and stays inside codegen.
    ``right_closed`` puts a value equal to an edge into the interval left of it.
    Values outside the edges get -1 and ``len(edges) - 1``.
    """

    def pick(lo: int, hi: int) -> Column:
        # invariant: the answer lies in [lo, hi]
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        edge = F.lit(float(edges[mid]))
        left = (c <= edge) if right_closed else (c < edge)
        return F.when(left, pick(lo, mid - 1)).otherwise(pick(mid, hi))

    return F.when(c.isNotNull(), pick(-1, len(edges) - 1))


def cut(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins with the lowest edge included; NULL outside."""
    n = len(edges) - 1
    i = search_tree(c, edges, right_closed=True)
    return F.when(c == F.lit(float(edges[0])), F.lit(0)).when((i >= 0) & (i < n), i)


def key_hash(seed: int | str, key: Sequence[str], digits: int = 8) -> Column:
    """Hash of the key as a number of ``digits`` hex digits.

    Depends on nothing but seed and key, so it does not change with the
    partitioning or the executor. Only integer and text keys are stable.
    """
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]]
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def long_rows(df: DataFrame, rows: Sequence[tuple], names: Sequence[str], keep=()) -> DataFrame:
    """Turn one wide row into several long rows with an exploded struct array."""
    structs = [
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(r, names)])
        for r in rows
    ]
    return df.select(*keep, F.explode(F.array(*structs)).alias("_r")).select(*keep, "_r.*")


def best_row(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per group: the one with the smallest ``order`` tuple.

    An aggregate rather than ``row_number``: equal keys meet already on the map
    side, so one huge group never travels to one task.
    """
    rest = [c for c in df.columns if c not in by]
    ranked = F.struct(
        *[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest]
    )
    out = df.groupBy(*by).agg(F.min(ranked).alias("_b"))
    picked = {c: F.col(f"_b.{c}") for c in rest}
    return out.select(*[picked.get(c, F.col(c)).alias(c) for c in df.columns])
