"""Column helpers shared by every operator.

* Column names may contain dots, spaces or backticks (``pm2.5``), so every
  reference goes through :func:`qcol`.
* Arithmetic follows IEEE semantics (x/0 -> +-inf or nan, ln(0) -> -inf,
  ln(<0) -> nan) so that results agree with the SQL database the cards were
  specified against, whatever ``spark.sql.ansi.enabled`` says.
* Sorting is always NULLS LAST, ascending or descending.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(name: str) -> str:
    """Backtick-quote an identifier, doubling inner backticks."""
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str | Column) -> Column:
    """Column for a (possibly dotted) top-level column name."""
    if isinstance(name, Column):
        return name
    return F.col(quote(name))


def join_names(*parts: object) -> str:
    """Output naming rule: parts joined with ``_`` (``col_suffix``, ``output_i``)."""
    return "_".join(str(p) for p in parts)


def unique(names: Iterable[str]) -> list[str]:
    """Deduplicate while keeping first-seen order."""
    return list(dict.fromkeys(names))


def lit_double(x: float) -> Column:
    return F.lit(float(x)).cast("double")


_INF = float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """``a / b`` on doubles with IEEE results for a zero divisor (NULLs propagate).

    ``a * inf`` is exactly the IEEE quotient by zero: +-inf for a != 0, NaN
    for 0 or NaN, NULL for NULL.
    """
    a = a.cast("double")
    b = b.cast("double")
    return F.when(b == 0, a * F.lit(_INF)).otherwise(F.try_divide(a, b))


def ieee_ln(x: Column) -> Column:
    """Natural log with ``ln(0) = -inf`` and ``ln(x<0) = nan``."""
    x = x.cast("double")
    return (
        F.when(x == 0, F.lit(-_INF))
        .when(x < 0, F.lit(float("nan")))
        .otherwise(F.ln(x))
    )


def asc(name: str | Column) -> Column:
    return qcol(name).asc_nulls_last()


def desc(name: str | Column) -> Column:
    return qcol(name).desc_nulls_last()


def sort_cols(names: Sequence[str], descending: Sequence[bool] | None = None) -> list[Column]:
    descending = descending or [False] * len(names)
    return [desc(n) if d else asc(n) for n, d in zip(names, descending)]
