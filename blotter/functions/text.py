"""Column helpers with the source database's text semantics.

* Ordered text lists (``LISTAGG ... WITHIN GROUP (ORDER BY x)``): NULLs are
  skipped, no values gives NULL, elements sorted by binary string order.
  Built from ``collect_set``/``collect_list`` + ``array_sort`` + ``array_join``:
  one aggregation with map-side combine and no Expand, so several lists can
  share one ``agg`` (the ordered ``listagg(DISTINCT)`` built-in cannot, see
  SURVEY T1).
* ``||`` treats NULL as empty text; Spark's ``concat`` would give NULL.
* Code comparisons ignore case but keep raw values in output.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordered_set_text(c: Column | str, sep: str) -> Column:
    """Sorted distinct non-NULL values joined by ``sep``; NULL when none."""
    joined = F.array_join(F.array_sort(F.collect_set(_col(c))), sep)
    return F.nullif(joined, F.lit(""))


def ordered_list_text(c: Column | str, sep: str) -> Column:
    """Sorted non-NULL values, duplicates kept, joined by ``sep``; NULL when none."""
    joined = F.array_join(F.array_sort(F.collect_list(_col(c))), sep)
    return F.nullif(joined, F.lit(""))


def text_concat(*parts: Column | str) -> Column:
    """Concatenation where a NULL part counts as empty text."""
    return F.concat(*[F.coalesce(_col(p), F.lit("")) for p in parts])


def upper_in(c: Column | str, values: tuple[str, ...]) -> Column:
    """``UPPER(NVL(c,'')) IN values`` as a never-NULL boolean."""
    return F.coalesce(F.upper(_col(c)).isin(list(values)), F.lit(False))


def upper_contains(c: Column | str, word: str) -> Column:
    """``UPPER(NVL(c,'')) LIKE '%word%'`` as a never-NULL boolean."""
    return F.coalesce(F.upper(_col(c)).contains(word), F.lit(False))


def upper_contains_any(c: Column | str, words: tuple[str, ...]) -> Column:
    return any_of(*[upper_contains(c, w) for w in words])


def any_of(*conds: Column) -> Column:
    return reduce(or_, conds)


def flag(cond: Column) -> Column:
    """Boolean to 1/0 integer (NULL counts as 0)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def collapse_spaces(c: Column) -> Column:
    """``TRIM(REGEXP_REPLACE(c, ' +', ' '))``: space runs to one, ends trimmed."""
    return F.trim(F.regexp_replace(c, " +", " "))
