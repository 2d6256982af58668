"""What is known of a cohort's keys, kept beside the DataFrame: the span of their ids, and
for keys beyond the broadcast budget Bloom filters of them."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame

from blotter.functions.bloom import KeyFilter, key_filter
from blotter.plans.materialize import Span, materialize

_FILTERS: "weakref.WeakKeyDictionary[DataFrame, tuple[int, dict]]" = weakref.WeakKeyDictionary()
_SPANS: "weakref.WeakKeyDictionary[DataFrame, Span]" = weakref.WeakKeyDictionary()


def spanned(keys: DataFrame, span: Span | None) -> DataFrame:
    """``keys``, of which it is known from now on that its ids lie in ``span``."""
    if span is not None:
        _SPANS[keys] = span
    return keys


def span_of(keys: DataFrame | None) -> Span | None:
    return None if keys is None else _SPANS.get(keys)


def filtered(keys: DataFrame, n_keys: int) -> DataFrame:
    """``keys`` (so many at most), whose Bloom filters are made from now on where they are asked for."""
    _FILTERS[keys] = (n_keys, {})
    return keys


def filter_of(keys: DataFrame | None, cols: tuple[str, ...]) -> KeyFilter | None:
    """The filter over columns of ``keys``, written once; None for keys that are broadcast anyway."""
    if keys is None or keys not in _FILTERS:
        return None
    n_keys, made = _FILTERS[keys]
    if cols not in made:
        own = key_filter(keys, list(cols), n_keys)
        made[cols] = None if own is None else KeyFilter(materialize(own.bits, rebalance=False), own.size)
    return made[cols]
