"""blotter: Spark-native yearly incident metrics and their proof extracts.

Operators take a :class:`~blotter.sources.catalog.Catalog` of the 16 input
relations and :class:`~blotter.params.Params`, and return
DataFrames (cohort queries run a few small jobs when built, see README); Catalyst
and adaptive execution do the planning.
"""

from blotter.params import Params
from blotter.sources.catalog import Catalog

__all__ = ["Catalog", "Params"]
