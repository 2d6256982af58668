"""The whole report set for one year: KPI row plus every proof extract.

One materialized cohort, the inclusive one, serves all: the narrow cohort is its
rows of the NIBRS code.  The incident facts of that cohort are written once and
read by the KPI and the proofs, so each rollup table is scanned once per set.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from blotter.operators import facts as fa
from blotter.operators import metrics as me
from blotter.operators import proofs as pr
from blotter.operators import rollups as ro
from blotter.params import Params
from blotter.plans.materialize import drop_folder, new_run_folder, writing_to
from blotter.plans.ordered import write_ordered
from blotter.sources.catalog import Catalog

SHARED = (
    "proof_total_reports", "proof_reports_with_arrest", "proof_open_reports",
    "proof_closed_by_other_means", "proof_summed_loss_value", "proof_avg_suspects",
    "proof_reports_with_vehicle_info",
)


class ReportSet(dict[str, DataFrame]):
    """``{name: DataFrame}``; owns the folder of its materialized tables.

    The reports stay lazy and read those tables, so run them before ``close``
    (or use the set as a context manager), which deletes the folder.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        super().__init__()
        self._spark, self.folder = spark, folder

    def close(self) -> None:
        drop_folder(self._spark, self.folder)

    def __enter__(self) -> ReportSet:
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def report_set(cat: Catalog, p: Params) -> ReportSet:
    """The KPI row and all nine proofs of ``p``."""
    spark = cat.raw("incidents").sparkSession
    out = ReportSet(spark, new_run_folder(spark))
    with writing_to(out.folder):
        wide = pr.inclusive_cohort(cat, p)
        ro.share_first_hops(wide.keys)
        links = ro.vehicle_rows(cat, wide.keys)
        wide = wide.with_facts(fa.written_facts(cat, wide.keys))
        cohort = wide.narrowed(p)
        out["metrics_summary"] = me.metrics_summary(cat, p, cohort)
        for name in SHARED:
            out[name] = getattr(pr, name)(cat, p, cohort)
        out["proof_total_vehicles_linked"] = pr.proof_total_vehicles_linked(cat, p, cohort, links)
        out["proof_total_reports_inclusive"] = pr.proof_total_reports_inclusive(cat, p, wide)
    return out


@contextmanager
def single_report(cat: Catalog, p: Params, name: str) -> Iterator[DataFrame]:
    """One report, KPI row or proof, for the length of a block; leaving it drops the tables that it wrote."""
    make = {"metrics_summary": me.metrics_summary, "report_metrics": me.report_metrics,
            "incident_metrics": me.incident_metrics, "vehicle_links": pr.vehicle_links}.get(name) or getattr(pr, name)
    spark = cat.raw("incidents").sparkSession
    folder = new_run_folder(spark)
    try:
        with writing_to(folder):
            df = make(cat, p)
        yield df
    finally:
        drop_folder(spark, folder)


def write_proofs(cat: Catalog, p: Params, path: str) -> None:
    """All nine proofs of ``p`` as ordered results, each in a folder of its name."""
    with report_set(cat, p) as out:
        for name, keys in pr.ORDER.items():
            write_ordered(out[name], f"{path}/{name}", list(keys))
