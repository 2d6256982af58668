"""Plan summary of every registered query: ``python -m blotter.plans.report SF_DIR``.

Runs each query once, then reads its final (adaptive) physical plan and counts
the operators that decide its cost: shuffle exchanges, broadcasts, join
kinds, Expand.  Prints a markdown table.
"""

from __future__ import annotations

import re
import sys

from blotter.plans.inspect import plan_text
from blotter.plans.registry import QUERIES, catalog_for
from blotter.plans.session import build_session

COUNTED = {
    "shuffle": r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition",
    "broadcast": r"\bBroadcastExchange\b",
    "bhj": r"\bBroadcastHashJoin\b",
    "smj": r"\bSortMergeJoin\b",
    "shj": r"\bShuffledHashJoin\b",
    "expand": r"\bExpand\b",
}


def summarize(df) -> dict[str, int]:
    df.collect()
    text = plan_text(df, "simple")
    final = text.split("== Initial Plan ==")[0]
    return {k: len(re.findall(p, final)) for k, p in COUNTED.items()}


def main(sf_dir: str) -> None:
    spark = build_session("local[8]", shuffle_partitions=8)
    catalog_for(spark, sf_dir)
    cols = list(COUNTED)
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for name, fn in QUERIES.items():
        counts = summarize(fn(spark, sf_dir))
        print(f"| `{name}` | " + " | ".join(str(counts[c]) for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
