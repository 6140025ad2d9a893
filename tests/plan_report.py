"""Write docs/plans.md: the formatted physical plans of the heavy queries.

usage: python tests/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casework.session import ensure_checkpoint_dir, get_spark  # noqa: E402

NAMES = ["outcome_crosstab_pct", "count_within", "profile_numeric", "precision_threshold",
         "stratified_split", "facet_filter", "merge_annotations", "kde_grid"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark()
    ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="casework-plan-"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    import __spark_entry__ as E
    out = ["# Physical plans (generated by tests/plan_report.py)", "",
           f"Scale: `{sf_dir}`. Only the operator outline is kept. Scan lines show `PushedFilters` and "
           "`ReadSchema`.", ""]
    for name in NAMES:
        df = E.queries()[name](spark, sf_dir)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        outline = plan.split("\n\n")[0]
        scans = re.findall(r"(?:PushedFilters|ReadSchema): .*", plan)
        out += [f"## {name}", "", "```", outline.strip(), "```", "", "```", *scans, "```", ""]
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "plans.md")
    with open(path, "w") as f:
        f.write("\n".join(out))
    print(path)


if __name__ == "__main__":
    main()
