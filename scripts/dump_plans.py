"""Write the physical plan trees of the headline queries to docs/PLANS.md.

usage: python scripts/dump_plans.py [sf_dir]
The tree part of ``explain("formatted")`` is kept (operator outline with
codegen stage ids); node details are summarised to the scan lines.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

QUERIES = ["s2_article_snapshot", "j3_similar_pairs", "g2_story_groups", "o1_top_stories",
           "s5_insert_if_absent", "w3_approval_fold", "j8_review_rows", "j10_best_media",
           "m7_url_type", "o2_digest_top", "x9_extract_main_text"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from tidewire.plans.queries import REGISTRY
    from tidewire.session import get_spark
    spark = get_spark("plans")
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `scripts/dump_plans.py` on `{sf}` (AQE initial plans; stages that read",
           "materialised tables start at a parquet scan of the checkpoint folder).", ""]
    for name in QUERIES:
        df = REGISTRY[name](spark, sf)
        text = spark.sparkContext._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
            df._jdf.queryExecution(), "formatted")
        tree = text.split("\n\n(1)")[0]
        scans = [ln.strip() for ln in text.split("\n") if ln.strip().startswith(("ReadSchema:", "PushedFilters:"))]
        tree = re.sub(r"file:[^\]\s,]+", "…", tree)
        out += [f"## {name}", "", "```", tree.strip(), "```", ""]
        if scans:
            out += ["Scan details:", "", "```", *[re.sub(r"file:[^\]\s,]+", "…", s)[:300] for s in scans], "```", ""]
    os.makedirs(os.path.join(ROOT, "docs"), exist_ok=True)
    with open(os.path.join(ROOT, "docs", "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
