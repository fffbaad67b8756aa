"""Write PLANS.md: the final adaptive physical plan of the key queries, after they ran.

    python tools/plans.py [sf_dir]

Each query is collected first, so ``explain('formatted')`` shows the plan AQE settled on
(``isFinalPlan=true``: the join strategies and shuffle reads actually used). Below the tree, the
scans' pruned ``ReadSchema`` and pushed filters are listed.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

KEYS = ["clean_strong", "split_stratified_exact", "predict_all_models", "compare_with_ensemble",
        "encode_ids", "score_head", "head_gradient", "metrics_by_domain"]


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def tree(text: str) -> str:
    return text.split("\n\n\n")[0].strip()


def scans(text: str) -> list[str]:
    """ReadSchema / PushedFilters of every parquet scan node in the formatted plan."""
    out = []
    for block in re.split(r"\n\n", text):
        head = block.strip().splitlines()[0] if block.strip() else ""
        if "Scan parquet" not in head:
            continue
        keep = [ln for ln in block.strip().splitlines()[1:] if ln.startswith(("ReadSchema", "PushedFilters"))]
        loc = [ln for ln in block.strip().splitlines() if ln.startswith("Location")]
        table = re.findall(r"/([a-z_]+\.parquet|[a-z-]+-[0-9a-f]{12})", loc[0])[-1:] if loc else []
        out.append(f"{head.strip()} {table[0] if table else ''}: " + "; ".join(keep))
    return out


def main(argv):
    from botsift.plans.catalog import QUERIES
    from botsift.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8, "botsift-plans")
    out = ["# Physical plans of the key queries", "",
           f"Generated by `python tools/plans.py {sf}`: each query is run (collected) first, so the",
           "tree is the final adaptive plan (`isFinalPlan=true`); the parquet scans' pruned `ReadSchema`",
           "and pushed filters follow each tree.", ""]
    for k in KEYS:
        df = QUERIES[k](spark, sf)
        df.collect()
        text = formatted(df)
        out += [f"## {k}", "", "```", tree(text), "```", ""]
        out += [f"* {s}" for s in scans(text)] + [""]
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
