"""Time the headline queries; prints one JSON line.

Folder and cores come from BENCH_SF_DIR and BENCH_CPUS. Each query is planned and run to the end twice
with a sink that stores nothing, so every row and column is computed; the faster run counts. ``build`` is the part
of it until the plan stands, with the jobs that queries run for that.

The test tables are single files with one row group, which a task cannot share. Before the clock starts, tables with
texts are written as one file per core to a temporary folder; the queries read this folder.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from veilspark.session import build_session  # noqa: E402

HEADLINE = (
    "guarded_select", "treated_select", "write_merge", "table_inventory", "column_catalog",
    "candidate_keys", "key_violations", "fk_discovery", "fk_violations", "scan_policy",
    "column_hints_typed", "query_log_audit", "detect_email", "detect_phone", "detect_card", "detect_iban",
    "detect_dob", "analyze_text", "analyze_column", "entity_profile", "treat_hash", "treat_pseudonymise",
    "anonymise_text", "operator_map", "process_table", "treat_stream", "token_join",
)


TEXTS = ("customer", "documents", "pages", "conversations")


def laid_out(spark, folder: str, cores: int) -> str:
    """A folder with the tables of ``folder``, those with texts in as many files as there are cores."""
    out = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(folder)):
        if name.removesuffix(".parquet") in TEXTS:
            spark.read.parquet(f"{folder}/{name}").repartition(cores).write.parquet(f"{out}/{name}")
        else:
            os.symlink(f"{folder}/{name}", f"{out}/{name}")
    return out


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        int(cpus) if cpus.isdigit() else None,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    tables = laid_out(spark, folder, int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    built: dict[str, float] = {}
    failed: dict[str, str] = {}
    for key in keys:
        runs = []
        try:
            for _ in range(2):
                begin = time.perf_counter()
                df = QUERIES[key](spark, tables)
                df._jdf.queryExecution().executedPlan()
                build = time.perf_counter() - begin
                df.write.format("noop").mode("overwrite").save()
                runs.append((time.perf_counter() - begin, build))
        except Exception as error:  # noqa: BLE001 - a broken query must not cost the figures of the others
            failed[key] = f"{type(error).__name__}: {str(error)[:200]}"
            print(key, failed[key], file=sys.stderr, flush=True)
            continue
        times[key], built[key] = (round(x, 3) for x in min(runs))
        print(key, [[round(x, 2) for x in r] for r in runs], file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "build": built,
                **({"failed": failed} if failed else {}),
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
