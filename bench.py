"""Wall time of the headline queries: BENCH_SF_DIR=... BENCH_CPUS=8 python bench.py

Every query runs whole, into a sink that drops the rows. The figure is the median of BENCH_RUNS
runs after one run of the first query that starts the JVM's compilers. Beside it stand the time that DuckDB takes for the
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from duploscope.operators import exact
from duploscope.plans import catalog
from duploscope.session import get_session, run_scope
from duploscope.sources import files

HEADLINE = [
    "path_functions", "item_labels", "criteria_waterfall", "eligible_entries", "identity_dedupe", "size_candidates",
    "exact_groups", "exact_members", "scan_funnel", "review_sorted_topk", "keep_newest", "proposal_summary", "report_rows",
    "plan_issues", "revalidation_status", "cleanup_rollup", "folder_metrics", "duplicate_trees", "nested_suppression",
    "compare_rows", "pixel_fingerprints", "lsh_candidates", "relationships_balanced", "complete_link_groups",
]
SLOW_SQL = ("relationships_balanced", "complete_link_groups")  # all pairs by list functions, and one step of a recursion for each link
PUBLISHED = {"list_25000_files": 2.24, "2000_of_one_length": 0.557, "2000_pairs": 2.108, "4_of_32_mib": 0.539}


def _oracle_times(sf_dir: str, names: list[str], runs: int) -> dict[str, float]:
    import duckdb

    connection, times = duckdb.connect(), {}
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    for name in names:
        if name in catalog.ORACLES and name not in SLOW_SQL:
            taken = []
            for _ in range(runs):
                started = time.perf_counter()
                connection.execute(catalog.ORACLES[name]).fetchnumpy()
                taken.append(time.perf_counter() - started)
            times[name] = round(statistics.median(taken), 3)
    return times


def _make_files(folder: Path) -> None:
    for n in range(100):
        (folder / f"list/{n}").mkdir(parents=True)
    for n in range(25_000):
        (folder / f"list/{n % 100}/{n}").write_bytes(n.to_bytes(3, "little"))
    for name in ("unequal", "pairs", "large"):
        (folder / name).mkdir()
    for n in range(2_000):
        (folder / f"unequal/{n}").write_bytes(n.to_bytes(4, "little") * 128)
        for copy in "ab":
            (folder / f"pairs/{n}{copy}").write_bytes(n.to_bytes(4, "little") * 8)
    for n in range(4):
        (folder / f"large/{n}").write_bytes(b"large" * (32 * 1024 * 1024 // 5) + b"xx")


def _file_times(spark, runs: int) -> dict[str, float]:
    folder = Path(tempfile.mkdtemp(prefix="bench-files-"))
    _make_files(folder)

    def proved(name: str) -> int:
        listing = files.read_files(spark, [str(folder / name)], with_digest=False)
        return exact.find_exact_duplicates(listing, files.PROOF, files.hash_files).groups.count()

    cases = {
        "list_25000_files": (lambda: files.read_files(spark, [str(folder / "list")], with_digest=False).count(), 25_000),
        "2000_of_one_length": (lambda: proved("unequal"), 0),
        "2000_pairs": (lambda: proved("pairs"), 2_000),
        "4_of_32_mib": (lambda: proved("large"), 1),
    }
    times = {}
    for name, (run, expected) in cases.items():
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            with run_scope(spark):
                found = run()
            taken.append(time.perf_counter() - started)
            if found != expected:
                raise AssertionError(f"{name}: {found} instead of {expected}")
        times[name] = round(statistics.median(taken), 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name] or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="12g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        with run_scope(spark):
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    run(names[0])
    times = {}
    for name in names:
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of the headline queries, median of runs",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "duckdb": _oracle_times(sf_dir, names, runs),
        "files": _file_times(spark, runs),
        "files_published": PUBLISHED,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
