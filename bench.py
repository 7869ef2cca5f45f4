"""Headline queries of the engine at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The published baseline counts items per second of one process: chunks
fingerprinted and signed, verifications, decisions and proofs. ``throughput``
gives the same units for whole tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veritrail.plans import catalog  # noqa: E402
from veritrail.runtime import local_session, table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = {
    "fingerprint_chunks": ("chunks_fingerprinted_per_s", ("documents",)),
    "index_rows_signed": ("rows_signed_per_s", ("documents",)),
    "verify_outcomes": ("verifications_per_s", ("documents", "benchmark", "conversations")),
    "policy_decisions_chunks": ("chunk_decisions_per_s", ("documents",)),
    "tool_admission": ("tool_decisions_per_s", ("events",)),
    "merkle_proof_verification": ("proofs_per_s", ("documents",)),
    "fingerprint_windows": (None, ()),
    "receipt_summary": (None, ()),
    "security_events": (None, ()),
    "dag_checks": (None, ()),
    "trajectory_rollup": (None, ()),
    "rate_anomaly": (None, ()),
}


def run(spark, name: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: table(spark, SF_DIR, t).count() for t in ("documents", "benchmark", "conversations", "events")}
    times, throughput = {}, {}
    for name, (unit, tables) in HEADLINE.items():
        run(spark, name)  # compiled code and warm files, as in a long-lived session
        times[name] = round(run(spark, name), 3)
        if unit:
            throughput[unit] = round(sum(rows[t] for t in tables) / times[name])
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "throughput": throughput, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
