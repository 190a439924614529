"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the input and the local cores.  Every query is run in full into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilflow.plans import catalog
from vigilflow.session import local_session

HEADLINES = """
overview_kpis threat_distribution severity_distribution top_threat_sources security_timeline
hunt_predictions network_convergence hunting_summary source_profile source_timeline source_destinations
incident_linked_counts incident_timeline prediction_investigation alert_transitions incident_transitions
report_summary incidents_csv incident_evidence
clean_infinite normalize_labels flow_rates conn_per_destination exact_dedup
quantile_bounds robust_scale train_test_split profile_numeric profile_categorical
classifier_metrics risk_triage risk_reasons scrub_details leak_scan stream_timeline lifecycle_stream
isolation_forest_score random_forest_score processed_dataset stream_score incident_detail dataset_json_export
""".split()


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, folder, "audit_summary")  # starts the JVM's code paths
    names = sys.argv[1:] or HEADLINES
    times = {}
    for name in names:
        times[name] = run(spark, folder, name)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(
        json.dumps({"metric": "headline queries wall time", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1]})
    )


if __name__ == "__main__":
    main()
