"""The operators on workers that do not have this package: another working folder, no PYTHONPATH."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from vigilflow.session import local_session
spark = local_session(4, 4)
spark.sparkContext.setLogLevel("ERROR")
def known(rows):
    import importlib.util
    yield importlib.util.find_spec("vigilflow") is not None
sees = spark.sparkContext.parallelize([1], 1).mapPartitions(known).collect()
from vigilflow.llm import queries
for name in ("op1_line_crf", "op5_simhash", "op6_pu_toxicity", "op7_pivot_index", "op9_piece_viterbi", "op11_divergence", "op12_rule_ledger", "op13_collocations"):
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, sees)
"""


def test_python_operators_run_without_the_package_on_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    rows = [line.split() for line in ran.stdout.splitlines() if line.startswith("op")]
    assert len(rows) == 8 and all(r[1:] == ["True", "[False]"] or r[0] == "op13_collocations" and r[2] == "[False]" for r in rows), ran.stdout + ran.stderr[-3000:]
