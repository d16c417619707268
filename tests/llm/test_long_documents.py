"""Long documents that are dense in what an operator looks for, in a session of its own with a small heap."""

import json
import os
import subprocess
import sys

import pytest

pytest.importorskip("public_tokenizers")

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import json, sys
from tracemill.llm import decontam, stages
from tracemill.session import build_session
step, folder = sys.argv[1:]
spark = build_session("small", master="local[1]", shuffle_partitions=2, **{"spark.driver.memory": "512m", "spark.ui.enabled": "false",
                      "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"{folder}/kept"})
item = " ".join(f"b{i}" for i in range(30))
docs = spark.createDataFrame([(1, " ".join([item] * 300)), (2, " ".join(f"c{i}" for i in range(9000))), (3, None)], "doc_id long, text string")
bench = spark.createDataFrame([("i", item)], "item_id string, text string")
if step == "contamination":
    out = [tuple(r) for r in decontam.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "contaminated").collect()]
else:
    bench.write.parquet(f"{folder}/benchmark.parquet")
    out = [(r.doc_id,) for r in stages.clean(spark, docs, folder).collect()]
print("GOT", json.dumps(sorted(out)))
"""


def ran(step, folder):
    done = subprocess.run([sys.executable, "-c", SCRIPT, step, str(folder)], cwd=REPO, env=os.environ | {"PYTHONPATH": REPO}, capture_output=True, text=True, timeout=300)
    found = [x for x in done.stdout.splitlines() if x.startswith("GOT ")]
    assert found, done.stderr[-2000:]
    return json.loads(found[0][4:])


def test_document_of_benchmark_text_alone(tmp_path):
    """Nearly every word begins a benchmark token: the places hold words in proportion to the document, not to its square."""
    assert ran("contamination", tmp_path) == [[1, 9000, 9000, True], [2, 9000, 0, False], [3, 0, 0, False]]


def test_stage_over_a_document_of_benchmark_text_alone(tmp_path):
    """The pipeline's third stage drops it and keeps the others, in the same heap."""
    assert ran("stage", tmp_path) == [[2], [3]]
