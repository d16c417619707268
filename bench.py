"""Time the headline queries and print one JSON line.

Every query is run to completion with all its columns (the noop sink), so nothing is pruned away."""

import json
import os
import time

from tracemill.plans import QUERIES
from tracemill.session import build_session

HEADLINE = ["pass_k_by_arm", "run_summary", "paired_pass_k", "paired_bootstrap", "paired_bootstrap_merged", "task_type_breakdown",
            "reward_trend_gate", "group_advantages", "reward_rule_signal", "step_metrics", "persona_breakdown", "beta_prior", "posterior_weights",
            "weighted_task_draw", "validation_cascade", "unique_signature_tasks", "entity_overlap", "structural_dedupe", "stratified_carve",
            "rollout_slots", "auth_before_first_write", "write_match", "results_of_calls", "termination_fold", "episode_write_metrics",
            "consistency_gate", "training_sequences", "vague_targets", "decoy_orders", "variant_outcomes", "varied_tasks", "record_quarantine",
            "simulation_scan", "stream_group_settlement"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
                          **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's engines
    times = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
