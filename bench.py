"""Headline timings on one machine: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from topicweave.operators.cells import place_corpus
from topicweave.operators.nmf import fit_nmf
from topicweave.operators.plsa import fit_em
from topicweave.operators.svd import truncated_svd
from topicweave.plans import queries as plans
from topicweave.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
TOPICS = 10

# Whole registered queries, in an order where the first model query pays for
# placing the cells and fitting; the reports after it reuse the fitted model.
QUERIES = [
    "clean_text",
    "term_counts",
    "latest_per_account",
    "status_dedup",
    "plsa_topic_prior",
    "vocabulary",
    "plsa_reconstruct",
    "model_residuals",
    "top_words",
    "topic_top_docs",
    "dominant_topic",
    "fold_in",
    "search",
    "search_batch",
]


def main() -> None:
    spark = build_session(
        "bench",
        master=f"local[{CPUS}]",
        shuffle_partitions=int(CPUS),
        **{
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> object:
        start = time.time()
        result = run()
        seconds[name] = round(time.time() - start, 3)
        return result

    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not measured
    registry = plans.registry()
    for name in QUERIES:
        timed(
            name,
            lambda q=registry[name]: q(spark, SF_DIR).write.format("noop").mode("overwrite").save(),
        )
    plans.forget()

    corpus = plans.documents(spark, SF_DIR)
    blocks = timed("place_corpus", lambda: place_corpus(corpus))
    timed("em_k10_1_iteration", lambda: fit_em(blocks, TOPICS, 1))
    timed("em_k10_5_iterations", lambda: fit_em(blocks, TOPICS, 5))
    seconds["em_k10_per_iteration"] = round(
        (seconds["em_k10_5_iterations"] - seconds["em_k10_1_iteration"]) / 4, 3
    )
    for name in ["sklearn", "simple_MU", "HALS", "Lin_PG", "ANLS_BLOCKPIVOT"]:
        timed(f"nmf_{name}_2_iterations", lambda n=name: fit_nmf(blocks, TOPICS, 2, n))
    timed("svd_10_values", lambda: truncated_svd(blocks, 10, 3).sigma)
    blocks.release()

    measured = [s for n, s in seconds.items() if n != "em_k10_per_iteration"]
    print(
        json.dumps(
            {
                "metric": "topic analytics, all headline queries",
                "value": round(sum(measured), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
