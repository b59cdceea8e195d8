"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from chatloom.plans.queries import REGISTRY
from chatloom.session import build_session

HEADLINE = [
    "prepare_chat",
    "window_documents",
    "pack_by_chars",
    "long_window_corpus",
    "window_ids",
    "tokens_by_channel",
    "window_documents_tokens",
    "term_vocabulary",
    "topic_term_counts",
    "ctfidf",
    "cluster_profile_by_label",
    "silhouette_exact",
    "silhouette_simplified",
    "representative_message",
    "topic_timeline",
    "train_test_split",
    "knn_graph",
    "density_clusters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__log__level="ERROR",
    )
    REGISTRY["label_map"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))


if __name__ == "__main__":
    main()
