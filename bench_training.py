"""Training throughput on generated points: d = 100, k = 30, five rounds.

Usage: python bench_training.py [rows]. Points are generated by Spark, written to the session's
shared folder and read back, so that a round costs what it costs on stored data. Prints one JSON
line with seconds per round (first and later ones apart) and rows · k · d per second.
"""

from __future__ import annotations

import json
import os
import sys
import time

from bench import session
from millrace.operators import datagen, kmeans, nearest
from millrace.plans.scratch import remove, write_table

D, K, ROUNDS = 100, 30, 5


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 1_000_000
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    mixture = datagen.Mixture(d=D, k=K)
    points, centers, _ = datagen.gaussian_mixture(spark, mixture, n_rows=rows, partitions=64)
    start = time.perf_counter()
    stored, path = write_table(points.select("point_id", "features"), "points")
    generated = time.perf_counter() - start
    try:
        data = stored.select("features").persist(kmeans.storage_level("MEMORY_AND_DISK"))
        model, seconds = nearest.collect_centers(centers), []
        for _ in range(ROUNDS):
            start = time.perf_counter()
            model, _ = kmeans.one_round(data, model, "features")
            seconds.append(time.perf_counter() - start)
        data.unpersist()
        later = sum(seconds[1:]) / (ROUNDS - 1)
        print(
            json.dumps(
                {
                    "rows": rows,
                    "d": D,
                    "k": K,
                    "generate_and_write_sec": round(generated, 3),
                    "first_round_sec": round(seconds[0], 3),
                    "later_round_sec": round(later, 3),
                    "rows_k_d_per_sec": round(rows * K * D / later),
                }
            )
        )
    finally:
        remove(spark, path)
        spark.stop()


if __name__ == "__main__":
    main()
