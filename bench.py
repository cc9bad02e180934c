"""Benchmark: headline fits and pipelines at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value" (total seconds of "queries"), "unit", "queries"
(seconds each: headline fits, stock pyspark.ml solvers, pipelines), "sf", "variants" (the
same fits on the slower per-pass paths, for comparison, not in the total), plus per-fit
"passes" over the data, "iterations" and "final_loss"}.
Each timing covers the whole job: read, prepare, cache, every pass, result; "queries" are medians of 3,
after one untimed run of each kind of fit and stock solver on the smallest tables.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ridgeline.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="ridgeline-bench")
    spark.sparkContext.setLogLevel("ERROR")

    from pyspark.sql import functions as F

    import ridgeline as rl
    from ridgeline.workload import queries as Q
    from ridgeline.workload.fixtures import (
        LIN3,
        LIN_NET,
        LIN_RAW,
        LOG_SIG,
        embedding_design,
        lineitem_design,
    )

    def lin(fx):
        return lineitem_design(spark, sf_dir, fx)

    def emb4_columns():
        arr = embedding_design(spark, sf_dir, width=4, keep=("embedding",))
        return rl.labeled_points(
            arr.df, "label", {f"e{j}": F.col("embedding")[j] for j in range(4)}, bias=True
        )

    fits = {
        # least squares by Gram moments (2 passes over the source), logistic CG with Newton-step trials
        "cg_linear": lambda: rl.fit_linear(lin(LIN_NET), solver="gram", storage="none"),
        "gd": lambda: rl.fit_gd(lin(LIN3), step_size=Q.GD_STEP, max_iter=Q.GD_MAX, tol=Q.GD_TOL, solver="gram", storage="none"),
        "gd_stock": lambda: rl.fit_gd_stock(lin(LIN_RAW), step_size=Q.STOCK_STEP, max_iter=Q.STOCK_MAX, tol=Q.STOCK_TOL, solver="gram", storage="none"),
        "cg_logistic": lambda: rl.fit_logistic(lin(LOG_SIG), newton_steps=True),
        "cg_logistic_l2": lambda: rl.fit_logistic(lin(LOG_SIG), reg_param=Q.RIDGE, newton_steps=True),
        "cg_array_logistic": lambda: rl.fit_logistic(embedding_design(spark, sf_dir), reg_param=Q.RIDGE),
        # stock pyspark.ml solvers on the same tables
        "ml_linear_normal": lambda: rl.fit_ml_linear(lin(LIN_NET), solver="normal"),
        "lbfgs_logistic": lambda: rl.fit_lbfgs_logistic(lin(LOG_SIG)),
    }
    variants = {
        # the same fits on the per-pass paths, for the passes / time comparison (not in the total)
        "cg_linear_passes": lambda: rl.fit_linear(lin(LIN_NET), solver="passes"),
        "cg_linear_wolfe": lambda: rl.fit_linear(lin(LIN_NET), solver="passes", line_search="wolfe"),
        "gd_passes": lambda: rl.fit_gd(lin(LIN3), step_size=Q.GD_STEP, max_iter=Q.GD_MAX, tol=Q.GD_TOL, solver="passes"),
        "cg_logistic_plain_search": lambda: rl.fit_logistic(lin(LOG_SIG)),
        "lbfgs_own_logistic": lambda: rl.fit_lbfgs(lin(LOG_SIG)),
        "cg_logistic_l1": lambda: rl.fit_logistic(Q.log_sig3(spark, sf_dir), updater=rl.l1(Q.L1_WEIGHT)),
        "cg_logistic_sequential_search": lambda: rl.fit_logistic(lin(LOG_SIG), batched=False),
        # form A (columns) vs form B (array) on the same 4 embedding entries + bias
        "cg_emb4_columns": lambda: rl.fit_logistic(emb4_columns(), reg_param=Q.RIDGE),
        "cg_emb4_array": lambda: rl.fit_logistic(embedding_design(spark, sf_dir, width=4), reg_param=Q.RIDGE),
    }
    pipelines = {
        "linear_pipeline_mse": Q.q_linear_pipeline_mse,
        "logistic_pipeline_accuracy": Q.q_logistic_pipeline_accuracy,
    }

    # warm the JVM (class loading, JIT, codegen paths) on the smallest tables, untimed
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        rl.fit_logistic(lineitem_design(spark, warm, LOG_SIG))
        rl.fit_linear(lineitem_design(spark, warm, LIN_NET))
        rl.fit_lbfgs_logistic(lineitem_design(spark, warm, LOG_SIG))
        rl.fit_ml_linear(lineitem_design(spark, warm, LIN_NET))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()

    out = {"queries": {}, "variants": {}, "passes": {}, "iterations": {}, "final_loss": {}, "weights": {}}
    for group, table in (("queries", fits), ("variants", variants)):
        for name, fn in table.items():
            seconds = []
            for _ in range(3 if group == "queries" else 1):
                t0 = time.perf_counter()
                res = fn()
                seconds.append(time.perf_counter() - t0)
            out[group][name] = round(median(seconds), 3)
            stock = res.method == "lbfgs" or res.method.startswith("ml_")
            out["passes"][name] = None if stock else res.total_passes
            out["iterations"][name] = int(res.iterations)
            out["final_loss"][name] = None if res.final_loss is None else float(res.final_loss)
            out["weights"][name] = [round(float(v), 8) for v in res.weights[:4]]
    for name, fn in pipelines.items():
        seconds = []
        for _ in range(3):
            t0 = time.perf_counter()
            fn(spark, sf_dir).collect()
            seconds.append(time.perf_counter() - t0)
        out["queries"][name] = round(median(seconds), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(out["queries"].values()), 3)
    line = {
        "metric": "total_seconds_fits_and_pipelines",
        "value": total,
        "unit": "sec",
        "queries": out["queries"],
        "sf": float(m.group(1)) if m else None,
        "variants": out["variants"],
        "cpus": cpus,
        "passes": out["passes"],
        "iterations": out["iterations"],
        "final_loss": out["final_loss"],
        "weights": out["weights"],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
