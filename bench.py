"""Headline timings: build the fact once, store it, then run the queries on the stored table.

Prints one JSON line. `BENCH_SF_DIR` names the input folder, `BENCH_CPUS` the cores.
"""

import json
import os
import tempfile
import time

from erario import fixtures, session
from erario.operators import timeline
from erario.operators.aggregate import between, evolution, ranking
from erario.operators.compare import fingerprint
from erario.operators.quality import duplicate_summary, monthly_validation
from erario.plans import checks, model, report
from erario.schema import ACTION, BI_MEASURES, GROUP, ORGAN, PROGRAM

START, END = "1996-02-01", "1999-11-01"


def run(df):
    df.write.format("noop").mode("overwrite").save()


def workloads(bi, typed):
    ranged = between(bi, START, END)
    yield from ((f"{q}_{n}", model.aggregate_view(bi, n)) for q, n in zip(("q11", "q12", "q13", "q14"), model.VIEW_KEYS))
    yield "q15_monthly_validation", monthly_validation(bi)
    yield "q16_top_organs", ranking(ranged, ORGAN)
    yield "q17_top_programs", ranking(ranged, PROGRAM)
    yield "q18_top_actions", ranking(ranged, PROGRAM + ACTION)
    yield "q19_organ_evolution", evolution(ranged, ORGAN)
    yield "q20_program_evolution", evolution(ranged, PROGRAM)
    yield "q21_group_evolution", evolution(ranged, GROUP, BI_MEASURES)
    yield "q22_accumulated", report.totals(ranged)
    yield "w01_w03_variation", timeline.with_variation(bi, ["codigo_orgao_superior"])
    yield "w04_running_total", timeline.running_total(bi, ["codigo_programa"])
    yield "v06_organ_month_cube", report.label_month_matrix(bi, "Orgao")
    yield "v08_hierarchy_rollup", report.classification(bi)
    yield "a16_fingerprint", fingerprint(bi)
    yield "q08_duplicates", duplicate_summary(bi)
    views = model.aggregate_views(bi)
    yield "r06_projection_measures", checks.projection_measures(typed, model.bi_projection(typed))
    yield "r08_view_months", checks.view_months(bi, views)
    yield "r12_reconciliation", checks.reconciliation(bi, views)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    base = spark.conf.get("spark.checkpoint.dir", None)
    store = f"{base}/bench-{time.time_ns()}" if base else tempfile.mkdtemp(prefix="run-", dir="/tmp")
    seconds = {}

    def timed(name, action):
        began = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - began, 3)

    by_month = lambda df, name: df.hint("rebalance", "periodo").write.partitionBy("periodo").parquet(f"{store}/{name}")
    timed("load_fact", lambda: by_month(fixtures.fact(spark, sf_dir), "fact"))
    timed("load_typed", lambda: by_month(fixtures.despesas(spark, sf_dir), "despesas"))
    bi, typed = spark.read.parquet(f"{store}/fact"), spark.read.parquet(f"{store}/despesas")
    run(report.totals(bi))
    for name, df in workloads(bi, typed):
        timed(name, lambda: run(df))
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
