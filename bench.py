"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query runs once, to the end, into Spark's no-op sink. A short scan beforehand keeps JVM start
out of the first number.
"""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from minekit.catalog import queries  # noqa: E402

HEADLINE = """
liked_items user_baskets pair_counts pairs_named item_stripes item_frequency rule_confidence rule_lift
rule_lift_named value_frequency column_modes impute_mode typed_projection null_profile feature_table
hash_split kfold_train_sizes csv_roundtrip routed_predictions dedup_with_id tokens term_counts top_terms
vocabulary doc_term_counts topn_per_user map_score regression_metrics segment_regression linreg_ols
wide_prediction dt_classify dt_regress gbt_regress rf_regress als_recommend lda_topics lda_top_documents
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("minekit-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    catalog, seconds = queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
