"""Run a program: ``python -m minekit.plans <program> <arguments...>``; see README for the arguments."""

import sys

from pyspark.sql import SparkSession

from minekit.plans import baskets, housing, recommender, topics, trips


def _housing(kind):
    return lambda spark, *args: housing.regress(spark, kind, *args)


PROGRAMS = {
    "pairs": baskets.pairs,
    "stripes": baskets.stripes,
    "confidence": baskets.confidence,
    "lift": baskets.lift,
    "trip-classes": trips.classify,
    "trip-regression": trips.regress,
    "topic-texts": topics.prepare,
    "topics": topics.model,
    "recommend": recommender.recommend,
    "housing-prepare": housing.prepare,
    "housing-dt": _housing("dt"),
    "housing-rf": _housing("rf"),
    "housing-gbt": _housing("gbt"),
    "housing-predict": housing.predict,
}


def main(argv: list[str]) -> int:
    if not argv or argv[0] not in PROGRAMS:
        print("programs:", ", ".join(PROGRAMS), file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"minekit {argv[0]}").getOrCreate()
    print(PROGRAMS[argv[0]](spark, *argv[1:]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
