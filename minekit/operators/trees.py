"""Fitted trees as tables: the text of a model becomes rows, the rows become one column expression.

The table ``(tree, weight, node, parent, side, feature, threshold, categories, prediction)`` can be
stored, queried and scored without the library that fitted the model. It is as large as the model
(trees times nodes, both bounded by its parameters), not as the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.operators.models import tree_text

SCHEMA = (
    "tree int, weight double, node int, parent int, side string, feature int, threshold double, "
    "categories array<double>, prediction double"
)

# The lines of a model text.
_TREE = re.compile(r"\s*Tree (\d+) \(weight (\S+)\):")
_IF = re.compile(r"\s*If \(feature (\d+) (?:<= (\S+)|in \{([^}]*)\})\)")
_ELSE = re.compile(r"\s*Else \(feature ")
_LEAF = re.compile(r"\s*Predict: (\S+)")


def parse(text: str) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` from a model text; nodes are numbered per tree in the order of the text.

    A single tree has number 0 and weight 1. ``side`` is the branch of ``parent`` on which a node
    hangs, ``left`` where the condition holds. A text that breaks off or names no tree is an error.
    """
    tree, weight, node = 0, 1.0, 0
    waiting: list[list] = []  # [node, side], the way from the root to where the next node hangs
    complete = False
    for line in text.splitlines():
        if found := _TREE.match(line):
            tree, weight, node, complete = int(found[1]), float(found[2]), 0, False
            if waiting:
                raise ValueError(f"the tree before tree {tree} breaks off")
        elif _ELSE.match(line):
            waiting[-1][1] = "right"
        elif (split := _IF.match(line)) or (leaf := _LEAF.match(line)):
            if complete:
                raise ValueError(f"tree {tree} has two roots")
            parent, side = waiting[-1] if waiting else (None, None)
            if split:
                listed = None if split[3] is None else [float(x) for x in split[3].split(",")]
                threshold = None if split[2] is None else float(split[2])
                yield tree, weight, node, parent, side, int(split[1]), threshold, listed, None
                waiting.append([node, "left"])
            else:
                yield tree, weight, node, parent, side, None, None, None, float(leaf[1])
                while waiting and waiting[-1][1] == "right":
                    waiting.pop()
                complete = not waiting
            node += 1
    if waiting or not complete:
        raise ValueError("the model text holds no complete tree")


def tree_table(spark: SparkSession, model: Model) -> DataFrame:
    """The trees of a fitted tree, forest or boosted model (or of a pipeline that ends in one).

    ``weight`` is the share of the tree in the sum that is the prediction: 1 over the number of
    trees in a forest, the learned weight in a boosted model. Classes of a forest are decided by
    votes that the text does not hold, so forests of classes are an error.
    """
    text = tree_text(model)
    if re.match(r"(RandomForest|GBT)Classification", text):
        raise ValueError("the text of a classifying ensemble does not hold its votes")
    rows = list(parse(text))
    if text.startswith("RandomForest"):
        n = len({r[0] for r in rows})
        rows = [(r[0], r[1] / n, *r[2:]) for r in rows]
    return spark.createDataFrame(rows, SCHEMA)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def score_expression(table: DataFrame, features: Sequence[str]) -> Column:
    """The prediction as one column over ``features``, given in the order of the fit.

    Comparisons follow the fitted model: a value equal to the threshold goes left, NaN goes right. A
    row with a missing feature has no prediction. An empty table scores nothing: NULL.
    """
    children: dict[tuple, tuple] = {}
    weights: dict[int, float] = {}
    for r in table.collect():  # the model, bounded by its parameters
        children[r.tree, r.parent, r.side] = r
        weights[r.tree] = r.weight

    def branch(tree: int, parent: int | None, side: str | None) -> str:
        r = children[tree, parent, side]
        if r.feature is None:
            return f"{r.prediction!r}D"
        value = f"CAST({_quoted(features[r.feature])} AS DOUBLE)"
        if r.threshold is not None:
            condition = f"{value} <= {r.threshold!r}D"
        else:
            condition = f"{value} IN ({', '.join(f'{c!r}D' for c in r.categories)})"
        left, right = (branch(tree, r.node, s) for s in ("left", "right"))
        return f"CASE WHEN {condition} THEN {left} ELSE {right} END"

    if not weights:
        return F.lit(None).cast("double")
    parts = [branch(tree, None, None) for tree in sorted(weights)]
    terms = [p if weights[t] == 1.0 else f"{weights[t]!r}D * {p}" for t, p in zip(sorted(weights), parts)]
    missing = " OR ".join(f"{_quoted(f)} IS NULL" for f in features)
    return F.expr(f"CASE WHEN NOT ({missing}) THEN {' + '.join(f'({x})' for x in terms)} END")


def score(table: DataFrame, df: DataFrame, features: Sequence[str], name: str = "prediction") -> DataFrame:
    """``df`` and its prediction by the stored trees; one projection, no shuffle, no Python."""
    return df.withColumn(name, score_expression(table, features))

