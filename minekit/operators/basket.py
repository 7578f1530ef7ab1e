"""Market-basket operators: baskets, pair counts, stripes, association rules.

Columns are ``user`` and ``item`` throughout; pairs are ``(item_a, item_b, n)`` with
``item_a < item_b``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minekit.functions import number_from_text
from minekit.operators.scale import in_parts, large_groups, list_parts

BASKET_BLOCK = 2_000
LIST_BLOCK = 10_000
MAX_LOOKUP = 32  # baskets looked up instead of expanded; one bit of a bigint each


def liked_items(
    ratings: DataFrame,
    user: str = "user",
    item: str = "item",
    rating: str = "rating",
    min_rating: float = 4.0,
) -> DataFrame:
    """Distinct ``(user, item)`` of ratings at or above ``min_rating``; unreadable rows drop out."""
    is_text = isinstance(ratings.schema[rating].dataType, T.StringType)
    value = number_from_text(rating) if is_text else F.col(rating)
    # explicit null tests: the ones later joins imply are then already there, and every use of
    # the result has the same plan and shares its shuffle
    return (
        ratings.where(value >= F.lit(float(min_rating)))
        .select(F.col(user).alias("user"), F.col(item).alias("item"))
        .where(F.col("user").isNotNull() & F.col("item").isNotNull())
        .distinct()
    )


def item_frequency(liked: DataFrame) -> DataFrame:
    """How many users like each item; repeated rows count once."""
    distinct = liked.select("user", "item").distinct()
    return distinct.groupBy("item").agg(F.count(F.lit(1)).alias("freq"))


def user_baskets(liked: DataFrame, max_items: int = LIST_BLOCK) -> DataFrame:
    """``(user, part, items)``: sorted item lists, long baskets spread over several parts."""
    distinct = liked.select("user", "item").distinct()
    return list_parts(distinct, "user", "item", max_items, F.col("item")).withColumnRenamed(
        "entries", "items"
    )


def pair_counts(liked: DataFrame, min_pairs: int = 1, block: int = BASKET_BLOCK) -> DataFrame:
    """In how many baskets each unordered item pair occurs together, pairs seen >= ``min_pairs``.

    Exact for every input; what keeps it affordable:

    * Items liked by fewer than ``min_pairs`` users cannot be part of a result pair and are
      removed before the self-join (n(a,b) <= min(freq a, freq b)).
    * With ``min_pairs`` = m a result pair occurs in at least one basket besides the m-1 largest.
      Those baskets, where larger than ``block``, are looked up and not expanded: each item
      carries one bit per such basket and a pair adds the baskets whose bit both items have.
    * Any other basket above ``block`` items is cut into B hash blocks and joined cell by cell,
      one cell per pair of blocks, so a huge basket becomes many bounded join keys instead of
      one task.
    * Both sides of the self-join are the same table, so they share one shuffle; counts are
      combined map-side before the only pair-sized shuffle.
    """
    return _counted(liked, min_pairs, block, frequencies=False)


def pair_frequencies(liked: DataFrame, min_pairs: int = 1, block: int = BASKET_BLOCK) -> DataFrame:
    """``pair_counts`` with ``freq_a`` and ``freq_b``, how many users like either item.

    Each row takes the frequency of its item along before the self-join, so the pairs, which are
    far more than the rows, are never shuffled to look frequencies up.
    """
    return _counted(liked, min_pairs, block, frequencies=True)


def pair_counts_apart(
    rows: DataFrame, known: str, min_pairs: int = 1, block: int = BASKET_BLOCK, frequencies: bool = False
) -> DataFrame:
    """Pair counts of ``(user, item, known)`` without the pairs whose rows are both ``known``.

    For pairs that are counted by other means: those of dense items, or of rows seen before.
    """
    return _counted(rows, min_pairs, block, frequencies, known)


def _counted(
    liked: DataFrame, min_pairs: int, block: int, frequencies: bool, known: str | None = None
) -> DataFrame:
    # no cost for `liked_items`, whose rows are distinct: the optimiser drops the second aggregate
    rows = liked.select("user", "item", *([known] if known else [])).distinct()
    large = large_groups(rows, "user", block)
    held = F.lit(0).cast("bigint")
    if min_pairs > 1:
        # at most MAX_LOOKUP rows, hence the broadcasts
        giants = F.broadcast(_largest_baskets(large, min(min_pairs - 1, MAX_LOOKUP)))
        # marked by a left join: an anti join would be pushed below `liked` and compute it twice
        marked = rows.join(giants, "user", "left")
        items = (
            marked.groupBy("item")
            .agg(F.count(F.lit(1)).alias("freq"), F.coalesce(F.bit_or("bit"), held).alias("held"))
            .where(F.col("freq") >= min_pairs)
        )
        rows = marked.where(F.col("bit").isNull()).join(items, "item")
    elif frequencies:
        rows = rows.join(rows.groupBy("item").agg(F.count(F.lit(1)).alias("freq")), "item").withColumn("held", held)
    else:
        rows = rows.withColumn("held", held)
    carried = (["held", "freq"] if frequencies else ["held"]) + ([known] if known else [])
    rows = rows.select("user", "item", *carried)
    every_block = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    cells = (
        in_parts(rows, "user", "item", block, large)
        .withColumn("other", F.explode(every_block))
        .select(
            "user",
            "item",
            *carried,
            "part",
            F.least("part", "other").alias("lo"),
            F.greatest("part", "other").alias("hi"),
        )
    )
    # An explicit number of partitions: adaptive coalescing judges by input bytes, and would pack
    # cells together whose few rows make many pairs.
    slices = int(liked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(slices, "user", "lo", "hi")
    x, y = cells.alias("x"), cells.alias("y")
    same_cell = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("user", "lo", "hi")]
    # within a diagonal cell each pair once, in any other cell only pairs across the two blocks
    once = F.when(F.col("x.lo") == F.col("x.hi"), F.col("x.item") < F.col("y.item")).otherwise(
        F.col("x.part") < F.col("y.part")
    )
    if known:
        once = once & ~(F.col(f"x.{known}") & F.col(f"y.{known}"))
    met = x.join(y, [*same_cell, once])
    pair = [
        F.least("x.item", "y.item").alias("item_a"),
        F.greatest("x.item", "y.item").alias("item_b"),
    ]
    both = F.bit_count(F.col("x.held").bitwiseAND(F.col("y.held"))).cast("bigint")
    n = F.count(F.lit(1)) if min_pairs == 1 else F.count(F.lit(1)) + F.max("both")
    columns = [*pair, *[both.alias("both")] * (min_pairs > 1)]
    taken = []
    if frequencies:
        ordered = F.col("x.item") < F.col("y.item")
        for name, first, second in (("freq_a", "x.freq", "y.freq"), ("freq_b", "y.freq", "x.freq")):
            columns.append(F.when(ordered, F.col(first)).otherwise(F.col(second)).alias(name))
            taken.append(F.max(name).alias(name))  # the same in all rows of a pair
    counted = met.select(*columns).groupBy("item_a", "item_b").agg(n.alias("n"), *taken)
    return counted.where(F.col("n") >= min_pairs) if min_pairs > 1 else counted


def _largest_baskets(large: DataFrame, k: int) -> DataFrame:
    """``(user, bit)``: the ``k`` largest of the large baskets, one bit each."""
    top = large.orderBy(F.desc("size"), "user").limit(k)
    return (
        top.agg(F.sort_array(F.collect_list("user")).alias("users"))
        .select(F.posexplode("users").alias("pos", "user"))
        .select("user", F.expr("shiftleft(1L, pos)").alias("bit"))
    )


def by_count(pairs: DataFrame) -> DataFrame:
    """Most frequent pairs first."""
    return pairs.orderBy(F.desc("n"), "item_a", "item_b")


def item_stripes(pairs: DataFrame, max_entries: int = LIST_BLOCK) -> DataFrame:
    """``(item_a, part, stripe)`` with ``stripe`` a map from partner item to count.

    Built from pair counts, so merging never depends on the partitioning. Items with more than
    ``max_entries`` partners get several parts.
    """
    counts = pairs.select("item_a", "item_b", "n")
    lists = list_parts(counts, "item_a", "item_b", max_entries, F.struct("item_b", "n"))
    return lists.select("item_a", "part", F.map_from_entries("entries").alias("stripe"))


def stripe_value(stripe: str | Column, item: Column | object, default: int = 0) -> Column:
    """The count of ``item`` in one part of a stripe, ``default`` if it is not there."""
    stripe = F.col(stripe) if isinstance(stripe, str) else stripe
    item = item if isinstance(item, Column) else F.lit(item)
    return F.coalesce(F.try_element_at(stripe, item), F.lit(default))


def stripe_lookup(stripes: DataFrame, item: Column | object, default: int = 0) -> DataFrame:
    """``(item_a, n)``: the count of ``item`` in each stripe, over all of its parts."""
    item = item if isinstance(item, Column) else F.lit(item)
    found = F.max(F.try_element_at(F.col("stripe"), item))
    return stripes.groupBy("item_a").agg(F.coalesce(found, F.lit(default)).alias("n"))


def with_titles(
    df: DataFrame,
    id_cols: list[str],
    titles: DataFrame,
    default: str | None = "",
    key: str = "item",
    title: str = "title",
) -> DataFrame:
    """Add ``title_<suffix>`` for each id column (``item_a`` -> ``title_a``), ``default`` if unknown.

    ``default=None`` leaves unknown titles NULL. Ids listed twice keep the smallest title.
    No broadcast hint: the join strategy follows the measured size of the title table.
    """
    names = titles.groupBy(F.col(key).alias("_id")).agg(F.min(title).alias("_title"))
    for id_col in id_cols:
        out = "title" + id_col[len("item"):] if id_col.startswith("item") else f"{id_col}_title"
        found = F.col("_title") if default is None else F.coalesce("_title", F.lit(default))
        df = (
            df.join(names, F.col(id_col) == F.col("_id"), "left")
            .withColumn(out, found)
            .drop("_id", "_title")
        )
    return df


def stripes_named(pairs: DataFrame, titles: DataFrame, max_entries: int = LIST_BLOCK) -> DataFrame:
    """Stripes with titles: ``(item_a, title_a, part, stripe)``, stripe a list of (item, title, n).

    Items stay keyed by id, so two items with the same title are never merged.
    """
    named = with_titles(pairs.select("item_a", "item_b", "n"), ["item_b"], titles)
    entry = F.struct(F.col("item_b").alias("item"), F.col("title_b").alias("title"), "n")
    stripes = list_parts(named, "item_a", "item_b", max_entries, entry).withColumnRenamed("entries", "stripe")
    return with_titles(stripes, ["item_a"], titles).select("item_a", "title_a", "part", "stripe")


def rules_confidence(
    liked: DataFrame,
    min_conf: float = 0.8,
    min_pairs: int = 2,
    directed: bool = True,
    block: int = BASKET_BLOCK,
) -> DataFrame:
    """Rules a -> b with P(b|a) = n(a,b)/freq(a) strictly above ``min_conf``.

    ``directed`` evaluates both orientations of every pair; otherwise only ``item_a < item_b``.
    """
    return by_confidence(pair_frequencies(liked, min_pairs, block), min_conf, directed)


def by_confidence(pairs: DataFrame, min_conf: float = 0.8, directed: bool = True) -> DataFrame:
    """Rules above ``min_conf`` from pairs with ``n``, ``freq_a`` and ``freq_b``, most frequent first."""
    ways = [F.struct("item_a", "item_b", "n", F.col("freq_a").alias("n_a"))]
    if directed:
        back = (F.col("item_b").alias("item_a"), F.col("item_a").alias("item_b"), "n", F.col("freq_b").alias("n_a"))
        ways.append(F.struct(*back))
    return (
        pairs.select(F.inline(F.array(*ways)))
        .withColumn("confidence", F.col("n").cast("double") / F.col("n_a"))
        .where(F.col("confidence") > F.lit(float(min_conf)))
        .select("item_a", "item_b", "n", "n_a", "confidence")
        .orderBy(F.desc("n"), "item_a", "item_b")
    )


def rules_lift(
    liked: DataFrame,
    min_lift: float = 2.5,
    min_pairs: int = 1,
    denominator: str = "rows",
    block: int = BASKET_BLOCK,
) -> DataFrame:
    """Pairs with lift n(a,b)*N/(freq(a)*freq(b)) strictly above ``min_lift``.

    N is the number of liked rows (``"rows"``) or of users (``"baskets"``); it enters the plan as
    a scalar subquery, so the whole report stays one lazy query.
    """
    if denominator not in ("rows", "baskets"):
        raise ValueError("denominator is 'rows' or 'baskets'")
    counted = liked.select("user", *["item"] * (denominator == "rows")).distinct()
    total = counted.agg(F.count(F.lit(1)).cast("double")).scalar()
    observed = F.col("n").cast("double") * F.col("total")
    expected = F.col("freq_a").cast("double") * F.col("freq_b")
    return (
        pair_frequencies(liked, min_pairs, block)
        .withColumn("total", total)
        .where(observed > F.lit(float(min_lift)) * expected)
        .select("item_a", "item_b", "n", "freq_a", "freq_b", (observed / expected).alias("lift"))
        .orderBy(F.desc("lift"), "item_a", "item_b")
    )
