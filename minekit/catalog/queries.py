"""One callable ``(spark, sf_dir) -> DataFrame`` per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.catalog import tables as t
from minekit.functions import duration_bin
from minekit.operators import (
    basket,
    bitmaps,
    containment,
    dictionary,
    digests,
    heavy,
    metrics,
    models,
    moments,
    prep,
    products,
    ranking,
    recommend,
    stripe_store,
    text,
    topics,
    trees,
)
from minekit.operators.scale import checkpointed, dealt, scratch_path
from minekit.sources import (
    read_csv,
    read_headerless,
    read_routed,
    write_csv,
    write_routed,
    write_text,
)

Query = Callable[[SparkSession, str], DataFrame]

TRIP_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "day_of_week", "l_linenumber"]
TRIP_KEYS = ["l_orderkey", "l_linenumber"]
QUANTITY_BINS = 64  # at least one split candidate per quantity 1..50
# The six months of the wide prediction output.
MONTHS = ["201610", "201611", "201612", "201710", "201711", "201712"]


# --- baskets -------------------------------------------------------------------------------


def _liked_parts(spark: SparkSession, sf: str) -> DataFrame:
    return basket.liked_items(t.part_ratings(spark, sf), min_rating=t.LIKED_QUANTITY)


def _liked_brands(spark: SparkSession, sf: str) -> DataFrame:
    return basket.liked_items(t.brand_ratings(spark, sf), min_rating=t.BRAND_QUANTITY)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return basket.pair_counts(_liked_parts(spark, sf))


def titles_or_null(spark: SparkSession, sf: str) -> DataFrame:
    """Item frequencies with titles from a list that lacks some items; those stay NULL."""
    titles = t.table(spark, sf, "part").where("p_size <= 25").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("title")
    )
    frequency = basket.item_frequency(_liked_parts(spark, sf)).withColumnRenamed("item", "item_a")
    return basket.with_titles(frequency, ["item_a"], titles, default=None)


def stripe_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One brand looked up in the stripes of all others, which lie in several parts."""
    pairs = basket.pair_counts(_liked_brands(spark, sf))
    return basket.stripe_lookup(basket.item_stripes(pairs, max_entries=4), "Brand#33")


def user_baskets(spark: SparkSession, sf: str) -> DataFrame:
    lists = basket.user_baskets(_liked_parts(spark, sf))
    return lists.select("user", "part", F.array_join("items", ",").alias("items"))


def pairs_named(spark: SparkSession, sf: str) -> DataFrame:
    titles = t.part_titles(spark, sf)
    return basket.by_count(basket.with_titles(_pairs(spark, sf), ["item_a", "item_b"], titles))


def item_stripes(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.transform(
        F.map_entries("stripe"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))
    )
    stripes = basket.item_stripes(_pairs(spark, sf))
    return stripes.select("item_a", "part", F.array_join(cells, ",").alias("stripe"))


def stripes_named(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.transform("stripe", lambda e: F.concat_ws(":", e["title"], e["n"].cast("string")))
    stripes = basket.stripes_named(_pairs(spark, sf), t.part_titles(spark, sf))
    return stripes.select("item_a", "title_a", "part", F.array_join(cells, ",").alias("stripe"))


def rule_confidence_one_way(spark: SparkSession, sf: str) -> DataFrame:
    return basket.rules_confidence(_liked_brands(spark, sf), directed=False)


def rule_lift_baskets(spark: SparkSession, sf: str) -> DataFrame:
    return basket.rules_lift(_liked_brands(spark, sf), min_lift=1.02, min_pairs=3, denominator="baskets")


def rule_lift(spark: SparkSession, sf: str) -> DataFrame:
    return basket.rules_lift(_liked_parts(spark, sf), min_pairs=2)


def rule_lift_named(spark: SparkSession, sf: str) -> DataFrame:
    rules = basket.rules_lift(_liked_parts(spark, sf))
    named = basket.with_titles(rules, ["item_a", "item_b"], t.part_titles(spark, sf))
    return named.select("item_a", "title_a", "item_b", "title_b", "lift").orderBy(
        F.desc("lift"), "item_a", "item_b"
    )


def rule_confidence_bits(spark: SparkSession, sf: str) -> DataFrame:
    return bitmaps.rules_confidence(_liked_brands(spark, sf))


def rule_confidence_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return containment.rules_confidence(_liked_brands(spark, sf))


def confidence_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """How few pairs of parts the prefixes open, of all that occur together."""
    liked = _liked_parts(spark, sf)
    few = containment.candidates(liked, 0.8, 1).agg(F.count(F.lit(1)).alias("n_candidates"))
    together = basket.pair_counts(liked).agg((F.count(F.lit(1)) * 2).alias("n_pairs"))
    return few.withColumn("n_pairs", together.scalar())


def pair_counts_bits(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of parts, of which those with at least a five-hundredth of the customers are counted by bits."""
    return bitmaps.pair_counts(_liked_parts(spark, sf), share=500)


def brand_pairs_bits(spark: SparkSession, sf: str) -> DataFrame:
    return bitmaps.pair_counts(_liked_brands(spark, sf))


def stripes_in_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Stripes of a store that got the odd orders, then the even ones, then some of both again."""
    path = scratch_path(spark, "stripes")
    stripe_store.create(spark, path)
    lines = t.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    rated = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    batches = ("l_orderkey % 2 = 1", "l_orderkey % 2 = 0", "l_orderkey % 5 = 0")
    for number, chosen in enumerate(batches, 1):
        batch = basket.liked_items(rated.where(chosen), "o_custkey", "l_partkey", "l_quantity", t.LIKED_QUANTITY)
        stripe_store.add(spark, path, number, batch)
    cells = F.transform(
        F.map_entries("stripe"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))
    )
    return stripe_store.item_stripes(spark, path).select("item_a", "part", F.array_join(cells, ",").alias("stripe"))


# --- preparation ---------------------------------------------------------------------------


def value_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return prep.value_frequency(t.gappy_events(spark, sf), ["kind", "k", "grp"], 5)


def heavy_hitters(spark: SparkSession, sf: str) -> DataFrame:
    """Skewed columns, and one in which every value is its own."""
    return heavy.heavy_hitters(t.gappy_events(spark, sf), ["kind", "k", "grp", "event_id"], 5)


def column_modes(spark: SparkSession, sf: str) -> DataFrame:
    return prep.column_modes(t.gappy_events(spark, sf), ["kind", "k", "grp"])


def impute_mode(spark: SparkSession, sf: str) -> DataFrame:
    return prep.impute_mode(t.gappy_events(spark, sf), ["kind", "k"]).select("event_id", "kind", "k")


def impute_constant(spark: SparkSession, sf: str) -> DataFrame:
    filled = prep.impute_constant(
        t.gappy_events(spark, sf), {"kind": "none", "k": "2.0", "amount": "345.72"}
    )
    return filled.select("event_id", "kind", "k", "amount")


def typed_projection(spark: SparkSession, sf: str) -> DataFrame:
    texts = t.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        F.concat(F.lit("0"), F.col("l_linenumber").cast("string")).alias("l_linenumber"),
        F.col("l_quantity").cast("string").alias("l_quantity"),
        F.col("l_extendedprice").cast("string").alias("l_extendedprice"),
        F.col("l_discount").cast("string").alias("discount_floor"),
        (F.col("l_extendedprice") * 1000).cast("string").alias("milli_price"),  # with exponents from 10^7 on
        F.col("l_returnflag").alias("not_a_number"),
    )
    return prep.typed_projection(
        texts,
        {
            "l_orderkey": "bigint",
            "l_linenumber": "int",
            "l_quantity": "int",
            "l_extendedprice": "double",
            "discount_floor": "int",
            "milli_price": "bigint",
            "not_a_number": "int",
        },
    )


def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    profile = prep.null_profile(t.gappy_events(spark, sf), ["event_id", "kind", "k", "amount"])
    rounded = {c: F.round(c, 4) for c in ("mean", "stddev", "min", "max")}
    return profile.withColumns(rounded)


def drop_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return prep.drop_report(t.gappy_events(spark, sf))


def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    return prep.drop_nulls(t.gappy_events(spark, sf))


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    parts = t.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), "p_size", "p_retailprice")
    sales = (
        t.table(spark, sf, "lineitem")
        .groupBy(F.col("l_partkey").alias("key"))
        .agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("units"))
    )
    return prep.feature_table(
        parts,
        sales,
        "key",
        ["key", "p_size", "p_retailprice", "lines", "units"],
        ["id_part", "size", "price", "num_lines", "num_units"],
    )


def duration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", duration_bin("l_quantity").cast("bigint").alias("bin")
    )


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    orders = t.table(spark, sf, "orders").select("o_orderkey")
    train, test = prep.hash_split(orders, ["o_orderkey"], 0.8)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def kfold_train_sizes(spark: SparkSession, sf: str) -> DataFrame:
    orders = t.table(spark, sf, "orders").select("o_orderkey")
    sizes = prep.fold_sizes(prep.with_fold(orders, ["o_orderkey"], 5))
    return sizes.withColumn("fold", F.col("fold").cast("bigint"))


# --- files ---------------------------------------------------------------------------------

ORDER_SCHEMA = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)
ORDER_COLUMNS = [part.split()[0] for part in ORDER_SCHEMA.split(", ")]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "orders").select(*ORDER_COLUMNS)


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_csv(_orders(spark, sf), path)
    return read_csv(spark, path, ORDER_SCHEMA)


def csv_schema_prefix(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "prefix")
    write_csv(_orders(spark, sf), path)
    return read_csv(spark, path, "id_order long, id_customer long")


def csv_glob_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "glob")
    write_csv(_orders(spark, sf).repartition(4, "o_orderkey"), path)
    return read_csv(spark, path + "/*.csv", ORDER_SCHEMA)


def headerless_ratings(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "text")
    write_text(t.part_ratings(spark, sf), path)
    raw = read_headerless(spark, path).toDF("user", "item", "rating")
    typed = prep.typed_projection(raw, {"user": "bigint", "item": "bigint", "rating": "double"})
    return basket.liked_items(typed, min_rating=t.LIKED_QUANTITY)


def routed_predictions(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "routed")
    scored = t.trips(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("duration_bin").alias("prediction")
    )
    write_routed(scored, path)
    sizes = [
        read_routed(spark, path, k).agg(
            F.lit(k).cast("bigint").alias("prediction"),
            F.count(F.lit(1)).alias("n"),
            F.min("l_quantity").alias("lowest"),
            F.max("l_quantity").alias("highest"),
        )
        for k in range(1, 7)
    ]
    out = sizes[0]
    for part in sizes[1:]:
        out = out.unionByName(part)
    return out


# --- text ----------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return text.dedup_with_id(t.english(spark, sf), "text", "lang", "en", key="doc_id")


def _tok(spark: SparkSession, sf: str) -> DataFrame:
    return text.tokens(_texts(spark, sf))


def doc_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    return text.bag_of_words(_tok(spark, sf))[0]


def _topic_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = _texts(spark, sf)
    counts, vocab = text.bag_of_words(text.tokens(docs))
    vectors = checkpointed(dealt(text.doc_term_vectors(counts, vocab), ["id"]))
    return docs, vocab, vectors


def doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The entries of the documents' bag-of-words vectors."""
    return text.vector_entries(_topic_inputs(spark, sf)[2])


def dedup_generated_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts under generated ids: as many ids as rows and as values."""
    unique = text.dedup_with_id(t.english(spark, sf), "text", "lang", "en")
    return unique.agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("id").alias("n_ids"),
        F.countDistinct("value").alias("n_values"),
    )


def lda_topics(spark: SparkSession, sf: str) -> DataFrame:
    _, vocab, vectors = _topic_inputs(spark, sf)
    return topics.topic_terms(topics.fit_lda(vectors), vocab)


def lda_top_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs, _, vectors = _topic_inputs(spark, sf)
    return topics.top_documents(topics.fit_lda(vectors), vectors, docs)


def _per_topic(report: DataFrame, what: str) -> DataFrame:
    """Per topic of a report: entries, distinct entries, and whether the weights fall with the rank."""
    weights = F.transform(F.array_sort(F.collect_list(F.struct("rank", "weight"))), lambda e: e["weight"])
    return report.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(what).alias("n_distinct"),
        (weights == F.sort_array(weights, asc=False)).alias("ordered"),
    )


def lda_topics_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the top terms, whichever topics were learned."""
    return _per_topic(lda_topics(spark, sf), "term")


def lda_top_documents_check(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of the top documents, whichever topics were learned."""
    return _per_topic(lda_top_documents(spark, sf), "id")


# --- rankings and metrics ------------------------------------------------------------------


def relevant_sets(spark: SparkSession, sf: str) -> DataFrame:
    sets = ranking.relevant_sets(t.scored_events(spark, sf))
    return sets.select("user", "part", F.array_join("items", ",").alias("items"))


def ranked_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = ranking.ranked_lists(t.scored_events(spark, sf))
    return lists.select("user", F.array_join("items", ",").alias("items"))


def map_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = t.scored_events(spark, sf)
    return metrics.map_score(scored, ranking.relevant_items(scored)).select(F.round("map", 6).alias("map"))


def _guessed(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a plain formula as the prediction."""
    return t.trips(spark, sf).select(
        F.col("duration_bin").alias("bin"),
        F.least(F.ceil(F.col("l_extendedprice") / 15000), F.lit(6)).cast("int").alias("bin_guess"),
        F.col("l_quantity").alias("label"),
        (F.col("l_extendedprice") / 1500).alias("prediction"),
    )


def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.accuracy(_guessed(spark, sf), "bin", "bin_guess").select(
        F.round("accuracy", 6).alias("accuracy")
    )


def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.regression_metrics(_guessed(spark, sf))
    return found.select(*[F.round(c, 6).alias(c) for c in ("rmse", "mse", "mae")])


def metrics_report(spark: SparkSession, sf: str) -> DataFrame:
    guessed = _guessed(spark, sf)
    values = metrics.regression_metrics(guessed).first().asDict()
    values["accuracy"] = metrics.accuracy(guessed, "bin", "bin_guess").first()["accuracy"]
    rows = [("formula", name, round(value, 6)) for name, value in values.items()]
    return metrics.metrics_table(spark, rows)


# --- models --------------------------------------------------------------------------------


def linreg_ols(spark: SparkSession, sf: str) -> DataFrame:
    model = models.fit_all(
        t.trips(spark, sf), "linear", ["l_quantity"], "l_extendedprice", solver="normal"
    ).stages[-1]
    row = (round(float(model.coefficients[0]), 4), round(float(model.intercept), 4))
    return spark.createDataFrame([row], "slope double, intercept double")


def segment_regression(spark: SparkSession, sf: str) -> DataFrame:
    lines = models.segment_regression(t.trips(spark, sf), "duration_bin", "l_quantity", "l_extendedprice")
    return lines.select(
        F.col("duration_bin").cast("bigint").alias("duration_bin"),
        "n",
        F.round("slope", 4).alias("slope"),
        F.round("intercept", 4).alias("intercept"),
    )


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    """Trips with a step function of one feature, which a deep enough tree learns exactly."""
    return t.trips(spark, sf).withColumn("level", F.col("duration_bin") * 100.0)


def wide_prediction(spark: SparkSession, sf: str) -> DataFrame:
    """A searched forest scores another table, and the prediction is repeated per month."""
    found = models.fit_supervised(
        _levels(spark, sf), "rf", ["l_quantity"], "level", TRIP_KEYS, maxBins=QUANTITY_BINS
    )
    sized = t.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("l_quantity"))
    scored = models.score(found.model, sized).withColumn("prediction", F.round("prediction", 2))
    return models.wide_prediction(scored, "p_partkey", "ParcelId", MONTHS)


def dt_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The class is a step function of one feature, so a deep enough tree learns it exactly."""
    trips = t.trips(spark, sf)
    found = models.fit_supervised(
        trips, "dt_class", TRIP_FEATURES, "duration_bin", TRIP_KEYS, maxBins=QUANTITY_BINS
    )
    scored = models.score(found.model, trips)
    return scored.groupBy(
        F.col("duration_bin").cast("bigint").alias("duration_bin"),
        F.col("prediction").cast("bigint").alias("prediction"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _steps(spark: SparkSession, sf: str, kind: str, **params) -> DataFrame:
    """Search and fit a step function of one feature and report the learned steps."""
    trips = _levels(spark, sf)
    found = models.fit_supervised(
        trips, kind, TRIP_FEATURES, "level", TRIP_KEYS, maxBins=QUANTITY_BINS, **params
    )
    scored = models.score(found.model, trips)
    return scored.groupBy(
        "level", F.round("prediction", 3).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("n"))


def dt_regress(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf, "dt")


def gbt_regress(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf, "gbt")


def rf_regress(spark: SparkSession, sf: str) -> DataFrame:
    """Every tree sees all features, so that each of them can find the steps."""
    return _steps(spark, sf, "rf", featureSubsetStrategy="all")


def linreg_cv(spark: SparkSession, sf: str) -> DataFrame:
    """Search on 70 %, report the error on the other 30 %."""
    train, test = prep.hash_split(t.trips(spark, sf), TRIP_KEYS, 0.7)
    found = models.fit_supervised(train, "linear", TRIP_FEATURES, "amount", TRIP_KEYS)
    return metrics.metrics_long(metrics.regression_metrics(models.score(found.model, test), "amount"), "linear")


def linreg_cv_check(spark: SparkSession, sf: str) -> DataFrame:
    """A plane without noise: with a regularisation of 0 to choose, the search finds its coefficients."""
    features = ["l_quantity", "l_discount", "l_tax"]
    plane = F.col("l_quantity") * 3 - F.col("l_discount") * 250 + F.col("l_tax") * 100 + 7
    found = models.fit_supervised(
        t.trips(spark, sf).withColumn("plane", plane), "linear", features, "plane", TRIP_KEYS,
        grid=models.GRIDS["linear"] | {"regParam": [1000.0, 0.001, 0.0]},
    )
    line = found.model.stages[-1]
    terms = [*zip(features, map(float, line.coefficients)), ("intercept", float(line.intercept))]
    return spark.createDataFrame([(n, round(v, 4)) for n, v in terms], "term string, coefficient double")


def cv_select(spark: SparkSession, sf: str) -> DataFrame:
    """All trials over a step function: each setting is exact, and the first wins."""
    return models.fit_supervised(
        _levels(spark, sf), "dt", TRIP_FEATURES, "level", TRIP_KEYS, maxBins=QUANTITY_BINS
    ).trials


def model_report(spark: SparkSession, sf: str) -> DataFrame:
    found = models.fit_supervised(t.trips(spark, sf), "dt", TRIP_FEATURES, "amount", TRIP_KEYS)
    return models.model_report(spark, "dt", found.model)


def model_report_check(spark: SparkSession, sf: str) -> DataFrame:
    """The leaves in the text of a tree that learned a step function."""
    found = models.fit_supervised(
        _levels(spark, sf), "dt", TRIP_FEATURES, "level", TRIP_KEYS, maxBins=QUANTITY_BINS
    )
    report = models.model_report(spark, "dt", found.model)
    leaves = F.regexp_extract_all("text", F.lit(r"Predict: (\S+)"), F.lit(1))
    return report.select(F.explode(leaves.cast("array<double>")).alias("level")).distinct()


def segment_models(spark: SparkSession, sf: str) -> DataFrame:
    """Classify, route, then one searched regression per predicted class, all from one aggregate."""
    trips = t.trips(spark, sf)
    tree = models.fit_supervised(trips, "dt_class", TRIP_FEATURES, "duration_bin", TRIP_KEYS)
    routed = checkpointed(models.score(tree.model, trips).withColumnRenamed("prediction", "class"))
    settings = [(reg, 0.0) for reg in models.GRIDS["linear"]["regParam"]]
    _, found = moments.search(routed, "class", TRIP_FEATURES, "amount", TRIP_KEYS, settings)
    error = F.col("prediction") - F.col("amount")
    errors = (
        moments.scored(routed, "class", found, TRIP_FEATURES)
        .groupBy(F.concat(F.lit("class-"), F.col("class").cast("int")).alias("model"))
        .agg(F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"))
        .withColumn("rmse", F.sqrt("mse"))
    )
    named = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rmse", "mse", "mae")]
    return errors.select("model", F.inline(F.array(*named)))


def segment_planes(spark: SparkSession, sf: str) -> DataFrame:
    """A plane without noise for each class: with a penalty of 0 to choose, the search finds every coefficient."""
    trips = t.trips(spark, sf)
    k = F.col("duration_bin")
    plane = k * F.col("l_quantity") - 250 * F.col("l_discount") + 100 * k * F.col("l_tax") + 7 * k
    features, settings = ["l_quantity", "l_discount", "l_tax"], [(1000.0, 0.0), (0.5, 0.5), (0.0, 0.0)]
    _, found = moments.search(trips.withColumn("plane", plane), "duration_bin", features, "plane", TRIP_KEYS, settings)
    return found.select(
        F.col("group").cast("bigint").alias("duration_bin"), "term", F.round("coefficient", 4).alias("coefficient"), "reg"
    )


def _ratings(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    return recommend.int_ids(checkpointed(t.mean_ratings(spark, sf)))


def als_search(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.als_search(_ratings(spark, sf)[0]).trials


def als_search_check(spark: SparkSession, sf: str) -> DataFrame:
    """Every setting on every fold, and the one with the smallest mean error is marked."""
    trials = als_search(spark, sf)
    least = trials.agg(F.min("mean_rmse")).first()[0]
    return trials.groupBy("trial", "setting").agg(
        F.countDistinct("fold").alias("n_folds"),
        F.min((F.col("rmse") > 0) & (F.col("rmse") < 5)).alias("in_range"),
        F.min(F.col("best") == (F.col("mean_rmse") == F.lit(least))).alias("consistent"),
    )


def als_recommend(spark: SparkSession, sf: str) -> DataFrame:
    ratings, keys = _ratings(spark, sf)
    model = recommend.als_search(ratings).model
    found, _ = recommend.recommend_bounded(model, t.part_titles(spark, sf), keys=keys)
    return found.withColumn("rating", F.col("rating").cast("float"))


def als_recommend_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: five different items, ranks from 1 to 5, ratings falling."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "rating")))  # five entries
    ratings = F.transform(listed, lambda e: e["rating"])
    return als_recommend(spark, sf).groupBy(F.col("user").cast("bigint").alias("user")).agg(
        F.countDistinct("item").alias("n_items"),
        F.array_join(F.transform(listed, lambda e: e["rank"].cast("string")), ",").alias("ranks"),
        (ratings == F.sort_array(ratings, asc=False)).alias("ordered"),
    )


def als_recommend_user(spark: SparkSession, sf: str) -> DataFrame:
    """The single-customer report: only customer 0 is scored."""
    ratings, keys = _ratings(spark, sf)
    model = recommend.als_search(ratings).model
    asked = t.table(spark, sf, "customer").where("c_custkey = 0").select(F.col("c_custkey").alias("user"))
    return recommend.recommend(model, t.part_titles(spark, sf), asked, keys=keys)


def als_bounded_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: the five items by length bounds have the scores of the five from scoring all items."""
    ratings, keys = _ratings(spark, sf)
    model, titles = recommend.als_fit(ratings), t.part_titles(spark, sf)
    bounded, _ = recommend.recommend_bounded(model, titles, keys=keys)
    full = recommend.recommend(model, titles, keys=keys).select("user", "rank", F.col("rating").alias("full"))
    return (
        bounded.join(full, ["user", "rank"], "full")
        .groupBy(F.col("user").cast("bigint").alias("user"))
        .agg(
            F.countDistinct("item").alias("n_items"),
            F.coalesce(F.min(F.abs(F.col("rating") - F.col("full")) < 1e-4), F.lit(False)).alias("agrees"),
        )
    )


def _tastes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers and parts as short vectors of whole numbers, so that every product is exact."""
    customers = t.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user"),
        F.array(F.col("c_nationkey") - 12, F.floor(F.col("c_acctbal") / 1000), F.col("c_custkey") % 7 - 3).alias("vector"),
    )
    size, key = F.col("p_size"), F.col("p_partkey")
    parts = t.table(spark, sf, "part").select(
        key.alias("item"),
        F.array(size * (key % 11 - 5), size * (F.floor("p_retailprice") % 13 - 6), size * (key % 17 - 8)).alias("vector"),
    )
    return customers, parts


def top_items(spark: SparkSession, sf: str) -> DataFrame:
    """The five parts that suit each customer best."""
    return products.top_products(*_tastes(spark, sf))[0]


def top_items_one_user(spark: SparkSession, sf: str) -> DataFrame:
    """The report of customer 0; titles are known of parts not divisible by 3 only."""
    customers, parts = _tastes(spark, sf)
    top, _ = products.top_products(customers.where("user = 0"), parts, n=10)
    return basket.with_titles(top, ["item"], t.part_titles(spark, sf).where("item % 3 <> 0"), "Empty")


def top_items_work(spark: SparkSession, sf: str) -> DataFrame:
    """All products there are, and whether the bounds made do with less than half of them."""
    customers, parts = _tastes(spark, sf)
    _, work = products.top_products(customers, parts, chunk=16)
    # one row each, side by side without a join
    counts = (
        customers.agg(F.count("user").alias("n_users"))
        .unionByName(parts.agg(F.count("item").alias("n_items")), allowMissingColumns=True)
        .unionByName(work.agg(F.sum("n_products").alias("done")), allowMissingColumns=True)
    )
    return counts.agg(*[F.max(c).alias(c) for c in counts.columns]).select(
        (F.col("n_users") * F.col("n_items")).alias("n_pairs"),
        (F.col("done") * 2 < F.col("n_users") * F.col("n_items")).alias("below_half"),
    )


def trees_as_tables(spark: SparkSession, sf: str) -> DataFrame:
    """A tree, a forest and a boosted model scored from their tables, and the rows where pyspark.ml differs."""
    needed = dict.fromkeys([*TRIP_KEYS, *TRIP_FEATURES, "level"])
    # three fits and three scorings read it, several times each: written once, as narrow as they need it
    trips = checkpointed(dealt(_levels(spark, sf).select(*needed), TRIP_KEYS))
    fits = {"dt": {}, "rf": {"featureSubsetStrategy": "all"}, "gbt": {"maxIter": 3}}
    out = None
    for kind, params in fits.items():
        model = models.fit_all(trips, kind, TRIP_FEATURES, "level", maxBins=QUANTITY_BINS, **params)
        table = trees.tree_table(spark, model)
        both = trees.score(table, models.score(model, trips), TRIP_FEATURES, "stored")
        steps = both.groupBy(F.lit(kind).alias("kind"), "level", F.round("stored", 3).alias("prediction")).agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.abs(F.col("stored") - F.col("prediction")) > 1e-9).alias("n_differ"),
        )
        out = steps if out is None else out.unionByName(steps)
    return out


def dedup_by_digest(spark: SparkSession, sf: str) -> DataFrame:
    return digests.distinct_texts(t.english(spark, sf).where("lang = 'en'"), "text", "doc_id")


def dense_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the customer id replaced by a dense number."""
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    indexed, _ = recommend.index_keys(orders, "o_custkey")
    return indexed.select("o_orderkey", F.col("o_custkey").cast("bigint").alias("customer"))


def ids_from_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with dense customer numbers that the odd orders gave first and the even ones went on from."""
    path = scratch_path(spark, "dictionary")
    dictionary.create(spark, path)
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    for batch, chosen in enumerate(("o_orderkey % 2 = 1", "o_orderkey % 2 = 0"), 1):
        dictionary.extend(spark, path, orders.where(chosen), "o_custkey", batch)
    return dictionary.encoded(orders, path, "o_custkey").select("o_orderkey", F.col("o_custkey").alias("customer"))


def als_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Search on 80 %; setting, sizes, and RMSE, MSE and MAP on the other 20 %."""
    ratings, _ = _ratings(spark, sf)
    train, test = prep.hash_split(ratings, ["user", "item"], 0.8)
    found = recommend.als_search(train)
    scored = checkpointed(found.model.transform(test))
    ranked = scored.withColumnRenamed("prediction", "score")
    errors = metrics.regression_metrics(scored, "rating").drop("mae")
    precision = metrics.map_score(ranked, ranking.relevant_items(scored))
    facts = {**found.best, "n_train": train.count(), "n_test": test.count()}
    return (
        metrics.metrics_table(spark, [("als", name, float(value)) for name, value in facts.items()])
        .unionByName(metrics.metrics_long(errors, "als"))
        .unionByName(metrics.metrics_long(precision, "als"))
    )


def queries() -> dict[str, Query]:
    return {
        "liked_items": _liked_parts,
        "user_baskets": user_baskets,
        "pair_counts": lambda s, d: basket.by_count(_pairs(s, d)),
        "pairs_named": pairs_named,
        "item_stripes": item_stripes,
        "stripes_named": stripes_named,
        "titles_or_null": titles_or_null,
        "stripe_lookup": stripe_lookup,
        "item_frequency": lambda s, d: basket.item_frequency(_liked_parts(s, d)),
        "rule_confidence": lambda s, d: basket.rules_confidence(_liked_brands(s, d)),
        "rule_confidence_one_way": rule_confidence_one_way,
        "rule_confidence_bits": rule_confidence_bits,
        "rule_confidence_prefix": rule_confidence_prefix,
        "confidence_candidates": confidence_candidates,
        "pair_counts_bits": pair_counts_bits,
        "brand_pairs_bits": brand_pairs_bits,
        "stripes_in_batches": stripes_in_batches,
        "rule_lift": rule_lift,
        "rule_lift_baskets": rule_lift_baskets,
        "rule_lift_named": rule_lift_named,
        "value_frequency": value_frequency,
        "heavy_hitters": heavy_hitters,
        "column_modes": column_modes,
        "impute_mode": impute_mode,
        "impute_constant": impute_constant,
        "typed_projection": typed_projection,
        "null_profile": null_profile,
        "drop_nulls": drop_nulls,
        "complete_rows": complete_rows,
        "feature_table": feature_table,
        "duration_bin": duration_bins,
        "hash_split": hash_split,
        "kfold_train_sizes": kfold_train_sizes,
        "csv_roundtrip": csv_roundtrip,
        "csv_schema_prefix": csv_schema_prefix,
        "csv_glob_scan": csv_glob_scan,
        "headerless_ratings": headerless_ratings,
        "routed_predictions": routed_predictions,
        "dedup_with_id": _texts,
        "tokens": lambda s, d: text.token_rows(_tok(s, d)),
        "term_counts": lambda s, d: text.term_counts(_tok(s, d)),
        "top_terms": lambda s, d: text.top_terms(_tok(s, d)),
        "vocabulary": lambda s, d: text.vocabulary(_tok(s, d)),
        "doc_term_counts": doc_term_counts,
        "doc_vectors": doc_vectors,
        "dedup_generated_ids": dedup_generated_ids,
        "relevant_sets": relevant_sets,
        "topn_per_user": lambda s, d: ranking.topn_per_user(t.scored_events(s, d)),
        "ranked_lists": ranked_lists,
        "map_score": map_score,
        "accuracy": accuracy,
        "regression_metrics": regression_metrics,
        "metrics_report": metrics_report,
        "linreg_ols": linreg_ols,
        "segment_regression": segment_regression,
        "wide_prediction": wide_prediction,
        "dt_classify": dt_classify,
        "dt_regress": dt_regress,
        "gbt_regress": gbt_regress,
        "rf_regress": rf_regress,
        "linreg_cv": linreg_cv,
        "linreg_cv_check": linreg_cv_check,
        "cv_select": cv_select,
        "model_report": model_report,
        "model_report_check": model_report_check,
        "segment_models": segment_models,
        "segment_planes": segment_planes,
        "als_recommend": als_recommend,
        "als_recommend_check": als_recommend_check,
        "als_recommend_user": als_recommend_user,
        "als_bounded_check": als_bounded_check,
        "top_items": top_items,
        "top_items_one_user": top_items_one_user,
        "top_items_work": top_items_work,
        "trees_as_tables": trees_as_tables,
        "dedup_by_digest": dedup_by_digest,
        "dense_keys": dense_keys,
        "ids_from_dictionary": ids_from_dictionary,
        "als_search": als_search,
        "als_search_check": als_search_check,
        "als_metrics": als_metrics,
        "lda_topics": lda_topics,
        "lda_topics_check": lda_topics_check,
        "lda_top_documents": lda_top_documents,
        "lda_top_documents_check": lda_top_documents_check,
    }
