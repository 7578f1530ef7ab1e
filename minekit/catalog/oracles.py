"""Independent SQL for the registered queries, written for DuckDB over the same tables."""

from __future__ import annotations

from textwrap import dedent

# The default English stop words that are all letters and longer than four.
STOP_WORDS = """
myself ourselves yours yourself yourselves himself herself itself their theirs themselves which
these those being having doing because until while about against between through during before
after above below under again further there where other should cannot could ought would
"""

_LIKED = """
liked AS (
  SELECT DISTINCT o_custkey AS "user", l_partkey AS item
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_quantity >= 40
)"""
_LIKED_BRAND = """
liked AS (
  SELECT DISTINCT o_custkey AS "user", p_brand AS item
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE l_quantity >= 4
)"""
_FREQ = "freq AS (SELECT item, count(*) AS n FROM liked GROUP BY item)"
_PAIRS = """
pairs AS (
  SELECT x.item AS item_a, y.item AS item_b, count(*) AS n
  FROM liked x JOIN liked y ON x."user" = y."user" AND x.item < y.item
  GROUP BY 1, 2
)"""
_GAPPY = """
gappy AS (
  SELECT event_id,
         CASE WHEN event_type <> 'error' THEN event_type END AS kind,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) >= 10
              THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k,
         CASE WHEN value >= 5.0 THEN value END AS amount,
         user_id % 10 AS grp
  FROM events
)"""
_CELLS = """
cells AS (
  SELECT 'kind' AS "column", kind AS value FROM gappy
  UNION ALL SELECT 'k', CAST(k AS VARCHAR) FROM gappy
  UNION ALL SELECT 'grp', CAST(grp AS VARCHAR) FROM gappy
),
counted AS (SELECT "column", value, count(*) AS n FROM cells GROUP BY 1, 2)"""
_MODES = """
modes AS (
  SELECT "column", value, n FROM (
    SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r
    FROM counted WHERE value IS NOT NULL) WHERE r = 1
)"""
_BIN = """CASE WHEN l_quantity <= 5 THEN 1 WHEN l_quantity <= 10 THEN 2 WHEN l_quantity <= 15 THEN 3
     WHEN l_quantity <= 20 THEN 4 WHEN l_quantity <= 30 THEN 5 ELSE 6 END"""
_GUESS = f"""
guessed AS (
  SELECT {_BIN} AS bin, CAST(least(ceil(l_extendedprice / 15000), 6) AS INTEGER) AS bin_guess,
         l_quantity AS label, l_extendedprice / 1500 AS prediction
  FROM lineitem
)"""
_DOCS = """
docs AS (
  SELECT min(doc_id) AS id, text AS value FROM documents
  WHERE lang = 'en' AND text IS NOT NULL GROUP BY text
)"""
_WORDS = """
words AS (
  SELECT id, term FROM (
    SELECT id, unnest(regexp_split_to_array(lower(value), '\\s')) AS term FROM docs)
  WHERE length(term) > 4 AND regexp_full_match(term, '\\p{L}+') AND term NOT IN (%s)
)""" % ", ".join(f"'{w}'" for w in STOP_WORDS.split())
_TERMS = "terms AS (SELECT term, count(*) AS n FROM words GROUP BY term)"
_VOCAB = """
vocab AS (
  SELECT idx, term FROM (
    SELECT row_number() OVER (ORDER BY n DESC, term) - 26 AS idx, term FROM terms)
  WHERE idx >= 0
)"""
_SCORED = """
scored AS (
  SELECT user_id AS "user", event_id AS item, value AS rating, (event_id * 37) % 101 AS score
  FROM events
)"""
_TOP = """
top AS (
  SELECT "user", item, score, "rank" FROM (
    SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS "rank" FROM scored)
  WHERE "rank" <= 15
)"""
_HASH = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8) AS BIGINT)"
_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _q(*ctes: str, select: str) -> str:
    return "WITH " + ",".join(dedent(c) for c in ctes) + "\n" + dedent(select)


_TASTES = """
    WITH products AS (
      SELECT c_custkey AS "user", p_partkey AS item,
             CAST(p_size * ((c_nationkey - 12) * (p_partkey % 11 - 5)
                            + CAST(floor(c_acctbal / 1000) AS BIGINT) * (CAST(floor(p_retailprice) AS BIGINT) % 13 - 6)
                            + (c_custkey % 7 - 3) * (p_partkey % 17 - 8)) AS DOUBLE) AS score
      FROM customer, part
    ),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS rank FROM products
    )"""


def oracle_sql() -> dict[str, str]:
    split = _HASH.format("o_orderkey")
    return {
        "liked_items": _q(_LIKED, select="SELECT * FROM liked"),
        "user_baskets": _q(
            _LIKED,
            select="""
            SELECT "user", CAST(0 AS BIGINT) AS part, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items
            FROM liked GROUP BY "user" """,
        ),
        "pair_counts": _q(_LIKED, _PAIRS, select="SELECT * FROM pairs"),
        "pairs_named": _q(
            _LIKED,
            _PAIRS,
            select="""
            SELECT item_a, item_b, n, coalesce(a.p_name, '') AS title_a, coalesce(b.p_name, '') AS title_b
            FROM pairs LEFT JOIN part a ON item_a = a.p_partkey LEFT JOIN part b ON item_b = b.p_partkey""",
        ),
        "item_stripes": _q(
            _LIKED,
            _PAIRS,
            select="""
            SELECT item_a, CAST(0 AS BIGINT) AS part,
                   string_agg(item_b || ':' || n, ',' ORDER BY item_b) AS stripe
            FROM pairs GROUP BY item_a""",
        ),
        "stripes_named": _q(
            _LIKED,
            _PAIRS,
            select="""
            SELECT item_a, coalesce(min(a.p_name), '') AS title_a, CAST(0 AS BIGINT) AS part,
                   string_agg(coalesce(b.p_name, '') || ':' || n, ',' ORDER BY item_b) AS stripe
            FROM pairs LEFT JOIN part a ON item_a = a.p_partkey LEFT JOIN part b ON item_b = b.p_partkey
            GROUP BY item_a""",
        ),
        "item_frequency": _q(_LIKED, _FREQ, select="SELECT item, n AS freq FROM freq"),
        "rule_confidence": _q(
            _LIKED_BRAND,
            _FREQ,
            select="""
            SELECT item_a, item_b, n, n_a, confidence FROM (
              SELECT x.item AS item_a, y.item AS item_b, count(*) AS n, min(f.n) AS n_a,
                     CAST(count(*) AS DOUBLE) / min(f.n) AS confidence
              FROM liked x JOIN liked y ON x."user" = y."user" AND x.item <> y.item
              JOIN freq f ON f.item = x.item
              GROUP BY 1, 2)
            WHERE n <> 1 AND n * 5 > n_a * 4""",
        ),
        **dict.fromkeys(("rule_confidence_bits", "rule_confidence_prefix"), _q(
            _LIKED_BRAND,
            _FREQ,
            select="""
            SELECT item_a, item_b, n, n_a, CAST(n AS DOUBLE) / n_a AS confidence FROM (
              SELECT x.item AS item_a, y.item AS item_b, count(*) AS n, min(f.n) AS n_a
              FROM liked x JOIN liked y ON x."user" = y."user" AND x.item <> y.item
              JOIN freq f ON f.item = x.item
              GROUP BY 1, 2)
            WHERE n >= 2 AND n * 5 > n_a * 4""",
        )),
        "confidence_candidates": _q(
            _LIKED,
            _FREQ,
            _PAIRS,
            select="""
            SELECT (SELECT count(*) FROM (
                      SELECT DISTINCT p.item, y.item FROM (
                        SELECT x."user", x.item, f.n,
                               row_number() OVER (PARTITION BY x.item ORDER BY s.size, x."user") AS r
                        FROM liked x JOIN freq f ON f.item = x.item
                        JOIN (SELECT "user", count(*) AS size FROM liked GROUP BY 1) s ON s."user" = x."user") p
                      JOIN liked y ON y."user" = p."user" AND y.item <> p.item
                      JOIN freq g ON g.item = y.item
                      WHERE p.r <= p.n // 5 + 1 AND 5 * g.n >= 4 * p.n)) AS n_candidates,
                   2 * (SELECT count(*) FROM pairs) AS n_pairs""",
        ),
        "pair_counts_bits": _q(_LIKED, _PAIRS, select="SELECT * FROM pairs"),
        "brand_pairs_bits": _q(_LIKED_BRAND, _PAIRS, select="SELECT * FROM pairs"),
        "stripes_in_batches": _q(
            _LIKED,
            _PAIRS,
            select="""
            SELECT item_a, CAST(0 AS BIGINT) AS part,
                   string_agg(item_b || ':' || n, ',' ORDER BY item_b) AS stripe
            FROM pairs GROUP BY item_a""",
        ),
        "rule_confidence_one_way": _q(
            _LIKED_BRAND,
            _FREQ,
            _PAIRS,
            select="""
            SELECT item_a, item_b, p.n, f.n AS n_a, CAST(p.n AS DOUBLE) / f.n AS confidence
            FROM pairs p JOIN freq f ON f.item = item_a WHERE p.n <> 1 AND p.n * 5 > f.n * 4""",
        ),
        "rule_lift_baskets": _q(
            _LIKED_BRAND,
            _FREQ,
            _PAIRS,
            select="""
            SELECT item_a, item_b, p.n, a.n AS freq_a, b.n AS freq_b,
                   CAST(p.n AS DOUBLE) * u.c / (CAST(a.n AS DOUBLE) * b.n) AS lift
            FROM pairs p JOIN freq a ON item_a = a.item JOIN freq b ON item_b = b.item,
                 (SELECT count(DISTINCT "user") AS c FROM liked) u
            WHERE p.n >= 3 AND p.n * u.c * 100 > 102 * a.n * b.n""",
        ),
        "rule_lift": _q(
            _LIKED,
            _FREQ,
            _PAIRS,
            select="""
            SELECT item_a, item_b, p.n, a.n AS freq_a, b.n AS freq_b,
                   CAST(p.n AS DOUBLE) * (SELECT count(*) FROM liked) / (CAST(a.n AS DOUBLE) * b.n) AS lift
            FROM pairs p JOIN freq a ON item_a = a.item JOIN freq b ON item_b = b.item
            WHERE p.n >= 2 AND p.n * (SELECT count(*) FROM liked) * 2 > 5 * a.n * b.n""",
        ),
        "rule_lift_named": _q(
            _LIKED,
            _FREQ,
            _PAIRS,
            select="""
            SELECT item_a, coalesce(s.p_name, '') AS title_a, item_b, coalesce(t.p_name, '') AS title_b,
                   CAST(p.n AS DOUBLE) * (SELECT count(*) FROM liked) / (CAST(a.n AS DOUBLE) * b.n) AS lift
            FROM pairs p JOIN freq a ON item_a = a.item JOIN freq b ON item_b = b.item
            LEFT JOIN part s ON item_a = s.p_partkey LEFT JOIN part t ON item_b = t.p_partkey
            WHERE p.n * (SELECT count(*) FROM liked) * 2 > 5 * a.n * b.n""",
        ),
        "value_frequency": _q(
            _GAPPY,
            _CELLS,
            select="""
            SELECT * FROM (
              SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS "rank"
              FROM counted) WHERE "rank" <= 5""",
        ),
        "heavy_hitters": _q(
            _GAPPY,
            _CELLS,
            select="""
            SELECT * FROM (
              SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value NULLS FIRST) AS "rank"
              FROM (SELECT * FROM counted
                    UNION ALL SELECT 'event_id', CAST(event_id AS VARCHAR), count(*) FROM gappy GROUP BY 2))
            WHERE "rank" <= 5""",
        ),
        "column_modes": _q(_GAPPY, _CELLS, _MODES, select="SELECT * FROM modes"),
        "impute_mode": _q(
            _GAPPY,
            _CELLS,
            _MODES,
            select="""
            SELECT event_id,
                   coalesce(kind, (SELECT value FROM modes WHERE "column" = 'kind')) AS kind,
                   coalesce(k, (SELECT CAST(value AS INTEGER) FROM modes WHERE "column" = 'k')) AS k
            FROM gappy""",
        ),
        "impute_constant": _q(
            _GAPPY,
            select="""
            SELECT event_id, coalesce(kind, 'none') AS kind, coalesce(k, 2) AS k,
                   coalesce(amount, 345.72) AS amount FROM gappy""",
        ),
        "typed_projection": """
            SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS l_quantity,
                   l_extendedprice, CAST(trunc(l_discount) AS INTEGER) AS discount_floor,
                   CAST(trunc(l_extendedprice * 1000) AS BIGINT) AS milli_price,
                   TRY_CAST(l_returnflag AS INTEGER) AS not_a_number
            FROM lineitem""",
        "null_profile": _q(
            _GAPPY,
            select="\nUNION ALL\n".join(
                f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) - count({c}) AS n_null,
                {f'round(avg({c}), 4)' if num else 'CAST(NULL AS DOUBLE)'} AS mean,
                {f'round(stddev_samp({c}), 4)' if num else 'CAST(NULL AS DOUBLE)'} AS stddev,
                {f'round(CAST(min({c}) AS DOUBLE), 4)' if num else 'CAST(NULL AS DOUBLE)'} AS "min",
                {f'round(CAST(max({c}) AS DOUBLE), 4)' if num else 'CAST(NULL AS DOUBLE)'} AS "max"
                FROM gappy"""
                for c, num in (("event_id", True), ("kind", False), ("k", True), ("amount", True))
            ),
        ),
        "drop_nulls": _q(
            _GAPPY,
            select="""
            SELECT count(*) AS rows_before,
                   count(*) FILTER (kind IS NOT NULL AND k IS NOT NULL AND amount IS NOT NULL) AS rows_after
            FROM gappy""",
        ),
        "complete_rows": _q(
            _GAPPY,
            select="SELECT * FROM gappy WHERE kind IS NOT NULL AND k IS NOT NULL AND amount IS NOT NULL",
        ),
        "feature_table": """
            SELECT p_partkey AS id_part, p_size AS size, p_retailprice AS price,
                   count(*) AS num_lines, CAST(sum(l_quantity) AS BIGINT) AS num_units
            FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2, 3""",
        "duration_bin": f"SELECT l_orderkey, l_linenumber, CAST({_BIN} AS BIGINT) AS bin FROM lineitem",
        "hash_split": f"""
            SELECT o_orderkey, CASE WHEN {split} < 3435973836 THEN 'train' ELSE 'test' END AS part
            FROM orders""",
        "kfold_train_sizes": f"""
            SELECT {split} % 5 AS fold, count(*) AS n_test,
                   (SELECT count(*) FROM orders) - count(*) AS n_train
            FROM orders GROUP BY 1""",
        "csv_roundtrip": _ORDERS,
        "csv_glob_scan": _ORDERS,
        "csv_schema_prefix": "SELECT o_orderkey AS id_order, o_custkey AS id_customer FROM orders",
        "headerless_ratings": _q(_LIKED, select="SELECT * FROM liked"),
        "routed_predictions": f"""
            SELECT CAST({_BIN} AS BIGINT) AS prediction, count(*) AS n,
                   min(l_quantity) AS lowest, max(l_quantity) AS highest
            FROM lineitem GROUP BY 1""",
        "dedup_with_id": _q(_DOCS, select="SELECT id, value FROM docs"),
        "tokens": _q(_DOCS, _WORDS, select="SELECT id, term FROM words"),
        "term_counts": _q(_DOCS, _WORDS, _TERMS, select="SELECT term, n FROM terms"),
        "top_terms": _q(
            _DOCS, _WORDS, _TERMS, select="SELECT term, n FROM terms ORDER BY n DESC, term LIMIT 100"
        ),
        "vocabulary": _q(_DOCS, _WORDS, _TERMS, _VOCAB, select="SELECT idx, term FROM vocab"),
        "doc_term_counts": _q(
            _DOCS,
            _WORDS,
            _TERMS,
            _VOCAB,
            select="SELECT id, idx, count(*) AS n FROM words JOIN vocab USING (term) GROUP BY 1, 2",
        ),
        "relevant_sets": _q(
            _SCORED,
            select="""
            SELECT "user", CAST(0 AS BIGINT) AS part, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT "user", item FROM scored WHERE rating > 2.5) GROUP BY "user" """,
        ),
        "topn_per_user": _q(_SCORED, _TOP, select="SELECT * FROM top"),
        "ranked_lists": _q(
            _SCORED,
            _TOP,
            select="""
            SELECT "user", string_agg(CAST(item AS VARCHAR), ',' ORDER BY "rank") AS items
            FROM top GROUP BY "user" """,
        ),
        "map_score": _q(
            _SCORED,
            _TOP,
            """
            rel AS (SELECT DISTINCT "user", item FROM scored WHERE rating > 2.5),
            hits AS (
              SELECT top."user", "rank", CASE WHEN rel.item IS NULL THEN 0 ELSE 1 END AS hit
              FROM top LEFT JOIN rel ON rel."user" = top."user" AND rel.item = top.item
            ),
            running AS (
              SELECT "user", "rank", hit, sum(hit) OVER (PARTITION BY "user" ORDER BY "rank") AS so_far FROM hits
            ),
            gains AS (
              SELECT "user", sum(CAST(hit * so_far AS DOUBLE) / "rank") AS gain FROM running GROUP BY "user"
            )""",
            select="""
            SELECT round(avg(gain / c), 6) AS "map"
            FROM gains JOIN (SELECT "user", count(*) AS c FROM rel GROUP BY "user") USING ("user")""",
        ),
        "accuracy": _q(
            _GUESS,
            select="""
            SELECT round(avg(CAST(CASE WHEN bin = bin_guess THEN 1 ELSE 0 END AS DOUBLE)), 6) AS accuracy
            FROM guessed""",
        ),
        "regression_metrics": _q(
            _GUESS,
            select="""
            SELECT round(sqrt(avg((label - prediction) ** 2)), 6) AS rmse,
                   round(avg((label - prediction) ** 2), 6) AS mse,
                   round(avg(abs(label - prediction)), 6) AS mae FROM guessed""",
        ),
        "metrics_report": _q(
            _GUESS,
            select="""
            SELECT 'formula' AS model, 'rmse' AS metric,
                   round(sqrt(avg((label - prediction) ** 2)), 6) AS value FROM guessed
            UNION ALL SELECT 'formula', 'mse', round(avg((label - prediction) ** 2), 6) FROM guessed
            UNION ALL SELECT 'formula', 'mae', round(avg(abs(label - prediction)), 6) FROM guessed
            UNION ALL SELECT 'formula', 'accuracy',
                   round(avg(CAST(CASE WHEN bin = bin_guess THEN 1 ELSE 0 END AS DOUBLE)), 6) FROM guessed""",
        ),
        "linreg_ols": """
            SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
                   round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""",
        "segment_regression": f"""
            SELECT CAST({_BIN} AS BIGINT) AS duration_bin, count(*) AS n,
                   round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
                   round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept
            FROM lineitem GROUP BY 1""",
        "wide_prediction": f"""
            WITH scored AS (
              SELECT p_partkey, CAST({_BIN} AS DOUBLE) * 100 AS p
              FROM (SELECT p_partkey, p_size AS l_quantity FROM part)
            )
            SELECT p_partkey AS "ParcelId", p AS "201610", p AS "201611", p AS "201612",
                   p AS "201710", p AS "201711", p AS "201712" FROM scored""",
        "ids_from_dictionary": """
            WITH first AS (
              SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS customer
              FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 1)
            ),
            second AS (
              SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) - 1 + (SELECT count(*) FROM first) AS customer
              FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 2 = 0)
              WHERE o_custkey NOT IN (SELECT o_custkey FROM first)
            )
            SELECT o_orderkey, customer
            FROM orders JOIN (SELECT * FROM first UNION ALL SELECT * FROM second) USING (o_custkey)""",
        "segment_planes": f"""
            WITH bins AS (SELECT DISTINCT CAST({_BIN} AS BIGINT) AS duration_bin FROM lineitem)
            SELECT duration_bin, 'l_quantity' AS term, CAST(duration_bin AS DOUBLE) AS coefficient,
                   CAST(0 AS DOUBLE) AS reg FROM bins
            UNION ALL SELECT duration_bin, 'l_discount', CAST(-250 AS DOUBLE), CAST(0 AS DOUBLE) FROM bins
            UNION ALL SELECT duration_bin, 'l_tax', CAST(100 * duration_bin AS DOUBLE), CAST(0 AS DOUBLE) FROM bins
            UNION ALL SELECT duration_bin, 'intercept', CAST(7 * duration_bin AS DOUBLE), CAST(0 AS DOUBLE) FROM bins""",
        "dense_keys": """
            SELECT o_orderkey, dense_rank() OVER (ORDER BY o_custkey) - 1 AS customer FROM orders""",
        "dt_classify": f"""
            SELECT CAST({_BIN} AS BIGINT) AS duration_bin, CAST({_BIN} AS BIGINT) AS prediction,
                   count(*) AS n FROM lineitem GROUP BY 1, 2""",
        "dt_regress": f"""
            SELECT CAST({_BIN} AS DOUBLE) * 100 AS level, CAST({_BIN} AS DOUBLE) * 100 AS prediction,
                   count(*) AS n FROM lineitem GROUP BY 1, 2""",
        "gbt_regress": f"""
            SELECT CAST({_BIN} AS DOUBLE) * 100 AS level, CAST({_BIN} AS DOUBLE) * 100 AS prediction,
                   count(*) AS n FROM lineitem GROUP BY 1, 2""",
        "rf_regress": f"""
            SELECT CAST({_BIN} AS DOUBLE) * 100 AS level, CAST({_BIN} AS DOUBLE) * 100 AS prediction,
                   count(*) AS n FROM lineitem GROUP BY 1, 2""",
        "linreg_cv_check": """
            SELECT * FROM (VALUES ('l_quantity', CAST(3 AS DOUBLE)), ('l_discount', CAST(-250 AS DOUBLE)),
                                  ('l_tax', CAST(100 AS DOUBLE)), ('intercept', CAST(7 AS DOUBLE)))
            AS plane(term, coefficient)""",
        "cv_select": """
            SELECT trial, setting, CAST(fold AS INTEGER) AS fold, CAST(0 AS DOUBLE) AS rmse,
                   CAST(0 AS DOUBLE) AS mean_rmse, trial = 0 AS best
            FROM (VALUES (0, 'maxDepth=5'), (1, 'maxDepth=8'), (2, 'maxDepth=10')) AS settings(trial, setting),
                 range(5) AS folds(fold)""",
        "model_report_check": f"SELECT DISTINCT CAST({_BIN} AS DOUBLE) * 100 AS level FROM lineitem",
        "als_search_check": """
            SELECT trial, setting, CAST(5 AS BIGINT) AS n_folds, true AS in_range, true AS consistent
            FROM (VALUES (0, 'maxIter=5, regParam=0.01'), (1, 'maxIter=8, regParam=0.1'),
                         (2, 'maxIter=10, regParam=0.01'), (3, 'maxIter=12, regParam=0.1'),
                         (4, 'maxIter=15, regParam=0.01')) AS settings(trial, setting)""",
        "als_recommend_check": """
            SELECT DISTINCT o_custkey AS "user", CAST(5 AS BIGINT) AS n_items, '1,2,3,4,5' AS ranks, true AS ordered
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "als_bounded_check": """
            SELECT DISTINCT o_custkey AS "user", CAST(5 AS BIGINT) AS n_items, true AS agrees
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        "top_items": f"""{_TASTES} SELECT "user", rank, item, score FROM ranked WHERE rank <= 5""",
        "top_items_one_user": f"""{_TASTES}
            SELECT "user", rank, item, score, CASE WHEN item % 3 <> 0 THEN p_name ELSE 'Empty' END AS title
            FROM ranked JOIN part ON item = p_partkey WHERE "user" = 0 AND rank <= 10""",
        "top_items_work": """
            SELECT (SELECT count(*) FROM customer) * (SELECT count(*) FROM part) AS n_pairs, true AS below_half""",
        "trees_as_tables": " UNION ALL ".join(
            f"""SELECT '{kind}' AS kind, CAST({_BIN} AS DOUBLE) * 100 AS level,
                       CAST({_BIN} AS DOUBLE) * 100 AS prediction, count(*) AS n, CAST(0 AS BIGINT) AS n_differ
                FROM lineitem GROUP BY 1, 2, 3"""
            for kind in ("dt", "rf", "gbt")
        ),
        "dedup_by_digest": _q(_DOCS, select="SELECT id, value FROM docs"),
        "doc_vectors": _q(
            _DOCS,
            _WORDS,
            _TERMS,
            _VOCAB,
            select="""
            SELECT id, idx, CAST(count(*) AS DOUBLE) AS value FROM words JOIN vocab USING (term) GROUP BY 1, 2""",
        ),
        "lda_topics_check": _q(
            _DOCS,
            _WORDS,
            _TERMS,
            _VOCAB,
            select="""
            SELECT topic, least(30, n) AS n, least(30, n) AS n_distinct, true AS ordered
            FROM range(5) AS topics(topic), (SELECT count(*) AS n FROM vocab)""",
        ),
        "lda_top_documents_check": _q(
            _DOCS,
            _WORDS,
            _TERMS,
            _VOCAB,
            select="""
            SELECT topic, least(20, n) AS n, least(20, n) AS n_distinct, true AS ordered
            FROM range(5) AS topics(topic),
                 (SELECT count(DISTINCT id) AS n FROM words JOIN vocab USING (term))""",
        ),
        "dedup_generated_ids": _q(
            _DOCS, select="SELECT count(*) AS n, count(*) AS n_ids, count(*) AS n_values FROM docs"
        ),
        "titles_or_null": _q(
            _LIKED,
            _FREQ,
            select="""
            SELECT item AS item_a, n AS freq, p_name AS title_a
            FROM freq LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON item = p_partkey""",
        ),
        "stripe_lookup": _q(
            _LIKED_BRAND,
            _PAIRS,
            select="""
            SELECT item_a, coalesce(max(n) FILTER (item_b = 'Brand#33'), 0) AS n FROM pairs GROUP BY item_a""",
        ),
    }
