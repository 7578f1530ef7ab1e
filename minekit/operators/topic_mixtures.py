"""Topic mixtures of documents under counts that EM learned, inferred where the documents are.

What Spark's ``LocalLDAModel`` infers, from the same start. That model holds topics x vocabulary on the
driver and in every task; here documents lie in blocks and each block gets the counts of its own terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minekit.operators.scale import ship_package
from minekit.operators.topic_counts import CHUNK_ENTRIES, TopicCounts

BLOCK_ENTRIES = 2_000_000  # (document, term) entries of a block, 24 MB beside its terms
GAMMA_SHAPE = 100.0  # of Spark's models by EM
SEED = 1_421_925_485  # of every LocalLDAModel that was saved and loaded, whichever its parameter says
CHANGE = 1e-3  # mean change of a document's topics at which Spark stops
_LEAST = 1e-100


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, for positive numbers."""
    x, out = np.array(x, np.float64), np.zeros(np.shape(x))
    while (small := x < 10).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    r = 1 / (x * x)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * 691 / 32760)))))
    return out + np.log(x) - 0.5 / x - series


def first_gamma(spark: SparkSession, k: int, seed: int) -> list[float]:
    """The start that Spark draws for every document, the same for all of them as their seed is one."""
    jvm = spark._jvm
    # the halves of a long, as its constructor takes them; a small number would be taken for an int, another seed
    halves = spark.sparkContext._gateway.new_array(jvm.int, 2)
    for i, half in enumerate((seed >> 32, seed)):
        halves[i] = (half & 0xFFFFFFFF ^ 0x80000000) - 0x80000000
    random = jvm.breeze.stats.distributions.RandBasis(jvm.org.apache.commons.math3.random.MersenneTwister(halves))
    gamma = jvm.breeze.stats.distributions.Gamma(GAMMA_SHAPE, 1.0 / GAMMA_SHAPE, random)
    return [gamma.draw() for _ in range(k)]


def _entries(features: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(lengths, terms, values)`` of an Arrow column of vectors, entries of zero left out."""
    dense = features.field("type").to_numpy(zero_copy_only=False) == 1
    values = features.field("values")
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = values.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    terms = np.arange(len(counts)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    terms[~dense[doc]] = features.field("indices").flatten().to_numpy(zero_copy_only=False)
    kept = counts != 0
    return np.bincount(doc[kept], minlength=len(sizes)), terms[kept].astype(np.int32), counts[kept]


def _expected(counts: np.ndarray) -> np.ndarray:
    """Exponentials of the expected logarithms of Dirichlet draws, one a row."""
    return np.exp(digamma(counts) - digamma(counts.sum(1))[:, None])


def inferred(
    lengths: np.ndarray, values: np.ndarray, by_entry: np.ndarray, start: np.ndarray, alpha: float
) -> np.ndarray:
    """The mixtures of documents, each with ``lengths`` entries, by Spark's variational inference."""
    out = np.zeros((len(lengths), by_entry.shape[1]))
    live = np.flatnonzero(lengths)  # a document without entries has zeros
    lengths = lengths[live]
    gamma = np.tile(start, (len(live), 1))
    while len(live):
        starts = np.cumsum(lengths) - lengths
        moving = np.ones(len(live), bool)
        # documents that have come to rest are dropped when they are half of all
        while moving.sum() * 2 > len(live):
            theta = _expected(gamma)
            norm = np.einsum("ij,ij->i", by_entry, np.repeat(theta, lengths, axis=0)) + _LEAST
            following = theta * np.add.reduceat(by_entry * (values / norm)[:, None], starts, axis=0) + alpha
            changed = np.abs(following - gamma).mean(1) > CHANGE
            gamma[moving] = following[moving]
            moving &= changed
        rest = ~moving
        out[live[rest]] = gamma[rest] / gamma[rest].sum(1)[:, None]
        entry = np.repeat(moving, lengths)
        live, lengths, gamma, values, by_entry = live[moving], lengths[moving], gamma[moving], values[entry], by_entry[entry]
    return out


def mixtures(
    dataset: DataFrame, counts: TopicCounts, seed: int = SEED, block_entries: int = BLOCK_ENTRIES
) -> DataFrame:
    """``dataset``, which has ``features``, with the vector ``topicDistribution``, row by row."""
    spark = dataset.sparkSession
    ship_package(spark)
    k, totals, alpha = len(counts.totals), np.array(counts.totals), counts.alpha
    start = np.array(first_gamma(spark, k, seed))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(_entries(batch.column("features"))[1])]})

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, terms, _ = _entries(batch.column("features"))
            block = np.repeat(batch.column("_block").to_numpy(), lengths)
            pairs = np.unique(block.astype(np.int64) << 32 | terms)
            yield pa.RecordBatch.from_pydict({"_block": pairs >> 32, "idx": (pairs & 0xFFFFFFFF).astype(np.int32)})

    def mixed(docs: pa.Table, known: pa.Table) -> pa.Table:
        terms = known["idx"].to_numpy()
        order = np.argsort(terms)
        by_term = known["counts"].combine_chunks().flatten().to_numpy().reshape(-1, k)[order]
        # a term that nothing is known of weighs nothing
        terms = np.append(terms[order], -1)
        by_term = np.vstack([np.exp(digamma(by_term) - digamma(totals)), np.zeros((1, k))])
        found = []
        for batch in docs.to_batches():
            lengths, wanted, values = _entries(batch.column("features"))
            at = np.searchsorted(terms[:-1], wanted)
            at[terms[at] != wanted] = len(terms) - 1
            ends = np.concatenate([[0], np.cumsum(lengths)])
            first = 0
            while first < len(lengths):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK_ENTRIES, "right")) - 1)
                here = slice(ends[first], ends[last])
                found.append(inferred(lengths[first:last], values[here], by_term[at[here]], start, alpha))
                first = last
        shares = np.concatenate(found) if found else np.zeros((0, k))
        lists = pa.ListArray.from_arrays(np.arange(0, shares.size + 1, k, dtype=np.int32), shares.ravel())
        return docs.drop_columns(["_block"]).append_column("topicDistribution", lists)

    entries = dataset.select("features").mapInArrow(sized, "n bigint").agg(F.sum("n")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // block_entries))
    # equal rows share a block; both sides of it are dealt by the same hash
    block = F.pmod(F.xxhash64(*dataset.columns), F.lit(n))
    docs = dataset.withColumn("_block", block).repartition("_block")
    pairs = docs.select("_block", "features").mapInArrow(asked, "_block bigint, idx int").distinct()
    known = pairs.join(counts.terms, "idx").select("_block", "idx", "counts")
    schema = T.StructType([*dataset.schema.fields, T.StructField("topicDistribution", T.ArrayType(T.DoubleType()))])
    shared = docs.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(mixed, schema)
    return shared.withColumn("topicDistribution", array_to_vector("topicDistribution"))
