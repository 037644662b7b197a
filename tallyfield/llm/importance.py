"""Quality selection by importance resampling of hashed n-gram models.

Two models count hashed words and word pairs: one over all rows (raw), one over labelled rows that are of the
wanted kind (target). A row's log weight is the summed log ratio of the two over its n-grams, and the rows with
the largest weight plus Gumbel noise are a sample without replacement in proportion to the weights. The noise is
a function of row id and seed. Models have a fixed number of buckets, so they are small whatever the input.

Defined results: a null or empty text has no n-grams and weight 0; equal rows have equal keys and are kept or
dropped together, so ties at the last place are all kept; without target rows all weights are 0; a null id is
hashed as any other; an empty table gives an empty table; columns other than the named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import as_bytes, column_of, map_text, mix, slices

BUCKETS = 1 << 18
#: Pseudo-counts a bucket, for words and for pairs.
SMOOTHING = (20.0, 100.0)
#: Labelled rows at most whose ids are taken as target, in order of a hash of the id.
MAX_TARGET = 200_000
SEED = 17


def features(text: bytes, buckets: int) -> np.ndarray:
    """Bucket of every word, then (above ``buckets``) of every pair of neighbours."""
    words = np.fromiter(map(zlib.crc32, text.lower().split()), np.uint64)
    if not len(words):
        return np.zeros(0, np.int64)
    pairs = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])
    size = np.uint64(buckets)
    return np.concatenate([mix(words) % size, pairs % size + size]).astype(np.int64)


def target_ids(labels: DataFrame, wanted, id_col: str = "doc_id", most: int = MAX_TARGET) -> tuple[list, float]:
    """Ids of at most ``most`` rows of the wanted kind, and the share of that kind among all labelled rows."""
    rows = labels.select(F.col(id_col).alias("id"), F.coalesce(wanted, F.lit(False)).alias("wanted"))
    share = rows.agg(F.avg(F.col("wanted").cast("double"))).first()[0]
    chosen = rows.filter("wanted and id is not null").select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    return [r[0] for r in chosen.collect()], share if share is not None else 1.0


def ngram_weights(
    df: DataFrame, target: Iterable, id_col: str, text_col: str, buckets: int = BUCKETS, smoothing=SMOOTHING
) -> np.ndarray:
    """Log ratio of the target model to the raw model for each of the ``2 * buckets`` buckets."""
    wanted = df.sparkSession.sparkContext.broadcast(frozenset(target))

    def run(batches):
        ids = wanted.value
        raw, good = np.zeros(2 * buckets, np.int64), np.zeros(2 * buckets, np.int64)
        for batch in batches:
            for part in slices(batch, text_col):
                rows = list(zip(column_of(part, id_col).to_pylist(), as_bytes(column_of(part, text_col))))
                found = [features(t, buckets) for _, t in rows]
                raw += np.bincount(np.concatenate(found), minlength=2 * buckets)
                chosen = [f for (i, _), f in zip(rows, found) if i in ids]
                if chosen:
                    good += np.bincount(np.concatenate(chosen), minlength=2 * buckets)
        at = np.flatnonzero(raw)
        for k in range(0, len(at), 1 << 14):
            some = at[k : k + (1 << 14)]
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array(some, pa.int64()), "raw": pa.array(raw[some]), "good": pa.array(good[some])}
            )

    counts = (
        df.select(id_col, text_col)
        .mapInArrow(run, "bucket bigint, raw bigint, good bigint")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
        .toArrow()  # a row a bucket at most
    )
    at = counts.column("bucket").to_numpy()
    raw, good = np.zeros(2 * buckets), np.zeros(2 * buckets)
    raw[at], good[at] = counts.column("raw").to_numpy(), counts.column("good").to_numpy()
    out = np.zeros(2 * buckets)
    for half, extra in zip((slice(0, buckets), slice(buckets, None)), smoothing):
        if raw[half].sum() and good[half].sum():
            share = good[half].sum() / raw[half].sum()
            out[half] = np.log((good[half] + extra * share) / (raw[half] + extra) / share)
    return out


def weigh(
    df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED
) -> DataFrame:
    """(id, n_ngrams, log_weight, key) for every row; ``key`` is the log weight plus Gumbel noise."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    kind = df.schema[id_col].dataType.simpleString()
    buckets = len(weights) // 2

    def work(part, texts):
        w = shared.value
        found = [features(t, buckets) for t in texts]
        logs = [float(w[f].sum()) for f in found]
        u = np.array([zlib.crc32(b"%d:%s" % (seed, str(i).encode())) for i in column_of(part, id_col).to_pylist()], float)
        noise = -np.log(-np.log((u + 0.5) / 2**32))
        return {
            id_col: column_of(part, id_col),
            "n_ngrams": [len(f) for f in found],
            "log_weight": logs,
            "key": [a + b for a, b in zip(logs, noise.tolist())],
        }

    return map_text(df, text_col, f"`{id_col}` {kind}, n_ngrams bigint, log_weight double, key double", work, id_col)


def largest_threshold(df: DataFrame, column: str, count: int) -> float | None:
    """The ``count``-th largest value of a double column; None if there are no rows.

    Each pass counts the rows of 4,096 equal cells between the bounds found so far and goes on within the cell
    that holds the wanted one; cells are described by their rows' least and largest value, so it ends exactly.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return None
    lower, upper, left = float(low), float(high), count
    width = (upper - lower) / 4096
    while width > 0 and lower < upper:
        inside = df.filter((F.col(column) >= lower) & (F.col(column) <= upper))
        cell = F.least(F.floor((F.col(column) - lower) / width), F.lit(4095)).cast("int")
        groups = inside.groupBy(cell.alias("cell")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        ).collect()
        for g in sorted(groups, key=lambda g: -g["low"]):
            if left <= g["n"]:
                lower, upper = g["low"], g["high"]
                break
            left -= g["n"]
        else:
            return float(low)
        width = (upper - lower) / 4096
    return lower


def resample(weighed: DataFrame, share: float) -> DataFrame:
    """The weighed rows and whether each is among the ``share`` of all rows with the largest keys."""
    kept = cut_lineage(weighed, "weighed")
    count = int(np.ceil(share * kept.count()))
    at = largest_threshold(kept, "key", count) if count else None
    return kept.withColumn("kept", F.lit(False) if at is None else F.col("key") >= F.lit(at))
