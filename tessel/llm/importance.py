"""Quality by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled good) and one of all text, give each
document an importance weight: the ratio of its probabilities under the two. Gumbel noise on the logarithm of the
weight and a top-k over the sums is a sample without replacement in proportion to the weights.

A model is a table of BUCKETS counts, so what is gathered is of a fixed size. The k-th largest sum is found by a
radix selection of four narrow aggregates, never by sorting everything in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import NO_ID, chunks, written
from tessel.llm.shingles import _FOLD, BLANK, NOT_WORD, mix, windows, word_hashes

#: Buckets that the n-grams of a model are hashed into.
BUCKETS = 1 << 18
#: Counts by which each bucket of the target model leans on the model of all text.
PRIOR = 100.0
#: Labelled documents that the target model is counted from at most, chosen by hash.
TARGET_DOCS = 200_000
#: Share of documents sampled beyond the share of good ones among those labelled.
SLACK = 0.02
SEED = 20
_DIGIT = 16


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each n-gram: runs of letters and digits, words between white space, and pairs of such words."""
    buckets, owners = [], []
    for blank, widths in ((NOT_WORD, (1,)), (BLANK, (1, 2))):
        words, at = word_hashes(texts, blank=blank)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for width in widths:
            grams = windows(words, width)
            whole = owner[: len(grams)] == owner[width - 1 :][: len(grams)]
            buckets.append(grams[whole] % np.uint64(BUCKETS))
            owners.append(owner[: len(grams)][whole])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def log_ratios(every: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm of target probability over overall probability for each bucket."""
    if not target.sum():
        return np.zeros(BUCKETS)
    share = target.sum() / every.sum()
    return np.log((target + PRIOR * share) / (share * (every + PRIOR)))


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise that an id and the seed decide."""
    with np.errstate(over="ignore"):
        bits = mix(mix(ids.view(np.uint64) + np.uint64(seed) * _FOLD) + _FOLD)
    return -np.log(-np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53))


def _ordered(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def kth_largest(df: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(value, rows above it) of the k-th largest value of a long column, 1 <= k <= rows. Each step narrows 16 bits and brings 65,536 counts to the driver at most."""
    high, above = None, 0
    for shift in (48, 32, 16, 0):
        # The top digit is signed, the others are not.
        rest = df if high is None else df.where(F.shiftright(column, shift + _DIGIT) == high)
        counts = rest.groupBy(F.shiftright(column, shift).alias("digit")).count().collect()
        for row in sorted(counts, key=lambda r: -r["digit"]):
            if above + row["count"] >= k:
                high = row["digit"]
                break
            above += row["count"]
    return high, above


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, score, kept), a row for each row of docs (doc_id long, text string).

    Target text: documents whose label rows all say quality 1 and toxic 0, TARGET_DOCS of them at most. score is
    log_weight plus noise; kept marks the k = share * rows largest scores, ties to the smaller doc_id. share is by
    default that of good documents among those labelled, plus SLACK. Null and empty texts weigh 0. Repeated rows
    share their noise, score and fate, so k may be passed by the repeats of its last row. A null doc_id sorts first.
    Without labels every document is kept; an empty table gives an empty one. Other columns are ignored.
    """
    spark = docs.sparkSession
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        ((F.min(F.coalesce("quality", F.lit(0))) == 1) & (F.max(F.coalesce("toxic", F.lit(1))) == 0)).alias("good")
    )
    n_good, n_judged = judged.agg(F.count_if("good"), F.count("*")).first()
    chosen = judged.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCS).select("doc_id")
    targets = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in chosen.collect()], np.int64)))
    share = share if share is not None else min(1.0, n_good / n_judged + SLACK) if n_judged else 1.0
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in chunks(batches, "text"):
            buckets, owner = ngrams(part.column("text"))
            good = np.isin(np.asarray(part.column("id")), targets.value)[owner]
            every += np.bincount(buckets, minlength=BUCKETS)
            target += np.bincount(buckets[good], minlength=BUCKETS)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(target[at])], ["bucket", "n", "target"])

    counts = texts.mapInArrow(counted, "bucket long, n long, target long").groupBy("bucket").agg(F.sum("n"), F.sum("target"))
    every, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    held = np.array([tuple(r) for r in counts.collect()], np.int64).reshape(-1, 3)  # BUCKETS rows at most
    every[held[:, 0]], target[held[:, 0]] = held[:, 1], held[:, 2]
    ratios = spark.sparkContext.broadcast(log_ratios(every, target))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            buckets, owner = ngrams(part.column("text"))
            # Rounded, so that the order of summands never matters.
            weight = np.round(np.bincount(owner, ratios.value[buckets], minlength=len(part)), 6)
            score = weight + gumbel(np.asarray(part.column("id")), seed)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(weight), pa.array(score), pa.array(_ordered(score))], ["id", "log_weight", "score", "place"])

    scores = written(texts.mapInArrow(scored, "id long, log_weight double, score double, place long"), "scores")
    rows = scores.count()
    k = min(rows, round(share * rows))
    if k == 0:
        kept = F.lit(False)
    else:
        place, above = kth_largest(scores, "place", k)
        # Of the rows with that very score, the smaller ids.
        last, _ = kth_largest(scores.where(F.col("place") == place).select((-1 - F.col("id")).alias("back")), "back", k - above)
        kept = (F.col("place") > place) | ((F.col("place") == place) & (-1 - F.col("id") >= last))
    return scores.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "log_weight", "score", kept.alias("kept"))
