"""MinHash near-duplicates with odd sketches.

Each text's set of word shingles gives MinHash samples. Groups of samples are band keys; all samples fold
into an odd sketch, a bitmap of parities, whose XOR population count estimates how many samples differ
most precisely where the similarity is high. Texts that share a band key become candidates, the sketches
drop the unlike ones, and the full sets decide. Components of links are the groups.

Texts with equal sets are one node, named by a 64-bit hash of the set, so copies cost one row each and make no pairs.
A doc_id names no text: rows that share one, or have none, are told apart by their texts. The text itself moves through
one shuffle, and only to verify candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm import buckets
from tessel.llm.common import NO_ID, chunks, drop, fresh, table_bytes, trimmed, written
from tessel.llm.shingles import MinHash, shingle_sets

#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 6) ** 40, 6 in a million.
BANDS, ROWS = 40, 6
#: Samples and bits of the odd sketch, made of the texts that share a band.
SAMPLES, BITS = 1024, 2048
#: The sketch keeps a pair unless its estimate is this far below the least similarity: over four standard deviations.
MARGIN = 0.07
#: Nodes that a task remembers to have sent.
SENT = 500_000


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs (doc_id long, text string).

    Links join texts whose sets of width-word shingles (words between ASCII white space, A-Z lower-cased)
    meet 100 * shared >= percent * united. A text of fewer words is one shingle; null and empty texts have
    none and link with nothing. component_id is the smallest doc_id that links reach; kept marks that
    document, and of several unlike sets under that doc_id one. Repeated rows share their component; rows with one
    doc_id, or none, and unlike texts do not. A null doc_id sorts first. An empty table gives an empty one; other
    columns, whatever their names, are ignored.
    """
    name = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias
    return _judged(docs, width, percent).select(name("id")("doc_id"), "n_shingles", name("root")("component_id"), "kept")


def _row(docs: DataFrame) -> list:
    """What tells rows apart: the doc_id, NO_ID for null, and a hash of the text."""
    return [F.coalesce("doc_id", F.lit(NO_ID)), F.xxhash64("text")]


def _judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, digest, node, n_shingles, root, kept), a row for each row of docs; id and digest are those of _row, root is an id."""
    hasher, sketcher = MinHash(BANDS, ROWS), MinHash(SAMPLES, 1, BITS, seed=2)
    id_, digest = _row(docs)
    texts = docs.select(id_.alias("id"), digest.alias("digest"), "text")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for part in chunks(batches, "text"):
            sizes, names, rows = [], [], []
            if len(sent) > SENT:
                sent.clear()
            for grams in shingle_sets(part.column("text"), width):
                sizes.append(len(grams))
                names.append(xxhash.xxh3_64_intdigest(grams.tobytes()))
                if len(grams) and names[-1] not in sent:
                    sent.add(names[-1])
                    rows.append((len(names) - 1, hasher.samples(grams)))
            new = np.zeros(len(names), np.int32)
            new[[k for k, _ in rows]] = 1
            bands = hasher.band_keys(np.array([r for _, r in rows], np.uint32).reshape(-1, hasher.count))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("digest"), pa.array(sizes, pa.int64()), pa.array(np.array(names, np.uint64).view(np.int64)), _some(bands, new)],
                ["id", "digest", "n_shingles", "node", "bands"],
            )

    signs = written(texts.mapInArrow(lambda x: trimmed(signed(x)), "id long, digest long, n_shingles long, node long, bands array<long>"), "signs")
    member = written(signs.drop("bands"), "member")
    owner = written(member.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("id", "digest")).alias("first")), "owners")
    nodes = signs.where("bands is not null").select(F.col("node").alias("id"), "bands")

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(batch.column("id")), np.asarray(batch.column("bands").flatten()).view(np.uint64).reshape(batch.num_rows, BANDS)

    met = buckets.met(nodes, keyed, table_bytes(signs), entry_ratio=2.0)
    drop(signs)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            found = list(shingle_sets(part.column("text"), width))
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in found])]).astype(np.int32)
            values = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            odd = sketcher.odd_sketches(np.array([sketcher.samples(g, 256) if len(g) else np.zeros(SAMPLES, np.uint32) for g in found]))
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), _lists(odd)], ["id", "grams", "sketch"])

    # Copies need no set of their own: only texts that own a set are made again.
    wanted = met.select(F.explode("ids").alias("node")).distinct()
    own = owner.join(wanted, "node", "left_semi").select("node", "first.id", "first.digest")
    own = texts.join(own, ["id", "digest"]).select("node", "text").dropDuplicates(["node"])
    held = written(own.mapInArrow(lambda x: trimmed(sets(x)), "id long, grams array<long>, sketch array<long>"), "sets")
    most = sketcher.most_odd(percent / 100 - MARGIN)

    # Stars: the sketches turn the unlike pairs away, the sets prove the others.
    ends = [held.select(F.col("id").alias(e), F.col("sketch").alias(f"s{e}")) for e in "ab"]
    likely = buckets.stars(met).join(ends[0], "a").join(ends[1], "b").where(_apart("sa", "sb") <= most).select("a", "b")
    both = written(likely, "likely").join(held.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(held.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
    shared, united = F.size(F.array_intersect("ga", "gb")), F.size("ga") + F.size("gb") - F.size(F.array_intersect("ga", "gb"))
    links = both.where((100 * shared >= percent * united) & (shared > 0)).select("a", "b")

    def made(rows: list[tuple]) -> tuple[buckets.Sets, buckets.Near]:
        grams = [np.asarray(r[0].values).view(np.uint64) for r in rows]
        sketch = np.array([np.asarray(r[1].values) for r in rows]).view(np.uint64)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            steps = range(0, len(i), 1 << 16)
            return np.concatenate([np.bitwise_count(sketch[i[k : k + (1 << 16)]] ^ sketch[j[k : k + (1 << 16)]]).sum(axis=1, dtype=np.int64) <= most for k in steps] or [np.empty(0, bool)])

        return buckets.Sets(np.concatenate(grams), np.repeat(np.arange(len(rows)), list(map(len, grams))), len(rows)), near

    root = buckets.closed(met, links, held, made, percent).withColumnRenamed("id", "node")
    drop(met)
    drop(held)
    best = owner.join(root, "node").groupBy("root").agg(F.min(F.struct("first.id", "first.digest", "node")).alias("best"))
    home = owner.join(root.join(best, "root").select("node", "best"), "node", "left")
    home = home.select("node", F.coalesce("best.id", "first.id").alias("root"), F.coalesce("best.node", "node").alias("kept_node"))
    out = member.join(home, "node", "left")
    full = F.col("n_shingles") > 0
    kept = ~full | ((F.col("id") == F.col("root")) & (F.col("node") == F.col("kept_node")))
    return out.select("id", "digest", "node", "n_shingles", F.when(full, F.col("root")).otherwise(F.col("id")).alias("root"), kept.alias("kept"))


def _apart(p: str, q: str) -> F.Column:
    """The XOR population count of two sketches."""
    return F.aggregate(F.zip_with(p, q, lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda s, t: s + t)


def _some(table: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """The rows of the table at the places where counts has 1, null elsewhere."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts) * table.shape[1]]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(table.ravel()), mask=pa.array(counts == 0))


def _lists(table: np.ndarray) -> pa.ListArray:
    n, k = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(table.ravel()))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, one document of each group staying: the one with the smallest doc_id, and one row of it if repeated.

    A document without text links with nothing and stays. Only rows of one doc_id and equal sets count as repeated;
    rows without a doc_id and without text never do. Columns are those of docs.
    """
    found = written(_judged(docs, width, percent).drop("root"), "found")
    named = found.where(f"kept and (n_shingles > 0 or id <> {NO_ID})")
    again = written(named.groupBy("id", "node").agg(F.min("digest").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    id_, digest = fresh(docs, "_id", "_digest")
    keys = [id_, digest]
    rows = docs.withColumns(dict(zip(keys, _row(docs), strict=True)))
    left = rows.join(found.where("not kept").select("id", "digest").distinct().toDF(*keys), keys, "left_anti")
    if not again.isEmpty():
        left = left.join(named.join(again, ["id", "node"]).select("id", "digest").distinct().toDF(*keys), keys, "left_anti")
        left = left.unionByName(rows.join(again.select("id", "least").toDF(*keys), keys, "left_semi").dropDuplicates(keys))
    return left.select(*docs.columns)
