"""Fuzzy line dedup by MinHash.

Lines are compared lower-cased (A-Z) and with white space collapsed. A line is a set of character shingles; MinHash
samples in many bands give candidates with high recall, the full sets decide by exact Jaccard similarity, and a
distributed union-find over the links makes components. The first line of each component stays.

Equal lines are one node, so a line that is in a third of all documents costs a narrow row each time it occurs and one
node. The lines are written once; signatures, candidates and proofs are made from that table, and the texts of documents
move through no shuffle. A node is named by a 64-bit hash of its line, and wherever lines are taken for equal another
32 bits must agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm import buckets
from tessel.llm.common import NO_ID, chunks, drop, fresh, let, table_bytes, trimmed, written
from tessel.llm.shingles import MinHash

#: Characters in a shingle; a shorter line is one shingle. One changed character changes so many shingles at most.
WIDTH = 5
#: Bands of six samples. Each sample is in two bands, in another company: simulated, a pair of similarity 0.8 shares no
#: band with probability 12 in 10,000, of 0.85 with 4 in 100,000.
BANDS, ROWS, SAMPLES = 28, 6, 84
#: Bytes of lines that a task remembers to have met.
MET_BYTES = 64 << 20


def lines_of(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, normalised line) of the lines with a word in them."""
    for k, line in enumerate(text.lower().split(b"\n")):
        if words := line.split():
            yield k, b" ".join(words)


def _windows(lines: list[str], kind: type, block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of WIDTH code points within a line, line after line, and how many each line has."""
    padded = [x if len(x) >= WIDTH else x.ljust(WIDTH, "\n") for x in lines]  # no line holds a line feed
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points) - WIDTH + 1
    step, half = (kind(0x9E3779B1), kind(15)) if kind is np.uint32 else (kind(0x9E3779B97F4A7C15), kind(31))
    grams, spare = np.empty(n, kind), np.empty(block, kind)
    for k in range(0, n, block):  # a block stays in the cache
        out = grams[k : k + block]
        size, held = len(out), spare[: len(out)]
        part = points[k : k + size + WIDTH - 1].astype(kind, copy=False)
        np.multiply(part[:size], step, out=out)
        for j in range(1, WIDTH):
            out += part[j : j + size]
            out *= step
            out ^= np.right_shift(out, half, out=held)
        out *= step
        out ^= np.right_shift(out, half, out=held)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    own = np.ones(n, bool)
    over = np.cumsum(sizes)[:-1]
    for j in range(1, WIDTH):  # the windows over two lines
        own[over - j] = False
    return grams[own], sizes - WIDTH + 1


def signatures(lines: list[str], hasher: MinHash, block: int = 1 << 15) -> np.ndarray:
    """The MinHash samples of each line's shingles: (lines, samples)."""
    grams, sizes = _windows(lines, np.uint32)
    tops = np.cumsum(sizes)
    begins = tops - sizes
    out = np.empty((len(lines), hasher.count), np.uint32)
    k = 0
    while k < len(lines):
        to = max(k + 1, int(np.searchsorted(tops, begins[k] + block, "right")))
        cut = begins[k:to] - begins[k]
        part = grams[begins[k] : tops[to - 1]]
        held, least = np.empty_like(part), np.empty((hasher.count, to - k), np.uint32)
        for j in range(hasher.count):
            np.multiply(part, hasher.a[j], out=held)  # a permutation, the factor being odd
            np.minimum.reduceat(held, cut, out=least[j])
        out[k:to] = least.T
        k = to
    return out


def banded(samples: np.ndarray) -> np.ndarray:
    """Samples in the order of their bands: in a row, then along the diagonals of a grid of bands."""
    grid = np.arange(SAMPLES).reshape(ROWS, -1)
    diagonals = [[grid[r, (c + 5 * r) % grid.shape[1]] for r in range(ROWS)] for c in range(grid.shape[1])]
    return samples[:, np.concatenate([np.arange(SAMPLES), np.ravel(diagonals)])]


def shingle_sets(lines: list[str]) -> buckets.Sets:
    """The sets of shingles of up to LOT lines."""
    grams, sizes = _windows(lines, np.uint64)
    return buckets.Sets(grams, np.repeat(np.arange(len(lines), dtype=np.uint64), sizes), len(lines))


def line_table(docs: DataFrame) -> DataFrame:
    """A written table (id, tell, doc, mark, line, of, text): each line with a word; mark is a hash of the document's text, of how many such lines it has.

    id and tell are hashes of the normalised line; text, the line itself, is there when a task meets it first.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    kinds = [pa.int64(), pa.int32()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = {}
        held = 0
        for part in chunks(batches, "text", 1 << 20):
            names, counts, numbers, first = [], [], [], []
            for text in part.column("text").to_pylist():
                before = len(names)
                for number, line in lines_of(text or b""):
                    name = known.get(line)
                    first.append(None if name else line)
                    if name is None:
                        digest = xxhash.xxh3_128_intdigest(line)
                        name = known[line] = (digest >> 64) - 2**63, (digest & 0xFFFFFFFF) - 2**31
                        held += len(line) + 100
                    names.append(name)
                    numbers.append(number)
                counts.append(len(names) - before)
            if names:
                at = np.repeat(np.arange(len(counts)), counts)
                own = [pa.array(x, kind) for x, kind in zip(zip(*names, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*own, part.column("doc").take(pa.array(at)), part.column("mark").take(pa.array(at)), pa.array(numbers), pa.array(np.array(counts)[at]), pa.array(first, pa.string())], ["id", "tell", "doc", "mark", "line", "of", "text"])
            if held > MET_BYTES:
                known.clear()
                held = 0

    return written(texts.mapInArrow(lambda x: trimmed(rows(x)), "id long, tell int, doc long, mark long, line long, of long, text string"), "lines")


def line_links(lines: DataFrame, percent: int) -> DataFrame:
    """(id, root) of the ids in lines that the law links to others, directly or through others."""
    hasher = MinHash(SAMPLES, 1, seed=9)
    bands = MinHash(BANDS, ROWS)
    nodes = lines.where("text is not null").select("id", "tell", "text")

    def signed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        samples = signatures(batch.column("text").to_pylist(), hasher)
        return np.asarray(batch.column("id")), bands.band_keys(banded(samples)).view(np.uint64)

    sets = buckets.met(nodes.select("id", "text"), signed, table_bytes(lines))
    wanted = sets.select(F.explode("ids").alias("id")).distinct()
    # Unlike lines under one hash, should there ever be such, are not compared: they stay.
    texts = nodes.join(wanted, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"), F.min("tell").alias("p"), F.max("tell").alias("q"))
    texts = written(texts.where("p = q").select("id", "text"), "candidates")

    def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, buckets.LOT // 2):
                part = batch.slice(k, buckets.LOT // 2)
                # The first of a set stands in many pairs, which come one after the other.
                at, first = np.unique(np.asarray(part.column("a")), return_index=True)
                sets = shingle_sets(part.column("ta").take(pa.array(first)).to_pylist() + part.column("tb").to_pylist())
                good = pa.array(sets.like(np.searchsorted(at, part.column("a")), len(at) + np.arange(part.num_rows), percent))
                yield part.select(["a", "b"]).filter(good)

    star = buckets.stars(sets).join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").sortWithinPartitions("a")
    out = buckets.closed(sets, star.mapInArrow(lambda x: trimmed(proven(x)), "a long, b long"), texts, lambda rows: (shingle_sets([r[0].as_py() for r in rows]), None), percent)
    drop(sets)
    drop(texts)
    return out


def _duplicates(lines: DataFrame, percent: int) -> DataFrame:
    """(doc, mark, line, first): each line of a line_table() to drop and the place that stands for it; repeated rows give repeated results."""
    root = line_links(lines, percent)
    place = F.struct("doc", "mark", "line")
    # Lines are counted under their hashes first; a hash of unlike lines, should there ever be such, drops none.
    met = lines.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("tell").alias("p"), F.max("tell").alias("q")).where("p = q")
    met = written(met.join(root, "id", "left").where("n > 1 or root is not null").select("id", "root", "first"), "met")
    best = met.where("root is not null").groupBy("root").agg(F.min("first").alias("best"))
    keep = met.join(best, "root", "left").select("id", F.coalesce("best", "first").alias("first"))
    return lines.select("id", "doc", "mark", "line").join(keep, "id").where(place != F.col("first")).drop("id")


def duplicate_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, mark, line, keep_doc, keep_line): each line to drop, with the line that stands for it.

    Lines end at \\n and are numbered from 0; lines without a word are never compared. Two lines link when
    100 * shared >= percent * united shingles; of a component the line with the least (doc_id, mark, number) stays, a
    null doc_id being least. mark is xxhash64 of the text, so that rows which share a doc_id, or have none, are told
    apart by their texts. Repeated rows have the same lines at the same place and share their fate. Null, empty and
    blank texts have no lines; an empty table gives an empty one; columns other than doc_id and text are ignored.
    """
    name = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return _duplicates(line_table(docs), percent).select(name("doc").alias("doc_id"), "mark", "line", name("first.doc").alias("keep_doc"), F.col("first.line").alias("keep_line")).distinct()


def _lost(lines: DataFrame, percent: int, id_: str, mark: str, gone: str) -> DataFrame:
    """The numbers of the lines to drop, ascending, by document: at most the lines of one document."""
    lost = _duplicates(lines, percent)
    return lost.groupBy(F.col("doc").alias(id_), F.col("mark").alias(mark)).agg(F.sort_array(F.collect_set("line")).alias(gone))


def line_report(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped_lines, kept), a row for each row of docs: kept unless all its lines with words go.

    n_lines counts the lines with a word; dropped_lines are numbers of lines, ascending. Null and empty texts have no
    lines and are kept. Repeated rows get the same answer each; an empty table gives an empty one.
    """
    lines, keys = line_table(docs), ["doc", "mark"]
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("mark"))
    gone = _lost(lines, percent, "doc", "mark", "dropped_lines")
    out = rows.join(lines.groupBy(*keys).agg(F.max("of").alias("of")).join(gone, keys, "left"), keys, "left")
    out = out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), F.coalesce("of", F.lit(0).cast("long")).alias("n_lines"), "dropped_lines")
    none = F.expr("cast(array() as array<long>)")
    n = F.size(F.coalesce("dropped_lines", none)).cast("long")
    return out.select("doc_id", "n_lines", n.alias("n_dropped"), F.coalesce("dropped_lines", none).alias("dropped_lines"), ((F.col("n_lines") == 0) | (n < F.col("n_lines"))).alias("kept"))


def drop_duplicate_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with each text less its dropped lines, and without the documents none of whose lines with words stay.

    Columns are those of docs; n_chars, where there is one, counts the new text's characters. Other texts, null and
    empty ones among them, are unchanged; repeated rows stay repeated; an empty table gives an empty one.
    """
    id_, mark, gone = fresh(docs, "_doc", "_mark", "_gone")
    lost = _lost(line_table(docs), percent, id_, mark, gone)
    both = docs.join(lost, (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(mark)), "left")
    lines = F.split("text", "\n")
    at = F.array_except(F.transform(lines, lambda _, i: i.cast("long")), F.col(gone))
    kept = let(lines, lambda x: F.array_join(F.transform(at, lambda i: F.get(x, i.cast("int"))), "\n"))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    out = both.withColumn("text", text).where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return out.select(*docs.columns)
