"""Benchmark decontamination by spaced seeds.

A mask picks some of the tokens of a window and ignores the others, so a window whose substituted tokens fall on
ignored places hashes like the original. Windows of the benchmark and of the documents are hashed under a few fixed
masks and joined on the hashes. A pair that meets is verified on both texts: along each seed the longest stretch with
few substitutions is measured, and it counts as an overlap if it is long and similar enough.

Of the documents' windows only those reach the join that a bitmap of the benchmark's hashes lets through. Its size is
bounded (FILTER_BITS), whatever the benchmark's, and it only saves work: what it lets through wrongly joins nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import NO_ID, chunks, drop, fresh, trimmed, written
from tessel.llm.shingles import _FOLD, NOT_WORD, mix, word_hashes

#: For items of LONG tokens or more: six tokens each. Every stretch that is an overlap, wherever its substitutions are, has
#: a window that agrees under one of these: one of 24 tokens or more has a half that is an overlap too, and the shorter
#: ones were all tried.
MASKS = ("1101111", "111010011", "11100100011")
#: For shorter items: four tokens each, all ways tried.
SHORT_MASKS = ("1111", "11011", "11101", "10111")
LONG = 12
#: An overlap has so many equal tokens at least, or LEAST_PERCENT of 100 of a shorter item's; and so many of 100 in its stretch.
LEAST_EQUAL, LEAST_PERCENT = 10, 80
#: Items with fewer tokens ("yes", "new york") are in clean documents too and are no evidence.
LEAST_ITEM = 4
#: Bits of the bitmap: 32 for each hash of the benchmark, between these bounds.
FILTER_BITS = (1 << 22, 1 << 28)
#: Bytes of text that a step works on; its arrays take some forty times as much.
STEP_BYTES = 1 << 19
_SPANS = "array<struct<item_id:long,first_word:long,n_words:long,n_equal:long>>"


def masked(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash under the mask of the window that begins at each token."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, salt + 1, np.uint64)
    for j, on in enumerate(mask):
        if on == "1":
            acc *= _FOLD
            acc += words[j : j + n]
    return mix(acc)


def masks_of(n: int) -> tuple[tuple[int, str], ...]:
    """(salt, mask) for an item of n tokens."""
    every = tuple(enumerate((*MASKS, *SHORT_MASKS)))
    return () if n < LEAST_ITEM else every[: len(MASKS)] if n >= LONG else every[len(MASKS) :]


def stretch(equal: np.ndarray, whole: int) -> tuple[int, int, int] | None:
    """(first, length, equal tokens) of the stretch with the most equal tokens among those with LEAST_PERCENT of 100 equal, if it is an overlap.

    An equal token marks one and another marks minus four, so the stretches in question are those with a sum of 0 or more.
    """
    marks = np.where(equal, 1, -(LEAST_PERCENT // (100 - LEAST_PERCENT)))
    sums, counts = (np.concatenate([[0], np.cumsum(x)]) for x in (marks, equal))
    # For each end the first begin whose sum is not above the end's.
    begins = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    held = counts - counts[begins]
    end = int(np.argmax(held))
    n = int(held[end])
    if n < min(LEAST_EQUAL, -(-LEAST_PERCENT * whole // 100)):
        return None
    inside = np.flatnonzero(equal[begins[end] : end])
    return int(begins[end] + inside[0]), int(inside[-1] - inside[0] + 1), n


def spans(words: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """(first token, tokens, equal tokens) of the overlaps of a text with an item, in the order of their seeds.

    A seed that lies in an overlap which is already found is passed over, so a text that repeats itself costs no more
    than one that does not; every overlap there is shares its seeds with one that is reported.
    """
    seeds = []
    for salt, mask in masks_of(len(item)):
        own, theirs = masked(item, mask, salt), masked(words, mask, salt)
        order = np.argsort(own, kind="stable")
        lo, hi = (np.searchsorted(own[order], theirs, side) for side in ("left", "right"))
        seeds += [(p, len(mask), order, lo[p], hi[p]) for p in np.flatnonzero(lo < hi).tolist()]
    out: list[tuple[int, int, int]] = []
    covered = 0
    for p, n, order, lo, hi in sorted(seeds, key=lambda s: s[:2]):
        if p + n <= covered:
            continue
        for place in order[lo:hi].tolist():
            start = p - place
            a, b = max(start, 0), min(start + len(item), len(words))
            got = stretch(words[a:b] == item[a - start : b - start], len(item))
            if got and a + got[0] + got[1] > covered:
                out.append((a + got[0], got[1], got[2]))
                covered = a + got[0] + got[1]
                break
    return out


def _hashes(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(part.column("text"), blank=NOT_WORD)


def _item_keys(items: DataFrame) -> DataFrame:
    """A written table (hash, item): each hash of each item under its masks, once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", STEP_BYTES):
            words, at = _hashes(part)
            for name, a, b in zip(part.column("item").to_pylist(), at[:-1], at[1:], strict=True):
                keys = [masked(words[a:b], mask, salt) for salt, mask in masks_of(b - a)]
                if keys:
                    keys = np.unique(np.concatenate(keys)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), name))], ["hash", "item"])

    return written(items.mapInArrow(rows, "hash long, item long").distinct(), "item_keys")


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a bitmap."""
    mask = np.uint64(bits - 1)
    return (keys & mask).astype(np.int64), ((keys >> np.uint64(32)) & mask).astype(np.int64)


def _filter(keys: DataFrame) -> np.ndarray:
    """The bitmap of the hashes, as bytes; executors send at most one word for each word of it."""
    spark, n = keys.sparkSession, keys.count()
    bits = max(FILTER_BITS[0], min(FILTER_BITS[1], 1 << (32 * n).bit_length()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _places(np.asarray(batch.column("hash")).view(np.uint64), bits):
                np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        words = held.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    out = np.zeros(bits // 64, np.int64)
    words = keys.select("hash").mapInArrow(rows, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    for part in words.toArrow().to_batches():
        out[np.asarray(part.column("at"))] = np.asarray(part.column("word"))
    return out.view(np.uint8)


def _row(docs: DataFrame) -> list:
    """What tells rows apart: the doc_id, NO_ID for null, and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64("text")]


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A written table (id, mark, overlaps): the rows that some item overlaps, by doc_id and a hash of the text."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.xxhash64("item_id", "text").alias("item"), F.col("item_id").cast("long"), "text").distinct()
    keys = _item_keys(items)
    shared = spark.sparkContext.broadcast(_filter(keys))  # FILTER_BITS at most
    every = list(enumerate((*MASKS, *SHORT_MASKS)))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        bits = 8 * len(held)
        for part in chunks(batches, "text", STEP_BYTES):
            words, at = _hashes(part)
            where, which = [], []
            for salt, mask in every:
                hashed = masked(words, mask, salt)
                hit = np.arange(len(hashed))
                for place in _places(hashed, bits):
                    some = place[hit]
                    hit = hit[held[some >> 3] >> (some & 7).astype(np.uint8) & 1 > 0]
                text = np.searchsorted(at, hit, "right") - 1
                inside = hit + len(mask) <= at[text + 1]
                where.append(text[inside])
                which.append(hashed[hit[inside]])
            where, which = np.concatenate(where), np.concatenate(which)
            order = np.lexsort((which, where))
            where, which = where[order], which[order]
            new = np.ones(len(where), bool)
            new[1:] = (where[1:] != where[:-1]) | (which[1:] != which[:-1])
            where, which = where[new], which[new]
            rows, counts = np.unique(where, return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(which.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(rows)) for c in ("id", "mark", "text")), lists], ["id", "mark", "text", "hashes"])

    id_, mark = _row(docs)
    texts = docs.where("text is not null").select(id_.alias("id"), mark.alias("mark"), "text")
    suspects = written(texts.mapInArrow(lambda x: trimmed(suspected(x)), "id long, mark long, text string, hashes array<long>"), "suspects")
    # Hashes are distinct for a row, items for a hash: a text that repeats itself makes no more rows here.
    pairs = suspects.select("id", "mark", F.explode("hashes").alias("hash")).join(keys, "hash").select("id", "mark", "item").distinct()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first_word", "n_words", "n_equal")]))
        for part in chunks(batches, "text", STEP_BYTES):
            (words, at), (own, to) = _hashes(part), word_hashes(part.column("item_text"), blank=NOT_WORD)
            names = part.column("item_id").to_pylist()
            out = [[{"item_id": names[k], "first_word": p, "n_words": n, "n_equal": e} for p, n, e in spans(words[at[k] : at[k + 1]], own[to[k] : to[k + 1]])] for k in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("mark"), pa.array(out, kind)], ["id", "mark", "overlaps"])

    both = pairs.join(items.withColumnRenamed("text", "item_text"), "item").join(suspects.select("id", "mark", "text").dropDuplicates(["id", "mark"]), ["id", "mark"])
    each = both.select("id", "mark", "item_id", "text", "item_text").mapInArrow(verified, f"id long, mark long, overlaps {_SPANS}").where("size(overlaps) > 0")
    # At most the items that overlap one text.
    out = written(each.groupBy("id", "mark").agg(F.array_sort(F.flatten(F.collect_list("overlaps"))).alias("overlaps")), "overlaps")
    drop(suspects)
    drop(keys)
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_overlaps, item_ids, overlaps, kept), a row for each row of docs: kept if no item overlaps its text.

    Tokens are runs of letters, digits and non-ASCII characters, A-Z lower-cased. An overlap is a stretch of a text
    lined up with an item, LEAST_PERCENT of 100 tokens equal, with at least LEAST_EQUAL equal tokens or, for a shorter
    item, LEAST_PERCENT of 100 of the item's. overlaps lists item_id, first token, length and equal tokens; of
    overlaps with one item that share their seeds one is listed. item_ids is ascending. Null and empty texts overlap
    nothing; null items and items under LEAST_ITEM tokens are not searched; a null item_id is an id like any other.
    Repeated rows get the same answer each, and rows that share a doc_id are judged by their own texts. An empty table
    on either side gives no overlaps. Columns other than doc_id, text, item_id and text are ignored.
    """
    id_, mark = _row(docs)
    rows = docs.select(F.col("doc_id").cast("long"), id_.alias("id"), mark.alias("mark"))
    some = F.coalesce("overlaps", F.expr(f"cast(array() as {_SPANS})"))
    out = rows.join(found(docs, benchmark), ["id", "mark"], "left").select("doc_id", some.alias("overlaps"))
    return out.select("doc_id", F.size("overlaps").cast("long").alias("n_overlaps"), F.array_sort(F.array_distinct("overlaps.item_id")).alias("item_ids"), "overlaps", (F.size("overlaps") == 0).alias("kept"))


def drop_overlapping(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that some item overlaps, as overlaps() says; columns are those of docs.

    Repeated rows go together, rows that share a doc_id each by their text. Null and empty texts stay. With no
    benchmark all stay; an empty table gives an empty one.
    """
    keys = fresh(docs, "_id", "_mark")
    gone = found(docs, benchmark).select("id", "mark").toDF(*keys)
    return docs.withColumns(dict(zip(keys, _row(docs), strict=True))).join(gone, keys, "left_anti").select(*docs.columns)
