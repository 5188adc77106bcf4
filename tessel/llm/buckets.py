"""Buckets of equal band keys: candidates, their comparison and the components that come of it.

Tasks deal (key, node) entries to parts of the key space as packed binary columns, so an entry costs ten or fourteen
bytes of shuffle and no row. A part keeps the keys that several nodes have and hands on their sets; equal sets that
come from several bands fall together. No set grows with its group: a group larger than CHUNK, in the task that makes
its keys or in the part where they meet, becomes chunks, each with a common first member, and chunks of one key are
compared tile by tile.

First each member is compared with the first of its set, which is linear in the group; components of those links are
then the labels by which the rest is judged: only members of unlike labels are compared further.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import drop, trimmed, written
from tessel.llm.links import components

#: Members of a set, but for its first.
CHUNK = 1000
#: Entries that a task gathers before it deals them out.
ENTRIES = 1_000_000
#: Bytes of entries that a part should hold.
PART_BYTES = 64 << 20
#: Sets, and pairs, that are worked on at once: as many as the high bits of a sort key can number.
LOT, LOW_BITS = 4096, np.uint64(52)
#: Members of a tile from which on all intersections are counted by a matrix product, where no filter stands before.
DENSE = 32

Signed = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]
_DEALT = "part int, base long, high binary, low binary, ids binary, hot binary, bid long, set array<long>"
_KINDS = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("high", pa.binary()), ("low", pa.binary()), ("ids", pa.binary()), ("hot", pa.binary()), ("bid", pa.int64()), ("set", pa.list_(pa.int64()))])


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of the runs of equal keys."""
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return at, np.diff(np.append(at, len(keys)))


def _ordered(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and ids in the order of the keys."""
    low = int(keys.min()) if len(keys) else 0
    bits = max(len(keys) - 1, 0).bit_length()
    if not len(keys) or (int(keys.max()) - low) >> (64 - bits):
        order = np.argsort(keys)
        return keys[order], ids[order]
    # Where a key and its place share a word, words are sorted: cheaper than sorting places by keys.
    held = (keys - np.uint64(low)) << np.uint64(bits)
    held |= np.arange(len(keys), dtype=np.uint64)
    held.sort()
    return (held >> np.uint64(bits)) + np.uint64(low), ids[(held & np.uint64((1 << bits) - 1)).view(np.int64)]


def _chunks(ids: np.ndarray, chunk: int) -> Iterator[list[int]]:
    """The ids in chunks, the first id in front of each."""
    for i in range(1, len(ids), chunk):
        yield [int(ids[0]), *ids[i : i + chunk].tolist()]


def _dealing(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The high 48 bits of all keys in ascending order, and the id that has each."""
    if len(ids) > 1 << 16:
        return _ordered((keys >> np.uint64(16)).ravel(), np.repeat(ids, keys.shape[1]))
    held = (keys & ~np.uint64(0xFFFF) | np.arange(len(ids), dtype=np.uint64)[:, None]).ravel()
    held.sort()
    return held >> np.uint64(16), ids[(held & np.uint64(0xFFFF)).view(np.int64)]


def _dealt(ids: np.ndarray, keys: np.ndarray, parts: int, chunk: int) -> Iterator[dict]:
    """Rows of packed entries for each part, and chunks of the keys that are common already here."""
    flat, who = _dealing(ids, keys)
    at, n = _runs(flat)
    keep, hot = np.ones(len(flat), bool), []
    for a, k in zip(at[n > chunk], n[n > chunk], strict=True):
        own = np.unique(who[a : a + k])
        if len(own) > chunk:
            hot.append(flat[a])
            who[a], keep[a + 1 : a + k] = own[0], False
            for part in _chunks(own, chunk):
                yield {"part": -1, "bid": int(flat[a]), "set": part}
    flat, who, hot = flat[keep], who[keep], np.array(hot, np.uint64)
    base = int(ids.min())
    kind = "<u4" if int(ids.max()) - base < 2**32 else "<i8"
    cut = [np.searchsorted((x * np.uint64(parts)) >> np.uint64(48), np.arange(parts + 1)) for x in (flat, hot)]
    for p in range(parts):
        (a, b), (c, d) = ((x[p], x[p + 1]) for x in cut)
        if a < b:
            k, w = flat[a:b], who[a:b]
            yield {
                "part": p,
                "base": base,
                "high": (k >> np.uint64(16)).astype("<u4").tobytes(),
                "low": k.astype("<u2").tobytes(),
                "ids": (w - base if kind == "<u4" else w).astype(kind).tobytes(),
                "hot": hot[c:d].tobytes(),
            }


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray]:
    low = np.frombuffer(row["low"], "<u2")
    keys = np.frombuffer(row["high"], "<u4").astype(np.uint64) << np.uint64(16) | low
    if len(row["ids"]) == 4 * len(low):
        return keys, np.frombuffer(row["ids"], "<u4").astype(np.int64) + row["base"]
    return keys, np.frombuffer(row["ids"], "<i8")


def _met(rows: list[dict], chunk: int) -> Iterator[tuple[int | None, list[int]]]:
    """(bid, set) of the keys that several nodes have; bid names a key whose set is in several chunks."""
    keys, ids = (np.concatenate(x) for x in zip(*map(_entries, rows), strict=True))
    hot = np.concatenate([np.frombuffer(r["hot"], "<u8") for r in rows])
    keys, ids = _ordered(keys, ids)
    at, n = _runs(keys)
    several = np.repeat(n > 1, n)
    keys, ids = keys[several], ids[several]
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[new], ids[new]
    at, n = _runs(keys)
    split = np.isin(keys[at], hot) | (n > chunk)
    seen = set()
    for a, k, apart in zip(at[n > 1].tolist(), n[n > 1].tolist(), split[n > 1].tolist(), strict=True):
        own = ids[a : a + k]
        if apart:
            for part in _chunks(own, chunk):
                yield int(keys[a]), part
        elif (name := own.tobytes()) not in seen:
            seen.add(name)
            yield None, own.tolist()


def _part_rows(rows: Iterator[dict], size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, _KINDS)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _KINDS)


def met(nodes: DataFrame, signed: Signed, input_bytes: int, entry_ratio: float = 4.0) -> DataFrame:
    """nodes -> a written table (bid, cid, ids array<long>): the sets of ids that share a band key, each once.

    signed(batch) gives the ids of a batch and their band keys (ids, bands; uint64). A set's first id is the least; of
    a key in several chunks each has the first id of its group in front, and all have one bid. cid names the chunk.
    input_bytes: of the nodes' table, which with entry_ratio sets the number of parts, so that a part stays small.
    """
    spark = nodes.sparkSession
    chunk, entries = CHUNK, ENTRIES
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(input_bytes * entry_ratio) // PART_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                ids, keys = signed(batch)
                held.append((ids, keys))
                n += keys.size
            if n >= entries:
                yield from _part_rows(_dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), parts, chunk), 64)
                held, n = [], 0
        if n:
            yield from _part_rows(_dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), parts, chunk), 64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            every = batch.to_pylist()
            rows += [r for r in every if r["set"] is None]
            if chunks := [(r["bid"], r["set"]) for r in every if r["set"] is not None]:
                yield _sets(chunks)
        if rows:
            held: list = []
            for x in _met(rows, chunk):
                held.append(x)
                if len(held) == 4096:
                    yield _sets(held)
                    held = []
            if held:
                yield _sets(held)

    def _sets(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([s for _, s in held], pa.list_(pa.int64()))], ["bid", "ids"])

    where = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.hash("bid", "set"))
    found = nodes.mapInArrow(lambda x: trimmed(deal(x)), _DEALT).repartition(parts, where).mapInArrow(lambda x: trimmed(meet(x)), "bid long, ids array<long>")
    once = found.distinct().withColumn("cid", F.xxhash64("bid", "ids"))
    return written(once.select(F.coalesce("bid", "cid").alias("bid"), "cid", "ids"), "buckets")


def stars(buckets: DataFrame) -> DataFrame:
    """(a, b), a < b: each member with the first of its set, each pair once."""
    return buckets.select(F.col("ids")[0].alias("a"), F.explode("ids").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tiles(buckets: DataFrame, root: DataFrame) -> DataFrame:
    """(near, tile, id, root): the members of the keys whose members, but for the first, still have several roots.

    root (id, root) labels the ids that have links; an id without is its own. The first member of a whole set has been
    compared with the others and is left out; that of a chunk has met those of its own chunk only and stays. Any two
    others of a key share a tile; a key of one chunk is one tile. near is the same for tiles of one least member, which
    have more members in common.
    """
    others = F.when(F.col("bid") == F.col("cid"), F.expr("slice(ids, 2, size(ids))")).otherwise(F.col("ids"))
    member = buckets.where("size(ids) > 2 or bid <> cid").select("bid", "cid", F.col("ids")[1].alias("near"), F.explode(others).alias("id"))
    member = member.join(root, "id", "left").select("bid", "cid", "near", "id", F.coalesce("root", "id").alias("root"))
    member = written(member, "members")
    apart = member.groupBy("bid").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p < q").select("bid")
    still = member.join(apart, "bid", "left_semi")
    single = still.where("bid = cid").select("near", F.col("cid").alias("tile"), "id", "root")
    many = still.where("bid <> cid")
    heads = many.select("bid", "cid").distinct()
    grid = heads.join(heads.withColumnRenamed("cid", "other"), "bid").where("cid <= other")
    grid = grid.select(F.xxhash64("cid", "other").alias("tile"), F.explode(F.array_distinct(F.array("cid", "other"))).alias("cid"))
    return single.unionByName(many.join(grid, "cid").select(F.col("tile").alias("near"), "tile", "id", "root").distinct())


class Sets:
    """Up to LOT sets, as sorted distinct hashes of 52 bits. owner: the set's number for each of the 64-bit hashes."""

    def __init__(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> None:
        keys = np.sort(owner.astype(np.uint64) << LOW_BITS | hashes >> np.uint64(12))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        self.owner, self.grams = (keys >> LOW_BITS).astype(np.int64), keys & np.uint64((1 << 52) - 1)
        self.sizes = np.bincount(self.owner, minlength=n)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the sets in a row, and the place in which of each."""
        n = self.sizes[which]
        at = np.repeat(self.begins[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return self.grams[at], np.repeat(np.arange(len(which), dtype=np.uint64), n)

    def like(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether 100 * shared >= percent * united holds for the pairs of sets."""
        a, b = self.sizes[i], self.sizes[j]
        good = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        some = np.flatnonzero(good)
        step = max(1, min(LOT, (4 << 20) // max(1, int(self.sizes.max(initial=1)))))
        for k in range(0, len(some), step):
            part = some[k : k + step]
            keys = np.sort(np.concatenate([place << LOW_BITS | grams for grams, place in (self.of(i[part]), self.of(j[part]))]))
            twice = keys[1:][keys[1:] == keys[:-1]] >> LOW_BITS
            shared = np.bincount(twice.astype(np.int64), minlength=len(part))
            good[part] = (shared > 0) & (100 * shared >= percent * (a[part] + b[part] - shared))
        return good

    def like_all(self, which: np.ndarray, percent: int) -> np.ndarray:
        """Whether it holds for the pairs among these sets: (n, n)."""
        n = len(which)
        grams, place = self.of(which)
        names = np.unique(grams, return_inverse=True)[1]
        both = np.zeros((n, n), np.float32)
        for k in range(0, int(names.max()) + 1, 4096):
            inside = (names >= k) & (names < k + 4096)
            held = np.zeros((n, 4096), np.float32)
            held[place[inside].astype(np.int64), names[inside] - k] = 1
            both += held @ held.T
        size = self.sizes[which]
        return (both > 0) & (100 * both >= percent * (size[:, None] + size - both))


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]
Made = Callable[[list[tuple]], tuple[Sets, Near | None]]


def tile_links(sizes: list[int], which: np.ndarray, ids: list[int], roots: list[int], sets: Sets, near: Near | None, percent: int) -> pa.RecordBatch:
    """(a, b): the pairs of like sets in tiles of so many members, one for each two roots. which: the set of each member. near(i, j) says which sets are worth a proof."""
    labels, left, right, at = np.array(roots), [], [], 0
    sure = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
    for n in sizes:
        apart = np.tril(labels[at : at + n, None] != labels[at : at + n], -1)
        if near or n < DENSE:
            i, j = np.nonzero(apart)
            left.append(i + at)
            right.append(j + at)
        else:
            for found, x in zip(sure, np.nonzero(apart & sets.like_all(which[at : at + n], percent)), strict=True):
                found.append(x + at)
        at += n
    if left:
        i, j = np.concatenate(left), np.concatenate(right)
        for k in range(0, len(i), 1 << 18):
            p, q = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            if near:
                worth = near(which[p], which[q])
                p, q = p[worth], q[worth]
            good = sets.like(which[p], which[q], percent)
            sure[0].append(p[good])
            sure[1].append(q[good])
    i, j = map(np.concatenate, sure)
    ends = np.stack([np.minimum(labels[i], labels[j]), np.maximum(labels[i], labels[j])], axis=1)
    first = np.unique(ends, axis=0, return_index=True)[1]
    names = np.array(ids, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(names[x[first]]) for x in (i, j)], ["a", "b"])


def closed(buckets: DataFrame, links: DataFrame, payload: DataFrame, made: Made, percent: int) -> DataFrame:
    """A written table (id, root) of all ids that links or any pair of a bucket connects. links (a, b): the stars that hold.

    payload (id, ...) has a row for each id that may be compared; made(its other columns, row by row) gives the sets.
    """
    root = written(components(links), "star_roots")
    others = [c for c in payload.columns if c != "id"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sizes, rows = None, [], []

        def flush() -> pa.RecordBatch:
            one = {r[0]: k for k, r in enumerate(rows)}  # an id is in several tiles
            place = {name: k for k, name in enumerate(one)}
            sets, near = made([rows[k][2:] for k in one.values()])
            return tile_links(sizes, np.array([place[r[0]] for r in rows]), [r[0] for r in rows], [r[1] for r in rows], sets, near, percent)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tile", "id", "root")] + [list(batch.column(c)) for c in others]
            for tile, *row in zip(*columns, strict=True):
                if tile != last:
                    if len(rows) >= LOT // 2:  # a tile has two more members at most, those of two chunks
                        yield flush()
                        sizes, rows = [], []
                    last = tile
                    sizes.append(0)
                rows.append(row)
                sizes[-1] += 1
        if rows:
            yield flush()

    placed = tiles(buckets, root).join(payload, "id").repartition("near").sortWithinPartitions("near", "tile")
    more = placed.select("tile", "id", "root", *others).mapInArrow(lambda x: trimmed(compared(x)), "a long, b long")
    for e in "ab":
        more = more.join(root.select(F.col("id").alias(e), F.col("root").alias(f"r{e}")), e, "left")
    upper = written(components(more.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "upper_roots")
    # A root of the stars may have one above; ids that no star holds have only that.
    named = root.unionByName(upper.select("id", F.col("id").alias("root"))).join(upper.toDF("root", "top"), "root", "left")
    out = written(named.groupBy("id").agg(F.min(F.coalesce("top", "root")).alias("root")), "roots")
    drop(root)
    drop(upper)
    return out
