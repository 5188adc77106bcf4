"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are whole tokens. Tier two: any other
pre-token's bytes form a linked list, and a heap of neighbouring pairs by rank and place merges them. Results are
remembered for each worker in a table of bounded size.

The tables are built once on the driver from the vocabulary, whose size bounds them, and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import chunks

#: Pre-tokens remembered by one worker, and the longest that is.
MEMO, MEMO_CHARS = 200_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens with ranks from a file of base64 and number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash: n distinct keys to n slots by a displacement for each bucket of about two keys."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        hashed: dict[int, list[int]] = {}
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            hashed.setdefault(h % self.buckets, []).append(h)
        self.shift = [0] * self.buckets
        taken, free = bytearray(n), n - 1
        for bucket, hs in sorted(hashed.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(hs) == 1:  # any free slot will do, named outright
                while taken[free]:
                    free -= 1
                taken[free] = 1
                self.shift[bucket] = -free - 1
                continue
            d = 0
            while True:
                at = [self._slot(h, d) for h in hs]
                if len(set(at)) == len(at) and not any(taken[s] for s in at):
                    break
                d += 1
            for s in at:
                taken[s] = 1
            self.shift[bucket] = d

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 >> 27) & 0xFFFFFFFFFF) % self.n

    def slot(self, key: bytes) -> int:
        """The key's slot; for other bytes some slot."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else self._slot(h, d)


class Codec:
    """Encodes and decodes like the public library of the rank files."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        self.key = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
        self.table = PerfectHash(list(ranks))
        self.held: list[tuple[bytes, int]] = [(b"", -1)] * len(ranks)
        for token, rank in ranks.items():
            self.held[self.table.slot(token)] = (token, rank)
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: For each left rank: right rank to the rank of both together. Kept by left, so that keys stay small numbers.
        self.after: list[dict[int, int]] = [{} for _ in self.bytes_of]
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    self.after[a][b] = rank

    def whole(self, piece: bytes) -> int:
        """Tier one: the rank of a piece that is a token, else -1."""
        token, rank = self.held[self.table.slot(piece)]
        return rank if token == piece else -1

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Tier two: the least rank first, the leftmost of equals, until no pair is a token."""
        ids = list(map(self.single.__getitem__, piece))
        n, table = len(ids), self.after
        shift = max(12, n.bit_length())
        heap = [table[a][b] << shift | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if b in table[a]]
        heapify(heap)
        after, before, mask = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << shift) - 1
        while heap:
            top = heappop(heap)
            i = top & mask
            j, a = after[i], ids[i]
            if j >= n or a < 0 or (rank := table[a].get(ids[j])) is None or rank != top >> shift:
                continue  # one side has been merged since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := table[rank].get(ids[k])) is not None:
                    heappush(heap, r << shift | i)
            h = before[i]
            if h >= 0 and (r := table[ids[h]].get(rank)) is not None:
                heappush(heap, r << shift | h)
        return tuple([x for x in ids if x >= 0])

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        rank = self.whole(data)
        return (rank,) if rank >= 0 else self.merged(data)

    def encoder(self) -> _Encoder:
        return _Encoder(self)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Encoder(dict):
    """Pre-token to ids, filled as pre-tokens come. When it is full it becomes the old table, of which what is met again returns."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.find, self.old = codec, regex.compile(codec.pattern).findall, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.old.get(text) or self.codec.piece(text)
        if len(text) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, self.find(text))))


_workers: dict[str, _Encoder] = {}


def _worker(shared) -> _Encoder:
    """This worker's encoder; tables and remembered pre-tokens outlive the task."""
    codec = shared.value
    key = codec.key
    if key not in _workers:
        _workers.clear()
        _workers[key] = codec.encoder()
    return _workers[key]


def _codec(docs: DataFrame, ranks_path: str, pattern: str):
    return docs.sparkSession.sparkContext.broadcast(Codec(load_ranks(ranks_path), pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>), a row for each row of docs: the ids of the whole text, none for null or empty text."""
    shared = _codec(docs, ranks_path, pattern)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(shared)
        for part in chunks(batches, "text", 1 << 20):
            ids = [encoder.encode(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary): the bytes that the ids stand for. Null ids give no bytes; an unknown id is an error."""
    shared = _codec(encoded, ranks_path, pattern)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            out = [codec.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row of docs; null text counts as empty.

    Encoding and decoding in one pass: ids do not leave the worker. Repeated rows give repeated results, an empty
    table an empty one, and other columns are ignored.
    """
    shared = _codec(docs, ranks_path, pattern)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(shared)
        codec, sha = encoder.codec, hashlib.sha256
        decimal = [str(i) for i in range(len(codec.bytes_of))]
        for part in chunks(batches, "text", 1 << 20):
            sizes, names, backs = [], [], []
            for text in part.column("text").to_pylist():
                ids = encoder.encode(text or "")
                sizes.append(len(ids))
                names.append(sha(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                backs.append(sha(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.string()), pa.array(backs, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
