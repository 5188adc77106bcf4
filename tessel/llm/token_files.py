"""Token-id files with Elias-Fano document boundaries.

A segment file holds the ids of consecutive documents in one array of 2 or 4 bytes an id, and two monotone
sequences in Elias-Fano form: where each document ends in the array, and the doc_ids. Low bits are packed, high
bits are unary with the place of every 256th one as a select sample, so any document's bounds are found without a
table of 64-bit offsets.

Layout, little-endian: MAGIC, header (HEADER), then the sections in the order of SECTIONS, each padded to 8 bytes.

Executors write whole segments to the shared folder under names of their own. Only the manifest, which a Spark
job commits, says which segments count, so a retried or speculative task leaves no trace in the result.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import NO_ID, chunks, new_path, trimmed, written

MAGIC = b"TKEFSEG1"
#: id width, sample rate, documents, ids, least doc_id, then for ends and doc_ids: low bits, high bytes.
HEADER = struct.Struct("<IIQQqIIQQ")
RATE = 256
#: Ids in a segment, but for one longer document.
SEGMENT_IDS = 8 << 20
#: Fixed value: how a tokenizer cuts words. LATIN: letters up to U+00FF. PLAIN: the same cuts for pieces that are SIMPLE.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"[{LATIN}]+|[0-9]|[^{LATIN}0-9]+").findall
#: Printable ASCII but for the apostrophe, and the Latin letters of one code point, which no rule composes.
SIMPLE = re.compile(f"[!-&(-~{LATIN[6:]}]+").fullmatch
#: White-space pieces that each of a worker's two tables remembers, the longest that is, and how many the library gets at once.
MEMO, MEMO_CHARS, JOINED = 400_000, 64, 1000


class EliasFano:
    """A non-decreasing sequence of unsigned integers in about 2 + log2(universe / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) if n else 0) // 64 * 8 + 8, np.uint8)
        np.bitwise_or.at(high, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return cls(n, bits, low, high, at[::RATE].astype("<u4" if len(high) < 2**29 else "<u8"))

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, whole words of the high bits are counted, then one is searched."""
        words = self.high.view("<u8")
        at = int(self.samples[i // RATE])
        left = i % RATE
        w, word = at >> 6, int(words[at >> 6]) >> (at & 63) << (at & 63)
        while (ones := word.bit_count()) <= left:
            left -= ones
            w += 1
            word = int(words[w])
        for _ in range(left):
            word &= word - 1
        high = (w << 6) + (word & -word).bit_length() - 1 - i
        return high << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        b = a + self.low_bits
        part = int.from_bytes(self.low[a >> 3 : (b + 7) >> 3].tobytes(), "little")
        return part >> (a & 7) & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        out = high.astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out


def _padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 8)


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: bytes, width: int) -> bytes:
    """A segment of documents in ascending doc_id order; ids: width bytes each."""
    least = int(doc_ids[0]) if len(doc_ids) else 0
    apart = doc_ids.astype(np.int64).view(np.uint64) - np.array([least], np.int64).view(np.uint64)
    ends, names = EliasFano.of(np.cumsum(counts)), EliasFano.of(apart)
    head = HEADER.pack(width, RATE, len(doc_ids), int(counts.sum()), least, ends.low_bits, names.low_bits, len(ends.high), len(names.high))
    parts = [MAGIC + head]
    for ef in (ends, names):
        parts += [ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes()]
    return b"".join(map(_padded, [*parts, ids]))


class Segment:
    """A segment read back."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token segment")
        width, self.rate, self.n, self.n_ids, self.least, *rest = HEADER.unpack_from(data, 8)
        at = len(_padded(data[: 8 + HEADER.size]))
        parts = []
        for low_bits, high in zip(rest[:2], rest[2:], strict=True):
            sections = []
            for kind, n in (("u1", (self.n * low_bits + 7) // 8), ("u1", high), ("<u4" if high < 2**29 else "<u8", -(-self.n // RATE))):
                sections.append(np.frombuffer(data, kind, n, at))
                at += -(-sections[-1].nbytes // 8) * 8
            parts.append(EliasFano(self.n, low_bits, *sections))
        self.ends, self.names = parts
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at)

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i begins and ends in ids, by two selects."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int:
        return self.least + self.names.select(i)


def _open(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


class _Pieces:
    """White-space pieces and their ids. No token crosses a space or a newline, so a text's ids are its pieces' ids.

    A batch looks up each of its distinct pieces once. Ids stand in one array, pieces have a number. When the table is
    full it becomes the old one, of which what is met again returns. New pieces go through the library many at a time:
    SIMPLE ones are cut to words here, and as each word ends with a token that ends one they come apart again; others
    are parted by a special token.
    """

    def __init__(self, tokenizer_json: str, width: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_str(tokenizer_json), np.dtype(f"<u{width}")
        self.known, self.old = _Table(self.kind), _Table(self.kind)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        #: Parts joined pieces, if the vocabulary has such a token.
        self.mark, self.mark_id = max(special, default=("", -1), key=lambda x: x[1])
        # A piece with the sign of every special token in it is looked at alone.
        self.sign = os.path.commonprefix([t.content for t in self.tokenizer.get_added_tokens_decoder().values()]) if self.mark else ""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.plain = self._plain(json.loads(tokenizer_json)) if suffix else None
        probe = ["plain", "zqxjk", "Capital", "a", "supercalifragilistic", "XVII", "end.", "(see", "a1b22", "x--y,", "$3.50!", "~#/A", "Über\u00e9-na\u00efve", "\u00c9T\u00c9", "stra\u00dfe"]
        self.worded = bool(self.plain) and all(map(np.array_equal, self._words(probe), self._apart(probe)))

    def _plain(self, held: dict):
        """A tokenizer of the same model for SIMPLE words, and whether they are lower-cased; None if the rules say more about such words than PLAIN does."""
        from tokenizers import Tokenizer

        inside = lambda x, key: [y["type"] for y in x.get(key) or [x]] if x else []
        normal, split = inside(held.get("normalizer"), "normalizers"), inside(held.get("pre_tokenizer"), "pretokenizers")
        replaced = [n["pattern"] for n in (held.get("normalizer") or {}).get("normalizers", ()) if n["type"] == "Replace"]
        cut = [s.get("pattern") for s in (held.get("pre_tokenizer") or {}).get("pretokenizers", ())[:1]]
        if not set(normal) <= {"NFC", "Replace", "Lowercase"} or split != ["Split", "ByteLevel"] or any(p != {"Regex": r"\s+"} for p in replaced) or cut != [{"Regex": SPLIT}]:
            return None
        own = Tokenizer.from_str(json.dumps({**held, "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, held["pre_tokenizer"]["pretokenizers"][1]]}, "added_tokens": []}))
        return own, "Lowercase" in normal

    def _ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces in a row, and how many each has; each piece is encoded alone."""
        ids = self._ids(pieces)
        return np.concatenate([*ids, np.empty(0, self.kind)]), np.array(list(map(len, ids)), np.int64)

    def _words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of PLAIN, whose words are encoded together: a word ends with an id that ends one."""
        tokenizer, lower = self.plain
        words = [[p] if p.isalpha() else PLAIN(p) for p in pieces]
        flat = list(chain.from_iterable(words))
        texts = [" ".join(flat[i : i + JOINED]) for i in range(0, len(flat), JOINED)]
        ids = np.concatenate([np.empty(0, self.kind), *self._ids([t.lower() for t in texts] if lower else texts, tokenizer)])
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(sizes) != len(flat) or sizes.sum() != len(ids):
            raise ValueError("words do not come apart")
        counts = np.fromiter(map(len, words), np.int64, len(words))
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(upto)

    def _marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces encoded together with the mark between them."""
        held, sizes = [np.empty(0, self.kind)], [np.empty(0, np.int64)]
        groups = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)]
        for group, ids in zip(groups, self._ids([self.mark.join(g) for g in groups]), strict=True):
            at = np.concatenate([[-1], np.flatnonzero(ids == self.mark_id), [len(ids)]])
            sizes.append(np.diff(at) - 1)
            if len(sizes[-1]) != len(group):
                raise ValueError("pieces do not come apart")
            held.append(ids[ids != self.mark_id])
        return np.concatenate(held), np.concatenate(sizes)

    def _kind(self, piece: str) -> int:
        """1: words of PLAIN; 2: may stand beside the mark; 3: is looked at alone."""
        if self.worded and piece.isascii() and piece.isalpha():
            return 1
        if not self.sign or self.sign in piece:
            return 3
        return 1 if self.worded and SIMPLE(piece) else 2

    def _met(self, pieces: list[str]) -> np.ndarray:
        """The numbers of pieces that the table lacks, which it has from then on."""
        before = self.old.find(pieces)
        kinds, new = np.zeros(len(pieces), np.int64), np.flatnonzero(before < 0)
        kinds[new] = [self._kind(pieces[k]) for k in new.tolist()]
        order = np.argsort(kinds, kind="stable")
        ordered = [pieces[k] for k in order.tolist()]
        a, b, c = np.searchsorted(kinds[order], [1, 2, 3]).tolist()
        old = before[order[:a]]
        parts = [(self.old.ids(old), self.old.sizes[old]), self._words(ordered[a:b]), self._marked(ordered[b:c]), self._apart(ordered[c:])]
        out = np.empty(len(pieces), np.int64)
        out[order] = self.known.add(ordered, *(np.concatenate(x) for x in zip(*parts, strict=True)))
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text."""
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        # A piece holds no space, so that the distinct ones may cross to Python as one string.
        pieces = " ".join(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ").to_pylist()).split(" ") if len(coded) else []
        if len(self.known.number) >= MEMO:
            self.known, self.old = _Table(self.kind), self.known
        at = self.known.find(pieces)
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            at[gaps] = self._met([pieces[k] for k in gaps.tolist()])
        table, code = self.known, at[np.asarray(coded.indices)] if len(pieces) else np.empty(0, np.int64)
        ids, ends = table.ids(code), np.concatenate([[0], np.cumsum(table.sizes[code])])
        bounds = ends[np.asarray(split.offsets)].tolist()
        table.forget()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]


class _Table:
    """Pieces by number, and the ids of each in one growing array."""

    def __init__(self, kind: np.dtype) -> None:
        self.number: dict[str, int] = {}
        self.held, self.begins, self.sizes = np.empty(1 << 16, kind), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.n = self.used = 0
        self.long: list[str] = []

    def find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these pieces in a row."""
        n = self.sizes[numbers]
        return self.held[np.repeat(self.begins[numbers] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]

    def add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Gives the pieces numbers."""
        for name, more, used in (("held", len(ids), self.used), ("begins", len(pieces), self.n), ("sizes", len(pieces), self.n)):
            have = getattr(self, name)
            if used + more > len(have):
                grown = np.empty(max(used + more, 2 * len(have)), have.dtype)
                grown[:used] = have[:used]
                setattr(self, name, grown)
        self.held[self.used : self.used + len(ids)] = ids
        self.begins[self.n : self.n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(pieces)] = sizes
        self.number.update(zip(pieces, range(self.n, self.n + len(pieces)), strict=True))
        out = np.arange(self.n, self.n + len(pieces))
        self.n, self.used = self.n + len(pieces), self.used + len(ids)
        self.long += [p for p in pieces if len(p) > MEMO_CHARS]
        return out

    def forget(self) -> None:
        """Drops the names of long pieces."""
        for p in self.long:
            self.number.pop(p, None)
        self.long.clear()


_workers: dict[str, _Pieces] = {}


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encodes the whole text of each row (null: empty), ends each document with end_id, and writes segments in
    ascending doc_id order; returns their manifest (part, seq, file, n_docs, n_ids, start).

    start: the ids in all segments before. Rows are dealt by ranges of doc_id; rows of equal doc_id are ordered by
    text, a null doc_id comes first. An empty table writes no file. Other columns are ignored.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_str(text).get_vocab(with_added_tokens=True).values(), default=0)
    width = 2 if max(most, end_id) < 2**16 else 4
    shared, base = spark.sparkContext.broadcast(text), path or new_path(spark, "tokens")
    end = np.array([end_id], f"<u{width}").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"{width} {hash(shared.value)}"
        if key not in _workers:
            _workers.clear()
            _workers[key] = _Pieces(shared.value, width)
        pieces, part, seq = _workers[key], TaskContext.get().partitionId(), 0
        names: list[int] = []
        data: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            uri = f"{base}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.tkef"
            counts = np.array([len(x) // width for x in data], np.int64)
            fs, at = _open(uri)
            fs.create_dir(at.rpartition("/")[0])
            with fs.open_output_stream(at) as f:
                f.write(pack(np.array(names, np.int64), counts, b"".join(data), width))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": uri, "n_docs": len(names), "n_ids": int(counts.sum())}], schema)
            names.clear()
            data.clear()
            seq, held = seq + 1, 0
            return row

        for batch in chunks(batches, "text", 2 << 20):
            for name, ids in zip(batch.column("id").to_pylist(), pieces.encode(batch.column("text")), strict=True):
                names.append(name)
                data.append(ids + end)
                held += len(data[-1]) // width
                if held >= segment_ids:
                    yield flush()
        if names:
            yield flush()

    schema = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    dealt = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text").repartitionByRange("id").sortWithinPartitions("id", "text")
    found = written(dealt.mapInArrow(lambda x: trimmed(rows(x)), "part long, seq long, file string, n_docs long, n_ids long"), "segments")
    # Starts in two steps: over the few totals of partitions, then inside each partition.
    totals = found.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return found.join(totals, "part").select("part", "seq", "file", "n_docs", "n_ids", (F.col("first") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("start"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the segment files: start counts the ids before it.

    Each document's bounds and doc_id come from selects in the Elias-Fano sections; no table of offsets is made.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def documents(segment: Segment, which: range, first: int) -> pa.RecordBatch:
        out = []
        begin = segment.bounds(which[0])[0]
        for i in which:
            end, name = segment.ends.select(i), segment.doc_id(i)
            out.append((None if name == NO_ID else name, begin + first, end - begin, zlib.crc32(segment.ids[begin:end].astype("<u4").tobytes())))
            begin = end
        return pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, at = _open(uri)
                with fs.open_input_file(at) as f:
                    segment = Segment(f.read())
                for i in range(0, segment.n, 4096):
                    yield documents(segment, range(i, min(i + 4096, segment.n)), first)

    files = manifest.select("file", "start").repartition("file")
    return files.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
