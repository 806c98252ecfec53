"""Token ids in compact files: canonical length-limited Huffman codes from global counts, decoded by table.

Steps: (1) texts to ids, one scan, kept as a table; (2) counts of ids, summed by Spark, at most one row per vocabulary
entry; (3) optimal code lengths up to ``LIMIT`` bits on the driver; (4) ids dealt by ranges of document ids, sorted, and
packed into segments; (5) segments read back and decoded.

File format: Parquet files whose names and rows ascend with the document id. A row is a segment: the number of ids
before it in its file, ids and lengths of its documents, and a payload. The payload is the header ``HTK1``, number of ids, ids per block and number of blocks (each
little-endian unsigned 32-bit), then the bit offset at which every block begins (unsigned 64-bit), then the codes, high bit
first, padded to 32-bit words. Blocks are decoded independently, all blocks of a segment side by side: each step looks
up the next ``LIMIT`` bits of every block in a table of symbols and lengths. The code book is a table of (id, length);
canonical codes follow from the lengths.

Defined cases: NULL and empty texts are just the end id; NULL document ids come first; rows with equal document ids are
ordered by their ids' count and hash and each keeps its own row; an empty table writes and reads no segment.
"""

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import words as W
from strideframe.llm.stages import Scratch, save

LIMIT = 20
BLOCK = 256
SEGMENT = 1 << 18
_MAGIC = b"HTK1"
#: Parts that a worker keeps, and bytes of texts that are cut together.
_KEPT = 1_000_000
_SLAB = 1 << 20


# ---- texts to ids


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[_LETTER] = False
_MARK[ord("'")] = False
_BLANK = np.ones(256, bool)
_BLANK[[0x20, 0x0A]] = False
_PLAIN = 0xC5  # bytes below it: ASCII and letters up to U+013F, nothing that combines


def _cuts(data: np.ndarray) -> np.ndarray:
    """Places between an ASCII or Latin-1 letter and an ASCII digit or mark, where the tokenizer always splits."""
    before, after = data[:-1], data[1:]
    accented = np.zeros(len(data), bool)  # last byte of a Latin-1 letter
    accented[1:] = (before == 0xC3) & (after != 0x97) & (after != 0xB7)
    ends = _LETTER[data] | accented
    begins = _LETTER[data]
    begins[:-1] |= accented[1:]
    return np.flatnonzero(ends[:-1] & _MARK[after] | _MARK[before] & begins[1:]) + 1


class Parts:
    """Ids of the parts of texts, learnt from the tokenizer once per part and kept by the hash of the part.

    White space separates words for this tokenizer and is dropped, so texts are cut at blanks and line ends. Where a
    slab holds only ASCII and plain Latin letters and no special token, letters are lowered (as the tokenizer does) and
    separated from marks and digits, which leaves fewer different parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.pool = np.zeros(0, W.U64), np.zeros(0, np.uint32)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        size = np.array([len(x) for x in ids], np.int64)
        start = np.cumsum(size) - size + len(self.pool)
        self.pool = np.concatenate([self.pool, np.fromiter((i for x in ids for i in x), np.uint32)])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.start, self.size = np.insert(self.start, at, start), np.insert(self.size, at, size)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text (NULL: none)."""
        for _, _, data, offsets in W.slabs(column, _SLAB):
            plain = not len(data) or data.max() < _PLAIN and b"<|" not in data.tobytes()
            slab = W.WordSlab(data, offsets, _BLANK, W.LOWER if plain else W.SAME, _cuts(data) if plain else None)
            distinct, first, which = np.unique(slab.hashes, return_index=True, return_inverse=True)
            if len(self.hashes) > _KEPT:
                self._clear()
            at = np.searchsorted(self.hashes, distinct)
            new = np.ones(len(distinct), bool)
            inside = at < len(self.hashes)
            new[inside] = self.hashes[at[inside]] != distinct[inside]
            if new.any():
                self._learn(distinct[new], [slab.words(i, i + 1)[0] for i in first[new].tolist()])
                at = np.searchsorted(self.hashes, distinct)
            size, start = self.size[at][which], self.start[at][which]
            ends = np.cumsum(size)
            flat = self.pool[np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))]
            bounds = np.r_[0, ends][slab.first].tolist()
            for a, b in zip(bounds[:-1], bounds[1:]):
                yield flat[a:b]


@lru_cache(maxsize=1)
def _parts(path: str) -> Parts:
    return Parts(path)


def id_type(path: str, end_id: int) -> np.dtype:
    """Two bytes hold every id of a vocabulary of up to 65,536, four those of a larger one."""
    return np.dtype("<u2" if max(_parts(path).tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")


def tokenized(docs: DataFrame, path: str, end_id: int, kind: np.dtype) -> DataFrame:
    """``doc_id, n_tokens, ids``: ids as little-endian integers of ``kind``, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, end = _parts(path), np.array([end_id], kind).tobytes()
        for batch in batches:
            at, raws = 0, []
            for ids in parts.encode(batch.column(1)):
                raws.append(ids.astype(kind).tobytes() + end)
                if len(raws) == 1024 or at + len(raws) == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, len(raws)), pa.array([len(r) // kind.itemsize for r in raws], pa.int64()),
                         pa.array(raws, pa.binary())], names=["doc_id", "n_tokens", "ids"],
                    )
                    at, raws = at + len(raws), []

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def _counted(kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                made = np.bincount(np.frombuffer(raw.as_buffer(), kind))
                if len(made) > len(counts):
                    counts, made = made, counts
                counts[: len(made)] += made
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts[ids], pa.int64())], names=["id", "n"])

    return run


# ---- codes


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code with no code above ``limit`` bits (package merge). Counts are positive."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    packages, kinds = np.zeros(0, np.int64), []
    for _ in range(limit):
        row = np.concatenate([leaves, packages])
        by = np.argsort(row, kind="stable")
        row = row[by]
        kinds.append(by < n)
        even = len(row) // 2 * 2
        packages = row[:even:2] + row[1:even:2]
    lengths, taken = np.zeros(n, np.uint8), 2 * n - 2
    for leaf in reversed(kinds):
        k = int(leaf[:taken].sum())
        lengths[:k] += 1
        taken = 2 * (taken - k)
    out = np.zeros(n, np.uint8)
    out[order] = lengths
    return out


class CodeBook:
    """Canonical codes: by length, then by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.longest = int(lengths[-1]) if len(ids) else 1
        steps = np.left_shift(np.int64(1), self.longest - lengths)
        first = np.cumsum(steps) - steps
        size = int(ids.max()) + 1 if len(ids) else 0
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[ids], self.length[ids] = first >> (self.longest - lengths), lengths
        self.symbols, self.sizes = np.zeros(1 << self.longest, np.uint32), np.ones(1 << self.longest, np.uint8)
        filled = int(steps.sum())
        self.symbols[:filled], self.sizes[:filled] = np.repeat(ids, steps), np.repeat(lengths, steps)

    def pack(self, ids: np.ndarray) -> bytes:
        n, blocks = len(ids), -(-len(ids) // BLOCK)
        lengths, codes = self.length[ids], self.code[ids]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        words = np.zeros((int(ends[-1]) if n else 0) // 32 + 2, np.uint64)
        slot, room = starts >> 5, 64 - (starts & 31) - lengths
        spread = codes << room.astype(np.uint64)
        if n:
            heads = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
            words[slot[heads]] += np.add.reduceat(spread >> np.uint64(32), heads)
            words[slot[heads] + 1] += np.add.reduceat(spread & np.uint64(0xFFFFFFFF), heads)
        head = _MAGIC + struct.pack("<III", n, BLOCK, blocks)
        return head + starts[::BLOCK].astype("<u8").tobytes() + words.astype("<u4").tobytes()

    def unpack(self, payload: bytes) -> np.ndarray:
        if payload[:4] != _MAGIC:
            raise ValueError("not a segment of this format")
        n, per, blocks = struct.unpack_from("<III", payload, 4)
        at = np.frombuffer(payload, "<u8", blocks, 16).astype(np.int64)
        words = np.frombuffer(payload, "<u4", offset=16 + 8 * blocks).astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        out, shift = np.zeros((per, blocks), np.uint32), 64 - self.longest
        mask, last = np.uint64((1 << self.longest) - 1), n - (blocks - 1) * per
        for step in range(per if n else 0):
            if step == last and blocks:  # the last block is shorter
                at = at[:-1]
            seen = (pairs[at >> 5] >> (shift - (at & 31)).astype(np.uint64)) & mask
            out[step, : len(at)] = self.symbols[seen]
            at = at + self.sizes[seen]
        return out.T.reshape(-1)[:n]


# ---- files


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Write ``path/codes`` and ``path/segments``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-ids")
    width = id_type(tokenizer_path, end_id)
    tokens = scratch.keep(tokenized(docs, tokenizer_path, end_id, width), "ids", "zstd")
    counts = tokens.select("ids").mapInArrow(_counted(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.orderBy("id").collect()  # at most the vocabulary
    ids, n = np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    lengths = code_lengths(n)
    codes = list(zip(ids.tolist(), lengths.tolist()))
    spark.createDataFrame(codes, "id long, length int").coalesce(1).write.parquet(f"{path}/codes")
    book = spark.sparkContext.broadcast((ids, lengths))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, offset = CodeBook(*book.value), TaskContext.get().partitionId(), 0
        names, sizes, raws, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            payload = own.pack(np.frombuffer(b"".join(raws), width))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([offset], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([names], pa.list_(kind)), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([payload], pa.binary())], names=["part", "offset", "n_ids", "doc_ids", "lengths", "payload"],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, raw in zip(batch.column(0), batch.column(1)):
                names.append(doc_id.as_py())
                raws.append(raw.as_py())
                sizes.append(len(raws[-1]) // width.itemsize)
                held += sizes[-1]
                if held >= SEGMENT:
                    yield segment()
                    offset += held
                    names, sizes, raws, held = [], [], [], 0
        if raws:
            yield segment()

    kind = tokens.schema["doc_id"].dataType.simpleString()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", "n_tokens", "_tie"]
    placed = tokens.withColumn("_tie", F.xxhash64("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    segments = placed.select("doc_id", "ids").mapInArrow(
        pack, f"part long, offset long, n_ids long, doc_ids array<{kind}>, lengths array<long>, payload binary"
    )
    save(segments, f"{path}/segments")
    scratch.drop("ids")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (array<int>) of every document in the files."""
    return _decoded(spark, path, "ids array<int>", lambda ids, sizes: pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(ids.astype(np.int32))
    ))


def _crc(ids: np.ndarray, sizes: list[int]) -> pa.Array:
    raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum([0, *sizes]) * 4
    return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64())


def _decoded(spark: SparkSession, path: str, column: str, made) -> DataFrame:
    segments = spark.read.parquet(f"{path}/segments")
    codes = spark.read.parquet(f"{path}/codes").collect()
    book = spark.sparkContext.broadcast(
        (np.array([r["id"] for r in codes], np.int64), np.array([r["length"] for r in codes], np.int64))
    )
    # One total per file, so as many rows as tasks wrote.
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    begins, at = {}, 0
    for r in totals:
        begins[r["part"]] = at
        at += r["n"]
    starts = spark.sparkContext.broadcast(begins)
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CodeBook(*book.value)
        for batch in batches:
            for r in range(batch.num_rows):
                part, offset, names, sizes, payload = (batch.column(i)[r].as_py() for i in range(5))
                ids = own.unpack(payload)
                begin = np.cumsum([starts.value[part] + offset, *sizes[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, batch.schema.field(2).type.value_type), pa.array(begin, pa.int64()),
                     pa.array(sizes, pa.int64()), made(ids, sizes)], names=["doc_id", "start", "n_tokens", name],
                )

    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    return segments.select("part", "offset", "doc_ids", "lengths", "payload").mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, {column}"
    )


def digest(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files in the shared folder, read them back, and return position, length and checksum per document."""
    path = Scratch(docs.sparkSession, "token-files").root
    write(docs, path, tokenizer_path, end_id)
    return _decoded(docs.sparkSession, path, "ids_crc32 long", _crc)
