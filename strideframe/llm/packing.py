"""Packing of token pieces into sequences of a fixed length: best fit in partitions, then a tree of underfull bins.

(1) Texts are encoded, closed by an end id, and cut into pieces where they are longer than a sequence. (2) Pieces are
sorted by length within the partitions of the scan and dealt in turn to leaves of about ``LEAF`` pieces, so that every
leaf gets the same mix of lengths. (3) A leaf packs its pieces best-fit, longest first. Bins with at most ``SPARE`` of
their length left are done. (4) The others go up a tree as items: a node takes the underfull bins of ``FAN`` children and
packs them best-fit again, until one node is left. After a best fit at most one bin of a node is half full or less, and
two fuller ones never fit together, so a node can merge no more than a bin or so for each child; it passes on the
``MOST`` bins with most room, and the others stay as they are. No piece is ever left out.

A leaf, or a node of at most FAN * MOST bins, is what a task holds. Only bins move between levels, never pieces.

Defined cases: NULL and empty texts are a piece of the end id alone; NULL ids and repeated rows are packed like any
other row; equal lengths go by row; an empty table gives no row. In ``pack`` a NULL size counts as 0, and an item below 0
or longer than a sequence raises ValueError.
Further columns of the documents are ignored, further columns of ``pack``'s items are kept whatever their names.
"""

import math
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe.llm.stages import Scratch, fresh, sized
from strideframe.llm.token_files import Parts

CAPACITY = 4096
LEAF = 50_000
FAN = 32
MOST = 4096
SPARE = 0.01
_ROWS = 4096


@lru_cache(maxsize=1)
def _parts(path: str) -> Parts:
    return Parts(path)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (little-endian unsigned 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, end = _parts(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            kind, names, rows, raws = batch.schema.field(0).type, [], [], []

            def made() -> pa.RecordBatch:
                columns = [pa.array(names, kind), *(pa.array(c, t) for c, t in zip(
                    zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
                if with_ids:
                    columns.append(pa.array(raws, pa.binary()))
                return pa.RecordBatch.from_arrays(columns, names=out.names)

            for doc_id, ids in zip(batch.column(0).to_pylist(), parts.encode(batch.column(1))):
                raw = memoryview(ids.astype("<u4").tobytes() + end)
                for number, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    names.append(doc_id)
                    rows.append((number, at // 4, len(own) // 4, zlib.crc32(own)))
                    if with_ids:
                        raws.append(bytes(own))
                    if len(rows) == _ROWS:
                        yield made()
                        names, rows, raws = [], [], []
            if rows:
                yield made()

    source = docs.select("doc_id", "text")
    ddl = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    out = T.StructType.fromDDL(ddl + (", ids binary" if with_ids else ""))
    return source.mapInArrow(run, out)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin): longest first, each into the fullest bin with room."""
    if len(sizes) and not 0 <= int(sizes.min()) <= int(sizes.max()) <= capacity:
        raise ValueError(f"items of {int(sizes.min())} to {int(sizes.max())} do not fit into {capacity}")
    wanted = sizes.tolist()
    bins, offsets, rooms = [0] * len(wanted), [0] * len(wanted), []
    having: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    present = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = wanted[i]
        enough = present >> size
        if enough:
            room = size + (enough & -enough).bit_length() - 1
            b = having[room].pop()
            if not having[room]:
                present ^= 1 << room
        else:
            room, b = capacity, len(rooms)
            rooms.append(room)
        bins[i], offsets[i] = b, capacity - room
        room -= size
        rooms[b] = room
        if room:
            if not having[room]:
                present |= 1 << room
            having[room].append(b)
    return np.array(bins, np.int64), np.array(offsets, np.int64), capacity - np.array(rooms, np.int64)


def _open(fills: np.ndarray, capacity: int, most: int) -> np.ndarray:
    """Which bins go up the tree: those that are not nearly full, at most ``most``, emptiest first."""
    going = np.flatnonzero(capacity - fills > SPARE * capacity)
    if len(going) > most:
        going = going[np.argsort(fills[going], kind="stable")[:most]]
    out = np.zeros(len(fills), bool)
    out[going] = True
    return out


def _by_group(key: str, fit: Callable[[pa.Table], pa.Table]):
    """Runs ``fit`` on the rows of every value of ``key``, which arrive together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(key).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held and b > a and held[-1].column(key)[0].as_py() != int(keys[a]):
                    yield from fit(pa.Table.from_batches(held)).to_batches(_ROWS)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from fit(pa.Table.from_batches(held)).to_batches(_ROWS)

    return run


def pack(
    items: DataFrame, size: str = "length", capacity: int = CAPACITY, *, leaf: int = LEAF, fan: int = FAN, most: int = MOST
) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset`` (further underscores where they have such columns)."""
    scratch = Scratch(items.sparkSession, "packing")
    row, node = fresh(items, "_row"), fresh(items, "_node")
    bin_id, place, fill = fresh(items, "_bin"), fresh(items, "_place"), fresh(items, "_fill")
    ordered = items.sortWithinPartitions(size).withColumn(row, F.monotonically_increasing_id())
    stored = scratch.keep(ordered, "items")
    leaves = max(1, math.ceil(stored.count() / leaf))

    def fit_leaf(table: pa.Table) -> pa.Table:
        rows = table.column(row).to_numpy()
        bins, offsets, fills = best_fit(table.column(size).fill_null(0).to_numpy().astype(np.int64), capacity)
        first = np.zeros(len(fills), np.int64)
        # A bin is named by the row of its first item; items of a bin come longest first, so that one is at offset 0.
        starts = np.flatnonzero(offsets == 0)[::-1]
        first[bins[starts]] = rows[starts]
        names = first[bins]
        going = (rows == names) & _open(fills, capacity, most)[bins]
        for column, values in ((bin_id, names), (place, offsets)):
            table = table.append_column(column, pa.array(values, pa.int64()))
        return table.append_column(fill, pa.array(fills[bins], pa.int64(), mask=~going))

    dealt = stored.withColumn(node, F.pmod(F.col(row), F.lit(leaves))).repartition(node).sortWithinPartitions(node)
    out = T.StructType([*dealt.schema.fields, *(T.StructField(c, T.LongType()) for c in (bin_id, place, fill))])
    placed = scratch.keep(dealt.mapInArrow(_by_group(node, fit_leaf), out), "leaves")

    def fit_node(table: pa.Table) -> pa.Table:
        own = table.column("bin").to_numpy()
        bins, offsets, fills = best_fit(table.column("fill").to_numpy(), capacity)
        host = np.zeros(len(fills), np.int64)
        starts = np.flatnonzero(offsets == 0)
        host[bins[starts]] = own[starts]
        going = (host[bins] == own) & _open(fills, capacity, most)[bins]
        return pa.table({
            "bin": own, "host": host[bins], "shift": offsets, "node": table.column("node"), "fill": fills[bins], "going": going,
        })

    bins = placed.where(F.col(fill).isNotNull()).select(
        F.col(bin_id).alias("bin"), F.col(fill).alias("fill"), F.col(node).alias("node")
    )
    merges: list[DataFrame] = []
    nodes = leaves
    while nodes > 1:
        nodes = math.ceil(nodes / fan)
        up = bins.withColumn("node", F.floor(F.col("node") / fan)).repartition("node").sortWithinPartitions("node")
        made = up.select("bin", "fill", "node").mapInArrow(
            _by_group("node", fit_node), "bin long, host long, shift long, node long, fill long, going boolean"
        )
        made = scratch.keep(made, f"level-{len(merges)}")
        merges.append(made.where("bin <> host").select("bin", "host", "shift"))
        bins = made.where("going").select("bin", "fill", "node")
    moved = None
    for level in reversed(merges):  # a host may itself have been moved further up
        if moved is not None:
            above = moved.select(F.col("bin").alias("host"), F.col("host").alias("top"), F.col("shift").alias("more"))
            level = level.join(above, "host", "left").select(
                "bin", F.coalesce("top", "host").alias("host"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
            ).unionByName(moved)
        moved = level
    sequence, offset = fresh(items, "sequence_id"), fresh(items, "offset")
    if moved is None:
        return placed.select(*items.columns, F.col(bin_id).alias(sequence), F.col(place).alias(offset))
    host, shift = fresh(placed, "_host"), fresh(placed, "_shift")
    moved = scratch.keep(moved, "moved")
    moved = sized(moved, moved.count()).select(F.col("bin").alias(bin_id), F.col("host").alias(host), F.col("shift").alias(shift))
    return placed.join(moved, bin_id, "left").select(
        *items.columns, F.coalesce(host, bin_id).alias(sequence), (F.col(place) + F.coalesce(shift, F.lit(0))).alias(offset)
    )


def digest(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its checksum and place."""
    return pack(pieces(docs, path, end_id, capacity), "length", capacity)


def sequences(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id, n_tokens, ids`` (array<int>): the packed sequences themselves, each a group of ``capacity`` ids at most."""
    scratch = Scratch(docs.sparkSession, "sequences")
    cut = pieces(docs, path, end_id, capacity, with_ids=True).withColumn("row", F.monotonically_increasing_id())
    cut = scratch.keep(cut, "pieces")
    placed = pack(cut.select("row", "length"), "length", capacity).join(cut.select("row", "ids"), "row")
    whole = placed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "row", "ids"))).alias("parts")
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [b"".join(p["ids"] for p in parts) for parts in batch.column(2).to_pylist()]
            ids = np.frombuffer(b"".join(raws), "<u4").astype(np.int32)
            ends = np.cumsum([0, *(len(r) // 4 for r in raws)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                names=["sequence_id", "n_tokens", "ids"],
            )

    return whole.mapInArrow(joined, "sequence_id long, n_tokens long, ids array<int>")
