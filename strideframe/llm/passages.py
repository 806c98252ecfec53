"""Substring dedup by level-wise doubling: word windows repeated at half the length are extended to the full length.

A window of ``size`` words holds ``size / 2 + 1`` windows of half that length; the one with the smallest hash (leftmost
of equals) stands for it, so equal windows are stood for by equal halves at equal offsets, and only about one position
in six is kept. Level one counts these halves over the corpus. Only those that occur at least twice go on: full windows
around them are hashed, and at level two the first occurrence of each is found (smaller document id, then earlier row,
then earlier start). The words under all later occurrences are removed. Texts are read three times, at levels two and
after it only those with surviving windows; what is shuffled is hashes and places.

Documents with the same words are one class: its first document takes part, the others lose every word if they have
``size`` words or more.

Hashes have 64 bits. Defined cases: NULL and empty texts have no words; NULL ids count as smallest; rows with equal ids
are ordered by row; a document shorter than ``size`` loses nothing; an empty table gives no rows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm import words as W
from strideframe.llm.stages import Scratch, sized

SIZE = 20


def _standing(hashes: np.ndarray, half: int, size: int) -> np.ndarray:
    """For every window start, the place of the half window that stands for it."""
    halves = W.window_hashes(hashes, half)
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.int64)
    for lo in range(0, max(n, 0), 1 << 18):
        part = halves[lo : min(lo + (1 << 18), n) + size - half]
        out[lo : lo + len(part) - size + half] = sliding_window_view(part, size - half + 1).argmin(1) + np.arange(
            lo, lo + len(part) - size + half
        )
    return out


def joined(slab: W.WordSlab, offsets: np.ndarray, d: int) -> bytes:
    """The words of document ``d``, joined by one space."""
    lo, hi = int(slab.first[d]), int(slab.first[d + 1])
    if lo == hi:
        return b""
    a, b = int(slab.starts[lo]), int(slab.ends[hi - 1])
    raw = slab.data[a:b].copy()
    keep = W.SPACED[raw]
    gaps = slab.ends[lo : hi - 1] - a
    raw[gaps] = 0x20
    keep[gaps] = True
    return raw[keep].tobytes()


def _first_level(size: int):
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.slabs(batch.column(1), 1 << 20):
                slab = W.WordSlab(data, offsets, W.SPACED, W.SAME)
                halves = W.window_hashes(slab.hashes, half).view(np.int64)
                counts, shas, hashes, places = np.diff(slab.first), [], [], []
                for d in range(slab.docs()):
                    lo, hi = int(slab.first[d]), int(slab.first[d + 1])
                    shas.append(hashlib.sha256(joined(slab, offsets, d)).hexdigest())
                    at = np.unique(_standing(slab.hashes[lo:hi], half, size)) if hi - lo >= size else np.zeros(0, np.int64)
                    places.append(at.astype(np.int32))
                    hashes.append(halves[lo + at])
                sizes = np.cumsum([0, *map(len, places)])
                ends = pa.array(sizes, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first),
                     pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(hashes))),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places)))],
                    names=["doc_id", "key", "n_words", "sha", "hashes", "places"],
                )

    return run


def _full_windows(size: int):
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1)
            for first, _, data, offsets in W.slabs(batch.column(2), 1 << 20):
                slab = W.WordSlab(data, offsets, W.SPACED, W.SAME)
                for d in range(slab.docs()):
                    own = slab.hashes[slab.first[d] : slab.first[d + 1]]
                    survivors = batch.column(3)[first + d].values.to_numpy()
                    starts = np.flatnonzero(np.isin(_standing(own, half, size), survivors))
                    if len(starts):
                        made = W.window_hashes(own, size)[starts].view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(made), pa.array(np.full(len(starts), rows[first + d])),
                             ids.take(pa.array(np.full(len(starts), first + d))), pa.array(starts.astype(np.int32))],
                            names=["hash", "row", "doc_id", "start"],
                        )

    return run


def _kept(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, texts = [], [], []
            for first, _, data, offsets in W.slabs(batch.column(1), 1 << 20):
                slab = W.WordSlab(data, offsets, W.SPACED, W.SAME)
                for d in range(slab.docs()):
                    lo, hi = int(slab.first[d]), int(slab.first[d + 1])
                    starts = batch.column(2)[first + d].values.to_numpy()
                    steps = np.bincount(starts, minlength=hi - lo + 1) - np.bincount(starts + size, minlength=hi - lo + 1)
                    covered = np.cumsum(steps)[: hi - lo] > 0
                    kept = b" ".join(w for w, gone in zip(slab.words(lo, hi), covered.tolist()) if not gone)
                    removed.append(int(covered.sum()))
                    shas.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                names=["row", "n_removed", "kept_sha256", "kept_text"],
            )

    return run


def without_repeats(docs: DataFrame, size: int = SIZE, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, changed): ``row, doc_id, key, n_words, n_removed, kept_sha256`` of every document, and ``row,
    kept_text`` of those that keep some words but not all. ``key`` is xxhash64 of the text."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "passages")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    base = scratch.keep(
        source.mapInArrow(
            _first_level(size),
            f"doc_id {kind}, key long, n_words long, sha string, hashes array<long>, places array<int>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "documents",
    )
    firsts = scratch.keep(
        base.groupBy("sha").agg(F.min(F.struct("doc_id", "row")).alias("f")).select("sha", F.col("f.row").alias("row")), "firsts"
    )
    ours = base.join(firsts.select("row"), "row", "left_semi")
    halves = ours.select("row", F.explode(F.arrays_zip("hashes", "places")).alias("p"))
    halves = scratch.keep(halves.select("row", F.col("p.hashes").alias("hash"), F.col("p.places").alias("place")), "halves")
    repeated = scratch.keep(halves.groupBy("hash").count().where("count > 1").select("hash"), "repeated")
    survivors = halves.join(repeated, "hash").groupBy("row").agg(F.collect_list("place").alias("places"))
    survivors = scratch.keep(survivors.join(base.select("row", "doc_id", "key"), "row"), "survivors")
    scratch.drop("halves", "repeated")
    windows = scratch.keep(
        _texts(source, survivors, "places").mapInArrow(_full_windows(size), f"hash long, row long, doc_id {kind}, start int"), "windows"
    )
    scratch.drop("survivors")
    place = F.struct("doc_id", "row", "start")
    first = windows.groupBy("hash").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = scratch.keep(first.select("hash", "f.row", "f.start"), "first").withColumnsRenamed({"row": "r", "start": "s"})
    later = windows.join(first, "hash").where("row <> r OR start <> s").groupBy("row").agg(F.collect_list("start").alias("starts"))
    later = scratch.keep(later.join(base.select("row", "doc_id", "key"), "row"), "later")
    scratch.drop("windows", "first")
    changed = _texts(source, later, "starts").select("row", "text", "starts").dropDuplicates(["row"])
    changed = scratch.keep(
        changed.mapInArrow(_kept(size), "row long, n_removed long, kept_sha256 string, kept_text string"), "changed"
    )
    first_row = firsts.select("row", F.lit(True).alias("is_first"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    copy = F.col("is_first").isNull() & (F.col("n_words") >= size)
    everyone = (
        base.select("row", "doc_id", "key", "n_words", "sha").join(first_row, "row", "left")
        .join(changed.drop("kept_text"), "row", "left")
        .select(
            "row", "doc_id", "key", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )
    )
    return everyone, changed.select("row", "kept_text")


def _texts(source: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``row, doc_id, text`` and ``column`` of the wanted documents. Other texts are dropped before the shuffle."""
    n = wanted.count()
    keys = wanted.select("key").distinct()
    some = source.join(sized(keys, n), "key", "left_semi") if n else source.where("false")
    w = wanted.select("row", F.col("doc_id").alias("d"), F.col("key").alias("k"), column)
    return some.join(w, F.col("key").eqNullSafe(F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select(
        "row", "doc_id", "text", column
    )


def digest(docs: DataFrame) -> DataFrame:
    everyone, _ = without_repeats(docs)
    return everyone.select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same in SQL: every window of 20 words, grouped.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
x AS (SELECT r, doc_id, i, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
l AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, r, i) AS k FROM x) WHERE k > 1),
g AS (SELECT DISTINCT r, unnest(generate_series(i, i + 19)) AS p FROM l),
t AS (SELECT r, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
k AS (SELECT t.r, string_agg(word, ' ' ORDER BY t.p) AS kept FROM t LEFT JOIN g ON t.r = g.r AND t.p = g.p WHERE g.p IS NULL GROUP BY t.r),
n AS (SELECT r, count(*) AS c FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN n USING (r)
"""
