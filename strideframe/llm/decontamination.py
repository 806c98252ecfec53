"""Benchmark decontamination: a broadcast hash set of test n-grams, a scan of token windows, verified hits.

Words are runs of letters and digits after lower-casing A-Z. A window is ``size`` consecutive words of a benchmark
item; an item with fewer words (but not none) is one window. The windows of a block of items go to the executors as a
sorted hash array behind a bit map; a document is hashed once, every window of the lengths in use is looked up, and a
hit counts only if its words equal the benchmark's.

Defined cases: NULL texts have no words; benchmark rows with a NULL id or text give no windows; repeated item ids are
one item; repeated documents give one row each; an empty benchmark leaves every document clean.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm import words as W
from strideframe.llm.stages import fresh, with_column

SIZE = 10
#: Most words of benchmark items in one broadcast; a larger benchmark is scanned in several blocks.
BLOCK_WORDS = 2_000_000
_BITS = 22
_HITS = "n_words: long, words: array<long>, items: array<string>, spans: array<struct<start: long, end: long>>"


class WindowSet:
    """Distinct windows of some items, for look-up by hash; ``owners`` are item numbers per window."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size = size
        found: dict[tuple[bytes, ...], tuple[int, set[str]]] = {}
        self.lengths: set[int] = set()
        column = pa.array([t for _, t in items], pa.string())
        for first, _, data, offsets in W.slabs(column):
            slab = W.WordSlab(data, offsets, W.ALNUM, W.LOWER)
            for d in range(slab.docs()):
                lo, hi = int(slab.first[d]), int(slab.first[d + 1])
                k = min(size, hi - lo)
                if k == 0:
                    continue
                self.lengths.add(k)
                text = slab.words(lo, hi)
                for i, h in enumerate(W.window_hashes(slab.hashes[lo:hi], k).tolist()):
                    found.setdefault(tuple(text[i : i + k]), (h, set()))[1].add(items[first + d][0])
        order = sorted(found, key=lambda w: found[w][0])
        self.hashes = np.array([found[w][0] for w in order], W.U64)
        self.windows = [b" ".join(w) for w in order]
        self.owners = [sorted(found[w][1]) for w in order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self.hashes >> W.U64(64 - _BITS)] = True

    def hits(self, slab: W.WordSlab) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, length, items) of verified occurrences."""
        for k in sorted(self.lengths):
            at, h = slab.windows(k)
            maybe = np.flatnonzero(self.seen[h >> W.U64(64 - _BITS)])
            at, h = at[maybe], h[maybe]
            left, right = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            for i in np.flatnonzero(left < right).tolist():
                w = b" ".join(slab.words(int(at[i]), int(at[i]) + k))
                for j in range(int(left[i]), int(right[i])):
                    if self.windows[j] == w:
                        yield int(at[i]), k, self.owners[j]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items as text, streamed to the driver in blocks of a bounded number of words."""
    items, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in rows.where("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        n = len(row["t"]) // 2 + 1  # at most so many words
        if items and size + n > limit:
            yield items
            items, size = [], 0
        items.append((row["i"], row["t"]))
        size += n
    yield items


def hit_words(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, str]:
    """Every document with a new struct column (its name is returned): ``n_words``, ``words`` (positions of the words
    inside occurring windows, ascending), ``spans`` (byte ranges of runs of them) and ``items`` (sorted ids)."""
    name = fresh(docs, "hits")
    out, columns = docs, docs.columns
    blocks = _blocks(benchmark, item_col, item_text_col, block_words)
    for number, items in enumerate(blocks):
        out = _scanned(out, columns, name, text_col, WindowSet(items, size), number > 0)
    return out, name


def _scanned(docs: DataFrame, columns: list[str], name: str, text_col: str, windows: WindowSet, more: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    hits = pa.struct([
        ("n_words", pa.int64()), ("words", pa.list_(pa.int64())), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])
    schema = with_column(docs.select(columns), name, f"struct<{_HITS}>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            before = batch.column(batch.num_columns - 1) if more else None
            kept = [batch.column(i) for i in range(len(columns))]
            text = kept[columns.index(text_col)]
            rows = []
            for first, _, data, offsets in W.slabs(text):
                slab = W.WordSlab(data, offsets, W.ALNUM, W.LOWER)
                words: dict[int, set[int]] = {}
                items: dict[int, set[str]] = {}
                for at, k, owners in found.hits(slab):
                    d = int(np.searchsorted(slab.first, at, "right")) - 1
                    words.setdefault(d, set()).update(range(at, at + k))
                    items.setdefault(d, set()).update(owners)
                for d in range(slab.docs()):
                    base = int(slab.first[d])
                    mine, ids = {w - base for w in words.get(d, ())}, items.get(d, set())
                    if more:
                        old = before[first + d].as_py()
                        mine, ids = mine | set(old["words"]), ids | set(old["items"])
                    at = sorted(mine)
                    spans = []
                    for i, w in enumerate(at):
                        s, e = (int(x) - int(offsets[d]) for x in (slab.starts[base + w], slab.ends[base + w]))
                        if i and at[i - 1] == w - 1:
                            spans[-1]["end"] = e
                        else:
                            spans.append({"start": s, "end": e})
                    n = int(slab.first[d + 1]) - base
                    rows.append({"n_words": n, "words": at, "items": sorted(ids), "spans": spans})
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, hits)], names=[*columns, name])

    return docs.mapInArrow(scan, schema)


def drop_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs."""
    found, name = hit_words(docs, benchmark, **options)
    return found.where(F.size(F.col(name)["words"]) == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the occurring windows cut out of the texts (everything from the first to the last word of a run)."""
    found, name = hit_words(docs, benchmark, text_col=text_col, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            texts = batch.column(i).to_pylist()
            for r, hits in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if hits["spans"]:
                    raw, at, parts = texts[r].encode(), 0, []
                    for s in hits["spans"]:
                        parts.append(raw[at : s["start"]])
                        at = s["end"]
                    texts[r] = b"".join([*parts, raw[at:]]).decode()
            kept = [pa.array(texts, batch.column(i).type) if k == i else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(kept, names=batch.schema.names[:-1])

    return found.mapInArrow(cut, docs.schema)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts of words, hit words and items, and the hash of the item list."""
    found, name = hit_words(docs.select("doc_id", "text"), benchmark)
    hits = F.col(name)
    return found.select(
        "doc_id", hits["n_words"].alias("n_words"), F.size(hits["words"]).cast("long").alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", hits["items"]).cast("binary"), 256).alias("items_sha256"),
        (F.size(hits["words"]) > 0).alias("contaminated"),
    )


#: The same in SQL: windows joined on their word lists.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, list_slice(w, i, i + least(10, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, k, i, list_slice(w, i, i + k - 1) AS g FROM
  (SELECT r, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
   FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
h AS (SELECT r, i, bw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY r),
m AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
