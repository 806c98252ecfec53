"""Words that differ by one letter, and the frequent form each of them stands for.

(1) Words and their counts are an aggregate over all documents. (2) Two words at distance one agree in the front half or
in the back half of the shorter one, so a word of m letters goes to four cells: its front and its back half, among words
of m (and m + 1) and among words of m - 1 (and m) letters. A cell too large for one index is divided in the same way:
its words agree in the front or in the back half of what is left between the known ends. This ends with cells whose
words have at most two letters left, as many as the alphabet allows. Cells are counted first, with map-side partial
counts, so large ones are divided before any row of them moves. (3) A task packs cells into batches and searches each
with a bit-sliced index: per position and letter the set of words that have it, as a bitset. All words of a batch are
queries at once. Walking along the letters, three sets per query are carried word-parallel: no error yet (Z), one letter
replaced (S), one letter more in the other word, whose positions are then shifted by one (I):

    S' = S & here | Z & ~here      I' = I & next | Z & here      Z' = Z & here

where ``here`` are the words with the query's letter at this position and ``next`` those that have it one further on.
Both sets start as the query's cell. (4) Links are made distinct (a pair may meet in more than one cell) and grouped; a
form has at least ``TIMES`` the count of its word, so chains are short, and roots follow by pointer doubling.

Defined cases: NULL and empty texts have no words; a row without id keeps all its runs as they are; repeated rows count
each; ties of counts go to the smaller word in code-point order; words of any length are searched whole; an empty table
gives no row; further columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.stages import Scratch, sized

#: A run of letters, and the capitals that stay as they are.
RUN = "[A-Za-zÀ-ÿ]+"
_OTHER_CAPITALS = "[À-Þ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 7
LEAST = 2
TIMES = 10
#: Words of a batch of cells and of one cell, and letters (words times letters between the known ends) of either.
BATCH = 1024
LETTERS = 1 << 21


def words(docs: DataFrame, every: int = 31, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """``word, n``: runs with A-Z lowered, one letter deleted where ``every`` divides the crc32 of ``id:run``."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # Deletion only shortens. Runs hold no letters beyond U+00FF, so lower() changes A-Z alone unless À-Þ occur.
    runs = runs.where(F.length("run") >= shortest).withColumn(
        "run", F.when(F.col("run").rlike(_OTHER_CAPITALS), F.translate("run", _UPPER, _LOWER)).otherwise(F.lower("run"))
    )
    name = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))
    marked = runs.select("run", F.crc32(name.cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run"))
    found = marked.select(word.alias("word")).where(F.length("word") >= shortest)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# ---- cells

_CELL = ["size", "front", "back", "key"]


def _with_cells(rows: DataFrame, choices: Column) -> DataFrame:
    """``word, n`` in the cells of ``choices``: an array of structs (size, front, back)."""
    at = rows.select("word", "n", F.explode(choices).alias("c"))
    key = F.concat(F.substring("word", F.lit(1), F.col("c.front")), F.expr("right(word, c.back)"))
    return at.select("word", "n", "c.size", "c.front", "c.back", key.alias("key"))


def _choice(size: Column, front: Column, back: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), front.cast("int").alias("front"), back.cast("int").alias("back"))


def cells(vocabulary: DataFrame, scratch: Scratch, batch: int = BATCH, letters: int = LETTERS) -> DataFrame:
    """``word, n, size, front, back, key``: words that agree in the first ``front`` and last ``back`` letters, of
    ``size`` or ``size + 1`` letters, in cells that fit an index."""
    m = F.length("word")
    halves = []
    for size in (m, m - 1):
        half = F.floor(size / 2)
        halves += [_choice(size, half, F.lit(0)), _choice(size, F.lit(0), size - half)]
    # The smallest words have no shorter partner to meet; their second pair of cells is empty but for themselves.
    shortest = vocabulary.agg(F.min(m)).first()[0]
    usable = F.filter(F.array(*halves), lambda c: c["size"] >= F.lit(shortest or 0))
    rows, done = _with_cells(vocabulary, usable), []
    between = F.col("size") - F.col("front") - F.col("back")
    for level in range(64):
        counts = rows.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("words"))
        large = counts.where((between >= 2) & ((F.col("words") > batch) | (F.col("words") * (between + 1) > letters)))
        large = scratch.keep(large.select(*_CELL), f"large-{level}")
        n = large.count()
        if not n:
            break
        hint = sized(large, n)  # at most one for ``batch`` rows
        done.append(rows.join(hint, _CELL, "left_anti"))
        half = F.floor(between / 2)
        nearer = F.array(
            _choice(F.col("size"), F.col("front") + half, F.col("back")),
            _choice(F.col("size"), F.col("front"), F.col("back") + between - half),
        )
        again = rows.join(hint, _CELL, "left_semi").select("word", "n", nearer.alias("c"))
        rows = scratch.keep(_with_cells(again, F.col("c")), f"divided-{level}")
    for part in done:
        rows = rows.unionByName(part)
    return rows.select("word", "n", *_CELL)


# ---- the index


def _sets(codes: np.ndarray, kinds: int, blocks: int) -> np.ndarray:
    """For every code the bitset of the places that have it."""
    flags = np.zeros((kinds, blocks * 64), bool)
    flags[codes, np.arange(len(codes))] = True
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def near(letters: np.ndarray, longer: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): places of words at distance one inside a cell, ``a`` never the longer one; pairs of one length come in
    both orders.

    ``letters``: one row per word, what is between the known ends, 0 behind the end; the last column is used by words
    that are ``longer`` by one letter only. ``cell``: number of the word's cell, from 0.
    """
    blocks = -(-len(cell) // 64)
    asked = np.flatnonzero(~longer)
    z = _sets(cell, int(cell.max()) + 1, blocks)[cell[asked]]
    inserted, replaced = z.copy(), np.zeros_like(z)
    columns = [np.unique(letters[:, i], return_inverse=True) for i in range(letters.shape[1])]
    sets = [_sets(codes, len(values), blocks) for values, codes in columns]
    for i in range(letters.shape[1] - 1):
        wanted = letters[asked, i]
        here = sets[i][columns[i][1][asked]]
        values = columns[i + 1][0]
        at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
        shifted = sets[i + 1][at]
        shifted[values[at] != wanted] = 0
        same = z & here
        replaced = (replaced & here) | (z & ~here)
        inserted = (inserted & shifted) | same
        z = same
    long = _sets(longer.astype(np.int64), 2, blocks)
    hits = (replaced & long[0]) | (inserted & long[1])
    row, block = np.nonzero(hits)
    bits = np.unpackbits(hits[row, block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, bit = np.nonzero(bits)
    return asked[row[which]], block[which] * 64 + bit


def _linked(batch_words: int, batch_letters: int):
    """Links of every cell, both ways, from rows that arrive cell by cell."""

    def search(rows: list[tuple[str, int]], numbers: list[int], shape: tuple[int, int, int]) -> pa.RecordBatch:
        size, front, back = shape
        width = size - front - back + 1
        middles = [w[front : len(w) - back].ljust(width, "\0") for w, _ in rows]
        letters = np.frombuffer("".join(middles).encode("utf-32-le"), "<u4").reshape(len(rows), width)
        longer = np.array([len(w) > size for w, _ in rows])
        a, b = near(letters, longer, np.array(numbers))
        one_way = longer[b]
        left, right = np.r_[a, b[one_way]].tolist(), np.r_[b, a[one_way]].tolist()
        names, counts = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in left], pa.string()), pa.array([names[i] for i in right], pa.string()),
             pa.array([counts[i] for i in right], pa.int64())], names=["word", "near", "near_n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []  # whole cells of one shape
        numbers: list[int] = []
        shape: tuple[int, int, int] | None = None
        cell: list[tuple[str, int]] = []
        key: tuple | None = None

        def close() -> Iterator[pa.RecordBatch]:
            """Put the finished cell to those held; search them first if they would be too many."""
            nonlocal held, numbers, shape
            if len(cell) < 2 or all(len(w) > key[0] for w, _ in cell):
                return
            width = key[0] - key[1] - key[2] + 1
            together = len(held) + len(cell)
            if held and (shape != key[:3] or together > batch_words or together * width > batch_letters):
                yield search(held, numbers, shape)
                held, numbers = [], []
            shape = key[:3]
            numbers += [numbers[-1] + 1 if numbers else 0] * len(cell)
            held += cell

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for word, n, *own in zip(*columns):
                own = tuple(own)
                if own != key:
                    if key is not None:
                        yield from close()
                    key, cell = own, []
                cell.append((word, n))
        if key is not None:
            yield from close()
        if held:
            yield search(held, numbers, shape)

    return run


def links(vocabulary: DataFrame, scratch: Scratch, batch: int = BATCH, letters: int = LETTERS) -> DataFrame:
    """``word, near, near_n``: all pairs of words at distance one, in both directions."""
    dealt = cells(vocabulary, scratch, batch, letters).repartition(*_CELL).sortWithinPartitions(*_CELL)
    found = dealt.mapInArrow(_linked(batch, letters), "word string, near string, near_n long")
    return found.distinct()


def group(vocabulary: DataFrame, times: int = TIMES, *, batch: int = BATCH, letters: int = LETTERS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table ``word, n`` of distinct words."""
    if times < 2:
        raise ValueError("a form must be more frequent than its word")
    scratch = Scratch(vocabulary.sparkSession, "spellings")
    vocabulary = scratch.keep(vocabulary.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    joined = links(vocabulary, scratch, batch, letters).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    strong = -F.col("best.less") >= F.col("n") * times
    formed = scratch.keep(vocabulary.join(joined, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    ), "forms")
    roots, step = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    while True:  # each round doubles the steps followed; a step multiplies the count by ``times``
        step += 1
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        followed = roots.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        followed = scratch.keep(followed, f"roots-{step}")
        roots = followed.select("word", "root")
        if followed.where("moved").isEmpty():
            break
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def digest(docs: DataFrame) -> DataFrame:
    return group(words(docs))
