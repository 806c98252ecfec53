"""Language identification by word-first backoff.

A known word counts by its log frequency in each language. An unseen word counts by its character n-grams: the
longest length of which some n-gram is known, shorter lengths only if none is. A language that lacks a word or n-gram
gets one floor, common to all languages: a fixed penalty below the rarest entry of the largest one. The score is the share of the best language when the mean word value,
times at most ``EVIDENCE`` words, is taken as a log likelihood.

The model is fitted on a bounded sample of labelled documents (about ``MOST_DOCS`` of each language, drawn row by
row, whole texts and whole words). Its tables hold the most frequent ``WORDS`` words, and ``GRAMS`` n-grams per length, of
each language; an entry of any language's share has its frequency in all. Only frequencies above 0 are stored, so the
model grows with the sum over languages. Every document is predicted, from its whole text.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0; NULL languages and ids teach nothing, nor do
texts without a letter, and a language without any counted word or n-gram is not in the model;
without any labelled document every text is ``und``; ties go to the language that sorts first.
"""

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.stages import drawn, fold, fresh, sized, with_column

MOST_DOCS = 1000
WORDS = 60_000
GRAMS = 30_000
LONGEST = 5
PENALTY = 1.0
EVIDENCE = 12
UNKNOWN = "und"
_SCALE = math.log(10)
_WORD = re.compile(r"[^\W\d_]+")
_LETTER = r"\p{L}"
_CHARS = 1 << 20


def _counted(text: str, counts: Counter) -> None:
    """Count the lower-cased words; a long text is taken in parts that end at white space, or else anywhere."""
    at = 0
    while at < len(text):
        end = min(at + _CHARS, len(text))
        if end < len(text):
            gap = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = gap + 1 if gap > at else end
        counts.update(_WORD.findall(text[at:end].lower()))
        at = end


def _rows(made: dict[tuple[str, int], Counter]) -> Iterator[pa.RecordBatch]:
    for (lang, n), counts in made.items():
        size = len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * size, pa.string()), pa.array([n] * size, pa.int32()),
             pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["lang", "n", "entry", "k"],
        )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the words of each language, summed within the task."""
    made: dict[tuple[str, int], Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            _counted(text.as_py() or "", made.setdefault((lang.as_py(), 0), Counter()))
            if sum(map(len, made.values())) > 300_000:
                yield from _rows(made)
                made = {}
    yield from _rows(made)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each language in which an n-gram occurs: each distinct word counts once per place, being a type."""
    for batch in batches:
        made: dict[tuple[str, int], Counter] = {}
        waiting = 0
        for lang, word in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            padded = f" {word} "
            for n in range(1, LONGEST + 1):
                made.setdefault((lang, n), Counter()).update(padded[i : i + n] for i in range(len(padded) - n + 1))
            del made[lang, 1][" "]
            waiting += LONGEST * len(padded)
            if waiting > 1_000_000:
                yield from _rows(made)
                made, waiting = {}, 0
        yield from _rows(made)


def _hashes(entries: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, entries), np.uint64, len(entries))


class Table:
    """Known entries of one length in the order of their hashes, with the languages that have each and its counts there."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, owners: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys, kind="stable")
        starts = np.cumsum(sizes) - sizes
        self.keys, self.sizes = keys[order], sizes[order]
        at = np.repeat(starts[order] - np.cumsum(self.sizes) + self.sizes, self.sizes) + np.arange(len(owners))
        self.owners, self.counts = owners[at], counts[at]


class Model:
    """Per length (0: whole words) the known entries and, per entry, how far its log10 frequency in each language that
    has it lies above the floor of the table. Entries are sorted 64-bit hashes, so the model is a few plain arrays."""

    def __init__(self, languages: list[str], tables: list[Table], totals: list[np.ndarray]):
        some = np.flatnonzero(np.sum(totals, axis=0) > 0)
        self.languages = [languages[i] for i in some]
        place = np.zeros(len(languages), np.int32)
        place[some] = np.arange(len(some), dtype=np.int32)
        self.keys = [t.keys for t in tables]
        self.base = np.cumsum([0, *(len(t.keys) for t in tables)])
        values = []
        for table, total in zip(tables, totals):
            known = np.maximum(total, 1.0)
            floor = -np.log10(known.max(initial=1.0)) - PENALTY
            values.append(np.log10(table.counts / known[table.owners]) - floor)
        #: Values of row r: ``values[first[r] : first[r + 1]]``, of the languages ``owners`` in the same places.
        self.first = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(t.sizes for t in tables)]))
        self.owners = np.concatenate([np.zeros(0, np.int32), *(place[t.owners] for t in tables)]).astype(np.int32)
        self.values = np.concatenate([np.zeros(0), *values])

    def rows(self, n: int, entries: list[str]) -> np.ndarray:
        """Row of every entry of length ``n`` (0: word), -1 if it is unknown."""
        keys, wanted = self.keys[n], _hashes(entries)
        if not len(keys):
            return np.full(len(entries), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at + self.base[n], -1)

    def sums(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Per language, the values of the rows, each as often as it occurs."""
        sizes = self.first[at + 1] - self.first[at]
        where = np.repeat(self.first[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.bincount(self.owners[where], self.values[where] * np.repeat(n, sizes), len(self.languages))

    def unseen(self, words: list[str], times: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], float]:
        """(rows, weights) of the n-grams that stand for words outside the table of words, and how many words have any.

        All words are tried at one length; those of which no n-gram is known go on to the next shorter one."""
        found, weights, covered = [], [], 0.0
        padded = [f" {w} " for w in words]
        for n in range(LONGEST, 0, -1):
            if not padded:
                break
            sizes = np.array([max(0, len(p) - n + 1) for p in padded])
            rows = self.rows(n, [p[i : i + n] for p in padded for i in range(len(p) - n + 1)])
            owner = np.repeat(np.arange(len(padded)), sizes)
            known = rows >= 0
            hits = np.bincount(owner[known], minlength=len(padded))
            found.append(rows[known])
            weights.append((times / np.maximum(hits, 1))[owner[known]])
            covered += float(times[hits > 0].sum())
            left = np.flatnonzero(hits == 0)
            padded, times = [padded[i] for i in left.tolist()], times[left]
        return found, weights, covered

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        counts: Counter = Counter()
        _counted(text, counts)
        words, times = list(counts), np.fromiter(counts.values(), float, len(counts))
        rows = self.rows(0, words)
        seen = rows >= 0
        some, weights, n = [rows[seen]], [times[seen]], float(times[seen].sum())
        if not seen.all():
            more, shares, covered = self.unseen([words[i] for i in np.flatnonzero(~seen).tolist()], times[~seen])
            some, weights, n = some + more, weights + shares, n + covered
        if n == 0:  # letters, but none of which any language has a trace
            return self.languages[0], 1.0 / len(self.languages)
        mean = self.sums(np.concatenate(some), np.concatenate(weights)) / n * (_SCALE * min(n, EVIDENCE))
        share = np.exp(mean - mean.max())
        best = int(np.argmax(mean))
        return self.languages[best], float(share[best] / share.sum())


def _bound(n: int) -> int:
    return WORDS if n == 0 else GRAMS


def _within_bounds(whole: DataFrame, each: DataFrame, large: list[tuple[int, str]]) -> DataFrame:
    """Entries among the most frequent of some language. ``large`` are the lengths and languages with more than those."""
    if not large:
        return whole
    big = each.sparkSession.createDataFrame(large, "n int, lang string")
    ranked = each.join(sized(big, len(large)), ["n", "lang"]).withColumn(
        "rank", F.row_number().over(Window.partitionBy("n", "lang").orderBy(F.desc("k"), "entry"))
    )
    top = ranked.where(F.col("rank") <= F.when(F.col("n") == 0, WORDS).otherwise(GRAMS)).select("n", "entry")
    small = each.join(sized(big, len(large)), ["n", "lang"], "left_anti").select("n", "entry")
    return whole.join(top.unionByName(small).distinct(), ["n", "entry"], "left_semi")


def fit(docs: DataFrame, usable: Column, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Count words and n-grams of the languages in a bounded sample of the ``usable`` labelled documents."""
    labelled = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(_LETTER)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    counted = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).collect()
    languages = sorted(r["lang"] for r in counted)
    if not languages:
        return Model([], [], [np.zeros(0)])
    shares = docs.sparkSession.createDataFrame(
        [(r["lang"], min(1.0, MOST_DOCS / r["docs"])) for r in counted], "lang string, share double"
    )
    # A language with ``MOST_DOCS`` documents or fewer has share 1, which takes every row.
    sample = drawn(labelled.join(sized(shares, len(counted)), "lang"), F.col("share"), 31)

    kinds = "lang string, n int, entry string, k long"
    words = sample.select("lang", "text").mapInArrow(_word_counts, kinds)
    words = words.groupBy("lang", "n", "entry").agg(F.sum("k").alias("k")).persist()
    parts = words.mapInArrow(_gram_counts, kinds).groupBy("lang", "n", "entry").agg(F.sum("k").alias("k"))
    per = words.unionByName(parts)
    whole = per.groupBy("n", "entry").agg(
        F.sum("k").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "k"))).alias("by")
    ).where("all > 1 OR n > 0")
    totals = [np.zeros(len(languages)) for _ in range(LONGEST + 1)]
    place = {lang: i for i, lang in enumerate(languages)}
    whole = whole.persist()
    each = whole.select("n", "entry", F.explode("by").alias("lang", "k"))
    large = []
    for r in each.groupBy("n", "lang").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("entries")).collect():
        totals[r["n"]][place[r["lang"]]] = r["k"]
        if r["entries"] > _bound(r["n"]):
            large.append((r["n"], r["lang"]))
    parts = [tuple(array(code) for code in "Qqiq") for _ in range(LONGEST + 1)]  # hash, languages, their places and counts
    for r in _within_bounds(whole, each, large).select("n", "entry", "by").toLocalIterator():
        keys, sizes, owners, counts = parts[r["n"]]
        keys.append(xxhash.xxh3_64_intdigest(r["entry"]))
        sizes.append(len(r["by"]))
        owners.extend(place[lang] for lang in r["by"])
        counts.extend(r["by"].values())
    whole.unpersist()
    words.unpersist()
    kinds = (np.uint64, np.int64, np.int32, np.int64)
    return Model(languages, [Table(*(np.array(a, k) for a, k in zip(p, kinds))) for p in parts], totals)


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a new struct column (its name is returned): ``lang`` and ``score``."""
    name = fresh(docs, "language")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            rows = pa.array([{"lang": a, "score": b} for a, b in made], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, with_column(docs, name, "struct<lang: string, score: double>")), name


def learnable(id_col: str = "doc_id") -> Column:
    return F.coalesce(fold(id_col) != 0, F.lit(False))


def identified(docs: DataFrame, least_score: float = 0.35) -> DataFrame:
    """``docs`` without those that have no letter or whose language stays open (score below ``least_score``).

    If no language could be learnt, no language is decided: all documents that hold a letter are kept."""
    model = fit(docs, F.col("doc_id").isNotNull())
    if not model.languages:
        return docs.where(F.col("text").rlike(_LETTER))
    found, name = predict(docs, model)
    language = F.col(name)
    return found.where((language["lang"] != UNKNOWN) & (language["score"] >= least_score)).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: whether it was held out from learning, the predicted language and its score."""
    model = fit(docs, learnable())
    found, name = predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"),
        F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"),
    )
