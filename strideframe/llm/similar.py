"""Exact Jaccard join of word-shingle sets, with skipping by set relations.

The classes of equal sets are joined, not the documents. A set's shingles are ordered rare first; two sets can only link
if their prefixes in that order meet. Two relations between sets save work:

* Answer level. Every list has a pivot: the set with the fewest shingles of its own, which in a group of edited copies
  is the text that they were made from, or close to it. Each member is first verified against the pivots of its lists.
  Members linked to a pivot are connected and are not compared with each other; a pivot all of whose members are linked
  is done. The others are compared with the members of the same pivot, and their common elements with a set that is
  highly similar to the pivot are derived from their common elements with the pivot and the few differences.
* Index level. In these comparisons the list of a shingle is ordered by set size and cut into blocks that know the most
  elements any of their sets has from the shingle on. A probe skips sizes that cannot reach the threshold, whole blocks
  whose best place leaves too few common elements, and then single entries.

Document frequencies are counted over all sets, but only for shingles in the lower part of the hash space, a share that
shrinks with set size (bands of sizes overlap, so two sets that may link share a band). A set goes on if enough of those
shingles occur elsewhere. Shingles hold 64-bit hashes. The members of a pivot are cut
into chunks of bounded size, and pairs of chunks are compared; no group is collected.

Defined cases: documents without words link with nothing and are their own component; NULL ids count as largest when a
component is named, so that it gets the smallest id there is; rows with equal ids keep their own row; fewer words than a
shingle are one shingle.
"""

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm import words as W
from strideframe.llm.components import components
from strideframe.llm.stages import Scratch, fresh, sized

SIZE = 5
#: (sets above this size, share of the hash space that is counted). A band ends at 4/3 of the next one's start.
BANDS = ((0, 1.0), (60, 0.56), (180, 0.38))
#: Elements of the sets of one chunk of a pivot's members; a task holds two chunks.
CELL = 400_000
_BLOCK = 64


def sets(slab: W.WordSlab, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every document of a slab."""
    for d in range(slab.docs()):
        own = slab.hashes[slab.first[d] : slab.first[d + 1]]
        k = min(size, len(own))
        yield np.unique(W.window_hashes(own, k)) if k else np.zeros(0, W.U64)


def least_common(n: int) -> int:
    """Elements of a set of ``n`` that a linked set must share: 3/4, rounded up."""
    return -(-3 * n // 4)


def _signed(sets_: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, sets_)])
    flat = np.concatenate(sets_) if sets_ else np.zeros(0, W.U64)
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat.view(np.int64)))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.slabs(batch.column(1), 1 << 20):
                slab = W.WordSlab(data, offsets, W.SPACED, W.LOWER)
                ns, one, two = [], [], []
                parts: list[list[np.ndarray]] = [[] for _ in range(2 * len(BANDS))]
                for u in sets(slab, size):
                    n = len(u)
                    ns.append(n)
                    with np.errstate(over="ignore"):
                        one.append(int(np.bitwise_xor.reduce(W.mix(u), initial=W.U64(0)).view(np.int64)))
                        two.append(int(W.mix(u + W.U64(0x5851F42D4C957F2D)).sum(dtype=W.U64).view(np.int64)))
                    for b, (above, share) in enumerate(BANDS):
                        upto = BANDS[b + 1][0] * 4 / 3 if b + 1 < len(BANDS) else math.inf
                        inside = n > above and n <= upto
                        k = n if share == 1.0 else int(np.searchsorted(u, W.U64(int(share * 2**64))))
                        parts[2 * b].append(u[:k] if inside else u[:0])
                        # A set with too few shingles in the counted part goes on with the next ones.
                        parts[2 * b + 1].append(u[k : max(k, n - least_common(n) + 1)] if inside else u[:0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first),
                     pa.array(ns, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), *map(_signed, parts)],
                    names=["doc_id", "key", "n", "one", "two", *(f"{x}{b}" for b in range(len(BANDS)) for x in "lm")],
                )

    return run


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in W.slabs(batch.column(1), 1 << 20):
                made = [u.tobytes() for u in sets(W.WordSlab(data, offsets, W.SPACED, W.LOWER), size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(made, pa.binary())], names=["row", "elements"]
                )

    return run


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, left, right = [], [], []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), W.U64), np.frombuffer(y.as_buffer(), W.U64)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            common.append(int((b[at] == a).sum()))
            left.append(len(a))
            right.append(len(b))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (common, left, right))],
            names=["a", "b", "common", "na", "nb"],
        )


class _Cell:
    """Some members of the lists of one pivot, with their whole sets, ordered by size."""

    def __init__(self, rows, sizes, linked, side, pivot, sets_: list[np.ndarray]):
        self.rows, self.n, self.linked, self.side = rows, sizes, linked, side
        self.parent = list(range(len(rows)))
        _, which, counts = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))  # rare first
        owner = np.repeat(np.arange(len(rows)), sizes)
        elements = rank[which]
        self.elements = elements[np.lexsort((elements, owner))]
        self.first = np.r_[0, np.cumsum(sizes)]
        self.mark = np.zeros(len(counts), bool)
        self._index(owner, np.sort(counts))
        # How the sets that are linked to the pivot differ from it.
        self.pivot = int(np.flatnonzero(pivot)[0])
        self.mark[self._set(self.pivot)] = True
        self.less, self.more = {}, {}
        for i in np.flatnonzero(linked).tolist():
            own = self._set(i)
            self.more[i] = own[~self.mark[own]]
            own = np.zeros(0, np.int64) if i == self.pivot else own
            self.less[i] = np.setdiff1d(self._set(self.pivot), own, True) if i != self.pivot else own
            self.parent[i] = self.pivot
        self.mark[:] = False

    def _set(self, i: int) -> np.ndarray:
        return self.elements[self.first[i] : self.first[i + 1]]

    def _index(self, owner: np.ndarray, counts: np.ndarray) -> None:
        """Per element the members that have it in their prefix, by size, with the number of elements from it on."""
        at = np.arange(len(self.elements)) - self.first[owner]
        size = self.n[owner]
        use = (at <= size - -(-3 * size // 4)) & (counts[self.elements] > 1)
        keys, members, rest = self.elements[use], owner[use], (size - at)[use]
        order = np.lexsort((members, keys))
        self.keys, self.members, self.rest = keys[order], members[order], rest[order]
        self.ends = np.searchsorted(self.keys, np.arange(len(self.mark) + 1))

    def _candidates(self, u: int) -> np.ndarray:
        """Members whose lists do not rule them out, by blocks and then by entries."""
        n, own, found = int(self.n[u]), self._set(u), []
        for at, w in enumerate(own[: n - least_common(n) + 1].tolist()):
            lo, hi = int(self.ends[w]), int(self.ends[w + 1])
            if hi - lo < 2:
                continue
            sizes = self.n[self.members[lo:hi]]
            hi = lo + int(np.searchsorted(sizes, 4 * n // 3, "right"))
            lo += int(np.searchsorted(sizes, least_common(n)))
            if lo >= hi:
                continue
            heads = np.arange(lo, hi, _BLOCK)
            best = np.minimum(np.maximum.reduceat(self.rest[lo:hi], heads - lo), n - at)
            for h in heads[7 * best >= 3 * (n + self.n[self.members[heads]])].tolist():
                some = slice(h, min(h + _BLOCK, hi))
                x = self.members[some]
                found.append(x[7 * np.minimum(self.rest[some], n - at) >= 3 * (n + self.n[x])])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _common(self, xs: list[int], with_pivot: int) -> np.ndarray:
        """Common elements of the marked set with others: from the pivot's number and the differences, or counted."""
        parts, signs, base = [], [], []
        for x in xs:
            near = x in self.less
            parts += [self.more[x], self.less[x]] if near else [self._set(x), self._set(x)[:0]]
            base.append(with_pivot if near else 0)
        sums = np.r_[0, np.cumsum(self.mark[np.concatenate(parts)])][np.cumsum([0, *map(len, parts)])]
        steps = np.diff(sums)
        return np.array(base) + steps[::2] - steps[1::2]

    def links(self) -> Iterator[tuple[int, int]]:
        """Links that connect what the pivot's answers and earlier links leave apart."""
        both = self.side.min() != self.side.max()
        for u in np.flatnonzero(~self.linked).tolist():
            xs = self._candidates(u)
            keep = (xs != u) & (self.linked[xs] | (xs < u))
            if both:
                keep &= self.side[xs] != self.side[u]
            xs = xs[keep].tolist()
            if not xs:
                continue
            self.mark[self._set(u)] = True
            with_pivot = int(self.mark[self._set(self.pivot)].sum())
            for lo in range(0, len(xs), 256):
                part = [x for x in xs[lo : lo + 256] if self._root(x) != self._root(u)]
                if part:
                    for x, c in zip(part, self._common(part, with_pivot).tolist()):
                        if 7 * c >= 3 * int(self.n[u] + self.n[x]) and self._root(x) != self._root(u):
                            self.parent[self._root(u)] = self._root(x)
                            yield int(self.rows[u]), int(self.rows[x])
            self.mark[self._set(u)] = False


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within every cell; the rows of a cell follow each other, ordered by size."""
    names = ("cell", "row", "n", "linked", "side", "pivot")
    held: list[tuple[dict[str, np.ndarray], list[np.ndarray]]] = []

    def close() -> pa.RecordBatch:
        own = [np.concatenate([h[c] for h, _ in held]) for c in names[1:]]
        found = list(_Cell(*own, [x for _, sets_ in held for x in sets_]).links())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    current = None
    for batch in batches:
        columns = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
        cell = columns["cell"]
        edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
        for a, b in zip(edges.tolist(), np.r_[edges[1:], len(cell)].tolist()):
            if held and cell[a] != current:
                yield close()
            current = cell[a]
            sets_ = [np.frombuffer(x.as_buffer(), W.U64) for x in batch.column(6).slice(a, b - a)]
            held.append(({c: v[a:b] for c, v in columns.items()}, sets_))
    if held:
        yield close()


def _postings(base: DataFrame, scratch: Scratch) -> DataFrame:
    """``token, row, n, single, at``: the shared shingles in the prefixes of all sets that may have a partner. A token is a
    shingle and a band in one number. ``base`` holds one row per class."""

    def tokens(b: int) -> DataFrame:
        salt = F.lit((b * 0x1E3779B97F4A7C15) % (1 << 63))
        owner = F.col("row") * 8 + 2 * b  # row, band, and whether the shingle lies beyond the counted part
        own = F.concat(
            F.transform(f"l{b}", lambda t: F.struct(t.bitwiseXOR(salt).alias("token"), owner.alias("owner"))),
            F.transform(f"m{b}", lambda t: F.struct(t.bitwiseXOR(salt).alias("token"), (owner + 1).alias("owner"))),
        )
        return base.where(F.size(f"l{b}") + F.size(f"m{b}") > 0).select(F.explode(own).alias("s")).select("s.*")

    every = reduce(DataFrame.unionByName, [tokens(b) for b in range(len(BANDS))])
    shared = scratch.keep(every.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    hits = every.join(shared, "token").withColumn("beyond", F.col("owner") % 2)
    per = hits.groupBy(F.expr("owner div 2").alias("set")).agg(
        F.count(F.when(F.col("beyond") == 0, 1)).alias("found"),
        F.sort_array(F.collect_list(F.struct("beyond", "df", "token"))).alias("order"),
    )
    per = scratch.keep(per, "found")
    counted = F.array(*[F.size(f"l{b}").cast("long") for b in range(len(BANDS))])
    sizes = base.select("row", "n", counted.alias("counted"))
    per = per.withColumn("row", F.expr("set div 4")).join(sizes, "row").withColumn(
        "k", F.element_at("counted", (F.col("set") % 4 + 1).cast("int"))
    )
    spare = F.col("n") - F.ceil(F.col("n") * 3 / 4)  # a linked set may lack so many
    single = F.col("k") - F.col("found")
    per = per.where(single <= spare).withColumns({"single": single, "slots": spare + 1 - single})
    # Inside the counted part the prefix has the single shingles first; beyond it all that were kept belong to it.
    inside = F.filter("order", lambda s: s["beyond"] == 0)
    beyond = F.filter("order", lambda s: s["beyond"] == 1)
    chosen = per.select(
        "row", "n", "k", "single",
        F.posexplode(F.concat(F.slice(inside, F.lit(1), F.greatest("slots", F.lit(0)).cast("int")), beyond)).alias("i", "s"),
    )
    at = F.when(F.col("s.beyond") == 1, F.col("k")).otherwise(F.col("single") + F.col("i"))
    made = scratch.keep(
        chosen.select(F.col("s.token").alias("token"), "row", "n", "single", at.cast("long").alias("at")), "postings"
    )
    scratch.drop("shared", "found")
    return made


def _linked(common: str = "common", na: str = "na", nb: str = "nb"):
    return 7 * F.col(common) >= 3 * (F.col(na) + F.col(nb))


def links(docs: DataFrame, scratch: Scratch, size: int = SIZE, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, links): ``row, doc_id, key, n, class`` of every document (``class``: the row that stands for all
    equal sets; ``key``: xxhash64 of the text), and links ``a, b`` between classes that connect what is similar."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{x}{b} array<long>" for b in range(len(BANDS)) for x in "lm")
    base = scratch.keep(
        source.mapInArrow(_sketches(size), f"doc_id {kind}, key long, n long, one long, two long, {lists}").withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "sketches",
    )
    classes = scratch.keep(base.where("n > 0").groupBy("n", "one", "two").agg(F.min("row").alias("class")), "classes")
    everyone = base.select("row", "doc_id", "key", "n", "one", "two").join(classes, ["n", "one", "two"], "left")
    everyone = scratch.keep(everyone.select("row", "doc_id", "key", "n", F.coalesce("class", "row").alias("class")), "everyone")
    firsts = classes.select(F.col("class").alias("row"))
    postings = _postings(base.join(firsts, "row", "left_semi"), scratch)
    scratch.drop("sketches", "classes")

    summary = postings.groupBy("token").agg(
        F.min(F.struct("single", "row", "n", "at")).alias("pivot"), F.count(F.lit(1)).alias("members")
    ).where("members > 1")
    lists_ = scratch.keep(
        summary.select("token", "members", "pivot.row", "pivot.n", "pivot.at").withColumnsRenamed(
            {"row": "p", "n": "pn", "at": "pat"}
        ), "lists",
    )
    members = scratch.keep(postings.join(lists_, "token"), "members")
    scratch.drop("postings")
    needed = scratch.keep(members.select("row").distinct().join(everyone.select("row", "doc_id", "key"), "row"), "needed")
    whole = scratch.keep(_elements(source, needed, size), "elements")

    least, rest = F.least("n", "pn"), F.least(F.col("n") - F.col("at"), F.col("pn") - F.col("pat"))
    possible = (4 * least >= 3 * F.greatest("n", "pn")) & (7 * rest >= 3 * (F.col("n") + F.col("pn")))
    first_pairs = members.where((F.col("row") != F.col("p")) & possible).select(F.col("p").alias("a"), F.col("row").alias("b"))
    seen = scratch.keep(_verified(first_pairs.distinct(), whole), "with-pivots")

    # What the pivots' answers leave open: pairs of members of one pivot's lists that are not both linked to it.
    linked = seen.where(_linked()).select(F.col("a").alias("p"), F.col("b").alias("row"), F.lit(True).alias("linked"))
    placed = members.select("p", "row", "n").distinct().join(linked, ["p", "row"], "left").select(
        "p", "row", "n", F.coalesce("linked", F.col("row") == F.col("p")).alias("linked")
    )
    placed = scratch.keep(placed, "placed")
    groups = placed.groupBy("p").agg(
        F.count(F.when(~F.col("linked"), 1)).alias("open"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")
    ).where("open > 0 AND members > 2")
    groups = scratch.keep(groups.select("p", F.ceil(F.col("weight") / CELL).cast("int").alias("cells")), "groups")
    spread = placed.join(groups, "p").withColumn("pivot", F.col("row") == F.col("p")).withColumn(
        "side", F.pmod(F.xxhash64("row"), "cells").cast("int")
    )
    every, own = F.sequence(F.lit(0), F.col("cells") - 1), F.col("side")
    pairs = F.when(  # the pivot goes to all cells, a member to those of its chunk with every other chunk
        F.col("pivot"), F.flatten(F.transform(every, lambda i: F.transform(F.sequence(i, F.col("cells") - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    ).otherwise(F.transform(every, lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"))))
    spread = spread.join(whole, "row").withColumn("c", F.explode(pairs))
    side = F.when(F.col("pivot"), F.col("c.i")).otherwise(own)
    spread = spread.select(F.xxhash64("p", "c.i", "c.j").alias("cell"), "row", "n", "linked", side.alias("side"), "pivot", "elements")
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    more = spread.repartition(parts, "cell").sortWithinPartitions("cell", "n", "row").mapInArrow(_cell_links, "a long, b long")
    found = scratch.keep(seen.where(_linked()).select("a", "b").unionByName(more), "links")
    scratch.drop("lists", "members", "needed", "elements", "with-pivots", "placed", "groups")
    return everyone, found


def _elements(source: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    n = needed.count()
    some = source.join(sized(needed.select("key").distinct(), n), "key", "left_semi") if n else source.where("false")
    w = needed.select("row", F.col("doc_id").alias("d"), F.col("key").alias("k"))
    texts = some.join(w, F.col("key").eqNullSafe(F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("row", "text")
    return texts.dropDuplicates(["row"]).mapInArrow(_whole_sets(size), "row long, elements binary")


def _verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    left = whole.select(F.col("row").alias("a"), F.col("elements").alias("x"))
    right = whole.select(F.col("row").alias("b"), F.col("elements").alias("y"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(_overlaps, "a long, b long, common long, na long, nb long")


def grouped(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``row, doc_id, key, n, component`` (a row) of every document."""
    scratch = Scratch(docs.sparkSession, "similar")
    everyone, found = links(docs, scratch, size)
    roots = components(found, scratch).withColumnRenamed("node", "class")
    return everyone.join(roots, "class", "left").select(
        "row", "doc_id", "key", "n", F.coalesce("root", "class").alias("component")
    )


def digest(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "similar-result")
    made = scratch.keep(grouped(docs), "grouped")
    names = scratch.keep(made.groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    return made.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id."""
    scratch = Scratch(docs.sparkSession, "similar-result")
    made = scratch.keep(grouped(docs), "grouped")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    winners = scratch.keep(made.groupBy("component").agg(F.min(order).alias("w")).select(F.col("w.row").alias("row")), "winners")
    losers = scratch.keep(made.join(winners, "row", "left_anti").select("doc_id", "key"), "losers")
    twice = losers.join(
        made.join(winners, "row", "left_semi").select(F.col("doc_id").alias("d"), F.col("key").alias("k")),
        F.col("key").eqNullSafe(F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi",
    )
    again = scratch.keep(twice.distinct(), "again")  # rows that equal a winner in id and text
    n, key, other_id, other_key = losers.count(), fresh(docs, "_llm_key"), fresh(docs, "_llm_d"), fresh(docs, "_llm_k")
    gone = sized(losers.select(F.col("doc_id").alias(other_id), F.col("key").alias(other_key)).distinct(), n)
    same = (F.col(key) == F.col(other_key)) & F.col("doc_id").eqNullSafe(F.col(other_id))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    kept = keyed.join(gone, same, "left_anti")
    if again.count():
        repeated = sized(again.select(F.col("doc_id").alias(other_id), F.col("key").alias(other_key)), n)
        kept = kept.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates([key, "doc_id"]))
    return kept.select(*docs.columns)


#: The same in SQL: pairs through common shingles, and reachability by recursion.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT DISTINCT r, sha256(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
  FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM x GROUP BY r),
o AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT reach.a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN c USING (r)
"""
