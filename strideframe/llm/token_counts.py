"""Token counts under a unigram model, with the dynamic programme shared in a trie of distinct pre-tokens.

A pre-token is U+2581 and a run of characters other than ASCII white space. It is cut into vocabulary pieces so that the
sum of their scores is greatest, with the fewest pieces among equals. A character that is no piece is written as byte
pieces. Piece scores are integers: a millionth of a unit of log probability under Zipf's law for the rank that the
vocabulary file gives, bytes below all others. A trie node keeps the best score and piece count of its prefix, so a
prefix that many pre-tokens share is scored once; the count of the terminal node is the pre-token's.

Defined cases: NULL, empty and blank texts have no pre-tokens and no tokens; repeated rows give repeated results.
"""

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strideframe.llm import words as W

MARK = "▁"
#: Bounds of the tables of a worker, and the longest pre-token that goes into the trie.
_NODES = 1_000_000
_KEPT = 1_000_000
_TRIE_CHARS = 64


class Pieces:
    def __init__(self, scores: dict[str, int], byte_score: int):
        self.scores, self.byte_score = scores, byte_score
        self.longest = max(map(len, scores), default=1)

    def step(self, text: str, d: int, best: list[int], count: list[int]) -> tuple[int, int]:
        """Score and piece count of the prefix of ``d`` characters, given those of all shorter ones."""
        found = None
        for s in range(max(0, d - self.longest), d):
            piece = self.scores.get(text[s:d])
            if piece is not None:
                made = (best[s] + piece, -count[s] - 1)
                if found is None or made > found:
                    found = made
        if text[d - 1] not in self.scores:
            n = len(text[d - 1].encode())
            made = (best[d - 1] + n * self.byte_score, -count[d - 1] - n)
            if found is None or made > found:
                found = made
        return found[0], -found[1]


class Trie:
    """Nodes are lists: children by character, score, count."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.root, self.nodes = pieces, [{}, 0, 0], 0

    def count(self, token: str) -> int:
        if len(token) > _TRIE_CHARS:
            best, count = [0], [0]
            for d in range(1, len(token) + 1):
                b, c = self.pieces.step(token, d, best, count)
                best.append(b)
                count.append(c)
            return count[-1]
        if self.nodes > _NODES:
            self.root, self.nodes = [{}, 0, 0], 0
        node, best, count = self.root, [0], [0]
        for d, char in enumerate(token, 1):
            below = node[0].get(char)
            if below is None:
                below = node[0][char] = [{}, *self.pieces.step(token, d, best, count)]
                self.nodes += 1
            node = below
            best.append(node[1])
            count.append(node[2])
        return node[2]


def read_pieces(path: str) -> Pieces:
    """Pieces of a vocabulary file whose scores are negative merge ranks; control and unused entries are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ranks = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unused(i) or model.is_unknown(i) or model.is_byte(i)):
            ranks[model.id_to_piece(i)] = -model.get_score(i)
    order = sorted(ranks, key=lambda p: (ranks[p], p))
    total = math.log(sum(1 / (r + 1) for r in range(len(order) + 1)))
    scores = {p: -round(1e6 * (math.log(r + 1) + total)) for r, p in enumerate(order)}
    return Pieces(scores, -round(1e6 * (math.log(len(order) + 1) + total + 2)))


class Counter:
    """Piece counts of pre-tokens by their hash; new ones go through the trie in sorted order."""

    def __init__(self, pieces: Pieces):
        self.trie = Trie(pieces)
        self.hashes, self.counts = np.zeros(0, W.U64), np.zeros(0, np.int64)

    def totals(self, column: pa.Array) -> Iterator[tuple[int, int]]:
        """(pre-tokens, tokens) of every text."""
        for _, _, data, offsets in W.slabs(column, 1 << 20):
            slab = W.WordSlab(data, offsets, W.SPACED, W.SAME)
            distinct, first, which = np.unique(slab.hashes, return_index=True, return_inverse=True)
            if len(self.hashes) > _KEPT:
                self.hashes, self.counts = np.zeros(0, W.U64), np.zeros(0, np.int64)
            at = np.searchsorted(self.hashes, distinct)
            new = np.ones(len(distinct), bool)
            inside = at < len(self.hashes)
            new[inside] = self.hashes[at[inside]] != distinct[inside]
            if new.any():
                tokens = [slab.words(i, i + 1)[0].decode() for i in first[new].tolist()]
                made = np.zeros(len(tokens), np.int64)
                for i in sorted(range(len(tokens)), key=tokens.__getitem__):
                    made[i] = self.trie.count(MARK + tokens[i])
                place = np.searchsorted(self.hashes, distinct[new])
                self.hashes = np.insert(self.hashes, place, distinct[new])
                self.counts = np.insert(self.counts, place, made)
                at = np.searchsorted(self.hashes, distinct)
            sums = np.r_[0, np.cumsum(self.counts[at][which])][slab.first]
            yield from zip(np.diff(slab.first).tolist(), np.diff(sums).tolist())


@lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def token_counts(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            found = list(counter.totals(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                names=["doc_id", "n_pretokens", "n_tokens"],
            )

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long")
