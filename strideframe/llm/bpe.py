"""Byte-level BPE by prefix dynamic programming, exact appends and edits, and decoding.

For every prefix of a byte string, the greedy merge encoding has one last token. Token ``t`` ending at ``i`` is that
last token exactly if encoding its bytes gives ``[t]`` and the last token of the prefix before it and ``t`` stay
apart when only their bytes are encoded. So one token number per prefix stores all encodings of all prefixes: the ids
of a prefix are read backwards from its end, an append computes new prefixes only, and after an edit the numbers are
computed again until as many as the longest token agree with the old ones.

Texts are first split by a pattern; each match is encoded on its own. A match that is itself a vocabulary entry is
that one token. Matches repeat, so each worker keeps the ids of recent ones in a bounded table.

Defined cases: NULL and empty texts have no tokens and decode to no bytes; repeated rows give repeated results.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strideframe.llm.stages import fresh, give_back, with_column

#: Bounds of the tables of a worker: matches (two generations), pairs of tokens, prefixes of matches.
_KEPT = 200_000
_PAIRS = 400_000
_PREFIXES = 400_000
_SHARED = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ends: dict = {}  # a trie over reversed tokens: byte -> node, -1 -> rank
        for token, rank in ranks.items():
            node = self.ends
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge inside a token
        self._apart: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._prefix: dict[bytes, int] = {}

    def forget(self) -> None:
        """Empty the bounded tables."""
        self._apart.clear()
        self._prefix.clear()

    def merged(self, piece: bytes) -> list[int]:
        """Plain merging, lowest rank first: the definition."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(
                ((self.ranks[p], i) for i, p in enumerate(map(bytes.__add__, parts, parts[1:])) if p in self.ranks),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether the bytes of a token are encoded as that token alone."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return known

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes ``token`` out of its bytes; None for a single byte."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                _, i = min((self.ranks[p], i) for i, p in enumerate(map(bytes.__add__, parts, parts[1:])) if p in self.ranks)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def apart(self, left: int, right: int) -> bool:
        """Whether the bytes of two whole tokens are encoded as these two.

        The merges of the two sides run interleaved in rank order, left before right at equal rank. Going back from
        the end, the later of the two merges next to the boundary is undone; at no moment may the pair that meets at
        the boundary have a merge that was due before the one just undone.
        """
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= _PAIRS:
                self._apart.clear()
            known = self._apart[key] = self._stays(left, right)
        return known

    def _stays(self, left: int, right: int) -> bool:
        ranks, tokens = self.ranks, self.tokens
        due, side = len(ranks) + len(tokens), 0  # the merge just undone: its rank; 0 left, 1 right of the boundary
        while True:
            rank = ranks.get(tokens[left] + tokens[right])
            if rank is not None and (rank < due or rank == due and side == 1):
                return False
            l, r = self._split(left), self._split(right)
            if l is None and r is None:
                return True
            if r is None or l is not None and left > right:
                due, side, left = left, 0, l[1]
            else:
                due, side, right = right, 1, r[0]

    def next_token(self, data: bytes | bytearray, i: int, before) -> int:
        """The last token of the prefix of ``i + 1`` bytes; ``before(j)`` is that of the prefix of j bytes."""
        node, start, found = self.ends, i, []
        while start >= 0:
            node = node.get(data[start])
            if node is None:
                break
            token = node.get(-1)
            if token is not None:
                found.append((start, token))
            start -= 1
        for start, token in reversed(found):
            if self.whole(token) and (start == 0 or self.apart(before(start), token)):
                return token
        raise ValueError(f"no token ends at byte {i}: the vocabulary lacks single bytes")

    def extend(self, data: bytes | bytearray, last: list[int]) -> None:
        """Append the last token of the next prefix of ``data`` to ``last`` (entry i belongs to the prefix of i + 1)."""
        last.append(self.next_token(data, len(last), lambda j: last[j - 1]))

    def prefix_tokens(self, data: bytes) -> list[int]:
        last: list[int] = []
        for _ in range(len(data)):
            self.extend(data, last)
        return last

    def read_back(self, last: list[int], end: int | None = None) -> list[int]:
        """The ids of the prefix of ``end`` bytes."""
        at, ids = len(last) if end is None else end, []
        while at:
            ids.append(last[at - 1])
            at -= len(self.tokens[ids[-1]])
        return ids[::-1]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a match; short prefixes are shared by all matches that begin with them."""
        rank = self.ranks.get(piece)
        if rank is not None:
            return [rank]
        if len(piece) > _SHARED:
            return self.read_back(self.prefix_tokens(piece))
        ids = []
        while piece:
            ids.append(self.last_token(piece))
            piece = piece[: -len(self.tokens[ids[-1]])]
        return ids[::-1]

    def last_token(self, head: bytes) -> int:
        """The last token of a short prefix. The table of prefixes is filled top down: only those get an entry that
        an encoding or the test of a longer prefix asks for."""
        known = self._prefix.get(head)
        if known is not None:
            return known
        node, found = self.ends, []
        for n, byte in enumerate(reversed(head), 1):
            node = node.get(byte)
            if node is None:
                break
            if -1 in node:
                found.append((n, node[-1]))
        size = len(head)
        while found:
            n, token = found.pop()
            if self.whole(token) and (n == size or self.apart(self.last_token(head[:-n]), token)):
                if len(self._prefix) >= _PREFIXES:
                    self._prefix.clear()
                self._prefix[head] = token
                return token
        raise ValueError(f"no token ends {head!r}: the vocabulary lacks single bytes")


class Prefixes:
    """The last tokens of all prefixes of one byte string, kept through appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.computed = 0
        self.append(data)

    def _more(self) -> None:
        self.vocabulary.extend(self.data, self.last)
        self.computed += 1

    def append(self, data: bytes) -> None:
        self.data += data
        while len(self.last) < len(self.data):
            self._more()

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Replace bytes ``start:end``. Prefixes before stay; those behind are reused once they agree again."""
        old, shift = self.last, len(data) - (end - start)
        self.data[start:end] = data
        self.last, agree = old[:start], 0
        while len(self.last) < len(self.data):
            at = len(self.last)
            self._more()
            agree = agree + 1 if at >= start + len(data) and old[at - shift] == self.last[at] else 0
            if agree == self.vocabulary.longest:
                self.last += old[at - shift + 1 :]
                return

    def ids(self, end: int | None = None) -> list[int]:
        return self.vocabulary.read_back(self.last, end)


class Editor:
    """A text split by the pattern, with the ids of its matches; edits split and encode only what may change.

    A match depends on no text beyond two characters after its end (the pattern looks ahead one character and may give
    one back), so matches that end earlier than that before an edit stay.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, text: str = ""):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.text, self.matches = "", []
        self.encoded = 0
        self.edit(0, 0, text)

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, text: str) -> None:
        shift = len(text) - (end - start)
        self.text = self.text[:start] + text + self.text[end:]
        keep = len(self.matches)
        while keep and self.matches[keep - 1][1] + 2 > start:
            keep -= 1
        old = {m[0] + shift: i for i, m in enumerate(self.matches) if m[0] >= end}
        made, rest = self.matches[:keep], []
        for m in self.pattern.finditer(self.text, made[-1][1] if made else 0):
            if m.start() >= start + len(text) and m.start() in old:
                rest = [(s + shift, e + shift, ids) for s, e, ids in self.matches[old[m.start()] :]]
                break
            made.append((m.start(), m.end(), self.vocabulary.encode(m.group().encode())))
            self.encoded += 1
        self.matches = made + rest

    def ids(self) -> list[int]:
        return [i for _, _, ids in self.matches for i in ids]


class _Known(dict):
    """Match -> its ids as little-endian unsigned 32-bit integers. When full, it starts anew and takes over those
    entries of the table before that are asked for again."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.before = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _KEPT:
            self.before = dict(self)
            self.clear()
        raw = self.before.get(piece)
        if raw is None:
            ids = self.vocabulary.encode(piece.encode())
            raw = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= _SHARED:
            self[piece] = raw
        return raw


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> tuple[Vocabulary, _Known, regex.Pattern]:
    vocabulary = Vocabulary(read_ranks(path))
    return vocabulary, _Known(vocabulary), regex.compile(pattern)


_CHARS = 1 << 20


def _encoded(text: str, known: _Known, pattern: regex.Pattern) -> bytes:
    """Ids of a text; matches are taken in groups so that a long text never is a list of all its matches."""
    if len(text) <= _CHARS:
        return b"".join(map(known.__getitem__, pattern.findall(text)))
    parts, some = [], []
    for m in pattern.finditer(text):
        some.append(m.group())
        if len(some) == _CHARS // 8:
            parts.append(b"".join(map(known.__getitem__, some)))
            some = []
    return b"".join([*parts, *map(known.__getitem__, some)])


def decode(ids: np.ndarray, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a new last column of token ids (array<int>); its name is ``ids_col``, or prefixed if taken."""
    name = fresh(docs, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what earlier stages left
        vocabulary, known, split = _coder(ranks_path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                raws = [_encoded(t or "", known, split) for t in part.column(at).to_pylist()]
                ends = np.cumsum([0, *(len(r) // 4 for r in raws)])
                flat = np.frombuffer(b"".join(raws), "<u4").astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, name])
        # Later stages run in the same worker.
        known.clear()
        known.before = {}
        vocabulary.forget()
        give_back()

    return docs.mapInArrow(run, with_column(docs, name, "array<int>"))


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: the number of tokens, the hash of the ids, and the hash of the bytes decoded from these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, known, split = _coder(ranks_path, pattern)
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for value in batch.column(1):
                raw = _encoded(value.as_py() or "", known, split)
                counts.append(len(raw) // 4)
                hashes.append(hashlib.sha256(raw).hexdigest())
                back = hashlib.sha256()
                for lo in range(0, len(raw), 4 * _CHARS):
                    back.update(decode(np.frombuffer(raw[lo : lo + 4 * _CHARS], "<u4"), vocabulary.tokens))
                decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
