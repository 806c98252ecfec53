"""Secret scans: candidates by pattern, false positives removed by a random forest trained on labelled findings.

Candidates are values assigned to a name that speaks of secrets ("Bearer" is part of the name), runs of at least 16
characters of the usual alphabets that hold a digit, and private key blocks. A token of known form inside one of the
first two is the candidate instead; other runs lose a "NAME=" before and full stops after them. The forest sees length, how usual the transitions between characters are in
running text, how much of the candidate the words of a dictionary cover, signs of a path, and the words beside it.
Transitions and dictionary (the ``DICTIONARY`` most frequent words) are counted over all words of all documents; the
forest is fitted on at most about ``MOST_ROWS`` labelled findings. Labelled findings are an argument (text, start, end,
label); without any, findings of a sample of documents (about ``MOST_DOCS``, drawn row by row) are labelled by format
(``weak_label``).

Defined cases: NULL and empty texts have no findings; with labels of one class only, every finding gets that class.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm import forest
from strideframe.llm.stages import Scratch, give_back, thinned

MOST_DOCS = 10_000
MOST_ROWS = 10_000
DICTIONARY = 20_000
THRESHOLD = 0.5
REPLACEMENT = "[secret]"

# Words that name secrets, and words that name harmless long values.
SECRET_WORDS = ("key", "token", "secret", "password", "passwd", "pwd", "auth", "credential", "bearer", "private")
HARMLESS_WORDS = ("hash", "sha", "md5", "commit", "checksum", "digest", "uuid", "guid", "version", "example", "card", "phone")

_ASSIGNED = re.compile(
    r"(?i)[a-z_.-]*(?:key|token|secret|passw(?:or)?d|pwd|auth|credential|bearer)[a-z0-9_.-]{0,40}[\"']?\s{0,3}(?::=|=>|[:=])"
    r"\s{0,3}[\"']?(?:(?:bearer|basic|token)\s{1,3})?(?!(?:bearer|basic|token)\s)([^\s\"'<>]{6,})"
)
_BEARER = re.compile(r"(?i)\bbearer\s{1,3}([a-z0-9._~+/=-]{16,})")
_HINT = re.compile(r"[:=]")
_RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?)-----")
#: Lines of a key after its BEGIN line: headers, empty ones, and base64 of at least 16 characters or with its padding.
_KEY_LINE = re.compile(r"[ \t]*+(?:(?:[A-Z][A-Za-z-]{2,30}: [^\r\n]*+)|[A-Za-z0-9+/]{16,}+={0,2}|[A-Za-z0-9+/]*+={1,2}[A-Za-z0-9+/]{0,4}|)[ \t]*+(?:\r?\n|$)")
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{30,}|xox[abpr]-[A-Za-z0-9-]{10,}"
    r"|sk-[A-Za-z0-9_-]{20,}|eyJ[\w-]+\.[\w-]+\.[\w-]*)"
)
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*=(?=[^=])")
#: Parts of a run that are no part of a key: words, numbers, versions and hexadecimal digests.
_BETWEEN = re.compile(r"[/._=~+-]")
_PLAIN = re.compile(r"[A-Za-z]?[a-z]*|[A-Z]*|[A-Za-z]?[0-9]*|(?:0x)?(?:[0-9a-f]{7,}|[0-9A-F]{7,})")
#: The name of an assigned password, up to its value.
_PASSWORD = re.compile(r"(?i)(?:passw(?:or)?d|pwd)[a-z0-9_.-]{0,40}[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?$")
#: What stands where a password would: words of documentation, references and calls.
_NO_PASSWORD = re.compile(
    r"(?i)(?:required|optional|string|undefined|nullable|invalid|incorrect|expired|missing|forgotten|changed|hidden"
    r"|redacted|example|boolean|default)[.,;:)]*|[$%{(\[].*|.*[(\[{].*|(.)\1*"
)
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = re.compile(r"[a-z]{3,}")
_KINDS = ("assigned", "run", "block")

Finding = tuple[int, int, str]


def _unclosed(text: str, at: int, end: int) -> int:
    """Where the lines of a key without an END marker end."""
    done = at
    m = re.compile(r"[ \t]*+\r?\n").match(text, at, end)
    while m and m.end() > m.start():
        if m.group().strip():
            done = m.start() + len(m.group().rstrip())
        m = _KEY_LINE.match(text, m.end(), end)
    return done


def _blocks(text: str) -> Iterator[Finding]:
    """Private keys: a BEGIN marker up to the END marker of its name; if that is missing, the key's lines."""
    begin: re.Match | None = None
    for m in _MARK.finditer(text):
        if m.group(1) == "BEGIN":
            if begin:
                yield begin.start(), _unclosed(text, begin.end(), m.start()), "block"
            begin = m
        elif begin and m.group(2) == begin.group(2):
            yield begin.start(), m.end(), "block"
            begin = None
    if begin:
        yield begin.start(), _unclosed(text, begin.end(), len(text)), "block"


def known(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Tokens of known form in a part of the text."""
    return [(start + m.start(), start + m.end()) for m in _KNOWN.finditer(text[start:end])]


def _parts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The candidates of a run: its tokens of known form and what is long enough beside them."""
    tokens, out = known(text, start, end), []
    for s, e in zip([start, *(e for _, e in tokens)], [*(s for s, _ in tokens), end]):
        while e > s and text[e - 1] == ".":
            e -= 1
        m = _NAME.match(text, s, e)
        if m and e - m.end() >= 16 and _DIGIT.search(text, m.end(), e):
            s = m.end()
        if e - s >= 16 and _DIGIT.search(text, s, e):
            out.append((s, e))
    return out + tokens


def _add(found: list[Finding], covered: list[tuple[int, int]], made: Iterator[tuple[list[tuple[int, int]], str]]) -> None:
    """Add what no span of ``covered``, which are in order, overlaps."""
    i = 0
    for spans, kind in made:
        for s, e in sorted(spans):
            while i < len(covered) and covered[i][1] <= s:
                i += 1
            if not (i < len(covered) and covered[i][0] < e):
                found.append((s, e, kind))


def candidates(text: str) -> list[Finding]:
    """(start, end, kind) by place; a run that an assignment or a block covers is not listed again."""
    found: list[Finding] = []
    if "PRIVATE KEY" in text:
        found += _blocks(text)
    blocks = [(s, e) for s, e, _ in found]
    if _HINT.search(text):
        _add(found, blocks, ((known(text, *m.span(1)) or [m.span(1)], "assigned") for m in _ASSIGNED.finditer(text)))
    if "earer" in text or "EARER" in text:
        taken = sorted((s, e) for s, e, _ in found)
        _add(found, taken, ((known(text, *m.span(1)) or [m.span(1)], "assigned") for m in _BEARER.finditer(text)))
    if _DIGIT.search(text):
        covered = sorted((s, e) for s, e, _ in found)
        _add(found, covered, ((_parts(text, *m.span()), "run") for m in _RUN.finditer(text) if _DIGIT.search(m.group())))
    return sorted(found)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0


def switches(value: str) -> float:
    """Share of neighbouring characters that differ in kind: small or capital letter, or digit; separators do not count."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "" for c in value]
    return sum(bool(a and b and a != b) for a, b in zip(kinds, kinds[1:])) / max(1, len(value) - 1)


def _harmless(text: str, start: int) -> bool:
    """Whether one of the three words before names a harmless long value."""
    return any(w.lower() in HARMLESS_WORDS for w in _WORD.findall(text[max(0, start - 60) : start])[-3:])


def password(text: str, start: int, value: str) -> bool:
    """Whether the value is assigned to the name of a password and is none of the usual words or references."""
    return bool(_PASSWORD.search(text[max(0, start - 80) : start])) and not _NO_PASSWORD.fullmatch(value)


def weak_label(text: str, finding: Finding) -> int:
    """A label by format: blocks, known token forms, assigned passwords, long, mixed values assigned to another name of
    secrets, and bare keys: 20 characters or more of mixed kinds in no order, most of them outside words, numbers and
    hexadecimal parts, and no harmless word before."""
    start, end, kind = finding
    value = text[start:end]
    if kind == "block" or _KNOWN.fullmatch(value):
        return 1
    mixed = bool(_DIGIT.search(value)) and bool(re.search(r"[A-Za-z]", value))
    if kind == "assigned":
        return int(password(text, start, value) or (len(value) >= 12 and mixed and entropy(value) >= 3.0))
    if not (len(value) >= 20 and mixed and switches(value) >= 0.3 and entropy(value) >= 3.5) or _harmless(text, start):
        return 0
    opaque = sum(len(p) for p in _BETWEEN.split(value) if not _PLAIN.fullmatch(p))
    return int(opaque >= 20 and 2 * opaque >= len(value))


_PLACES = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789+/_=.-")}
_OTHER = len(_PLACES)


class Language:
    """Transitions between characters, and a dictionary, of running text."""

    def __init__(self, words: list[str], pairs: dict[int, int]):
        counts = np.ones((_OTHER + 1) ** 2)
        for pair, k in pairs.items():
            counts[pair] += k
        counts = counts.reshape(_OTHER + 1, _OTHER + 1)
        self.usual = np.log2(counts / counts.sum(1, keepdims=True))
        self.words = frozenset(w for w in words if len(w) >= 3)
        self.longest = max(map(len, self.words), default=0)

    def transitions(self, value: str) -> float:
        at = [_PLACES.get(c, _OTHER) for c in value.lower()]
        return float(self.usual[at[:-1], at[1:]].mean()) if len(at) > 1 else 0.0

    def coverage(self, value: str) -> float:
        """Share of the characters inside dictionary words, longest first from the left."""
        covered = 0
        for m in _LETTERS.finditer(value.lower()):
            run, i = m.group(), 0
            while i < len(run) - 2:
                n = next((n for n in range(min(self.longest, len(run) - i), 2, -1) if run[i : i + n] in self.words), 0)
                covered += n
                i += n or 1
        return covered / max(1, len(value))


def features(text: str, finding: Finding, language: Language) -> list[float]:
    start, end, kind = finding
    value, before, after = text[start:end], text[max(0, start - 60) : start], text[end : end + 40]
    n = len(value)
    left = max(before.rfind(c) for c in " \n\t\"'") + 1
    right = min((i for i in map(after.find, " \n\t\"'") if i >= 0), default=len(after))
    around = before[left:] + value + after[:right]
    near = [w.lower() for w in _WORD.findall(before)[-3:] + _WORD.findall(after)[:2]]
    return [
        *(float(kind == k) for k in _KINDS), float(n), entropy(value),
        sum(map(str.isdigit, value)) / n, sum(map(str.isupper, value)) / n,
        float(len(re.findall(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+", value))) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(bool(_KNOWN.match(value))),
        language.transitions(value), language.coverage(value),
        float(around.count("/") + around.count("\\")), float("://" in around or around.startswith(("www.", "./", "~/"))),
        float(bool(re.search(r"\.[A-Za-z]{2,4}$", value))), float(value.count(".")),
        float(bool(re.search(r"[:=]\s{0,3}[\"']?$", before))), float(before[-1:] in ("'", '"')),
        float(any(w in SECRET_WORDS for w in near)), float(any(w in HARMLESS_WORDS for w in near)),
        float(sum(w in language.words for w in near)), switches(value), float(_harmless(text, start)),
        float(kind == "assigned" and password(text, start, value)),
    ]


class Model:
    def __init__(self, language: Language, trees: forest.Forest | None, only: float = 0.0):
        self.language, self.trees, self.only = language, trees, only

    def findings(self, text: str) -> list[tuple[Finding, float]]:
        """Candidates with the probability that they are secrets."""
        found = candidates(text)
        if not found:
            return []
        if self.trees is None:
            return [(f, self.only) for f in found]
        scores: list[float] = []
        for i in range(0, len(found), 1000):
            part = found[i : i + 1000]
            scores += self.trees.scores(np.array([features(text, f, self.language) for f in part])).tolist()
        return list(zip(found, scores))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for value in batch.column(0):
            counts.update(_WORD.findall((value.as_py() or "").lower()))
            if len(counts) > 300_000:
                yield rows()
                counts.clear()
    yield rows()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transitions within the words (``word, n``), summed within the task."""
    counts = np.zeros((_OTHER + 1) ** 2, np.int64)
    for batch in batches:
        for word, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = [_PLACES.get(c, _OTHER) for c in word]
            for a, b in zip(at, at[1:]):
                counts[a * (_OTHER + 1) + b] += k
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["pair", "n"])


def fit(docs: DataFrame, labelled: DataFrame | None = None) -> Model:
    """The model of a corpus. ``labelled``: columns text, start, end, kind, label (0 or 1) of reviewed findings."""
    scratch = Scratch(docs.sparkSession, "secrets")
    sample = thinned(docs.select("text"), MOST_DOCS)
    counted = docs.select("text").mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = scratch.keep(counted, "words")
    top = counted.orderBy(F.desc("n"), "word").limit(DICTIONARY).collect()
    pairs = counted.mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    scratch.drop("words")
    language = Language([r["word"] for r in top], {r["pair"]: r["n"] for r in pairs})
    shared = docs.sparkSession.sparkContext.broadcast(language)

    def weak(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for value in batch.column(0):
                text = value.as_py() or ""
                made += [(features(text, f, shared.value), weak_label(text, f)) for f in candidates(text)]
            yield _example_rows(made)

    def reviewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, start, end, kind, label in zip(*(c.to_pylist() for c in batch.columns)):
                if text is not None and label is not None and 0 <= (start or 0) < (end or 0) <= len(text):
                    made.append((features(text, (start or 0, end, kind or "run"), shared.value), int(label)))
            yield _example_rows(made)

    if labelled is None:
        rows = sample.mapInArrow(weak, "x array<double>, y int")
    else:
        rows = labelled.select("text", "start", "end", "kind", "label").mapInArrow(reviewed, "x array<double>, y int")
    rows = thinned(scratch.keep(rows, "examples"), MOST_ROWS)
    classes = {r["y"] for r in rows.select("y").distinct().collect()}
    trees = forest.random_forest(rows) if classes == {0, 1} else None
    scratch.drop("examples")
    return Model(language, trees, float(max(classes, default=0)))


def _example_rows(made: list[tuple[list[float], int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, _ in made], pa.list_(pa.float64())), pa.array([y for _, y in made], pa.int32())], names=["x", "y"]
    )


def scan(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every finding: ``doc_id, start, end`` (code points, end exclusive), ``kind, score, is_secret``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, made = [], []
            for i, value in enumerate(batch.column(1)):
                for (start, end, kind), score in shared.value.findings(value.as_py() or ""):
                    owners.append(i)
                    made.append({"start": start, "end": end, "kind": kind, "score": score, "is_secret": score >= threshold})
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_())
            names = ["start", "end", "kind", "score", "is_secret"]
            columns = [pa.array([m[n] for m in made], k) for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), *columns], names=["doc_id", *names]
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, end long, kind string, score double, is_secret boolean")


def redacted(docs: DataFrame, model: Model, *, text_col: str = "text", size_col: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret replaced; the column of text sizes, if there is one of type long, follows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    sized = dict(docs.dtypes).get(size_col) == "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            sizes = columns[batch.schema.get_field_index(size_col)].to_pylist() if sized else []
            for i, text in enumerate(texts):
                parts, done = [], 0
                for (start, end, _), score in shared.value.findings(text) if text else ():
                    if score >= threshold:
                        if start >= done:
                            parts += [text[done:start], REPLACEMENT]
                        done = max(done, end)
                if parts:
                    texts[i] = "".join([*parts, text[done:]])
                    if sized:
                        sizes[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if sized:
                columns[batch.schema.get_field_index(size_col)] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
        give_back()

    return docs.mapInArrow(run, docs.schema)
