"""Personal data: high-recall candidates, boosted trees on format and context, calibrated thresholds.

The base spans are what the strict patterns find; they always stay. Generators also propose looser spans (written-out
"at" signs, any groups of seven or more digits), which may overlap base spans and each other. Gradient-boosted trees are
fitted on loose candidates only, those that can be added, of all documents. Labelled findings are an argument; without any,
candidates are labelled by their loose format (``weak_label``), and every base span is also rewritten in its place to loose
forms of its kind, both such that are personal data and such that are not (``loosened``). Every one of them either is learnt
from or, three in ten by a hash of their text, held out. On all that are held out, scores are calibrated per kind by isotonic
regression, and the threshold of a kind is the least score with a calibrated probability of ``SURE``.
Candidates above it that overlap no span chosen before them, base or better scored, are added.

Defined cases: NULL and empty texts have no spans; without candidates of both classes only base spans are returned.
"""

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm import forest
from strideframe.llm.stages import Scratch

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are possessive and begin at their first digit: the same matches, in time linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE_DIGITS = re.compile(r"(?<![0-9])[+(]{0,2}[0-9](?:[ ()./:-]{0,3}[0-9]){6,}+")
_LOOSE_MAIL = re.compile(r"[^\s@<>()\[\]]{1,64}(?:@|[ ]?[\[(](?:at|AT)[\])][ ]?)[^\s@<>()\[\]]{1,255}")

_QUOTES = ".,;:!?\"'`*"
_MAIL = re.compile(
    r"[A-Za-z0-9._%+-]+(?:@|[ ]?[\[(](?:at|AT)[\])][ ]?)(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"
)
_NATIONAL = re.compile(
    r"\(0?[1-9][0-9]{1,4}\)[ -]?[0-9]{2,4}(?:[ -]?[0-9]{2,4}){1,3}"
    r"|0[1-9][0-9]{1,4}(?: ?[/-] ?| )[0-9]{3,8}(?:[ -][0-9]{2,4}){0,3}"
    r"|[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\1[0-9]{4}|00[1-9][0-9]{0,2}[ -][0-9]{1,5}(?:[ -][0-9]{2,8}){1,4}"
)

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches, looked for at the "@" signs only."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Matches of the strict patterns, by start and kind."""
    found: list[Span] = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # A long run of digits cannot be a part of an address, and would be slow to read as a number.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = re.sub(r"[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m.group())) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Base spans and everything the loose generators propose."""
    found = set(base)
    if "@" in text or "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        for m in _LOOSE_MAIL.finditer(text):
            own = m.group()
            left, right = len(own) - len(own.lstrip(_QUOTES)), len(own) - len(own.rstrip(_QUOTES))
            if len(own) > left + right:
                found.add((m.start() + left, m.end() - right, 0))
    if _DIGIT.search(text):
        for m in _LOOSE_DIGITS.finditer(text):
            digits = sum(map(str.isdigit, m.group()))
            if m.group().count(".") == 3 and digits <= 12:
                found.add((m.start(), m.end(), 1))
            if 13 <= digits <= 19:
                found.add((m.start(), m.end(), 2))
            if digits <= 15:
                found.add((m.start(), m.end(), 3))
    return sorted(found)


_WORDS = (
    ("mail", "contact", "write", "reply"), ("ip", "host", "server", "addr", "ping"),
    ("card", "visa", "credit", "account", "iban"), ("tel", "phone", "call", "mobile", "fax"),
)


def _kind_of(char: str) -> float:
    return 0.0 if not char else 1.0 if char.isspace() else 2.0 if char.isalpha() else 3.0 if char.isdigit() else 4.0


def features(text: str, span: Span) -> list[float]:
    start, end, kind = span
    own = text[start:end]
    groups = [g for g in re.split(r"[^0-9]+", own) if g]
    digits = "".join(groups)
    name, _, domain = own.partition("@")
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    words = re.findall(r"[^\W\d_]+", before.lower())[-3:]
    return [
        *(float(kind == k) for k in range(4)), float(min(len(own), 400)), float(len(digits)),
        len(digits) / len(own), float(len(groups)), float(max(map(len, groups), default=0)),
        float(min(map(len, groups), default=0)), float(own.startswith("+")), float(own.count("(")), float(own.count(".")),
        float(own.count("-")), float(own.count(" ")), float(14 <= len(digits) <= 19 and luhn(digits)),
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)), float("@" in own),
        float(domain.count(".")), float(len(domain.rpartition(".")[2])), float(len(name)),
        _kind_of(before[-1:]), _kind_of(after[:1]), sum(map(str.isdigit, before)) / 40, sum(map(str.isdigit, after)) / 40,
        *(float(any(w.startswith(k) for w in words for k in keys)) for keys in _WORDS), float(bool(re.search(r"[:=]\s*$", before))),
        float(own.startswith("0")), float(own.count("/")), float(own.count(":")), float(bool(_MAIL.fullmatch(own))),
        float(bool(_NATIONAL.fullmatch(own))), float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        float(all(len(g) == 4 for g in groups[:-1])),
    ]


class Model:
    def __init__(self, trees: forest.Forest | None, thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), both by start and kind."""
        base = base_spans(text)
        if self.trees is None:
            return base, base
        taken, known = _Taken(base), set(base)
        extra = [c for c in candidates(text, base) if c not in known and taken.free(c)]
        if not extra:
            return base, base
        scores = np.concatenate([
            self.trees.scores(np.array([features(text, c) for c in extra[i : i + 1000]])) for i in range(0, len(extra), 1000)
        ])
        chosen = list(base)
        for score, span in sorted(zip(scores.tolist(), extra), key=lambda p: (-p[0], p[1])):
            if score >= self.thresholds[span[2]] and taken.free(span):
                chosen.append(span)
                taken.add(span)
        return base, sorted(chosen, key=lambda s: (s[0], s[2]))


class _Taken:
    """Places that are covered: base spans, which may overlap each other, and added ones, which overlap nothing."""

    def __init__(self, base: list[Span]):
        order = sorted(base)
        self.starts = [s for s, _, _ in order]
        self.reach = list(accumulate((e for _, e, _ in order), max))
        self.added: list[tuple[int, int]] = []

    def free(self, span: Span) -> bool:
        i = bisect_left(self.starts, span[1])
        if i and self.reach[i - 1] > span[0]:
            return False
        i = bisect_left(self.added, (span[1], 0))
        return not (i and self.added[i - 1][1] > span[0])

    def add(self, span: Span) -> None:
        insort(self.added, span[:2])


def weak_label(text: str, span: Span) -> int:
    """A label by format of a span outside the base patterns."""
    start, end, kind = span
    own = text[start:end]
    groups = [g for g in re.split(r"[^0-9]+", own) if g]
    digits = "".join(groups)
    if kind == 0:
        return int(bool(_MAIL.fullmatch(own)))
    if kind == 1:
        return int(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups))
    if kind == 2:
        by_four = len(groups) > 2 and all(len(g) == 4 for g in groups[:-1]) and len(groups[-1]) <= 4
        return int(by_four and 14 <= len(digits) <= 19 and digits[0] in "3456" and luhn(digits))
    words = re.findall(r"[^\W\d_]+", text[max(0, start - 40) : start].lower())[-1:]
    named = any(w.startswith(k) for w in words for k in _WORDS[3]) and 10 <= len(digits) <= 15 and len(groups) <= 5
    return int(9 <= len(digits) <= 15 and (named or bool(_NATIONAL.fullmatch(own))))


def loosened(own: str, kind: int) -> list[str]:
    """Loose forms of a base span's text: personal data first, then look-alikes (a name, a plain number, a wrong sum)."""
    if kind == 0:
        local, _, domain = own.partition("@")
        return [f"{local}{at}{d}" for d in (domain, domain.partition(".")[0]) for at in (" (at) ", " [at] ", "(at)", " (AT) ")]
    digits = re.sub(r"[^0-9]", "", own)
    if kind == 1:
        parts = own.split(".")
        return [" . ".join(parts), " . ".join([parts[0], "999", *parts[2:]])]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        return [sep.join(d[i : i + 4] for i in range(0, len(d), 4)) for d in (digits, wrong) for sep in (".", " - ", "/")]
    d = digits[-10:] if digits[-10] != "0" else f"5{digits[-9:]}"
    return [
        f"({d[:3]}) {d[3:6]}-{d[6:]}", f"0{d[:3]} {d[3:]}", f"0{d[:3]}/{d[3:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"0{d[:4]}-{d[4:]}",
        f"({d[:3]}) {d[3:]}", d, d[:8], f"{d[:4]} {d[4:]}", f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[8:]}",
    ]


def _loose(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, candidates that overlap none of them)."""
    base = base_spans(text)
    taken = _Taken(base)
    return base, [c for c in candidates(text, []) if taken.free(c)]


def _made(text: str) -> Iterator[tuple[str, Span]]:
    """What the fit learns from: loose candidates, and base spans in loose forms with 80 characters on either side."""
    base, loose = _loose(text)
    for span in loose:
        yield text, span
    for start, end, kind in base:
        before, after = text[max(0, start - 80) : start], text[end : end + 80]
        for form in loosened(text[start:end], kind):
            changed, span = before + form + after, (len(before), len(before) + len(form), kind)
            if span in _loose(changed)[1]:
                yield changed, span


_EXAMPLE = "x array<double>, y int, kind int, key long"


def _example(text: str, span: Span, label: int) -> tuple[list[float], int, int, int]:
    """Features, label, kind, and a number by which rows are held out: equal texts go together, equal features do not."""
    return features(text, span), label, span[2], zlib.crc32(text[max(0, span[0] - 80) : span[1] + 80].encode())


def _example_rows(made: list[tuple[list[float], int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*made)) or [(), (), (), ()]
    kinds = (pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["x", "y", "kind", "key"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = []
    for batch in batches:
        for value in batch.column(0):
            for text, span in _made(value.as_py() or ""):
                made.append(_example(text, span, weak_label(text, span)))
                if len(made) == 1000:
                    yield _example_rows(made)
                    made = []
    yield _example_rows(made)


def _reviewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for text, start, end, kind, label in zip(*(c.to_pylist() for c in batch.columns)):
            if text is not None and label is not None and kind in KINDS and 0 <= (start or 0) < (end or 0) <= len(text):
                made.append(_example(text, (start or 0, end, KINDS.index(kind)), int(label)))
        yield _example_rows(made)


Pool = tuple[float, int, int]  # least score, ones, rows


def pooled(rows: Iterable[Pool]) -> list[Pool]:
    """Pools by rising score whose shares of ones rise and fit the rows best (pool adjacent violators). Pools of parts of the
    rows can be pooled again."""
    pools: list[Pool] = []
    for score, ones, n in rows:
        while pools and pools[-1][1] * n >= ones * pools[-1][2]:
            score, more, rest = pools.pop()
            ones, n = ones + more, n + rest
        pools.append((score, ones, n))
    return pools


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores, ascending, and the non-decreasing probabilities that fit the labels best."""
    order = np.argsort(scores, kind="stable")
    pools = pooled(zip(scores[order].tolist(), labels[order].tolist(), [1] * len(order)))
    return scores[order], np.repeat([y / n for _, y, n in pools], [n for _, _, n in pools])


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``kind, score, ones, n`` of a range, in order, pooled."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    made = [(kind, *pool) for kind, own in groupby(rows, lambda r: r[0]) for pool in pooled(r[1:] for r in own)]
    columns = list(zip(*made)) or [()] * 4
    kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["kind", "score", "ones", "n"])


def calibrated(trees: forest.Forest, hold: DataFrame) -> list[list[Pool]]:
    """Per kind, the pools of all rows held out: equal scores are counted together, ranges of scores pooled by tasks."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(trees.scores(forest.matrix(batch.column(0))))
                yield pa.RecordBatch.from_arrays([batch.column(2), scores, batch.column(1)], names=["kind", "score", "y"])

    scored = hold.select("x", "y", "kind").mapInArrow(score, "kind int, score double, y int")
    counted = scored.groupBy("kind", "score").agg(F.sum("y").alias("ones"), F.count("*").alias("n"))
    ranges = counted.repartitionByRange("kind", "score").sortWithinPartitions("kind", "score")
    found = sorted(tuple(r) for r in ranges.mapInArrow(_pools, "kind int, score double, ones long, n long").collect())
    return [pooled(r[1:] for r in found if r[0] == k) for k in range(len(KINDS))]


def fit(docs: DataFrame, labelled: DataFrame | None = None) -> Model:
    """The model of a corpus. ``labelled``: columns text, start, end, kind (a name of ``KINDS``), label (0 or 1)."""
    scratch = Scratch(docs.sparkSession, "personal")
    if labelled is None:
        made = docs.select("text").mapInArrow(_examples, _EXAMPLE)
    else:
        made = labelled.select("text", "start", "end", "kind", "label").mapInArrow(_reviewed, _EXAMPLE)
    made = scratch.keep(made, "examples").withColumn("part", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(10)))
    learn, hold = made.where("part < 7"), made.where("part >= 7")
    model = Model(None, [2.0] * len(KINDS))
    if {r["y"] for r in learn.select("y").distinct().collect()} == {0, 1} and not hold.isEmpty():
        trees = forest.boosted(learn)
        sure = [min((s for s, ones, n in pools if ones / n >= SURE), default=2.0) for pools in calibrated(trees, hold)]
        model = Model(trees, sure)
    scratch.drop("examples")
    return model


def _text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: base spans by kind and their hash, and all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans = [], [], []
            for value in batch.column(1):
                base, chosen = shared.value.spans(value.as_py() or "")
                counts.append([sum(s[2] == k for s in base) for k in range(4)])
                hashes.append(hashlib.sha256(_text(base).encode()).hexdigest())
                spans.append(_text(chosen))
            per_kind = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *per_kind, pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=names
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def redacted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every chosen span replaced by its kind in brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = batch.schema.get_field_index(text_col), []
            for value in batch.column(at):
                text = value.as_py()
                parts, done = [], 0
                for s, e, k in shared.value.spans(text)[1] if text else ():
                    if s >= done:
                        parts += [text[done:s], f"[{KINDS[k]}]"]
                    done = max(done, e)
                texts.append("".join([*parts, text[done:]]) if parts else text)
            kept = [pa.array(texts, c.type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(kept, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
