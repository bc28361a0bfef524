"""Personal data by patterns and a semi-Markov CRF (operator 9).

Base patterns find emails, IPv4 addresses, card numbers (Luhn) and phone
numbers in the whole text. The method adds spans found by a semi-Markov
conditional random field: texts are cut into islands (runs of words with a
digit or ``@``), islands into units (digit runs, letter runs, single other
characters), and every segment of up to ``max_units`` units is scored as a
whole (lengths, Luhn sum, dotted quads, first and last character, what stands
around it, ...) for every kind. Bounded-entity dynamic programming picks
boundaries and kinds together, in time linear in the island.

The method cannot add a span of more than ``max_units`` units (16): numbers
written digit by digit and addresses of many parts come from the base patterns
or not at all. A span's length in characters is not bounded, and base spans
are whole whatever their length.

Words without a digit or ``@`` cannot be part of a span (their score is minus
infinity), so islands can be decoded one by one without changing the result.

The weights are fitted by maximum likelihood (forward-backward over
segments) on a bounded sample: the islands of the ``sample_docs`` documents
with the smallest hash of their id among those of at most ``sample_chars``
characters that hold a digit or ``@``; the base spans are the labels. Islands
of more than 2,000 characters, and islands with a base span that is no
candidate (more than ``max_units`` units, or reaching over the island's end),
give no example; all are decoded in the result.

Defined cases: null or empty text -> no spans; no labelled span in the
sample -> base spans alone; equal spans are kept once per kind; null ids and
repeated rows are carried; empty table -> empty result; other columns are
not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, rows_named, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a digit run begins, so the look-behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def quad(text: str) -> bool:
    return all(int(p) <= 255 if len(p) < 9 else not p.strip("0") or int(p[-9:]) <= 255 and not p[:-9].strip("0")
               for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns that pass, sorted."""
    out = []
    if not _SIGN.search(text):
        return out
    done, at = 0, text.find("@")
    while at >= 0:                                    # leftmost local part before each @, greedy domain after it
        domain, low = _DOMAIN.match(text, at), at
        if domain:
            while low > done and text[low - 1] in _LOCAL:
                low -= 1
        if domain and low < at:
            out.append((low, 0, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if quad(m.group())]
    for m in _CARD.finditer(text):
        d = digits_of(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return sorted(out)


_UNIT = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")


def islands(text: str) -> Iterator[tuple[int, str]]:
    """Runs of words with a digit or @, parted by single spaces."""
    begin = end = -1
    for m in _SIGN.finditer(text):
        if m.start() < end:
            continue
        low = max(text.rfind(c, max(end, 0), m.start()) for c in SPACE) + 1
        high = m.end()
        while high < len(text) and text[high] not in SPACE:
            high += 1
        if begin >= 0 and low == end + 1 and text[end] == " ":
            end = high
            continue
        if begin >= 0:
            yield begin, text[begin:end]
        begin, end = low, high
    if begin >= 0:
        yield begin, text[begin:end]


_FEATURES = ("bias", "digits 1-3", "digits 4-8", "digits 9-11", "digits 12-15", "digits 16-19", "digits 20+", "no digit",
             "letters", "letters 6+", "one @", "dots 1", "dots 2", "dots 3", "dots 4+", "quad", "luhn", "all digits",
             "first +", "first digit", "first letter", "first other", "last digit", "last letter", "last other",
             "space", "dash", "bracket", "other sign", "joined before", "joined after", "units 1", "units 2-4",
             "units 5+", "dot after @", "symbol before", "symbol after", "domain end")
_DOT_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


def segment_features(text: str, before: str, after: str, units: int) -> list[int]:
    """Numbers of the features of a whole candidate span that hold."""
    d = digits_of(text)
    n, letters = len(d), sum(c.isalpha() for c in text)
    first, last, dots = text[0], text[-1], text.count(".")
    on = [0, 7 if n == 0 else 1 if n < 4 else 2 if n < 9 else 3 if n < 12 else 4 if n < 16 else 5 if n < 20 else 6]
    on += [8] * (letters > 0) + [9] * (letters > 5) + [10] * (text.count("@") == 1)
    on += [10 + min(dots, 4)] if dots else []
    on += [15] * bool(_DOT_QUAD.fullmatch(text) and quad(text)) + [16] * (12 <= n <= 19 and luhn(d)) + [17] * (n == len(text))
    on.append(18 if first == "+" else 19 if first.isdigit() else 20 if first.isalpha() else 21)
    on.append(22 if last.isdigit() else 23 if last.isalpha() else 24)
    on += [25] * (" " in text) + [26] * ("-" in text) + [27] * ("(" in text or ")" in text)
    on += [28] * any(not (c.isalnum() or c in "@.+-() _%") for c in text)
    on += [29] * before.isalnum() + [30] * after.isalnum()
    on.append(31 if units == 1 else 32 if units < 5 else 33)
    on += [34] * ("@" in text and "." in text[text.index("@"):])
    on += [35] * (before in ("@", ".", "-", "+")) + [36] * (after in ("@", ".", "-")) + [37] * (letters > 0 and last.isalpha())
    return on


@dataclass
class Lattice:
    """The candidate segments of an island: unit bounds, and features of (first unit, last unit + 1)."""

    bounds: list[int]
    starts: np.ndarray
    ends: np.ndarray
    features: np.ndarray


def _segments(island: str, max_units: int) -> tuple[list[int], Iterator[tuple[int, int, list[int]]]]:
    """Unit bounds, and (first unit, last unit + 1, features) of the candidates by last unit."""
    marks = [m.start() for m in _UNIT.finditer(island)] + [len(island)]

    def run() -> Iterator[tuple[int, int, list[int]]]:
        for j in range(1, len(marks)):
            if island[marks[j] - 1] == " ":
                continue
            for i in range(max(0, j - max_units), j):
                text = island[marks[i]:marks[j]]
                if text[0] != " " and _SIGN.search(text):
                    yield i, j, segment_features(text, island[marks[i] - 1] if i else "",
                                                 island[marks[j]:marks[j] + 1], j - i)
    return marks, run()


def lattice(island: str, max_units: int) -> Lattice:
    marks, found = _segments(island, max_units)
    found = list(found)
    rows = np.zeros((len(found), len(_FEATURES)))
    for s, (_, _, on) in enumerate(found):
        rows[s, on] = 1
    return Lattice(marks, np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64), rows)


def _by(n: int, at: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(n + 1))
    return [order[cuts[i]:cuts[i + 1]] for i in range(n)]


def best_spans(island: str, weights: np.ndarray, max_units: int) -> list[tuple[int, int, int]]:
    """Bounded-entity dynamic programming: the best choice of (start, kind, end) in the island.

    Segments are scored on the way and only one entry per unit is held.
    """
    marks, found = _segments(island, max_units)
    best, back = [0.0] * len(marks), [(-1, -1)] * len(marks)
    done = 0
    for i, j, on in found:
        for k in range(done + 1, j + 1):              # units that end no candidate stay outside
            best[k] = max(best[k], best[k - 1])
        done = j
        scores = weights[on].sum(axis=0)
        kind = int(scores.argmax())
        total = best[i] + float(scores[kind])
        if total > best[j]:
            best[j], back[j] = total, (i, kind)
    out, j = [], done
    while j > 0:
        i, kind = back[j]
        if i < 0:
            j -= 1
        else:
            out.append((marks[i], kind, marks[j]))
            j = i
    return out[::-1]


def _expected(lat: Lattice, weights: np.ndarray) -> np.ndarray:
    """Marginal probability of every (segment, kind)."""
    n, scores = len(lat.bounds) - 1, lat.features @ weights
    top = scores.max(axis=1, keepdims=True)
    whole = (top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True)))[:, 0]
    fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
    for j, own in enumerate(_by(n + 1, lat.ends)):
        if j:
            fwd[j] = np.logaddexp.reduce(np.concatenate(([fwd[j - 1]], fwd[lat.starts[own]] + whole[own])))
    by_start = _by(n + 1, lat.starts)
    for i in range(n - 1, -1, -1):
        own = by_start[i]
        bwd[i] = np.logaddexp.reduce(np.concatenate(([bwd[i + 1]], bwd[lat.ends[own]] + whole[own])))
    return np.exp(scores + (fwd[lat.starts] + bwd[lat.ends] - fwd[n])[:, None])


def fit_spans(examples: list[tuple[Lattice, np.ndarray]], rounds: int = 40, rate: float = 0.3,
              decay: float = 2e-3) -> np.ndarray:
    """Weights (features x kinds) by maximum likelihood (Adam); ``examples`` hold the gold (segment, kind) marks."""
    w = np.zeros((len(_FEATURES), len(KINDS)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        grad = sum(lat.features.T @ (gold - _expected(lat, w)) for lat, gold in examples) / len(examples) - decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w = w + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def examples_of(text: str, max_units: int) -> Iterator[tuple[Lattice, np.ndarray]]:
    """Islands of up to 2,000 characters whose base spans are all candidates, with the gold marks."""
    spans = base_spans(text)
    for at, island in islands(text):
        if len(island) > 2000:
            continue
        lat = lattice(island, max_units)
        if not len(lat.starts):
            continue
        gold, place, fits = np.zeros((len(lat.starts), len(KINDS))), {}, True
        for s, (i, j) in enumerate(zip(lat.starts, lat.ends, strict=True)):
            place[(at + lat.bounds[i], at + lat.bounds[j])] = s
        taken = at
        for start, kind, end in spans:              # overlapping base spans: the first is the label
            if end <= at or start >= at + len(island) or start < taken and (start, end) in place:
                continue
            if (start, end) not in place:
                fits = False
                break
            gold[place[(start, end)], kind] = 1
            taken = end
        if fits:
            yield lat, gold


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 600,
        sample_chars: int = 20_000, max_units: int = 16) -> np.ndarray | None:
    """Weights fitted on a bounded sample (see the module's text); None without any labelled span."""
    d = (rows_named(docs, doc_id, text).where((F.length(text) <= sample_chars) & F.col(text).rlike("[0-9@]"))
         .withColumn("__mark", F.xxhash64(text)))
    order = [F.xxhash64(doc_id), F.col(doc_id), F.col("__mark")]
    # The sample is drawn from ids and text hashes; its texts are fetched by a join with that short list.
    drawn = (d.select(doc_id, "__mark").orderBy(*order).limit(sample_docs)
             .select(F.col(doc_id).alias("__id"), F.col("__mark").alias("__of")).distinct())
    found = d.join(F.broadcast(drawn), d[doc_id].eqNullSafe(F.col("__id")) & (d["__mark"] == F.col("__of")), "left_semi")
    texts = [r[0] for r in found.orderBy(*order).limit(sample_docs).select(text).collect()]
    examples = [x for t in texts for x in examples_of(t, max_units)]
    if not any(gold.any() for _, gold in examples):
        return None
    return fit_spans(examples)


def all_spans(text: str, weights: np.ndarray | None, max_units: int) -> tuple[list, list]:
    """(base spans, base and added spans); an added span does not touch a base span."""
    base = base_spans(text)
    if weights is None:
        return base, base
    added = []
    for at, island in islands(text):
        added += [(at + i, kind, at + j) for i, kind, j in best_spans(island, weights, max_units)]
    bounds = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in bounds]
    reach = np.maximum.accumulate([e for _, e in bounds]).tolist() if bounds else []
    free = []
    for s, kind, e in added:
        k = int(np.searchsorted(starts, e))
        if not k or reach[k - 1] <= s:
            free.append((s, kind, e))
    return base, sorted({*base, *free})


def _scanned(weights: np.ndarray | None, max_units: int):
    span = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("stop", pa.int64()), ("kind", pa.string())])

    def rows(spans) -> list[dict]:
        return [{"start": s, "rank": k, "stop": e, "kind": KINDS[k]} for s, k, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t.as_py() or "", weights, max_units) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), *[pa.array([rows(f[i]) for f in found], pa.list_(span))
                                                      for i in (0, 1)]], names=["doc_id", "base", "spans"])
    return run


def scan(docs: DataFrame, weights: np.ndarray | None, doc_id: str = "doc_id", text: str = "text",
         max_units: int = 16) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, rank, stop, kind) in code points, sorted by start, then kind."""
    d = rows_named(docs, doc_id, text)
    span = "array<struct<start:long,rank:int,stop:long,kind:string>>"
    return (d.select(F.col(doc_id).cast("long"), text_of(d, text))
            .mapInArrow(_scanned(weights, max_units), f"doc_id long, base {span}, spans {span}")
            .withColumnRenamed("doc_id", doc_id))
