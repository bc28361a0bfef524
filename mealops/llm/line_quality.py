"""Quality rules with line labelling by a linear-chain CRF (operator 4).

Base rules count words, symbols, repeated lines and words in repeated 5-word
windows of the whole text. The method then labels every line that has a word
as content or boilerplate: a linear-chain conditional random field with
features of the line (symbols, capitals, repeats, legal phrases, ...) and
label transitions, decoded by Viterbi. Phrases are counted in the whole line,
as hits per word: one hit is full weight in a line of up to 64 words and
shrinks with the words beyond, so one mention in a long content line does not
condemn it. A document stays if the base rules
pass and its content lines hold at least ``share`` of the bytes of its lines.

The field is fitted by maximum likelihood on a bounded sample of labelled
documents: the ``sample_docs`` labels with the smallest hash of their id, and
of their documents those of at most ``sample_chars`` characters, in runs of at
most ``sample_lines`` lines. Lines of good documents are
content (lines with a legal phrase per 64 words apart); lines of bad documents are boilerplate
where they carry the noise that made the document bad. Everything else runs
over whole texts.

Defined cases: null text -> no words (base rule fails); no labelled document
or only one class -> no field, and the base rules decide alone; a document
without any line with a word has content share 1 (the base rules reject it);
null ids and repeated rows are carried; empty table -> empty result; ``keep``
returns the columns of its input whatever their names, ``decide`` replaces a
column named ``__quality``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_named, text_of

# The symbols of the contract, and phrases that open legal or navigation lines.
SYMBOLS = b"#*$%&|<>"
PHRASES = (b"licensed under", b"copyright", b"all rights reserved", b"terms of", b"privacy policy", b"subscribe",
           b"cookie", b"sign up", b"log in", b"click here", b"general public license", b"spdx-license")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
N_FEATURES = 11
# Fixed value: a line is legal or navigation text if it holds a phrase for every so many words.
PHRASE_WORDS = 64
_WINDOW = 5


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[float]:
    n, size = len(words), max(len(line), 1)
    upper = len(line) - len(line.translate(None, _UPPER))
    lower = len(line) - len(line.translate(None, _LOWER))
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    low = line.lower()
    hits = sum(low.count(p) for p in PHRASES)
    return [1.0, min(1.0, symbols / n), min(1.0, line.count(b"!") / n), upper / (upper + lower + 1),
            (size - len(line.translate(None, _DIGIT))) / size if size > 1 else 0.0, min(1.0, line.count(b"|") / n),
            float(n < 3), float(line.rstrip()[-1:] in (b".", b"!", b"?")), float(repeated),
            min(1.0, PHRASE_WORDS * hits / n), 1.0 - len(set(words)) / n if n >= 10 else 0.0]


def repeat_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur at least twice."""
    n = len(words)
    if n <= _WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    two = paired(ids[:-1], ids[1:])
    four = paired(two[:-2], two[2:])
    five = paired(four[:-1], ids[4:])
    often = np.bincount(five)[five] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[:len(five)] += often
    edges[_WINDOW:] -= often
    return int((np.cumsum(edges[:-1]) > 0).sum())


@dataclass
class Document:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    sizes: list[int]
    features: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def read_document(text: str | None) -> Document:
    raw = (text or "").encode("utf-8", "replace")
    words, seen, rows, sizes, dup = [], set(), [], [], 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        rows.append(line_features(line, own, again))
        sizes.append(len(line))
        words += own
    return Document(len(words), len(b"".join(words).decode("utf-8", "replace")),
                    len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeat_words(words), sizes,
                    np.array(rows).reshape(-1, N_FEATURES))


@dataclass(frozen=True)
class LineField:
    """Weights of the label 1 (boilerplate) against 0 (content), and transition scores [from][to]."""

    weights: tuple[float, ...]
    moves: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, features: np.ndarray) -> list[int]:
        """Viterbi: the best label sequence."""
        (m00, m01), (m10, m11) = self.moves
        best0 = best1 = 0.0
        back: list[tuple[int, int]] = []
        for i, e in enumerate((features @ np.array(self.weights)).tolist()):
            if i == 0:
                best1 = e
                continue
            from0 = (0, best0 + m00) if best0 + m00 >= best1 + m10 else (1, best1 + m10)
            from1 = (0, best0 + m01) if best0 + m01 >= best1 + m11 else (1, best1 + m11)
            back.append((from0[0], from1[0]))
            best0, best1 = from0[1], from1[1] + e
        at = int(best1 > best0)
        out = [at]
        for b in reversed(back):
            at = b[at]
            out.append(at)
        return out[::-1][:len(features)]

    def content_share(self, doc: Document) -> float:
        total = sum(doc.sizes)
        if not total:
            return 1.0
        return sum(s for s, y in zip(doc.sizes, self.labels(doc.features), strict=True) if y == 0) / total


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(sequences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.2,
              decay: float = 1e-3) -> LineField:
    """Maximum likelihood by gradient ascent (Adam); forward-backward runs over all sequences at once."""
    long = max(len(y) for _, y in sequences)
    x = np.zeros((len(sequences), long, N_FEATURES))
    y = np.zeros((len(sequences), long), np.int64)
    on = np.zeros((len(sequences), long), bool)
    for i, (f, labels) in enumerate(sequences):
        x[i, :len(labels)], y[i, :len(labels)], on[i, :len(labels)] = f, labels, True
    pair_on = on[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair_on], y[:, 1:][pair_on]), 1)
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, move = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        emit = np.stack([np.zeros(on.shape), x @ w], axis=2)
        fwd, bwd = np.zeros((*on.shape, 2)), np.zeros((*on.shape, 2))
        fwd[:, 0] = emit[:, 0]
        for k in range(1, long):
            step = _log_add(fwd[:, k - 1, :, None] + move, 1) + emit[:, k]
            fwd[:, k] = np.where(on[:, k, None], step, fwd[:, k - 1])
        for k in range(long - 2, -1, -1):
            step = _log_add(move + (emit[:, k + 1] + bwd[:, k + 1])[:, None, :], 2)
            bwd[:, k] = np.where(on[:, k + 1, None], step, 0.0)
        z = _log_add(fwd[:, -1], 1)
        one = np.exp(fwd[..., 1] + bwd[..., 1] - z[:, None]) * on
        pairs = np.exp(fwd[:, :-1, :, None] + move + (emit[:, 1:] + bwd[:, 1:])[:, :, None, :]
                       - z[:, None, None, None])[pair_on].sum(axis=0)
        grad = np.concatenate([((y * on - one)[..., None] * x).sum(axis=(0, 1)), (seen - pairs).ravel()]) / on.sum()
        grad -= decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    move = theta[N_FEATURES:].reshape(2, 2)
    return LineField(tuple(map(float, theta[:N_FEATURES])), tuple(tuple(map(float, r)) for r in move))


def weak_labels(doc: Document, good: bool) -> np.ndarray:
    """Line labels from a document label: legal phrases, and in bad documents noisy lines, are boilerplate."""
    f = doc.features
    noisy = (f[:, 1] >= 0.15) | (f[:, 2] >= 0.3) | (f[:, 3] >= 0.6) | (f[:, 5] >= 0.15)
    return ((f[:, 9] >= 1) | (noisy & (not good))).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
        sample_docs: int = 400, sample_chars: int = 20_000, sample_lines: int = 200) -> LineField | None:
    """The field fitted on a bounded sample of labelled documents (see the module's text)."""
    d = rows_named(docs, doc_id, text).where(F.length(text).between(1, sample_chars))
    # The sample is drawn from the narrow labels first; at most sample_docs rows are broadcast.
    drawn = (rows_named(labels, doc_id, quality).where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull())
             .orderBy(F.xxhash64(doc_id), doc_id, quality).limit(sample_docs))
    rows = (d.join(F.broadcast(drawn), doc_id).orderBy(F.xxhash64(doc_id), doc_id, text, quality).limit(sample_docs)
            .select(text, quality).collect())
    read = [(read_document(r[0]), bool(r[1])) for r in rows]
    whole = [(d.features, weak_labels(d, good)) for d, good in read if len(d.sizes)]
    # A step of the fit goes over all runs at once, so its time follows the longest run.
    sequences = [(f[a:a + sample_lines], y[a:a + sample_lines]) for f, y in whole for a in range(0, len(y), sample_lines)]
    if not sequences or len({int(v) for _, y in sequences for v in y}) < 2:
        return None
    return fit_field(sequences)


_DECISION = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
                          T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
                          T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
                          T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def _decisions(field: LineField | None, share: float, texts: pa.Array) -> list[tuple]:
    out = []
    for text in texts:
        d = read_document(text.as_py())
        content = field.content_share(d) if field else 1.0
        out.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.base_failed,
                    content, not d.base_failed and content >= share))
    return out


def _decided(field: LineField | None, share: float, at: int):
    names = [f.name for f in _DECISION.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*_decisions(field, share, batch.column(at)), strict=True)) or [[]] * len(names)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            made = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
            yield pa.record_batch([*batch.columns, made], names=[*batch.schema.names, "__quality"])

    return run


def _keeping(field: LineField | None, share: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([d[-1] for d in _decisions(field, share, batch.column(at))], pa.bool_()))

    return run


def decide(docs: DataFrame, field: LineField | None, text: str = "text", share: float = 0.5) -> DataFrame:
    """``docs`` with a struct ``__quality``: the base counts, base_failed, content_share and kept."""
    d = docs.select(*[docs[c] for c in docs.columns if c != "__quality"])
    schema = T.StructType([*d.schema.fields]).add("__quality", _DECISION)
    return d.mapInArrow(_decided(field, share, d.columns.index(text)), schema)


def keep(docs: DataFrame, field: LineField | None, text: str = "text", share: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that stay."""
    return docs.mapInArrow(_keeping(field, share, docs.columns.index(text)), docs.schema)
