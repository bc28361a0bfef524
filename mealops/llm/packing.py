"""Cost-balanced sequence packing (operator 2).

A task tokenizes its texts and appends the end id. Whole windows of
``length`` tokens become sequences of their own; the tails are collected, up
to ``group`` of them, and packed together: as many sequences are opened as
their tokens need, each tail has the cost ``linear * n + quadratic * n**2``
(attention looks at pairs of tokens), and tails in descending cost go to the
sequence with the lowest cost so far that has room. When none has room for
the whole tail, it is cut, and its parts fill the lowest-cost sequences with
any room. A group so pads less than one sequence in all.

There is no shuffle: a group is a run of rows of one partition, and a
sequence id is (partition, number in the partition), the same when a lost
task runs again.

Defined cases: null or empty text -> the end id alone; null document ids are
carried; repeated rows are packed each; texts of any length; empty table ->
empty result; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_named, text_of

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                     ("offset", pa.int64()), ("ids", pa.binary())])
_SQL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
        "ids binary")


def pack(lengths: list[int], length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(item, start in item, tokens, sequence) for items of at most ``length`` tokens."""
    opened = -(-sum(lengths) // length)
    cost, room, out = np.zeros(opened), np.full(opened, length), []
    n = np.array(lengths, dtype=float)
    for i in np.argsort(-(linear * n + quadratic * n * n), kind="stable"):
        start, left = 0, lengths[i]
        while left:
            fits = room >= left
            at = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            take = min(left, int(room[at]))
            out.append((int(i), start, take, at))
            cost[at] += linear * take + quadratic * take * take
            room[at] -= take
            start, left = start + take, left - take
    return out


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes bytes as printable characters: those that are printable stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _encoder(path: str):
    """text -> ids (little-endian unsigned 32-bit) by a ``tokenizers`` file.

    The file's vocabulary runs in ``tiktoken``, which merges by rank several
    times faster with the same ids. It knows no added tokens, so texts that
    hold the string of one go to ``tokenizers`` itself.
    """
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    byte = _byte_of_char()
    ranks = {bytes(byte[c] for c in t): i for t, i in tok.get_vocab(with_added_tokens=False).items() if t not in added}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if any(a in text for a in added):
            return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return encode


def _packed(path: str, length: int, end_id: int, group: int, linear: float, quadratic: float, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        base, made = TaskContext.get().partitionId() << 36, 0
        tails: list[tuple[int | None, int, bytes, int]] = []

        def rows(pieces) -> pa.RecordBatch:
            cols = list(zip(*[(doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, off, ids if keep_ids else None)
                              for doc, start, ids, total, seq, off in pieces], strict=True))
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA, strict=True)], schema=_SCHEMA)

        def flush() -> list:
            nonlocal made
            fill, out = {}, []
            for i, start, take, seq in pack([len(t[2]) // 4 for t in tails], length, linear, quadratic):
                doc, first, ids, total = tails[i]
                off = fill.get(seq, 0)
                out.append((doc, first + start, ids[4 * start:4 * (start + take)], total, base + made + seq, off))
                fill[seq] = off + take
            made += len(fill)
            tails.clear()
            return out

        for batch in batches:
            pieces = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total, step = len(ids) // 4, 4 * length
                full = len(ids) - len(ids) % step
                for at in range(0, full, step):
                    pieces.append((doc, at // 4, ids[at:at + step], total, base + made, 0))
                    made += 1
                if full < len(ids):
                    tails.append((doc, full // 4, ids[full:], total))
                if len(tails) >= group:
                    pieces += flush()
                if len(pieces) >= 20_000:
                    yield rows(pieces)
                    pieces = []
            if pieces:
                yield rows(pieces)
        if tails:
            yield rows(flush())

    return run


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = 2048,
                   end_id: int = 1, group: int = 4096, linear: float = 1.0, quadratic: float = 1 / 2048,
                   keep_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of packed sequences.

    ``tokenizer`` is the path of a ``tokenizers`` file, readable on every
    machine; ``ids`` holds little-endian unsigned 32-bit ids (null without
    ``keep_ids``). Tokens beyond a sequence's last piece are padding.
    """
    d = rows_named(docs, doc_id, text)
    return (d.select(F.col(doc_id).cast("long"), text_of(d, text))
            .mapInArrow(_packed(tokenizer, length, end_id, group, linear, quadratic, keep_ids), _SQL))
