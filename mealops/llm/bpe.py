"""Byte-level BPE encoding and decoding by DuckDB queries per partition (operator 5).

*Encoding.* A task splits its texts by the pre-tokenizer pattern and gathers
the words it has not met. Two bytes that stand together in no token of the
vocabulary are never merged, so a word is cut there first; the pieces' bytes
become rows (piece, position, token) of a DuckDB table, joined to the merge
table. Each round of a recursive query contracts every piece's leftmost pair
of least rank and joins the two pairs that this makes, until no piece has a
pair left. A document's ids are its words' ids in order.

A contraction a round would cost a long piece the square of its length. Pieces
over ``long_piece`` bytes go through a second recursive query, in lots of
their own: a round contracts all of a piece's pairs of least rank that do not
overlap, from the left, unless one of the pairs that this makes (or would make
on the way) has a lower rank; then it contracts the leftmost alone. So the
order of contractions is that of the first query.

*Decoding.* The ids become rows (document, position, id), join the
vocabulary, and an ordered aggregation puts each document's bytes together;
long id lists are cut into segments that are joined afterwards.

DuckDB runs in memory with one thread; words and ids are handed to it in
bounded lots, and its memory limit is fixed but for a piece that is longer
than a lot. Encoder, vocabulary and the words learned last (two generations
of ``most / 2``) stay with a Python worker for its next tasks.

Defined cases: null or empty text -> no ids, empty bytes; null ids array
decodes to empty bytes; an id outside the vocabulary raises an error; null
document ids and repeated rows are carried; empty table -> empty result;
other columns are carried by ``decode`` (one named ``decoded`` is replaced) and
not by ``encode``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_named, text_of, worker_state

_NONE = 2147483647                 # the rank of a pair that is no token
_SHIFT = 4294967296                # a pair's key: left * _SHIFT + right

# state: a piece's tokens, the merged token of every two neighbours (which is their rank), and the least of these.
_ENCODE = f"""
WITH RECURSIVE state(best, piece, toks, ranks) AS (
  SELECT coalesce(min(m.tok), {_NONE}), piece, list(lot.tok ORDER BY pos),
         list(coalesce(m.tok, {_NONE}) ORDER BY pos) FILTER (nxt IS NOT NULL)
  FROM lot LEFT JOIN merges m ON m.key = lot.tok * {_SHIFT} + nxt GROUP BY piece
  UNION ALL
  SELECT coalesce(list_min(ranks), {_NONE}), piece, toks, ranks
  FROM (
    SELECT piece, list_concat(toks[:p - 1], [best], toks[p + 2:]) AS toks,
           list_concat(ranks[:greatest(p - 2, 0)], CASE WHEN p > 1 THEN [coalesce(a.tok, {_NONE})] ELSE [] END,
                       CASE WHEN p < len(ranks) THEN [coalesce(b.tok, {_NONE})] ELSE [] END, ranks[p + 2:]) AS ranks
    FROM (SELECT *, list_position(ranks, best) AS p FROM state WHERE best < {_NONE})
    LEFT JOIN merges a ON a.key = toks[p - 1] * {_SHIFT} + best
    LEFT JOIN merges b ON b.key = best * {_SHIFT} + toks[p + 2])
)
SELECT piece, unnest(toks) AS tok FROM (SELECT * FROM state WHERE best = {_NONE} ORDER BY piece)"""

# The same with all occurrences of a piece's least pair in one round. In a run of overlapping occurrences every other
# one is taken; a taken place's left neighbour is the merged token where the place before it is taken, too.
_ENCODE_LONG = f"""
WITH RECURSIVE state(done, piece, toks) AS (
  SELECT false, piece, list(tok ORDER BY pos) FROM lot GROUP BY piece
  UNION ALL
  SELECT any_value(best) = {_NONE}, piece,
         list(CASE WHEN taken THEN best ELSE tok END ORDER BY pos) FILTER (NOT coalesce(gone, false))
  FROM (
    SELECT *, lag(taken) OVER (PARTITION BY piece ORDER BY pos) AS gone
    FROM (
      SELECT * EXCLUDE (taken),
             taken AND (NOT clash OR pos = min(pos) FILTER (taken) OVER (PARTITION BY piece)) AS taken
      FROM (
        SELECT t.*, bool_or(taken AND least(coalesce(a.tok, {_NONE}), coalesce(b.tok, {_NONE})) < best)
                    OVER (PARTITION BY piece) AS clash
        FROM (
          SELECT *, CASE WHEN lag(taken, 2) OVER (PARTITION BY piece ORDER BY pos) THEN best ELSE before END AS lower
          FROM (
            SELECT *, hit AND row_number() OVER (PARTITION BY piece, hit, run ORDER BY pos) % 2 = 1 AS taken
            FROM (
              SELECT *, pos - row_number() OVER (PARTITION BY piece, hit ORDER BY pos) AS run
              FROM (
                SELECT *, best < {_NONE} AND rank = best AS hit
                FROM (
                  SELECT n.*, coalesce(m.tok, {_NONE}) AS rank,
                         min(coalesce(m.tok, {_NONE})) OVER (PARTITION BY piece) AS best
                  FROM (
                    SELECT *, lag(tok) OVER (PARTITION BY piece ORDER BY pos) AS before,
                           lead(tok) OVER (PARTITION BY piece ORDER BY pos) AS nxt,
                           lead(tok, 2) OVER (PARTITION BY piece ORDER BY pos) AS third
                    FROM (SELECT piece, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM state WHERE NOT done)
                  ) n LEFT JOIN merges m ON m.key = n.tok * {_SHIFT} + nxt))))) t
        LEFT JOIN merges a ON taken AND a.key = lower * {_SHIFT} + best
        LEFT JOIN merges b ON taken AND b.key = best * {_SHIFT} + third)))
  GROUP BY piece
)
SELECT piece, unnest(toks) AS tok FROM (SELECT * FROM state WHERE done ORDER BY piece)"""

_DECODE = """
SELECT part, string_agg(v.hex, '' ORDER BY pos) AS hex
FROM lot JOIN vocabulary v USING (tok) GROUP BY part ORDER BY part"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 of a token's bytes and its rank (which is its id), a line each."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _database(memory: int):
    import duckdb
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{memory}MB", "temp_directory": ""})
    con.execute("SET preserve_insertion_order = false")
    return con


class Encoder:
    """Words to ids; remembers the words of its last two generations, ``most`` in all."""

    def __init__(self, path: str, memory: int, lot: int, long_piece: int, most: int):
        ranks = load_ranks(path)
        self.ranks, self.memory, self.lot, self.long_piece, self.most = ranks, memory, lot, long_piece, most
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        keys, toks = zip(*[(ranks[t[:i]] * _SHIFT + ranks[t[i:]], r) for t, r in ranks.items()
                           for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], strict=True)
        self.con = _database(memory)
        self.con.register("pairs", pa.table({"key": pa.array(keys, pa.int64()), "tok": pa.array(toks, pa.int64())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM pairs")
        self.con.unregister("pairs")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.met = np.zeros((256, 256), bool)                  # bytes that stand together in some token
        for t in ranks:
            for x, y in zip(t, t[1:], strict=False):
                self.met[x, y] = True

    def learn(self, words: set[str]) -> None:
        """Afterwards all ``words`` are known."""
        if len(self.known) + len(words) > self.most // 2:
            self.older, self.known = self.known, {}
        new = []
        for w in words:
            if w in self.known:
                continue
            ids = self.older.get(w)
            b = w.encode("utf-8", "replace")
            if ids is None and b in self.ranks:                # a word that is a token stays whole
                ids = np.array([self.ranks[b]], "<u4").tobytes()
            if ids is None:
                new.append((w, b))
            else:
                self.known[w] = ids
        new.sort()
        for low in range(0, len(new), self.lot):
            self._words(new[low:low + self.lot])

    def _words(self, words: list[tuple[str, bytes]]) -> None:
        joined = np.frombuffer(b"".join(b for _, b in words), np.uint8)
        ends = np.cumsum([len(b) for _, b in words])
        head = np.ones(len(joined), bool)                      # where a piece begins
        head[1:] = ~self.met[joined[:-1], joined[1:]]
        head[np.concatenate(([0], ends[:-1]))] = True
        starts = np.flatnonzero(head)
        stops = np.append(starts[1:], len(joined))
        sizes = stops - starts
        ids: list[bytes] = [b""] * len(starts)
        short = np.flatnonzero(sizes <= self.long_piece)
        lots = [(_ENCODE, short)] if len(short) else []
        long, held = [], 0
        for i in np.flatnonzero(sizes > self.long_piece).tolist():
            long.append(i)
            held += sizes[i]
            if held > 100_000:
                lots, long, held = [*lots, (_ENCODE_LONG, np.array(long))], [], 0
        if long:
            lots.append((_ENCODE_LONG, np.array(long)))
        for query, pieces in lots:
            for i, tok in zip(pieces.tolist(), self._contract(query, joined, starts[pieces], stops[pieces]), strict=True):
                ids[i] = tok
        of = np.searchsorted(starts, np.concatenate(([0], ends)))
        for (w, _), a, b in zip(words, of[:-1].tolist(), of[1:].tolist(), strict=True):
            self.known[w] = ids[a] if b == a + 1 else b"".join(ids[a:b])

    def _contract(self, query: str, joined: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
        sizes = stops - starts
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        tok = self.single[joined[at]]
        last = np.zeros(len(tok), bool)
        last[ends - 1] = True
        lot = pa.table({"piece": np.repeat(np.arange(len(starts)), sizes), "pos": np.arange(len(tok)), "tok": tok,
                        "nxt": pa.array(np.append(tok[1:], 0), mask=last)})
        more = len(tok) // 1000                                # a piece beyond a lot: about a kilobyte a byte
        if more > self.memory:
            self.con.execute(f"SET memory_limit = '{more}MB'")
        self.con.register("lot", lot)
        out = self.con.sql(query).to_arrow_table()
        self.con.unregister("lot")
        if more > self.memory:
            self.con.execute(f"SET memory_limit = '{self.memory}MB'")
        piece, ids = np.asarray(out["piece"]), np.asarray(out["tok"]).astype("<u4").tobytes()
        cuts = (np.searchsorted(piece, np.arange(len(starts) + 1)) * 4).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _encoded(path: str, pattern: str, memory: int, lot: int, long_piece: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_state(("bpe-encoder", path, memory, lot, long_piece, most),
                           lambda: Encoder(path, memory, lot, long_piece, most))
        split = regex.compile(pattern)

        def out(docs: list, texts: list[list[str]]) -> pa.RecordBatch:
            enc.learn(set().union(*texts))
            ids = [b"".join(map(enc.known.__getitem__, t)) for t in texts]
            offsets = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            return pa.record_batch([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                                   names=["doc_id", "ids"])

        docs, texts, held = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                texts.append(split.findall(text.as_py() or ""))
                held += len(texts[-1])
                if held > 300_000:
                    yield out(docs, texts)
                    docs, texts, held = [], [], 0
        if docs:
            yield out(docs, texts)

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
           memory: int = 200, lot: int = 20_000, long_piece: int = 128, most: int = 400_000) -> DataFrame:
    """(doc_id, ids array<int>): the texts by the rank file ``ranks`` (a path readable on every machine).

    ``memory`` is DuckDB's limit in MB, ``most`` bounds the words that a worker remembers (and is exceeded only
    by a lot of texts with more different words).
    """
    d = rows_named(docs, doc_id, text)
    return (d.select(F.col(doc_id).cast("long"), text_of(d, text))
            .mapInArrow(_encoded(ranks, pattern, memory, lot, long_piece, most), "doc_id long, ids array<int>")
            .withColumnRenamed("doc_id", doc_id))


class Vocabulary:
    """The tokens' bytes as a DuckDB table, and their sizes by id."""

    def __init__(self, path: str, memory: int):
        ranks = load_ranks(path)
        self.con = _database(memory)
        self.con.register("given", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()),
                                             "hex": [t.hex() for t in ranks]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.con.unregister("given")
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = [len(t) for t in ranks]


def _decoded(path: str, memory: int, lot: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_state(("bpe-vocabulary", path, memory), lambda: Vocabulary(path, memory))
        con, size = known.con, known.size

        def joined(parts: list[np.ndarray]) -> list[bytes]:
            n = np.array([len(p) for p in parts])
            tok = np.concatenate(parts)
            if len(tok) and (tok.min() < 0 or tok.max() >= len(size) or not size[tok].all()):
                raise ValueError("an id is not in the vocabulary")
            con.register("lot", pa.table({"part": np.repeat(np.arange(len(parts)), n), "tok": tok.astype(np.int32),
                                          "pos": np.arange(len(tok))}))
            got = con.sql(_DECODE).fetchall()
            con.unregister("lot")
            out = [b""] * len(parts)
            for part, text in got:
                out[part] = bytes.fromhex(text)
            return out

        for batch in batches:
            ids = batch.column(at)
            parts, owner, held, texts = [], [], 0, [[] for _ in range(len(ids))]

            def flush() -> None:
                for i, b in zip(owner, joined(parts), strict=True):
                    texts[i].append(b)
                parts.clear()
                owner.clear()

            for i, x in enumerate(ids):
                own = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int32)
                for low in range(0, len(own), lot):
                    parts.append(own[low:low + lot])
                    owner.append(i)
                    held += len(parts[-1])
                    if held >= lot:
                        flush()
                        held = 0
            if parts:
                flush()
            yield pa.record_batch([*batch.columns, pa.array([b"".join(t) for t in texts], pa.binary())],
                                  names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", memory: int = 200, lot: int = 100_000) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of its ``ids``."""
    from pyspark.sql.types import BinaryType, StructType
    e = encoded.select(*[encoded[c] for c in encoded.columns if c != "decoded"])
    schema = StructType([*e.schema.fields]).add("decoded", BinaryType())
    return e.mapInArrow(_decoded(ranks, memory, lot, e.columns.index(ids)), schema)


def round_trip(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
               memory: int = 200, lot: int = 20_000, long_piece: int = 128, most: int = 800_000,
               decode_lot: int = 100_000) -> DataFrame:
    """(doc_id, ids, decoded): ``decode`` of ``encode``, both in the same Python worker.

    The ids do not travel between workers, and half as many workers learn words; so each may remember more.
    """
    coded = _encoded(ranks, pattern, memory, lot, long_piece, most)
    back = _decoded(ranks, memory, decode_lot, 1)
    d = rows_named(docs, doc_id, text)
    return (d.select(F.col(doc_id).cast("long"), text_of(d, text))
            .mapInArrow(lambda batches: back(coded(batches)), "doc_id long, ids array<int>, decoded binary")
            .withColumnRenamed("doc_id", doc_id))
