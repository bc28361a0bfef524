"""Secret scans over an incremental blob ledger (operator 6).

A text is a blob, named by its SHA-256; a row (a path, or one historical
version of it) points to its blob. The ledger holds one row per (blob, rule
version) that has been scanned, with its spans, also where nothing was
found. A scan

1. names the blobs of all rows and keeps one row per blob (combined before
   the shuffle, so copies cost nothing more);
2. asks the ledger which rule versions each blob has seen, and reads the
   text only of blobs with a missing pair;
3. scans those pairs alone and appends them to the ledger;
4. joins the findings of the current rule versions back to every row.

A new rule version rescans every blob for that rule only; a new version of a
file scans one blob. Where few blobs are unseen (one in ten at most), their names are
broadcast and no other text is shuffled; else every text moves once. Spans are found with built-in functions: ``split``
and ``regexp_extract_all`` on one pattern give the pieces between and the
matches; their lengths, one row a match, are summed up by a window per blob
and rule, so the work follows the number of matches, whatever one text holds.
Beside its code points a span knows its bytes, and the end of all spans up to
it; so masking cuts a text at known bytes, each piece once.

Defined cases: null text counts as empty; rows that repeat an id are rows of
their own; null ids are kept; empty table -> empty result and an unchanged
ledger; columns of the input are carried by ``scan`` (its own two replace those
of the same name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_small, shared_folder, written


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str              # leftmost, non-overlapping
    least: int                # code points that the measured group must have
    group: int = 0            # the group that is measured


# The base kinds of the contract, in its order.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24),
)

#: Unseen blobs are few if they are one in so many, or fewer.
_FEW = 10

_FIELDS = [("start", T.LongType()), ("rank", T.IntegerType()), ("stop", T.LongType()), ("kind", T.StringType()),
           ("low", T.IntegerType()), ("high", T.IntegerType())]
#: A span: code points start to stop, place and name of its kind, bytes low to high.
SPAN = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in _FIELDS]))
#: ... and the last byte of it and all spans before it, in the order of a text's spans.
FOUND = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in [*_FIELDS, ("reach", T.IntegerType())]]))
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("kind", T.StringType()),
                       T.StructField("version", T.IntegerType()), T.StructField("spans", SPAN)])


def matches(text: Column, rule: Rule) -> Column:
    """array<struct> of the matches of ``rule``: sizes of the gap before and of the match, and whether it passes."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), F.zip_with(found, measured, lambda m, g: F.struct(
        m.alias("m"), (F.length(g) >= rule.least).alias("ok"))), lambda gap, m: F.struct(
            F.length(gap).cast("long").alias("gap"), F.length(m["m"]).cast("long").alias("n"),
            F.octet_length(gap).alias("gap_bytes"), F.octet_length(m["m"]).alias("n_bytes"), m["ok"].alias("ok")))
    return F.when(F.rlike(text, pattern), steps).otherwise(F.slice(steps, 1, 0))


def new_ledger(spark) -> str:
    """An empty ledger in the shared folder; returns its path."""
    path = shared_folder(spark, "secret-ledger")
    spark.createDataFrame([], LEDGER).write.parquet(path)
    return path


def _input(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(row: all columns of ``docs`` as one struct, id, body, blob), so that no name can clash with ours."""
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    body = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    return d.select("row", F.col("row")[id_col].cast("string").alias("id"), body.alias("body"), F.sha2(body, 256).alias("blob"))


def _names(rules) -> list[str]:
    return [f"{r.kind}@{r.version}" for r in rules]


def unseen(docs: DataFrame, ledger: str, id_col: str, text: str, rules=RULES) -> DataFrame:
    """(blob, body, todo): one row per blob (more where rows repeat its least id) with the kinds whose current
    version it has not seen."""
    spark = docs.sparkSession
    d = _input(docs, id_col, text).select(F.coalesce("id", F.lit("")).alias("id"), "body", "blob")
    # One row stands for each blob; joining on (blob, id) spreads a blob with many copies.
    least = d.groupBy("blob").agg(F.min("id").alias("id"))
    seen = (spark.read.schema(LEDGER).parquet(ledger).groupBy("blob")
            .agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("seen")))
    names = F.array(*[F.lit(n) for n in _names(rules)])
    asked = least.join(seen, "blob", "left").select(
        "blob", "id", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
    # Written, so that its size is known. Few unseen blobs among many seen ones are broadcast, and no text moves; where
    # many are unseen (a first scan), every text moves once, whatever the size, and one with many copies is spread.
    tally = Observation()
    counted = asked.observe(tally, F.count(F.lit(1)).alias("blobs"), F.count_if(F.size("todo") > 0).alias("unseen"))
    todo = written(counted.where(F.size("todo") > 0), "secret-todo")
    few = tally.get["unseen"] * _FEW <= tally.get["blobs"]
    return d.join(broadcast_small(todo) if few else todo.hint("merge"), ["blob", "id"]).select("blob", "body", "todo")


def update(docs: DataFrame, ledger: str, id_col: str = "doc_id", text: str = "text", rules=RULES) -> None:
    """Scan the unseen (blob, rule version) pairs of ``docs`` and append them to the ledger."""
    new = unseen(docs, ledger, id_col, text, rules)
    per_rule = [F.when(F.array_contains("todo", name), F.struct(
        F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(i).alias("rank"),
        matches(F.col("body"), r).alias("found"))) for i, (r, name) in enumerate(zip(rules, _names(rules), strict=True))]
    hits = written(new.select("blob", F.explode(F.filter(F.array(*per_rule), lambda x: x.isNotNull())).alias("f"))
                   .select("blob", "f.kind", "f.version", "f.rank", "f.found")
                   .dropDuplicates(["blob", "kind", "version"]), "secret-hits")
    none = hits.where(F.size("found") == 0).select("blob", "kind", "version", F.array().cast(SPAN).alias("spans"))
    each = hits.where(F.size("found") > 0).select("blob", "kind", "version", "rank", F.posexplode("found").alias("at", "m"))
    before = Window.partitionBy("blob", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("m.gap") + F.col("m.n")).over(before)
    high = F.sum(F.col("m.gap_bytes") + F.col("m.n_bytes")).over(before).cast("int")
    span = F.struct((F.col("stop") - F.col("m.n")).alias("start"), "rank", "stop", "kind",
                    (F.col("high") - F.col("m.n_bytes")).alias("low"), "high")
    spans = (each.select("*", stop.alias("stop"), high.alias("high"))
             .groupBy("blob", "kind", "version")
             .agg(F.sort_array(F.collect_list(F.when(F.col("m.ok"), span))).cast(SPAN).alias("spans")))
    none.unionByName(spans).write.mode("append").parquet(ledger)


def scan(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text: str = "text",
         rules=RULES) -> DataFrame:
    """``docs`` with ``secret_spans`` (sorted by start, then kind as listed) and ``blob_sha256`` added."""
    spark = docs.sparkSession
    ledger = ledger or new_ledger(spark)
    update(docs, ledger, id_col, text, rules)
    current = F.concat_ws("@", "kind", "version").isin(*_names(rules))
    # A replayed append or a repeated id may hold a pair twice; one span is kept.
    # A table of its own, so that the join can split a blob with very many paths.
    up_to = Window.partitionBy("blob").orderBy("s.start", "s.rank", "s.stop").rowsBetween(Window.unboundedPreceding, 0)
    found = written(spark.read.schema(LEDGER).parquet(ledger).where(current)
                    .select("blob", F.explode("spans").alias("s")).distinct()
                    .withColumn("reach", F.max("s.high").over(up_to))
                    .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("s.*", "reach"))).cast(FOUND).alias("spans")),
                    "secret-findings")
    d = _input(docs, id_col, text).select("row", F.col("blob").alias("own"))
    return (d.join(broadcast_small(found), F.col("own") == F.col("blob"), "left")
            .select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("secret_spans", "blob_sha256")],
                    F.coalesce("spans", F.array().cast(FOUND)).alias("secret_spans"), F.col("own").alias("blob_sha256")))


def joined(found: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every run of overlapping spans (of ``scan``) replaced by ``mark``."""

    def masked(raw: Column, spans: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            """The text from the end of all earlier spans to this one; null if they overlap."""
            done = F.when(i > 0, F.get(spans, i - 1)["reach"]).otherwise(F.lit(0))
            return F.when((i == 0) | (s["low"] >= done), F.substring(raw, done + 1, s["low"] - done).cast("string"))

        pieces = F.filter(F.transform(spans, piece), lambda p: p.isNotNull())
        rest = F.substring(raw, F.get(spans, F.size(spans) - 1)["reach"] + 1, F.octet_length(raw)).cast("string")
        return F.concat(F.array_join(pieces, mark), F.lit(mark), rest)

    # The bytes are made once, as the variable of a lambda, not once a piece.
    once = F.transform(F.array(F.struct(text.cast("binary").alias("raw"), found.alias("spans"))),
                       lambda x: masked(x["raw"], x["spans"]))
    return F.when(F.size(found) == 0, text).otherwise(F.get(once, F.lit(0)))
