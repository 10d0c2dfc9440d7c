"""Quality rules whose thresholds adapt to each language and source.

Every text gives integer counts; some of their ratios (per thousand) are rule
metrics. For each (lang, source) and metric a quantile sketch is built: a
histogram over log-linear buckets, five leading binary digits each, so its
relative error is below 1/16, it holds at most some hundred buckets, and it is
merged by adding counts: those of a language's sources are its sketch, and all
of them the corpus's. The fences lie three quartile
distances beyond the quartiles plus a slack, so a source of sound texts loses
none of them, whatever its habits are. A source's fences are drawn to its language's,
and those to the corpus's, as if GROUP_DOCS documents more had theirs: a source of few documents
has mostly its language's, one of many its own, and none is switched from one to the other. The rules
then join the fences to the documents and filter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.llm.common import broadcast_if_small, cut, table

MIN_WORDS = 50
REPEAT_PERCENT = 50
GROUP_DOCS = 20  # documents that the fences of the wider group weigh
QUARTILE_DISTANCES = 3
#: Rule metric, its slack beyond the fence, whether small values fail as well.
METRICS = {
    "symbols": (100, False),
    "dup_lines": (100, False),
    "repeats": (300, False),
    "marks": (400, False),
    "capitals": (150, False),
    "word_length": (150, True),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_capitals"]

# Classes of bytes: 1 continuation, 2 white space, 3 symbol, 4 other ASCII mark, 5 capital.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x80:0xC0] = 1
_CLASS[[0x20, *range(0x09, 0x0E)]] = 2
_CLASS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 4
_CLASS[[*b"#*$%&|<>"]] = 3
_CLASS[0x41:0x5B] = 5


class WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def repeated_words(found: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(found) < 4:
        return 0
    ids = WordIds()
    code = np.fromiter(map(ids.__getitem__, found), np.int64, len(found))
    pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * np.int64(len(ids)) + code[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    covered = np.zeros(len(found), bool)
    for i in range(3):
        covered[i : i + len(twice)] |= twice
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def counts_of(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    found = text.split()
    of = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=6)
    return len(found), len(text) - int(of[1] + of[2]), int(of[3]), repeated_lines(text), repeated_words(found), int(of[3] + of[4]), int(of[5])


def text_counts():
    """UDF over UTF-8 bytes: COUNTS as a struct."""

    @F.pandas_udf(", ".join(f"{name} long" for name in COUNTS))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([counts_of(text) for text in texts], columns=COUNTS)

    return counts.asNondeterministic()  # else a filter on a count is pushed down with a second call of its own


#: The metrics over the counts; integer division rounds down in either dialect.
METRIC_SQL = {
    "symbols": "1000 * n_symbols {div} greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines {div} greatest(n_words, 1)",
    "repeats": "1000 * n_repeat_words {div} greatest(n_words, 1)",
    "marks": "1000 * n_marks {div} greatest(n_words, 1)",
    "capitals": "1000 * n_capitals {div} greatest(word_chars, 1)",
    "word_length": "100 * word_chars {div} greatest(n_words, 1)",
}


def bucket(value: Column) -> Column:
    """Lower bound of a value's sketch bucket: its five leading binary digits."""
    drop = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def counted(docs: DataFrame) -> DataFrame:
    """(row, counts, metrics): each whole row as a struct, so that no name can clash."""
    found = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_counts()(docs["text"].cast("binary")).alias("c"))
    metrics = F.struct(*[F.expr(f"{sql.format(div='div')}").alias(m) for m, sql in METRIC_SQL.items()])
    return found.select("row", "c", "c.*").select("row", "c", metrics.alias("m"))


def _key(level: Column, lang: Column, source: Column) -> Column:
    """Names a sketch; a null part is left out of the JSON text, unlike an empty one."""
    return F.to_json(F.struct(level.alias("l"), lang.alias("a"), source.alias("b")))


def fences(found: DataFrame, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(lang, source, docs, and a fence hi_ or lo_ for each metric) from counted().

    One row for each (lang, source) that has a text with words. Only counts of
    buckets are shuffled: their number depends on languages and sources, not on
    documents.
    """
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(f"m.{m}")).alias("bucket")) for m in METRICS])
    base = cut(
        found.where("c.n_words > 0")
        .select(F.col("row.lang").alias("lang"), F.col("row.source").alias("source"), F.inline(rows))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )
    none = F.lit(None).cast("string")
    lang, source = F.col("lang"), F.col("source")
    own, of_lang, of_all = _key(F.lit(2), lang, source), _key(F.lit(1), lang, none), _key(F.lit(0), none, none)
    merged = base.select("metric", "bucket", "n", F.explode(F.array(own, of_lang, of_all)).alias("key"))
    merged = merged.groupBy("key", "metric", "bucket").agg(F.sum("n").alias("n"))
    of = Window.partitionBy("key", "metric")  # some hundred buckets
    running = merged.withColumns({"upto": F.sum("n").over(of.orderBy("bucket")), "all": F.sum("n").over(of)})
    quartiles = running.groupBy("key", "metric").agg(
        F.max("all").alias("docs"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"),
    )
    reach = QUARTILE_DISTANCES * (F.col("q3") - F.col("q1"))
    limits = {}
    for m, (slack, below) in METRICS.items():
        limits[f"hi_{m}"] = F.max(F.when(F.col("metric") == m, F.col("q3") + reach + slack))
        if below:
            limits[f"lo_{m}"] = F.max(F.when(F.col("metric") == m, F.greatest(F.col("q1") - reach - slack, F.lit(0))))
    by_key = cut(quartiles.groupBy("key").agg(F.max("docs").alias("docs"), *[c.alias(k) for k, c in limits.items()]))
    drawn = base.select("lang", "source").distinct().withColumns({"k2": own, "k1": of_lang, "k0": of_all})
    for k in ("k2", "k1", "k0"):
        level = by_key.withColumnsRenamed({"key": k} | {c: f"{c}_{k}" for c in ["docs", *limits]})
        drawn = drawn.join(broadcast_if_small(level), k)

    def mean(docs: str, own: Column, wider: Column) -> Column:
        total = F.col(docs) * own + group_docs * wider
        return F.call_function("div", total, F.col(docs) + group_docs)

    blended = [mean("docs_k2", F.col(f"{c}_k2"), mean("docs_k1", F.col(f"{c}_k1"), F.col(f"{c}_k0"))).alias(c) for c in limits]
    return cut(drawn.select("lang", "source", F.col("docs_k2").alias("docs"), *blended))


def judged(found: DataFrame, limits: DataFrame) -> DataFrame:
    """counted() rows with base_failed and kept."""
    limits = limits.withColumnsRenamed({c: f"f_{c}" for c in limits.columns})
    same = F.col("row.lang").eqNullSafe(F.col("f_lang")) & F.col("row.source").eqNullSafe(F.col("f_source"))
    failed = (F.col("c.n_words") < MIN_WORDS) | (100 * F.col("c.n_repeat_words") > REPEAT_PERCENT * F.col("c.n_words"))
    passes = F.lit(True)
    for m, (_, below) in METRICS.items():
        passes &= F.col(f"m.{m}") <= F.col(f"f_hi_{m}")
        if below:
            passes &= F.col(f"m.{m}") >= F.col(f"f_lo_{m}")
    return found.join(broadcast_if_small(limits), same, "left").select("row", "c", failed.alias("base_failed"), (~failed & F.coalesce(passes, F.lit(False))).alias("kept"))


def quality_rules(docs: DataFrame, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for every row of docs(doc_id, text, lang, source).

    A null or blank text has no words and fails the base rule; null languages
    and sources are groups of their own; repeated rows are judged alike; an
    empty table gives an empty result. group_docs is the weight of the wider group's fences.
    """
    found = cut(counted(docs.select("doc_id", "text", "lang", "source")).withColumn("row", F.col("row").dropFields("text")))
    return judged(found, fences(found, group_docs)).select("row.doc_id", *[f"c.{c}" for c in COUNTS], "base_failed", "kept")


def keep_good(docs: DataFrame, group_docs: int = GROUP_DOCS) -> DataFrame:
    """The rows of docs that pass, with their own columns.

    The counts are computed twice, for the sketches and for the filter, so that
    texts are never shuffled or stored.
    """
    found = counted(docs)
    return judged(found, fences(found, group_docs)).where("kept").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("n_marks", "n_capitals")


def _oracle() -> str:
    div = {m: sql.format(div="//") for m, sql in METRIC_SQL.items()}
    low = "CASE WHEN length(bin({v})) > 5 THEN ({v} >> (length(bin({v})) - 5)) << (length(bin({v})) - 5) ELSE {v} END"
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {low.format(v=m)} AS bucket FROM metrics WHERE n_words > 0" for m in METRICS)
    hi = ", ".join(
        f"max(CASE WHEN metric = '{m}' THEN q3 + {QUARTILE_DISTANCES} * (q3 - q1) + {slack} END) AS hi_{m}, max(CASE WHEN metric = '{m}' THEN greatest(q1 - {QUARTILE_DISTANCES} * (q3 - q1) - {slack}, 0) END) AS lo_{m}"
        for m, (slack, _) in METRICS.items()
    )
    blended = ", ".join(f"(o.docs * o.{x}_{m} + {GROUP_DOCS} * ((w.docs * w.{x}_{m} + {GROUP_DOCS} * c.{x}_{m}) // (w.docs + {GROUP_DOCS}))) // (o.docs + {GROUP_DOCS}) AS {x}_{m}" for m in METRICS for x in ("hi", "lo"))
    ok = " AND ".join(f"{m} <= hi_{m}" + (f" AND {m} >= lo_{m}" if below else "") for m, (_, below) in METRICS.items())
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT r, unnest(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS w,
              generate_subscripts(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), 1) AS i FROM t),
w1 AS (SELECT r, i, w, lead(w, 1) OVER d AS x, lead(w, 2) OVER d AS y FROM w0 WINDOW d AS (PARTITION BY r ORDER BY i)),
w2 AS (SELECT r, i, w, y IS NOT NULL AND count(*) OVER (PARTITION BY r, w, x, y) > 1 AS twice FROM w1),
w3 AS (SELECT r, w, twice OR coalesce(lag(twice, 1) OVER d, FALSE) OR coalesce(lag(twice, 2) OVER d, FALSE) AS covered FROM w2 WINDOW d AS (PARTITION BY r ORDER BY i)),
w4 AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(CASE WHEN covered THEN 1 ELSE 0 END) AS n_repeat_words FROM w3 GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t),
l1 AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (SELECT t.r, doc_id, lang, source, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
   CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
   CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
   CAST(length(regexp_replace(text, '[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS BIGINT) AS n_marks,
   CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
   FROM t LEFT JOIN w4 ON t.r = w4.r LEFT JOIN l1 ON t.r = l1.r),
metrics AS (SELECT *, {", ".join(f"{sql} AS {m}" for m, sql in div.items())} FROM counts),
base AS (SELECT lang, source, metric, bucket, count(*) AS n FROM ({long}) GROUP BY ALL),
merged AS (SELECT 2 AS l, lang AS a, source AS b, metric, bucket, n FROM base UNION ALL SELECT 1, lang, NULL, metric, bucket, n FROM base UNION ALL SELECT 0, NULL, NULL, metric, bucket, n FROM base),
sums AS (SELECT l, a, b, metric, bucket, sum(n) AS n FROM merged GROUP BY ALL),
running AS (SELECT *, sum(n) OVER (PARTITION BY l, a, b, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY l, a, b, metric) AS every FROM sums),
quartiles AS (SELECT l, a, b, metric, max(every) AS docs, min(CASE WHEN 4 * upto >= every THEN bucket END) AS q1, min(CASE WHEN 4 * upto >= 3 * every THEN bucket END) AS q3 FROM running GROUP BY ALL),
limits AS (SELECT l, a, b, max(docs) AS docs, {hi} FROM quartiles GROUP BY l, a, b),
own AS (SELECT o.a AS lang, o.b AS source, {blended} FROM limits o JOIN limits w ON o.l = 2 AND w.l = 1 AND w.a IS NOT DISTINCT FROM o.a JOIN limits c ON c.l = 0),
failed AS (SELECT metrics.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM metrics)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({ok}, FALSE) AS kept
FROM failed LEFT JOIN own ON failed.lang IS NOT DISTINCT FROM own.lang AND failed.source IS NOT DISTINCT FROM own.source"""


ORACLE_SQL = _oracle()

cloudpickle.register_pickle_by_value(sys.modules[__name__])
