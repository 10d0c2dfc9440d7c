"""Line deduplication by winnowing over line hashes.

A line is compared without ASCII white space at its ends; lines without a word
take no part. From each line runs the least window of whole lines that has
min_words words, and to each line another one. A window's fingerprint is the
least hash among its lines (winnowing, Schleimer et al. 2003): wherever the same run
of lines stands, the same line is selected, so every repeated run of min_words words
is guaranteed to share fingerprints.

The positions of a fingerprint are joined: each of them with the first one, in order of
document and line, around which the window has the same lines. Matches that overlap on one
diagonal of two documents become one, and are extended both ways, line by line, while both documents
have the same lines. A match that has min_words words is deleted from the later document. A position whose
first match ends early has windows of its own further on, so what is deleted is the union
of all maximal runs of min_words words that an earlier place has too, whichever that is.

Windows are found by range frames over the running number of words, and
nothing is paired within a group: each position meets the first one alone, so a line
that stands in a third of all documents costs one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.llm.common import SPACE, cut, table, words

MIN_WORDS = 50


def _key(docs: DataFrame) -> list[Column]:
    """A document's place in the order; rows that repeat id and text are one document."""
    return [docs["doc_id"].alias("doc_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_key")]


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line, h, n): place, hash and number of words of each line with a word."""
    line = F.btrim(F.col("raw"), F.lit(SPACE))
    found = docs.select(*_key(docs), F.posexplode(F.split(F.coalesce(docs["text"], F.lit("")), "\n")).alias("line", "raw"))
    return found.select("doc_id", "text_key", "line", F.xxhash64(line).alias("h"), F.size(words(line)).cast("long").alias("n")).where("n > 0")


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text_key, first, last, fingerprint, content) of every window; lines are counted among those with words."""
    doc = Window.partitionBy("doc_id", "text_key")
    so_far = doc.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    upto = lines.withColumns({"k": F.count("*").over(so_far).cast("int") - 1, "upto": F.sum("n").over(so_far)}).withColumn("before", F.col("upto") - F.col("n"))
    ahead = doc.orderBy("before").rangeBetween(0, min_words - 1)
    back = doc.orderBy("upto").rangeBetween(-(min_words - 1), 0)
    framed = upto.withColumns(
        {
            "from_here": F.struct(F.col("k").alias("first"), F.max("k").over(ahead).alias("last"), F.collect_list("h").over(ahead).alias("hashes"), (F.max("upto").over(ahead) - F.col("before")).alias("n_words")),
            "to_here": F.struct(F.min("k").over(back).alias("first"), F.col("k").alias("last"), F.collect_list("h").over(back).alias("hashes"), (F.col("upto") - F.min("before").over(back)).alias("n_words")),
        }
    )
    both = framed.select("doc_id", "text_key", F.explode(F.array("from_here", "to_here")).alias("w")).select("doc_id", "text_key", "w.*")
    return both.where(F.col("n_words") >= min_words).select("doc_id", "text_key", "first", "last", F.array_min("hashes").alias("fingerprint"), F.xxhash64("hashes").alias("content"))


def _matches(windows: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, last, o_id, o_key, shift): stretches of lines that an earlier place, shift lines before, has too."""
    place = F.struct("doc_id", "text_key", "first", "last")
    same = ["fingerprint", "content"]
    firsts = windows.groupBy(*same).agg(F.min(place).alias("origin"), F.max(place).alias("final")).where("origin != final").drop("final")
    later = windows.join(firsts, same).where(place > F.col("origin"))
    met = later.select("doc_id", "text_key", "first", "last", F.col("origin.doc_id").alias("o_id"), F.col("origin.text_key").alias("o_key"), (F.col("first") - F.col("origin.first")).alias("shift")).distinct()
    diagonal = ["doc_id", "text_key", "o_id", "o_key", "shift"]
    order = Window.partitionBy(*diagonal).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = met.withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    joined = joined.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(*diagonal, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def _agreeing(a: Column, b: Column) -> Column:
    """How many elements two arrays of one length have in common at their start."""
    odd = F.array_position(F.zip_with(a, b, lambda x, y: x == y), F.lit(False))
    return F.when(odd > 0, odd - 1).otherwise(F.size(a)).cast("int")


def _from(x: Column, start: Column, n: Column) -> Column:
    return F.slice(x, start + 1, n)


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, line, following): lines with words to delete, counted from 0, and the next one that has words."""
    lines = cut(_lines(docs).distinct())
    matches = cut(_matches(cut(_windows(lines, min_words))))
    either = matches.select("doc_id", "text_key").union(matches.select("o_id", "o_key")).distinct().withColumnsRenamed({"doc_id": "e_id", "text_key": "e_key"})
    met = lines.join(either, lines["doc_id"].eqNullSafe(either["e_id"]) & (lines["text_key"] == either["e_key"]), "left_semi")
    whole = met.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("line", "h", "n"))).alias("lines"))  # a document's own lines
    own = whole.select(F.col("doc_id").alias("a_id"), F.col("text_key").alias("a_key"), F.col("lines").alias("own"))
    other = whole.select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key"), F.col("lines.h").alias("y"))
    both = matches.join(own, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_key") == F.col("a_key"))).join(other, F.col("o_id").eqNullSafe(F.col("b_id")) & (F.col("o_key") == F.col("b_key")))
    x, y, first, last = F.col("own.h"), F.col("y"), F.col("first"), F.col("last")
    there, after = first - F.col("shift"), last - F.col("shift") + 1
    n_before, n_after = F.least(first, there), F.least(F.size(x) - last - 1, F.size(y) - after)
    left = _agreeing(F.reverse(_from(x, first - n_before, n_before)), F.reverse(_from(y, there - n_before, n_before)))
    right = _agreeing(_from(x, last + 1, n_after), _from(y, after, n_after))
    run = both.select("doc_id", "text_key", "own", (first - left).alias("first"), (last + right).alias("last"))
    n_words = F.aggregate(_from(F.col("own.n"), F.col("first"), F.col("last") - F.col("first") + 1), F.lit(0).cast("long"), lambda s, n: s + n)
    k = F.explode(F.sequence("first", "last"))
    gone = run.where(n_words >= min_words).select("doc_id", "text_key", F.col("own.line").alias("lines"), k.alias("k"))
    return gone.select("doc_id", "text_key", F.get("lines", F.col("k")).alias("line"), F.get("lines", F.col("k") + 1).alias("following")).distinct()


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, text, ...) with texts rid of repeated lines, n_lines and n_removed.

    A run of lines goes if it has min_words words and stands earlier, too. n_lines counts the lines with a word. A run that repeats within its own
    document is deleted as well. Lines without a word go with a run that they
    lie in, and stay elsewhere. The first of equal runs stays, by doc_id (null
    first), then by hash of the text, then by line. Rows that
    repeat id and text are one document and are cut alike. Null texts stay null, an empty
    table stays empty. Own columns named n_lines or n_removed give way.
    """
    new = ["n_lines", "n_removed"]
    gone = repeated_lines(docs, min_words).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("line", "following"))).alias("gone"))  # a document's own lines
    gone = gone.withColumnsRenamed({"doc_id": "g_id", "text_key": "g_key"})
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c not in new]).alias("row"), *_key(docs))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["g_id"]) & (rows["text_key"] == gone["g_key"]), "left")
    split = joined.select("row", "gone", F.split(F.col("row.text"), "\n").alias("all"))
    n = F.size("all")
    start = F.array(F.struct(F.lit(-1).alias("line"), F.lit(-1).alias("following")))
    edges = F.concat(start, F.col("gone")), F.concat(F.col("gone.line"), F.array(n))
    between = F.flatten(F.zip_with(*edges, lambda a, b: F.slice("all", a["line"] + 2, F.when(a["following"].eqNullSafe(b), 0).otherwise(b - a["line"] - 1))))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(between, "\n"))
    counted = F.coalesce(F.size(F.filter("all", lambda x: F.btrim(x, F.lit(SPACE)) != "")), F.lit(0))
    kept = split.select("row", text.alias("cleaned"), F.when(F.col("row.text").isNull(), 0).otherwise(counted).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    kept = kept.withColumn("n_removed", F.greatest("n_removed", F.lit(0).cast("long")))
    return kept.select(*[F.col("cleaned").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in new], *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document: what was deleted, and what stays by length and MD5 sum."""
    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.char_length(text).cast("long").alias("kept_chars"), F.md5(text).alias("kept_md5"))


#: Brute force: all pairs of equal lines, and their maximal runs on each diagonal of two documents; no hashes, no windows.
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l AS (SELECT r, i, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, CAST(len(list_filter(string_split_regex(raw, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n FROM s),
k AS (SELECT *, CAST(count(*) FILTER (n > 0) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS k FROM l),
u AS (SELECT * FROM k WHERE n > 0),
p AS (SELECT a.r, b.r AS o, a.k - b.k AS shift, a.k, a.n FROM u a JOIN u b ON a.t = b.t AND (b.r < a.r OR (b.r = a.r AND b.k < a.k))),
m AS (SELECT r, min(k) AS first, max(k) AS last FROM (SELECT *, k - row_number() OVER (PARTITION BY r, o, shift ORDER BY k) AS run FROM p) GROUP BY r, o, shift, run HAVING sum(n) >= {MIN_WORDS}),
g AS (SELECT DISTINCT r, unnest(range(first, last + 1)) AS k FROM m),
x AS (SELECT k.*, g.k IS NOT NULL AND (n > 0 OR h.k IS NOT NULL) AS gone FROM k LEFT JOIN g ON g.r = k.r AND g.k = k.k LEFT JOIN g h ON h.r = k.r AND h.k = k.k + 1),
y AS (SELECT r, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (n > 0 AND gone) AS n_removed, string_agg(CASE WHEN NOT gone THEN raw END, chr(10) ORDER BY i) AS kept FROM x GROUP BY r)
SELECT doc_id, n_lines, n_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, md5(coalesce(kept, '')) AS kept_md5 FROM d JOIN y ON y.r = d.r"""
