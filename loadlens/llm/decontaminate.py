"""Benchmark decontamination: SimHash windows, Hamming blocks, exact verification.

Words are hashed to 64 bits. The SimHash of a window has bit i set if more than half
of its words' hashes have it. An item is searched by windows sized by the item: the largest of
16, 8 and 4 words that any copy which passes PERCENT keeps word for word. They start at every word of items and texts.
A break inside a copy costs it at least four shingles, so that a copy that passes has an unbroken run of 16 words if the item has
17 or more, of 8 if it has 8 or more, and is whole below, unless four of the item's words stand in it twice.
Windows as long as the item itself miss copies (README): at 0.75 their SimHashes lie further apart than blocks can bridge.
Items and texts below five words are one shingle; such an item meets only texts of the same words.

The 64 bits are counted all at once: four words go through a carry-save adder
that leaves the count of each bit in three planes; two or four such blocks are
added plane by plane. All of it is bitwise arithmetic on the JVM.

Fingerprints within RADIUS bits agree in at least one of RADIUS + 1 parts, so an
index of the parts finds every such pair. A hit aligns the item with the text; the
item-sized stretch of text that it names is compared with the item exactly: the
weighted Jaccard similarity of five-word shingles, a shingle weighing as often as it occurs.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import ascii_lower, broadcast_if_small, cut, table, words

RADIUS = 3
PARTS = RADIUS + 1
PART_BITS = 64 // PARTS
BLOCK = 4  # words
#: Words of a window, and of the shortest item that it is for.
WINDOWS = {16: 17, 8: 8, 4: 5}
SHINGLE = 5
PERCENT = 75
INDEX_ROWS = 1_000_000  # of the index, broadcast at once; a larger one takes its turns
IDS = 500_000


def _and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def _or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _planes(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """How many of four words have each bit, in three planes."""
    odd = _xor(_xor(a, b), c)
    pair = _or(_and(a, b), _and(c, _xor(a, b)))
    more = _and(odd, d)
    return [_xor(odd, d), _xor(pair, more), _and(pair, more)]


def _added(x: list[Column], y: list[Column]) -> list[Column]:
    """Sum of two counts of as many planes, one plane longer."""
    out, carry = [_xor(x[0], y[0])], _and(x[0], y[0])
    for a, b in zip(x[1:], y[1:], strict=True):
        half = _xor(a, b)
        out.append(_xor(half, carry))
        carry = _or(_and(a, b), _and(carry, half))
    return [*out, carry]


def _fingerprints(rows: DataFrame) -> DataFrame:
    """rows(id, words) as (id, start, f16, f8, f4): the SimHash of the windows at each word.

    A window that would run over the end has none.
    """
    most = max(WINDOWS)
    hashed = rows.select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("h0"))
    shifted = [F.slice("h0", 1 + k, F.greatest(F.size("h0") - k, F.lit(0))).alias(f"h{k}") for k in range(1, most)]
    zipped = hashed.select("id", "h0", *shifted).select("id", F.posexplode(F.arrays_zip(*[f"h{k}" for k in range(most)])).alias("at", "z"))
    at = zipped.select("id", F.col("at").cast("long").alias("start"), *[F.col(f"z.h{k}").alias(f"h{k}") for k in range(most)])
    blocks = [_planes(*[F.col(f"h{BLOCK * i + j}") for j in range(BLOCK)]) for i in range(4)]
    counted = at.select("id", "start", *[c.alias(f"x{i}{j}") for i, p in enumerate(blocks) for j, c in enumerate(p)])
    x = [[F.col(f"x{i}{j}") for j in range(3)] for i in range(4)]
    first, second = _added(x[0], x[1]), _added(x[2], x[3])
    over2 = _or(x[0][2], _and(x[0][1], x[0][0]))  # 3 or 4 of 4
    halves = counted.select("id", "start", over2.alias("f4"), *[c.alias(f"y{j}") for j, c in enumerate(first)], *[c.alias(f"w{j}") for j, c in enumerate(second)])
    y, w = [F.col(f"y{j}") for j in range(4)], [F.col(f"w{j}") for j in range(4)]
    t = _added(y, w)
    over4 = _or(y[3], _and(y[2], _or(y[1], y[0])))  # 5 to 8 of 8
    over8 = _or(t[4], _and(t[3], _or(t[2], _or(t[1], t[0]))))  # 9 to 16 of 16
    return halves.select("id", "start", over8.alias("f16"), over4.alias("f8"), "f4")


def _parts(sizes: list[int]) -> Column:
    """Window size, number and bits of each part of the fingerprints, as one number, with the fingerprint."""
    out = []
    for n in sizes:
        f = F.col(f"f{n}")
        bits = [_and(F.shiftrightunsigned(f, PART_BITS * i), F.lit(2**PART_BITS - 1)) + (PARTS * n + i) * 2**PART_BITS for i in range(PARTS)]
        out += [F.struct(b.alias("part"), f.alias("f")) for b in bits]
    return F.explode(F.array(*out))


def _window() -> Column:
    """Words of an item's windows; null for items that have none."""
    n = F.lit(None).cast("int")
    for size, least in sorted(WINDOWS.items()):
        n = F.when(F.col("n_words") >= least, size).otherwise(n)
    return n


def _items(benchmark: DataFrame) -> DataFrame:
    """(key, item_id, words, n_words): a row for each different text of an id; the key names it. Rows without id or words go."""
    found = benchmark.select("item_id", words(ascii_lower(F.col("text"))).alias("words")).withColumn("n_words", F.size("words"))
    found = found.where("n_words > 0 and item_id is not null").dropDuplicates(["item_id", "words"])
    return found.withColumn("key", F.xxhash64("item_id", "words"))


def _window_hits(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Hits by near fingerprints. An index beyond INDEX_ROWS is broadcast piece by piece."""
    windowed = items.withColumn("window", _window()).where("window is not null")
    sizes = sorted(r.window for r in windowed.select("window").distinct().collect())  # of WINDOWS
    if not sizes:
        return texts.select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("start")).limit(0)
    made = _fingerprints(windowed.select(F.struct("key", "window").alias("id"), "words"))
    entries = made.select("id", F.col("start").alias("offset"), _parts(sizes).alias("e")).where(F.floor(F.col("e.part") / (PARTS * 2**PART_BITS)) == F.col("id.window"))
    index = cut(entries.select(F.col("id.key").alias("key"), "offset", F.col("e.part").alias("part"), F.col("e.f").alias("item_f")).distinct())
    probes = _fingerprints(texts).select("id", "start", _parts(sizes).alias("e")).select("id", "start", F.col("e.part").alias("part"), F.col("e.f").alias("f"))
    turns = math.ceil(index.count() / INDEX_ROWS)
    met = [probes.join(F.broadcast(index.where(F.pmod("part", F.lit(turns)) == k)), "part") for k in range(turns)]  # INDEX_ROWS about
    near = [m.where(F.bit_count(_xor(F.col("f"), F.col("item_f"))) <= RADIUS) for m in met]
    return reduce(DataFrame.union, near).select(F.col("id").alias("doc_id"), "key", (F.col("start") - F.col("offset")).alias("start"))


def _whole_hits(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Items below five words in texts of just these words."""
    short = items.where(F.col("n_words") < SHINGLE).select("key", "words")
    few = texts.where(F.size("words") < SHINGLE)
    return few.join(broadcast_if_small(cut(short)), "words").select(F.col("id").alias("doc_id"), "key", F.lit(0).cast("long").alias("start"))


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, key, start): where an item would begin for its windows to agree with the text's."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), words(ascii_lower(F.col("text"))).alias("words"))
    return _window_hits(texts, items).union(_whole_hits(texts, items)).distinct()


def _shingles(found: Column) -> Column:
    """All five-word shingles of an array of words; fewer words make one."""
    last = F.greatest(F.size(found) - SHINGLE, F.lit(0))
    return F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice(found, i, SHINGLE), " "))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, shared, in_either, similarity): the best place of each item in each document.

    Rows without an id and null, blank or short texts leak nothing; documents
    that repeat an id are searched each and reported together, and so are texts that repeat an item's. Several items
    in one document, and several places, are all found; the best place counts, the last among equals.
    """
    items = cut(_items(benchmark))
    hits = cut(_hits(docs, items))
    sizes = items.select("key", F.col("words").alias("item"), "n_words")
    hit = hits.join(broadcast_if_small(items.select("key", "n_words")), "key")
    docs_hit = broadcast_if_small(cut(hits.select("doc_id").distinct()), IDS)
    texts = docs.select("doc_id", "text").join(docs_hit, "doc_id", "left_semi").select("doc_id", words(ascii_lower(F.col("text"))).alias("words"))
    start = F.greatest(F.lit(0).cast("long"), F.least(F.col("start"), (F.size("words") - F.col("n_words")).cast("long")))
    placed = texts.join(hit, "doc_id").withColumn("at", start).select("doc_id", "key", "at", "n_words", F.slice("words", (F.col("at") + 1).cast("int"), F.col("n_words")).alias("stretch"))
    placed = placed.withColumn("t", F.xxhash64("stretch")).dropDuplicates(["doc_id", "key", "at", "t"])  # texts that share an id stay apart
    own = placed.select("doc_id", "key", "at", "n_words", "t", F.explode(_shingles(F.col("stretch"))).alias("g")).groupBy("doc_id", "key", "at", "n_words", "t", "g").agg(F.count("*").alias("n"))
    theirs = sizes.select("key", F.explode(_shingles(F.col("item"))).alias("g")).groupBy("key", "g").agg(F.count("*").alias("m"))
    totals = theirs.groupBy("key").agg(F.sum("m").alias("item_total"))
    both = own.join(theirs, ["key", "g"], "left").groupBy("doc_id", "key", "at", "n_words", "t").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("shared"), F.sum("n").alias("total"))
    scored = both.join(totals, "key").withColumn("in_either", F.col("total") + F.col("item_total") - F.col("shared")).where(100 * F.col("shared") >= PERCENT * F.col("in_either"))
    similarity = F.col("shared") / F.col("in_either")
    scored = scored.join(broadcast_if_small(items.select("key", "item_id")), "key")
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct(similarity.alias("similarity"), F.col("at"), "n_words", "shared", "in_either")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.at").alias("start_word"), F.col("b.n_words").alias("n_words"), "b.shared", "b.in_either", "b.similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with their own columns."""
    bad = cut(leaks(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct())
    return docs.join(broadcast_if_small(bad, IDS), docs["doc_id"] == bad["_bad"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Brute force: every place where an item shares a shingle with a text, no fingerprints.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 2))) AS i, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g, len(w) AS n FROM d WHERE len(w) > 0),
bs AS (SELECT item_id, unnest(range(1, greatest(len(w) - 3, 2))) AS j, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g, len(w) AS m FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT doc_id, item_id, greatest(0, least(i - j, n - m)) AS a, m FROM ds JOIN bs USING (g)),
wg AS (SELECT p.doc_id, p.item_id, p.a, p.m, ds.g, count(*) AS c FROM p JOIN ds ON ds.doc_id = p.doc_id AND ds.i > p.a AND ds.i <= p.a + greatest(p.m - 4, 1) GROUP BY ALL),
bg AS (SELECT item_id, g, count(*) AS c FROM bs GROUP BY ALL),
bt AS (SELECT item_id, sum(c) AS t FROM bg GROUP BY ALL),
s AS (SELECT doc_id, wg.item_id, a, m, sum(least(wg.c, coalesce(bg.c, 0))) AS shared, sum(wg.c) AS t FROM wg LEFT JOIN bg ON bg.item_id = wg.item_id AND bg.g = wg.g GROUP BY ALL),
f AS (SELECT doc_id, s.item_id, a, m, shared, s.t + bt.t - shared AS in_either FROM s JOIN bt ON bt.item_id = s.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / in_either DESC, a DESC) AS k FROM f WHERE 100 * shared >= 75 * in_either)
SELECT doc_id, item_id, CAST(a AS BIGINT) AS start_word, CAST(m AS INTEGER) AS n_words, CAST(shared AS BIGINT) AS shared, CAST(in_either AS BIGINT) AS in_either, shared / in_either AS similarity FROM r WHERE k = 1"""
