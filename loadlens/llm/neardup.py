"""Near-duplicate groups from bottom-k sketches of one hash function.

A document is the set of its five-word shingles, hashed to 64 bits. Equal sets
collapse to their least doc_id first. Of the others:

1. The K least hashes of a set are its sketch. Two sets with a Jaccard
   similarity of 0.75 share at least a quarter of their sketches (of the K
   least hashes of the union, each is shared with probability 0.75; that fewer
   than K/4 = 8 of 32 are has probability 4e-10; sets of up to K shingles share
   that much for certain). So each set need be listed only under its rarest
   sketch values, all but the K/4 - 1 most frequent ones: two such sets meet
   in at least one inverted list, and what many documents share is not listed
   unless a document consists of it.
2. Partners share three quarters of a set. Of the sets that meet another one,
   those with more than a quarter of shingles that no other of them has are
   linked with nothing, and leave the lists.
3. Lists with the same least document form a group, in which the ESTIMATE least
   hashes alone are compared: the union-sketch estimate drops pairs far below
   0.75, and what it leaves connects documents to candidate families. Two linked
   sets are in one family.
4. Each whole set is sent once, to its family, where the exact Jaccard of whole
   sets confirms links; pairs that are connected already are passed over, the
   most alike go first.
5. The confirmed links go through alternating large-star and small-star steps
   (Kiveris et al. 2014) until each document hangs on the least of its group.

Groups of 3 and families of 4 are resolved in the same way (resolve()): a task
holds sets of a total weight of BOUND at most, and large groups are cut into
parts that all hold one common document. What the parts leave apart from it,
mostly little or nothing, meets every part once more. So each two members of a group that are not connected meet in some task, whatever the
group's size; no step pairs all members, and none collects to the driver.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import broadcast_if_small, cut, table
from loadlens.llm.packed import blocks_of, bounds, pack, unpack
from loadlens.llm.shingles import bottom_sketch, full_set

K = 32
ESTIMATE = 64  # least hashes of a union that estimate a similarity
LIKELY, ENOUGH = 64, 25  # of 64 hashes at 0.75, fewer than 25 are shared with probability 1e-10
BOUND = 400_000  # weight of the sets that a task compares at once
SET_COST = 1_000  # weight of a set besides its hashes
COLUMNS = 8192
VALUES = 1_000_000  # shingles of a block
IDS = 500_000  # ids that may be broadcast
EDGES = 200_000  # links of a task


def overlaps(sketches: list[np.ndarray]) -> np.ndarray:
    """Matrix of how many values each two arrays of distinct values share."""
    ids = np.unique(np.concatenate(sketches), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    out = np.zeros((len(sketches), len(sketches)), np.float32)
    for start in range(0, int(ids.max(initial=-1)) + 1, COLUMNS):
        part = (ids >= start) & (ids < start + COLUMNS)
        seen = np.zeros((len(sketches), COLUMNS), np.float32)
        seen[row[part], ids[part] - start] = 1
        out += seen @ seen.T
    return out


def in_both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of two sorted arrays of distinct values that both have; a stable sort merges them."""
    merged = np.concatenate((a, b))
    merged.sort(kind="stable")
    return merged[:-1][merged[1:] == merged[:-1]]


def likely(a: np.ndarray, b: np.ndarray) -> bool:
    """Union-sketch estimate: of the union's least hashes enough are in both."""
    a, b = a[:ESTIMATE], b[:ESTIMATE]
    both = in_both(a, b)
    least = np.union1d(a, b)[:ESTIMATE]
    return LIKELY * np.searchsorted(both, least[-1], side="right") >= ENOUGH * len(least)


def alike(a: np.ndarray, b: np.ndarray, sizes: int) -> bool:
    """Exact: 100 i >= 75 (sizes - i), i being what both have."""
    return 7 * len(in_both(a, b)) >= 3 * sizes


def forest(frame: pd.DataFrame, exact: bool) -> tuple[list[tuple[int, int]], list[int]]:
    """Links that connect what all links among some sets connect, and what each row is connected with then: a row's place.

    Rows of one label count as connected. Only pairs of which one row asks are looked at.
    """
    docs, sets, n = frame["doc"].tolist(), frame["set"].tolist(), frame["n"].to_numpy()
    asks, held = frame["asks"].to_numpy(), np.array([min(len(s), ESTIMATE) for s in sets])
    _, first, which = np.unique(frame["label"].to_numpy(), return_index=True, return_inverse=True)
    root = first[which].tolist()

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    met = overlaps([s[:ESTIMATE] for s in sets])
    enough = LIKELY * met >= ENOUGH * np.maximum.outer(held, held)
    near = np.triu(enough & (4 * np.minimum.outer(n, n) >= 3 * np.maximum.outer(n, n)) & np.logical_or.outer(asks, asks), 1)
    left, right = np.nonzero(near)
    found = []
    for k in np.argsort(-met[left, right], kind="stable"):  # the most alike first, so that most others are connected already
        i, j = int(left[k]), int(right[k])
        if top(i) != top(j) and likely(sets[i], sets[j]) and (not exact or alike(sets[i], sets[j], n[i] + n[j])):
            root[top(i)] = top(j)
            found.append((docs[i], docs[j]))
    return found, [top(i) for i in range(len(docs))]


def forests(exact: bool):
    """forest() of every part of a group that a task was given: links without a group, and what is not connected with
    a large group's common document, with its label, beside the group."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (group, _), rows in frame.groupby(["group", "part"], sort=False).indices.items():
            if len(rows) == 1:
                continue
            own = frame.iloc[rows]
            made, tops = forest(own, exact)
            found += [(a, b, None) for a, b in made]
            docs, common = own["doc"].tolist(), np.nonzero(own["common"].to_numpy())[0]
            if len(common):
                found += [(docs[i], docs[top], group) for i, top in enumerate(tops) if top != tops[common[0]]]
        return pd.DataFrame(found, columns=["a", "b", "group"]).astype({"a": "int64", "b": "int64", "group": "Int64"})

    return run


def _index(sketches: DataFrame) -> DataFrame:
    """(list, doc, n): each set under its rarest shared sketch values."""
    values = sketches.select("doc", "n", F.explode("sketch").alias("value"))
    often = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    skipped = F.ceil(F.least(F.col("n"), F.lit(K)) / 4.0).cast("int") - 1
    by_doc = (
        values.join(often, "value")
        .groupBy("doc", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value")), asc=False).alias("v"))  # at most K
        .where(F.size("v") > skipped)
    )
    return by_doc.select("doc", "n", F.explode(F.slice("v", skipped + 1, K)).alias("v")).select(F.col("v.value").alias("list"), "doc", "n")


def block_values(parts: int):
    """A block's distinct shingles and how many of its sets have each, by part of the hash range."""

    def values(block: pd.DataFrame) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(block["set"].tolist()).view(np.uint64), return_counts=True)
        at = bounds(keys, parts)
        rows = [(int(block["block"].iloc[0]), p, pack(np.diff(keys[at[p] : at[p + 1]], prepend=np.uint64(0))), pack(n[at[p] : at[p + 1]])) for p in range(parts) if at[p + 1] > at[p]]
        return pd.DataFrame(rows, columns=["block", "part", "keys", "counts"])

    return values


def summed_values(part: pd.DataFrame) -> pd.DataFrame:
    """Every block's shingles of a part with the number of sets that have them anywhere."""
    own = [np.cumsum(unpack(k), dtype=np.uint64) for k in part["keys"]]
    n = np.concatenate([unpack(c) for c in part["counts"]])
    which = np.unique(np.concatenate(own), return_inverse=True)[1]
    total = np.bincount(which, weights=n).astype(np.uint64)[which]
    counts = [pack(x) for x in np.split(total, np.cumsum([len(k) for k in own])[:-1])]
    return pd.DataFrame({"block": part["block"], "part": part["part"], "counts": counts})


def shared_part(block: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
    """Of each set of a block, the shingles that another set has too, if they are three quarters of it."""
    sets = block["set"].tolist()
    size = np.array([len(s) for s in sets])
    _, which = np.unique(np.concatenate(sets).view(np.uint64), return_inverse=True)
    total = np.concatenate([unpack(x) for x in totals.sort_values("part")["counts"]])
    shared = np.split(total[which] > 1, np.cumsum(size)[:-1])
    rows = [(doc, len(s), s[own]) for doc, s, own in zip(block["doc"], sets, shared, strict=True) if 4 * own.sum() >= 3 * len(s)]
    return pd.DataFrame(rows, columns=["doc", "n", "set"])


def _shared(sets: DataFrame) -> DataFrame:
    """(doc, n, set) of the sets that can have partners: size, and the shingles that another one has too.

    Each block sends a shingle once, however many of its sets have it. What two sets
    share is in both of the smaller sets, so these are all that is needed from here on.
    """
    parts = blocks_of(sets.agg(F.sum(F.size("set"))).first()[0] or 0, VALUES)
    blocks = sets.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int"))
    sent = blocks.groupBy("block").applyInPandas(block_values(parts), "block int, part int, keys binary, counts binary")
    totals = sent.groupBy("part").applyInPandas(summed_values, "block int, part int, counts binary")
    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(shared_part, "doc long, n long, set array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(doc, component): the least document that each linked one is connected with."""

    def stars(e: DataFrame, tasks: int) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(tasks)
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").coalesce(tasks)
        least = large.groupBy("b").agg(F.min("a").alias("m")).coalesce(tasks)
        joined = large.join(least, "b").coalesce(tasks)
        small = joined.select(F.col("m").alias("a"), "b").union(joined.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        return small.coalesce(tasks).distinct().coalesce(tasks)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, now = None, (edges.count(), None)
    while now != before:
        edges, before = cut(stars(edges, math.ceil(now[0] / EDGES) + 1)), now
        now = mark(edges)
    return edges.select(F.col("b").alias("doc"), F.col("a").alias("component"))


def _linked(rows: DataFrame, sets: DataFrame, exact: bool) -> DataFrame:
    """forests() of rows(group, part, doc, label, asks, common). Small parts share a task."""
    weight = rows.join(sets.select("doc", _weight()), "doc").agg(F.sum("w")).first()[0] or 0
    bins = max(1, math.ceil(4 * weight / BOUND))
    dealt = rows.join(sets, "doc").withColumn("bin", F.pmod(F.xxhash64("group", "part"), F.lit(bins)).cast("int"))
    dealt = dealt.repartition(bins, "bin")  # what is few bytes may be much to compare
    return cut(dealt.groupBy("bin").applyInPandas(forests(exact), "a long, b long, group long"))


def _weight() -> Column:
    return (F.size("set") + SET_COST).cast("long").alias("w")


def _parts(weight: Column) -> Column:
    return F.ceil(weight / BOUND).cast("int")


def _dealt(n: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("doc", F.lit(salt)), n).cast("int")


def _all(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def resolve(members: DataFrame, sets: DataFrame, exact: bool) -> DataFrame:
    """Links (a, b) that connect, within each group of members(group, doc), what all its links connect."""
    members = cut(members.join(sets.select("doc", _weight()), "doc"))
    groups = members.groupBy("group").agg(F.count("*").alias("size"), F.min("doc").alias("head"), _parts(F.sum("w")).alias("parts"))
    groups = cut(groups.where("size > 1").drop("size"))
    placed = members.join(groups, "group")
    common = (F.col("doc") == F.col("head")) & (F.col("parts") > 1)
    part = F.when(common, _all(F.col("parts"))).otherwise(F.array(_dealt(F.col("parts"), 0)))
    first = _linked(placed.select("group", F.explode(part).alias("part"), "doc", F.col("doc").alias("label"), F.lit(True).alias("asks"), common.alias("common")), sets, exact)
    links = first.where("group is null").select("a", "b")
    apart = first.where("group is not null").select("group", F.col("a").alias("doc"), F.col("b").alias("label")).distinct()
    if apart.isEmpty():
        return links
    large = placed.where("parts > 1").join(apart, ["group", "doc"], "left")
    large = cut(large.select("group", "doc", "w", "parts", F.coalesce("label", "head").alias("label"), F.col("label").isNotNull().alias("apart")))
    blocks = cut(large.where("apart").groupBy("group").agg(_parts(F.sum("w")).alias("blocks")))
    left = large.join(blocks, "group")
    asking = left.where("apart").select("group", "doc", "label", F.explode(_all(F.col("parts"))).alias("part"), _dealt(F.col("blocks"), 1).alias("block"), F.lit(True).alias("asks"))
    asked = left.select("group", "doc", "label", _dealt(F.col("parts"), 0).alias("part"), F.explode(_all(F.col("blocks"))).alias("block"), F.lit(False).alias("asks"))
    met = asking.unionByName(asked).withColumn("part", F.xxhash64("part", "block")).withColumn("common", F.lit(False)).drop("block")
    return links.union(_linked(met, sets, exact).select("a", "b"))


def links(sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that connect what all links connect.

    sketches(doc, n, sketch) has one row for each distinct set; docs(doc_id,
    text) gives the whole sets of those that meet another one.
    """
    listed = cut(_index(sketches))
    active = broadcast_if_small(cut(listed.select(F.col("doc").alias("doc_id")).distinct()), IDS)
    sets = cut(docs.join(active, "doc_id", "left_semi").select(F.col("doc_id").alias("doc"), full_set()(F.col("text").cast("binary")).alias("set")))
    sets = cut(_shared(sets))
    listed = listed.join(broadcast_if_small(cut(sets.select("doc").distinct()), IDS), "doc", "left_semi")
    lists = listed.groupBy("list").agg(F.min("doc").alias("group"), F.count("*").alias("df")).where("df > 1")
    members = listed.join(lists, "list").select("group", "doc").distinct()
    near = components(resolve(members, sets.select("doc", "n", F.slice("set", 1, ESTIMATE).alias("set")), exact=False))
    heads = near.select(F.col("component").alias("group"), F.col("component").alias("doc")).distinct()
    return resolve(heads.union(near.where("doc != component").select("component", "doc")), sets, exact=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    Null, empty and blank texts have no shingles, are linked with nothing and
    kept; so are rows without a doc_id, whose component is null. Fewer than
    five words make one shingle. doc_id is the key: rows repeated under one id
    share its links, and a group holds each of their texts.
    """
    docs = docs.select("doc_id", "text")
    made = docs.select("doc_id", bottom_sketch(K)(F.col("text").cast("binary")).alias("s")).select("doc_id", "s.*")
    made = cut(made)
    same = ["n", "sum_a", "sum_b"]
    full = made.where("n > 0 and doc_id is not null")
    firsts = cut(full.groupBy(*same).agg(F.min("doc_id").alias("doc"), F.first("sketch").alias("sketch")))
    tree = components(links(firsts.select("doc", "n", "sketch"), docs))
    groups = firsts.join(tree, "doc", "left").select(*same, F.coalesce("component", "doc").alias("component"))
    found = made.join(groups, same, "left")
    ours = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), ours.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, one document of each group, with their own columns."""
    gone = cut(near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(broadcast_if_small(gone, IDS), docs["doc_id"] == gone["_gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS root FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
