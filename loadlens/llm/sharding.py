"""Sharding by a hierarchical weighted hash tree.

Shards hang on racks, racks on regions; a node weighs what its shards weigh.
A key descends from the root: at each level every child draws a uniform number from
the key and its own name, -ln(u) / weight, and the least draw wins (weighted
rendezvous hashing). A child wins in proportion to its weight, and a changed
weight changes that child's draws alone: keys move only into subtrees that
grew and out of subtrees that shrank; all other subtrees keep theirs. A shard
that joins as a region of its own takes keys only into itself.

Slots number a shard's rows without gaps. Rows are dealt by shard and by bits
of their hash into cells; cells are counted, the counts of a shard are added up, and rows
are numbered within their cell only, so no task sees a whole shard.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens.llm.common import broadcast_if_small, cut, hash01, table

SHARDS = 16
CELLS = 1024  # a shard
REGION, RACK = 4, 2  # shards in a full region, in a full rack

#: A tree: region -> rack -> shard -> weight.
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: Iterable[int]) -> Tree:
    """Equal shards: REGION of them a region and RACK of them a rack, in order."""
    tree: Tree = {}
    for s in shards:
        tree.setdefault(f"g{s // REGION}", {}).setdefault(f"k{s // RACK}", {})[s] = 1.0
    return tree


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else node


def _winner(key: Column, children: dict) -> Column:
    """The child with the least draw, as text."""
    if len(children) == 1:
        return F.lit(str(next(iter(children))))
    draws = [F.struct((-F.ln(hash01(key, F.lit(str(name)))) / F.lit(float(_weight(node)))).alias("draw"), F.lit(str(name)).alias("name")) for name, node in children.items()]
    return F.least(*draws)["name"]


def _descend(key: Column, node: dict, depth: int = 0) -> Column:
    """The shard under a node, as nested choices: no row asks more draws than lie on its way."""
    if not isinstance(next(iter(node.values())), dict):
        return _winner(key, node).cast("int")
    won = _winner(key, node)
    found = F.lit(None).cast("int")
    for name, child in node.items():
        found = F.when(won == str(name), _descend(key, child, depth + 1)).otherwise(found)
    return found


def placed(docs: DataFrame, tree: Tree, name: str = "shard") -> DataFrame:
    """docs with the shard of each doc_id; a null id has the key ''."""
    return docs.withColumn(name, _descend(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), tree))


def sharded(docs: DataFrame, shards: int = SHARDS, tree: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """docs(doc_id, text, ...) with size, text_crc32, law, shard, slot and grown_shard.

    Size is the text's UTF-8 bytes plus 1, a null text has size 1 and the sum
    of the empty one. The law is key: doc_id and the tree alone decide, so rows
    that repeat an id share a shard. Slots follow a hash of id and text, then the id;
    repeated rows get different slots in any order. Own columns that clash with
    new ones give way to them.
    """
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    tree = tree or even_tree(range(shards))
    grown = grown or even_tree(range(shards)) | {"added": {"added": {shards: 1.0}}}
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns if c not in new]).alias("row"),
        docs["doc_id"].alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        _descend(key, tree).alias("shard"),
        _descend(key, grown).alias("grown_shard"),
        F.floor(hash01(F.lit("slot"), key, F.crc32(text).cast("string")) * CELLS).cast("int").alias("_cell"),  # rows of one id are dealt by text
    )
    counts = rows.groupBy("shard", "_cell").agg(F.count("*").alias("n"))  # at most shards x CELLS rows
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("_cell")) - F.col("n")
    starts = cut(counts.select("shard", "_cell", before.alias("_start")))
    within = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_id", "text_crc32"))
    numbered = rows.join(broadcast_if_small(starts), ["shard", "_cell"]).withColumn("slot", F.col("_start") + within - 1)
    return numbered.select("row.*", *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql_draw(key: str, name: str) -> str:
    return f"(CAST('0x' || substr(md5({key} || ':{name}'), 1, 13) AS BIGINT) + 0.5) / CAST({2**52} AS DOUBLE)"


def _sql_winner(key: str, children: dict) -> str:
    """First of the least draws; each child beats all later ones or the search goes on."""
    names = list(children)
    if len(names) == 1:
        return f"'{names[0]}'"
    draw = [f"-ln({_sql_draw(key, n)}) / {float(_weight(children[n]))}" for n in names]
    cases = [f"WHEN {draw[i]} <= least({', '.join(draw)}) THEN '{names[i]}'" for i in range(len(names) - 1)]
    return f"CASE {' '.join(cases)} ELSE '{names[-1]}' END"


def oracle(rows: str = "documents", extra: tuple[str, ...] = ()) -> str:
    """SQL over a table, with other columns of it; the table of the CRC is made by eight shifts of each byte."""
    more, also = "".join(f", {c} AS x_{c}" for c in extra), "".join(f", x_{c} AS {c}" for c in extra)
    now, later = even_tree(range(SHARDS)), even_tree(range(SHARDS)) | {"added": {"added": {SHARDS: 1.0}}}

    def levels(tree: Tree, name: str) -> str:
        racks = " ".join(f"WHEN '{g}' THEN {_sql_winner('k', racks)}" for g, racks in tree.items())
        shards = " ".join(f"WHEN '{k}' THEN {_sql_winner('k', shards)}" for racks in tree.values() for k, shards in racks.items())
        return f"""{name}1 AS (SELECT r, k, {_sql_winner('k', tree)} AS g FROM d),
{name}2 AS (SELECT r, k, CASE g {racks} END AS c FROM {name}1),
{name}3 AS (SELECT r, CAST(CASE c {shards} END AS INTEGER) AS s FROM {name}2)"""

    step = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
    table_cte = "c0 AS (SELECT i, CAST(i AS BIGINT) AS c FROM range(256) t(i))"
    for i in range(8):
        table_cte += f", c{i + 1} AS (SELECT i, {step.format(c='c')} AS c FROM c{i})"
    return f"""
WITH {table_cte}, crc AS (SELECT list(c ORDER BY i) AS t FROM c8),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), '') AS k{more} FROM {rows}),
{levels(now, "a")}, {levels(later, "b")},
h AS (SELECT r, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
   lambda x, y: xor(x >> 8, t[CAST((xor(x, y) & 255) + 1 AS BIGINT)])) AS x FROM d, crc),
o AS (SELECT d.*, octet_length(encode(text)) + 1 AS size, xor(x, 4294967295) AS text_crc32, a3.s AS shard, b3.s AS grown_shard,
   CAST(floor((CAST('0x' || substr(md5('slot:' || k || ':' || CAST(xor(x, 4294967295) AS VARCHAR)), 1, 13) AS BIGINT) + 0.5) / CAST({2**52} AS DOUBLE) * {CELLS}) AS INTEGER) AS cell
   FROM d JOIN a3 USING (r) JOIN b3 USING (r) JOIN h USING (r))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
   row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard{also} FROM o"""


ORACLE_SQL = oracle()
