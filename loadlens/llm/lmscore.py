"""Language-model scores by stupid backoff (Brants et al. 2007), from the corpus's own counts.

S(w | u) = c(u w) / c(u) if the n-gram u w of `order` words, or as many as the document
has up to w, occurs at least MIN_COUNT times, otherwise 0.4 * S(w | u without its
first word); S(w) = c(w) / N. A document's score is the sum of the decimal logarithms over its words.

The relations are n-grams(block, gram) and counts(gram, n), the second partitioned by the
gram's 64-bit hash, and the scores are their join summed by document. Both travel packed,
a row for each block and partition instead of one for each gram: as rows, the n-grams of three orders would shuffle some
forty bytes a word and order, against about six here.

Documents are packed into blocks of some megabytes where they lie: their words' hashes once each,
and the words' places among them. A block counts its n-grams and sends each distinct one once, sorted and
packed, to the count table's partition for its hash; the partition adds the counts
up and answers each block with the totals in the block's own order. A frequent
n-gram thus costs a row part a block, not one a document, and no partition
grows with it. Words and pairs are counted first. A longer n-gram is sent only
if both shorter ones within it were found MIN_COUNT times, as it can't be found so often otherwise. At the end a
block joins all totals to its n-grams and sums the terms by document. Documents above PIECE words are dealt as
pieces that know the order - 1 words before them. Blocks grow with the root of the corpus (blocks_of()), so
that the number of messages grows with the corpus only.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import cut, table
from loadlens.llm.packed import blocks_of, bounds, pack, unpack
from loadlens.llm.shingles import WordHashes, mixed

BACKOFF = 0.4
MIN_COUNT = 2
ORDER = 3  # words of the longest n-gram
BLOCK = 1_200_000  # words
PIECE = 100_000  # words
DIGITS = 4
BLOCK_ROW = "block long, pieces binary, vocabulary binary, places binary"
TOTAL_ROW = "block long, part int, size int, n binary"


class Packer:
    """Pieces of documents on their way into a block."""

    def __init__(self, order: int):
        self.order, self.hashes = order, WordHashes()
        self.clear()

    def clear(self) -> None:
        self.pieces: list[tuple[int, int, int, int]] = []  # id, whether it is null, words of the piece before, words
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = (text or b"").split()
        code = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, len(found))
        for at in range(0, max(len(code), 1), PIECE):
            before = min(at, self.order - 1)
            own = code[at - before : at + PIECE]
            self.pieces.append((doc_id or 0, int(doc_id is None), before, len(own)))
            self.codes.append(own)
            self.size += len(own) + 1

    def row(self) -> pd.DataFrame:
        """The block, named by its content, so that a task that runs again names it alike."""
        vocabulary, places, n = np.unique(np.concatenate(self.codes), return_inverse=True, return_counts=True)
        often = np.argsort(-n, kind="stable")  # frequent words get small places, which pack well
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        vocabulary, places = vocabulary[often], rank[places]
        pieces = np.array(self.pieces, np.int64).T
        row = [pack(pieces.reshape(-1).view(np.uint64)), pack(np.diff(vocabulary, prepend=np.uint64(0))), pack(places)]
        name = np.array([xxhash.xxh64_intdigest(b"".join(row))], np.uint64).view(np.int64)[0]
        self.clear()
        return pd.DataFrame([[name, *row]], columns=["block", "pieces", "vocabulary", "places"])


def packed_blocks(order: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Packer(order)
        for docs in batches:
            for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
                block.add(None if doc_id is None else int(doc_id), text)
                if block.size >= size:
                    yield block.row()
        if block.pieces:
            yield block.row()

    return run


class Ngrams:
    """The n-grams of a block, order by order: sorted distinct hashes, where they end, and which one ends there."""

    def __init__(self, rows: pd.DataFrame, order: int):
        pieces = [unpack(x).view(np.int64).reshape(4, -1) for x in rows["pieces"]]
        codes = [np.cumsum(unpack(v), dtype=np.uint64)[unpack(p).astype(np.int64)] for v, p in zip(rows["vocabulary"], rows["places"], strict=True)]
        self.ids, self.null, before, sizes = np.concatenate(pieces, 1)
        self.code = np.concatenate([np.empty(0, np.uint64), *codes])
        self.piece = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(self.code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.real = place >= np.repeat(before, sizes)  # the others count in the piece before
        self.longest = np.minimum(place + 1, order)
        self.order, self.gram, self.size = order, mixed(self.code), 0
        self.of: list[np.ndarray] = []  # corpus counts of the n-grams that end at each place; 0 where none was asked for

    def next(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of one more word: keys, where they end, and which key it is."""
        self.size += 1
        ends = self.longest >= self.size
        if self.size > 1:
            with np.errstate(over="ignore"):
                self.gram = np.concatenate([self.gram[:1], mixed(self.gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.code[1:])])
        if self.size > 2:
            often = self.of[-1] >= MIN_COUNT
            ends &= often & np.concatenate([often[:1], often[:-1]])
        at = np.nonzero(ends)[0]
        keys, which = np.unique(self.gram[at], return_inverse=True)
        return keys, at, which

    def join(self, totals: pd.DataFrame, at: np.ndarray, which: np.ndarray) -> None:
        """The counts of the last n-grams from the partitions' answers."""
        own = totals[totals["size"] == self.size].sort_values("part")
        n = np.concatenate([np.empty(0, np.uint64), *[unpack(x) for x in own["n"]]]).astype(np.float64)
        of = np.zeros(len(self.code))
        of[at] = n[which]
        self.of.append(of)

    def messages(self, parts: int, keys: np.ndarray, at: np.ndarray, which: np.ndarray) -> Iterator[tuple]:
        """(part, size, keys, counts) for each partition that has some of the keys."""
        n = np.bincount(which[self.real[at]], minlength=len(keys))
        cuts = bounds(keys, parts)
        for p in np.nonzero(np.diff(cuts))[0]:
            part = slice(cuts[p], cuts[p + 1])
            yield int(p), self.size, pack(np.diff(keys[part], prepend=np.uint64(0))), pack(n[part])


def _sent(block: int, messages: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(block, *m) for m in messages], columns=["block", "part", "size", "keys", "n"])


def short_counts(parts: int, order: int):
    """A block's words and pairs for the count table."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        found = Ngrams(rows, order)
        return _sent(rows["block"].iloc[0], [m for _ in range(min(order, 2)) for m in found.messages(parts, *found.next())])

    return count


def longer_counts(parts: int, order: int, size: int):
    """A block's n-grams of `size` words for the count table, where those of one word less are counted."""

    def count(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        found = Ngrams(rows, order)
        for _ in range(size - 1):
            _, at, which = found.next()
            found.join(totals, at, which)
        return _sent(rows["block"].iloc[0], list(found.messages(parts, *found.next())))

    return count


def added(part: pd.DataFrame) -> pd.DataFrame:
    """A partition of the count table, n-grams of one size: every block's keys with the corpus's counts."""
    own = [np.cumsum(unpack(g), dtype=np.uint64) for g in part["keys"]]
    n = np.concatenate([unpack(c) for c in part["n"]])
    which = np.unique(np.concatenate(own), return_inverse=True)[1]
    total = np.bincount(which, weights=n).astype(np.uint64)[which]  # exact up to 2^53
    answers = [pack(x) for x in np.split(total, np.cumsum([len(g) for g in own])[:-1])]
    return pd.DataFrame({"block": part["block"], "part": part["part"], "size": part["size"], "n": answers})


def scored(order: int):
    """Sums by piece of a block, with the terms that N and the backoff factor are missing from."""

    def score(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        found = Ngrams(rows, order)
        used = np.ones(len(found.code), np.int64)
        for k in range(1, order + 1):
            _, at, which = found.next()
            found.join(totals, at, which)
            of = found.of[-1]
            if k == 1:
                with np.errstate(divide="ignore"):
                    term = np.log10(of)
            else:
                seen = at[of[at] >= MIN_COUNT]
                term[seen] = np.log10(of[seen]) - np.log10(found.of[-2][seen - 1])
                used[seen] = k

        def by_piece(weights: np.ndarray) -> np.ndarray:
            return np.bincount(found.piece[found.real], weights=weights[found.real], minlength=len(found.ids))

        sums = {"n_words": np.ones(len(used)), "n_pairs": used > 1, "n_longest": (used == order) & (order > 1), "n_backed": found.longest - used}
        ids = pd.array(found.ids, dtype="Int64")
        ids[found.null == 1] = pd.NA
        return pd.DataFrame({"doc_id": ids, **{c: by_piece(x).astype(np.int64) for c, x in sums.items()}, "log_sum": by_piece(term)})

    return score


def lm_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_pairs, n_longest, score, mean_score): a row for each doc_id of docs(doc_id, text).

    n_pairs counts the words that a pair or a longer n-gram scores, n_longest those that one of `order` words does; the rest back
    off to c(w) / N. mean_score is the score by word. Texts that are null, empty or blank have the score 0 over 0 words.
    Rows that repeat an id (null is one) are one document, each row's first word a first word. Other columns are left out.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = blocks_of(size // 6, BLOCK)  # of English and German, six bytes make a word about
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = rows.mapInPandas(packed_blocks(order, max(BLOCK, size // 6 // parts)), BLOCK_ROW)
    message = "block long, part int, size int, keys binary, n binary"
    by_block = blocks.groupBy("block")
    totals = by_block.applyInPandas(short_counts(parts, order), message).groupBy("part", "size").applyInPandas(added, TOTAL_ROW)
    for k in range(3, order + 1):
        more = by_block.cogroup(totals.groupBy("block")).applyInPandas(longer_counts(parts, order, k), message)
        totals = totals.union(more.groupBy("part", "size").applyInPandas(added, TOTAL_ROW))
    sums = by_block.cogroup(totals.groupBy("block")).applyInPandas(scored(order), "doc_id long, n_words long, n_pairs long, n_longest long, n_backed long, log_sum double")
    by_doc = cut(sums.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_pairs", "n_longest", "n_backed", "log_sum")]))
    n = by_doc.agg(F.sum("n_words")).first()[0] or 1
    score = F.col("log_sum") + F.col("n_backed") * math.log10(BACKOFF) - (F.col("n_words") - F.col("n_pairs")) * math.log10(max(n, 1))
    mean = F.round(score / F.greatest(F.col("n_words"), F.lit(1)), DIGITS)
    return by_doc.select("doc_id", "n_words", "n_pairs", "n_longest", F.round(score, DIGITS).alias("score"), mean.alias("mean_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
p AS (SELECT r, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
c1 AS (SELECT w, count(*) AS n FROM p GROUP BY w),
c2 AS (SELECT v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= {MIN_COUNT}),
c3 AS (SELECT u, v, w, count(*) AS n FROM p WHERE u IS NOT NULL GROUP BY u, v, w HAVING count(*) >= {MIN_COUNT}),
s AS (SELECT r, c2.n IS NOT NULL AS pair, c3.n IS NOT NULL AS triple,
   CASE WHEN c3.n IS NOT NULL THEN log10(c3.n / cuv.n)
        WHEN c2.n IS NOT NULL THEN log10(c2.n / cv.n) + CASE WHEN p.u IS NULL THEN 0 ELSE log10({BACKOFF}) END
        ELSE log10(c1.n / (SELECT count(*) FROM p)) + log10({BACKOFF}) * (CASE WHEN p.v IS NULL THEN 0 WHEN p.u IS NULL THEN 1 ELSE 2 END) END AS term
   FROM p JOIN c1 ON c1.w = p.w LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w
   LEFT JOIN c1 cv ON cv.w = p.v LEFT JOIN c2 cuv ON cuv.v = p.u AND cuv.w = p.v),
d AS (SELECT r, count(*) AS n_words, count(*) FILTER (pair) AS n_pairs, count(*) FILTER (triple) AS n_longest, sum(term) AS score FROM s GROUP BY r),
g AS (SELECT doc_id, CAST(coalesce(sum(n_words), 0) AS BIGINT) AS n_words, CAST(coalesce(sum(n_pairs), 0) AS BIGINT) AS n_pairs, CAST(coalesce(sum(n_longest), 0) AS BIGINT) AS n_longest, coalesce(sum(score), 0) AS score
   FROM t LEFT JOIN d ON d.r = t.r GROUP BY doc_id)
SELECT doc_id, n_words, n_pairs, n_longest, round(score, {DIGITS}) AS score, round(score / greatest(n_words, 1), {DIGITS}) AS mean_score FROM g"""

cloudpickle.register_pickle_by_value(sys.modules[__name__])
