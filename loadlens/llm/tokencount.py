"""Token counts of whole texts by overlapping chunks that resynchronise.

A text is cut into chunks of CHUNK characters that overlap, and each chunk is
encoded with offsets; a text up to CHUNK is one chunk. Two neighbouring encodings
are spliced at a boundary that is proven stable: a character after ASCII white space,
where both encodings begin a token, and from which on both have the same
tokens until the left chunk is about to end. What stands before such a place cannot
change what follows if the tokenizer cuts its input at white space: breaks_at_space()
verifies that when the tokenizer is loaded, and others are refused. Where the overlap
holds no such place (a run without spaces), it is doubled, and then the chunk
itself, at worst up to the whole text.

By the same rule a text of one chunk has the tokens of its words; these are counted word by
word, each distinct word being encoded once.

One text is one row, so a text is handled by one task. A task holds one Arrow batch of
whole texts (spark.sql.execution.arrow.maxBytesPerBatch bounds it) and the encodings of BATCH characters.
"""

from __future__ import annotations

import os
import string
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048  # tokens
CHUNK = 6_000  # characters
OVERLAP = 128  # characters
BATCH = 262_144  # characters of texts that are counted at once
REMEMBERED = 400_000  # words whose counts are kept
PROOF = 8  # tokens that must agree after a splice
SPACES = " \t\n\x0b\x0c\r"


def tokenizer_at(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


#: Pieces of text whose neighbours a tokenizer might join: letters, digits, marks, contractions, accents, scripts, controls.
PROBES = ["a", "Ab", "don't", "'s", "'", "9", "12", "-", "...", "$%", "_", "é", "e\u0301", "\u0301", "ß", "Σ", "ς", "字", "か", "ا", "\u200d", "\u00a0", "\u3000", "😀", "<|", "|>", "</w>", "Ġ"]


def breaks_at_space(tokenizer) -> bool:
    """Whether what stands before ASCII white space and what follows it are encoded apart.

    Added tokens must hold no white space, and each two probes beside each kind of white space must
    give the tokens that they give alone, with those that follow beginning at their own first character.
    """
    if any(c.isspace() for t in tokenizer.get_added_tokens_decoder().values() for c in t.content):
        return False
    alone = dict(zip(PROBES, ([(e.ids[i], *e.offsets[i]) for i in range(len(e))] for e in tokenizer.encode_batch(PROBES, add_special_tokens=False)), strict=True))
    pairs = [(a, s, b) for a in PROBES for b in PROBES for s in (*SPACES, " \n", "\r\n ")]
    for (a, s, b), e in zip(pairs, tokenizer.encode_batch(["".join(x) for x in pairs], add_special_tokens=False), strict=True):
        at = len(a) + len(s)
        if list(zip(e.ids, *zip(*e.offsets, strict=True), strict=True)) != alone[a] + [(i, at + x, at + y) for i, x, y in alone[b]]:
            return False
    return True


class Chunk:
    """An encoding of text[start:end]; its tokens before first are counted elsewhere."""

    def __init__(self, encoding, start: int, end: int):
        self.encoding, self.ids, self.start, self.end, self.first = encoding, encoding.ids, start, end, 0

    def token(self, k: int) -> tuple[int, int, int]:
        a, b = self.encoding.token_to_chars(k)
        return self.start + a, self.start + b, self.ids[k]


def _encode(tokenizer, text: str, start: int, end: int) -> Chunk:
    return Chunk(tokenizer.encode(text[start:end], add_special_tokens=False), start, end)


def _splice(text: str, left: Chunk, right: Chunk) -> tuple[int, int] | None:
    """The first stable boundary in the overlap, as a token of either chunk, or None.

    The last word that the left chunk sees may be cut short, so agreement is
    asked for all common tokens but its own.
    """
    cut = left.end
    while cut > right.start and text[cut - 1] not in SPACES:
        cut -= 1
    last = len(left.ids)
    while last > left.first and left.token(last - 1)[1] > cut:
        last -= 1
    k = last
    while k > left.first and left.token(k - 1)[0] > right.start:
        k -= 1
    tail = [left.token(i) for i in range(k, last)]
    head, n = [], 0
    while n < len(right.ids) and (t := right.token(n))[1] <= cut:
        head.append(t)
        n += 1
    at = {}
    for i, t in enumerate(head):
        at.setdefault(t[0], i)
    for i, t in enumerate(tail):
        new = i == 0 or tail[i - 1][0] != t[0]  # one character may make several tokens
        if new and text[t[0] - 1] in SPACES and t[0] in at and len(tail) - i >= PROOF and tail[i:] == head[at[t[0]] :]:
            return k + i, at[t[0]]
    return None


def grid(size: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of overlapping chunks."""
    starts = range(0, max(size - overlap, 1), chunk - overlap)
    return [(a, min(a + chunk, size)) for a in starts]


def count_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by chunks; equal to those of the whole text."""
    total, left = 0, None
    ranges = grid(len(text), chunk, overlap)
    batch = max(1, BATCH // chunk)
    for k in range(0, len(ranges), batch):
        some = ranges[k : k + batch]
        for (start, end), encoding in zip(some, tokenizer.encode_batch([text[a:b] for a, b in some], add_special_tokens=False), strict=True):
            right = Chunk(encoding, start, end)
            if left is None:
                left = right
                continue
            if left.end >= end:  # it has grown over this one
                continue
            place, wide = _splice(text, left, right), overlap
            while place is None:
                wide *= 2
                if left.end - wide <= left.start:  # nothing is left to widen: the left chunk grows
                    begin = left.token(left.first)[0] if left.first else left.start
                    left = _encode(tokenizer, text, begin, max(end, min(begin + 2 * (left.end - begin), len(text))))
                    break
                right = _encode(tokenizer, text, left.end - wide, end)
                place = _splice(text, left, right)
            if place is not None:
                total += place[0] - left.first
                left, left.first = right, place[1]
    return total + len(left.ids) - left.first


def lowers(tokenizer) -> bool:
    """Whether the tokenizer makes A-Z small by itself, and its special strings can be told by their '<|'."""
    letters = string.ascii_letters
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return all("<|" in t for t in special) and tokenizer.encode(letters, add_special_tokens=False).ids == tokenizer.encode(letters.lower(), add_special_tokens=False).ids


def count_batch(tokenizer, texts: list[str], known: dict[bytes, int] | None = None, lower: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Token counts in order.

    Texts above chunk characters go by chunks; the others have the
    tokens of their words. Each distinct word is encoded once, BATCH characters
    of texts at a time, and its count is remembered in known; with lower, as
    lowers() tells, words that differ in A-Z alone are one.
    """
    known = {} if known is None else known
    out, waiting, size = [0] * len(texts), [], 0

    def flush() -> None:
        nonlocal waiting, size
        new = list(set().union(*(found for _, found in waiting)) - known.keys())
        for word, made in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            known[word] = len(made.ids)
        for k, found in waiting:
            out[k] = sum(map(known.__getitem__, found))
        waiting, size = [], 0
        if len(known) > REMEMBERED:
            known.clear()

    for k, text in enumerate(texts):
        if len(text) > chunk:
            out[k] = count_long(tokenizer, text, chunk, overlap)
            continue
        raw = text.encode()  # only ASCII spaces split bytes, and only A-Z is lowered, as the tokenizer does
        waiting.append((k, (raw if not lower or b"<|" in raw else raw.lower()).split()))
        size += len(text)
        if size >= BATCH:
            flush()
    if waiting:
        flush()
    return out


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text).

    path names a tokenizer file that each executor has; one whose tokens may span
    white space raises ValueError. Null and empty texts have no bytes and no tokens; repeated
    rows are counted each, null ids stay null, other columns are left out. An empty table stays empty.
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = tokenizer_at(path)
        known: dict[bytes, int] = {}
        lower = lowers(tokenizer)
        for texts in batches:
            yield pd.Series(count_batch(tokenizer, texts.tolist(), known, lower, chunk, overlap), dtype="int64")

    if not breaks_at_space(tokenizer_at(path)):
        raise ValueError(f"{path} may join what white space parts, so its chunks can not be spliced")
    text = F.coalesce(docs["text"], F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
