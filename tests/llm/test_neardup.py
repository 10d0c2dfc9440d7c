import random

import pytest

from loadlens.llm import neardup

SCHEMA = "doc_id long, text string, n long"


def brute(rows):
    sets = {}
    for doc_id, text, _ in rows:
        w = (text or "").encode().lower().split()
        n = min(5, len(w))
        sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted((d, len(sets[d]), top(d), top(d) == d) for d in ids)


def variants(seed, copies):
    """Copies of a few bases with growing numbers of edits, and a passage that others share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 6)))
    texts = []
    passage = [word() for _ in range(60)]
    for _ in range(2):
        base = [word() for _ in range(90)]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
                at = r.randrange(len(own))
                own[at : at + r.choice([0, 1, 1, 1, 2])] = [word() for _ in range(r.choice([0, 1, 1, 1, 2]))]
            texts.append(" ".join(own))
    for _ in range(copies):
        texts.append(" ".join([word() for _ in range(r.randint(3, 40))] + passage))
    texts += ["", None, "  ", "One two", "one TWO", "one two three", "É é", "é é", " ".join(passage), " ".join(passage)]
    return [(k, t, 1) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("bound", "copies"), [(1_000_000, 25), (20_000, 40), (4_000, 30)])
def test_equals_brute_force(spark, monkeypatch, bound, copies):
    monkeypatch.setattr(neardup, "BOUND", bound)  # the smaller, the more parts a group has
    rows = variants(copies, copies)
    found = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long, 1), (7, long, 1), (7, long, 1), (9, long, 1), (8, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=repr)
    assert found == sorted([(None, 36, None, True), (7, 36, 7, True), (7, 36, 7, True), (9, 36, 7, False), (8, 0, 8, True)], key=repr)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 7, 7, 8]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
