"""Odd rows, and agreement with plain versions, of the other operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from loadlens.llm import common, decontaminate, linededup, lmscore, mixing, quality, secrets, sharding, tokencount, warc

DOCS = "doc_id long, text string, lang string, source string, n_words string, row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", "y") for i, t, s in rows], DOCS)


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdehinorst") for _ in range(r.randint(1, 7))) for _ in range(n))


ODD = [(1, "", "a"), (2, None, "a"), (3, " \n\t ", None), (None, words(60, 1), "b"), (4, words(60, 2), ""), (4, words(60, 2), ""), (5, "é x  \x0bß " * 9000, None), (6, "one", "a")]


# ---- scores ----

def plain_scores(rows):
    texts = [(i, WORD.findall(t or "")) for i, t in rows]
    uni = Counter(w for _, ws in texts for w in ws)
    bi = Counter(p for _, ws in texts for p in zip(ws, ws[1:], strict=False))
    n = max(sum(uni.values()), 1)
    out = {}
    for i, ws in texts:
        s = out.setdefault(i, [0, 0, 0.0])
        for k, w in enumerate(ws):
            pair = (ws[k - 1], w) if k else None
            s[0] += 1
            if pair and bi[pair] >= 2:
                s[1] += 1
                s[2] += math.log10(bi[pair] / uni[pair[0]])
            else:
                s[2] += math.log10((0.4 if k else 1) * uni[w] / n)
    return out


@pytest.mark.parametrize(("block", "piece"), [(1_200_000, 100_000), (60, 7)])
def test_lm_scores(spark, monkeypatch, block, piece):
    monkeypatch.setattr(lmscore, "BLOCK", block)
    monkeypatch.setattr(lmscore, "PIECE", piece)
    rows = [(i, t) for i, t, _ in ODD] + [(k, words(40, k % 3)) for k in range(10, 22)] + [(30, "a a a a a"), (None, "a b"), (2**60 + 1, "a a")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, block long").repartition(3)
    found = lmscore.lm_scores(docs, 2).collect()
    want = plain_scores(rows)
    assert {r.doc_id for r in found} == set(want)
    for r in found:
        assert (r.n_words, r.n_pairs) == tuple(want[r.doc_id][:2])
        assert abs(r.score - want[r.doc_id][2]) < 1e-3
        assert abs(r.mean_score - want[r.doc_id][2] / max(r.n_words, 1)) < 1e-3
    assert lmscore.lm_scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize(("block", "piece"), [(1_200_000, 100_000), (50, 7), (50, 2)])
def test_lm_scores_by_order(spark, monkeypatch, block, piece, order):
    monkeypatch.setattr(lmscore, "BLOCK", block)
    monkeypatch.setattr(lmscore, "PIECE", piece)
    r = random.Random(4)
    texts = {i: [r.choice("abcd") for _ in range(r.randint(0, 40))] for i in range(12)}
    grams = Counter(tuple(ws[j - k : j]) for ws in texts.values() for j in range(1, len(ws) + 1) for k in range(1, min(order, j) + 1))
    total, want = sum(map(len, texts.values())), {}
    for i, ws in texts.items():
        score = pairs = top = 0
        for j in range(1, len(ws) + 1):
            longest = min(order, j)
            k = next(k for k in range(longest, 0, -1) if k == 1 or grams[tuple(ws[j - k : j])] >= lmscore.MIN_COUNT)
            score += math.log10(grams[tuple(ws[j - k : j])] / (grams[tuple(ws[j - k : j - 1])] if k > 1 else total)) + (longest - k) * math.log10(lmscore.BACKOFF)
            pairs += k > 1
            top += k == order > 1
        want[i] = (len(ws), pairs, score, top)
    found = {x.doc_id: (x.n_words, x.n_pairs, x.score, x.n_longest) for x in lmscore.lm_scores(docs_of(spark, [(i, " ".join(ws), "a") for i, ws in texts.items()]), order).collect()}
    assert found.keys() == want.keys()
    assert all(found[i][:2] == want[i][:2] and found[i][3] == want[i][3] and abs(found[i][2] - want[i][2]) < 1e-3 for i in want)


# ---- tokens ----

def test_token_counts(spark, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(tokencount.TOKENIZER)
    tokenizer = tokencount.tokenizer_at(path)
    texts = [t for _, t, _ in ODD] + ["<|endoftext|> a<|startoftext|>b", "x" * 9000, words(3000, 5), "don't " * 500 + "é" * 300]
    found = tokencount.token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), path).collect()
    for r in found:
        text = texts[r.doc_id] or ""
        assert r.n_bytes == len(text.encode())
        assert r.n_tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert r.over_limit == (r.n_tokens > 2048)
    for text in filter(None, texts):
        for chunk, overlap in ((200, 20), (1000, 200), (40, 4)):
            assert tokencount.count_long(tokenizer, text, chunk, overlap) == len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_odd_rows(spark):
    import public_tokenizers

    path = public_tokenizers.path(tokencount.TOKENIZER)
    tokenizer = tokencount.tokenizer_at(path)
    rows = [(1, words(2000, 3), "x", 9), (1, words(2000, 3), "x", 9), (None, "a b", "y", 9), (1, None, None, None), (2, "é" * 7000 + " a", "z", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes long")
    found = sorted((tuple(r) for r in tokencount.token_counts(docs, path, limit=3).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False)), n > 3) for i, t, *_ in rows]
    assert found == sorted(want, key=repr)
    assert tokencount.token_counts(docs.limit(0), path).count() == 0
    many = tokencount.token_counts(spark.createDataFrame([(k, words(400, k)) for k in range(50)], "doc_id long, text string"), path, chunk=150, overlap=20).collect()
    assert all(r.n_tokens == len(tokenizer.encode(words(400, r.doc_id), add_special_tokens=False)) for r in many)
    with pytest.raises(ValueError, match="white space"):
        tokencount.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))


# ---- quality ----

def plain_counts(text):
    text = text or ""
    ws = WORD.findall(text)
    tri = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    covered = {k + j for k in range(len(ws) - 2) if tri[tuple(ws[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    clean = [(100 + k, words(80 + k % 40, k) + ".", f"s{k % 2}") for k in range(60)]
    junk = [(500, " ".join(w + "%%%" for w in words(90, 7).split()), "s0"), (501, "ha " * 200, "s1"), (502, (words(10, 3) + "\n") * 30, "s1")]
    docs = docs_of(spark, ODD + clean + junk)
    found = quality.quality_rules(docs).collect()
    assert len(found) == len(ODD + clean + junk)
    texts = {i: t for i, t, _ in ODD + clean + junk}
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id for r in found if r.kept}
    assert {i for i, *_ in clean} <= kept
    assert not {500, 501, 502, 1, 2, 3, 6} & kept
    stage = quality.keep_good(docs)
    assert stage.columns == docs.columns
    assert {r.doc_id for r in stage.collect()} == kept
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_fences_of_large_sources_are_their_own(spark):
    """A source of shouting: its habit is right for it, wrong for a few documents elsewhere, and its weight grows with its documents."""
    loud = [(k, words(60, k).upper(), "loud") for k in range(200)]
    calm = [(1000 + k, words(60, k), "calm") for k in range(900)]
    odd = [(5000, words(60, 9).upper(), "calm"), (5001, words(60, 8).upper(), "few")]
    docs = docs_of(spark, loud + calm + odd)
    kept = {g: {r.doc_id for r in quality.quality_rules(docs, g).collect() if r.kept} for g in (0, quality.GROUP_DOCS, 10**9)}
    every = {i for i, *_ in calm}
    assert all(every <= k for k in kept.values())
    assert {i for i, *_ in loud} <= kept[0] and 5000 not in kept[0] and 5001 in kept[0]  # its own fences only
    assert {i for i, *_ in loud} <= kept[quality.GROUP_DOCS] and not {5000, 5001} & kept[quality.GROUP_DOCS]
    assert not {0, 5000, 5001} & kept[10**9]  # the corpus's fences
    limits = {r.source: r for r in quality.fences(quality.counted(docs)).collect()}
    wide = {r.source: r for r in quality.fences(quality.counted(docs), 10**9).collect()}
    assert (limits["loud"].docs, limits["calm"].docs, limits["few"].docs) == (200, 901, 1)
    assert wide["calm"].hi_capitals == wide["few"].hi_capitals
    assert limits["calm"].hi_capitals < limits["few"].hi_capitals < limits["loud"].hi_capitals


def test_quantile_buckets_merge(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(quality.bucket(F.col("id")).alias("b"), "id").collect()
    assert all(r.b <= r.id and (r.id - r.b) * 16 <= max(r.id, 1) for r in rows)


# ---- archives ----

def test_archives(spark):
    html = ["<p>" + words(3000, 1), "<p>" + words(3000, 1), "short", "short", None, "", "é" * 9000, "x" * 99, "x" * 99, "WARC/1.1\r\n\r\n0\r\n\r\n" * 20]
    pages = spark.createDataFrame([(k, None if k == 3 else f"http://a/{k}\r\nX: y", h) for k, h in enumerate(html)] + [(None, "u", html[0]), (6, "u", html[6])], "page_id long, url string, html string")
    found = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=repr)
    want = []
    for k, h in [*enumerate(html), (None, html[0]), (6, html[6])]:
        raw = (h or "").encode()
        first = min(i for i, x in enumerate(html) if (x or "") == (h or ""))
        again = len(raw) >= 100 and k != first
        want.append((k, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    assert found == sorted(want, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_segments_that_are_missing(spark):
    page = {"record_id": "00000000-0000-0000-0000-000000000001", "record_type": "response", "refers_id": None, "url": "u", "page_id": "1", "payload": b"z" * 500, "digest": hashlib.sha256(b"z" * 500).hexdigest()}
    raw = [next(warc.parsed(x + b"\r\n\r\n")) for x in warc.records_of(page, 100)]
    assert len(raw) > 4
    names = [f.split()[0] for f in warc.PARSED.split(", ")]
    make = lambda rows: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], warc.PARSED)
    whole = warc.reassembled(make(raw[::-1])).collect()
    assert [(bytes(r.payload), r.intact) for r in whole] == [(page["payload"], True)]
    for lost in (1, len(raw) - 1):
        broken = warc.reassembled(make(raw[:lost] + raw[lost + 1 :])).collect()
        assert [(r.payload, r.intact) for r in broken] == [(None, False)]
    assert warc.unframed(b"no head") is None
    assert warc.unframed(warc.framed(b"abc" * 5000)) == b"abc" * 5000


# ---- secrets ----

def test_forest_on_held_out_findings(spark):
    findings = list(secrets.labelled_findings(2400))
    model = secrets.trained(spark, findings[:1800])
    data = spark.createDataFrame([(*secrets.features(v, a, b), float(y)) for a, v, b, y in findings[1800:]], [*secrets.FEATURES, "label"])
    right = model.transform(data).where("label = prediction").count()
    assert right >= 0.97 * 600
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    rows = [(1, f'word token = "{key}" word'), (2, f"see commit {key} for it"), (3, None), (4, ""), (None, f"api_key: {key}")]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id or 0, r.is_secret) for r in found) == [(0, True), (1, True), (2, False)]
    assert all(r.value == key for r in found)


def test_short_and_odd_secrets(spark):
    model = secrets.trained(spark, list(secrets.labelled_findings()))
    secret = {'password = "hunter2Zx9"': "hunter2Zx9", 'password = "S3cr3t!Passw0rd"': "S3cr3t!Passw0rd", "secret: 'Xk9!pQ2zLm4#vT7w'": "Xk9!pQ2zLm4#vT7w", 'passwd="P@ssw0rd#2024!longer$one"': "P@ssw0rd#2024!longer$one", "see postgres://user:pA55w0rd@host/db": "pA55w0rd", 'secret = "qwmzkfjhtplrxcvbnasd"': "qwmzkfjhtplrxcvbnasd", "DB_PASS=k7!mQ2xv": "k7!mQ2xv"}
    plain = ["password: something", "token = get_token(user)", 'secret = "your_secret_here"', "api_key = os.environ['API_KEY']", "password = ${DB_PASSWORD}"]
    rows = [(i, f"word word {t} word word") for i, t in enumerate([*secret, *plain])]
    found = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert {(r.doc_id, r.value) for r in found if r.is_secret} == set(enumerate(secret.values()))
    assert {r.doc_id for r in found} == set(range(len(rows)))
    assert all(rows[r.doc_id][1][r.start :].startswith(r.value) for r in found)


def test_secrets_of_the_documents(spark):
    """Recall on what stands in the tables, the candidates by a plain scan, and nothing but assigned tokens found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {(r.doc_id, m.start(1), m.group(1)) for r in docs.collect() for m in re.finditer(r"(?:token|secret|key|password) ?[=:] ?[\"']([0-9A-Za-z]{20,64})[\"']", r.text or "")}
    found = secrets.scan(docs, secrets.trained(spark, list(secrets.labelled_findings()))).collect()
    secret = {(r.doc_id, r.start, r.value) for r in found if r.is_secret}
    assert planted and len(planted & secret) >= 0.9 * len(planted)
    runs = {(r.doc_id, m.start()) for r in docs.collect() for m in re.finditer(r"(?<![A-Za-z0-9])[0-9a-f]{32,}(?![A-Za-z0-9_+/=.-])", r.text or "") if re.search("[0-9]", m.group())}
    assert runs <= {(r.doc_id, r.start) for r in found}


def test_secrets_of_odd_rows(spark):
    model = secrets.trained(spark, list(secrets.labelled_findings()))
    body = "\n".join("MIIEvQIBADANBgkqhkiG9w0BAQEFAASCBKcwggSjAgEAAoIBAQC7VJTUt9Us8cKj" for _ in range(5))
    block = lambda kind: f"see\n-----BEGIN {kind}-----\n{body}\n-----END {kind}-----\nend"
    long = "word " * 200_000 + 'password = "hunter2Zx9"'
    rows = [(1, block("RSA PRIVATE KEY"), "x"), (2, block("CERTIFICATE"), "x"), (3, long, "x"), (3, long, "x"), (None, None, None), (4, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string")
    found = secrets.scan(docs, model).collect()
    assert sorted((r.doc_id, r.start, r.value, r.is_secret) for r in found) == [(1, 36, body, True), (2, 32, body, False)] + [(3, 1_000_012, "hunter2Zx9", True)] * 2
    assert secrets.scan(docs.limit(0), model).count() == 0
    edge = found[0].probability
    assert [r.is_secret for r in secrets.scan(docs.where("doc_id = 1"), model, edge).collect()] == [True]  # a tie is a secret


# ---- leaks ----

def test_leaks(spark):
    items = [(k, words(20 + 5 * k, 50 + k).capitalize()) for k in range(8)] + [(20, words(12, 99)), (21, "too short"), (22, None), (None, words(30, 77))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for k, t in items[:9]:
        for pad in range(9):
            rows.append((20000 + 100 * k + pad, f"{words(pad, 7)} {t.upper()}\n{words(30, pad)}", "a"))
            want.add((20000 + 100 * k + pad, k))
    rows += [(9000 + k, words(200, 500 + k), "a") for k in range(20)] + ODD
    edited = items[7][1].split()
    edited[30] = "zzz"
    rows.append((8000, f"{words(40, 3)} {' '.join(edited)} {words(9, 4)}", "a"))
    docs = docs_of(spark, rows)
    found = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want | {(8000, 7)}
    assert all(r.similarity == 1 for r in found if r.doc_id != 8000)
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == 20 + len(ODD)
    assert decontaminate.keep_clean(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_short_items_leak(spark):
    items = [(n, words(n, 600 + n)) for n in range(1, 11)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(100 + n, f"{words(23, 5)} {t.upper()} {words(31, 6)}", "a") for n, t in items if n >= 5]
    rows += [(200 + n, f" {t}\n", "a") for n, t in items]  # nothing else in the text
    rows += [(300, words(200, 3), "a"), *ODD]
    edited = items[9][1].split()
    rows.append((400, " ".join(["zzz", *edited[1:]]), "a"))  # 5 of 7 shingles
    rows.append((401, " ".join(edited[:8]), "a"))  # 4 of 6
    found = decontaminate.leaks(docs_of(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.start_word) for r in found} == {(100 + n, n, 23) for n in range(5, 11)} | {(200 + n, n, 0) for n in range(1, 11)}
    assert all(r.similarity == 1 for r in found)
    assert decontaminate.keep_clean(docs_of(spark, rows), bench).count() == 3 + len(ODD)


def plain_leak(text, item):
    """Whether a place where they share a shingle passes, by brute force over lists of words."""
    def grams(w):
        return [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))]

    of_text, of_item = grams(text), grams(item)
    for a in {max(0, min(i - j, len(text) - len(item))) for i, g in enumerate(of_text) for j, h in enumerate(of_item) if g == h}:
        own, theirs = Counter(grams(text[a : a + len(item)])), Counter(of_item)
        if 100 * (own & theirs).total() >= 75 * (own | theirs).total():
            return True
    return False


def test_edited_copies_leak(spark):
    r = random.Random(1)
    items = {n: words(n, 700 + n).split() for n in (5, 8, 10, 11, 12, 18, 19, 20, 21, 30, 37, 38, 39, 46, 59)}
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    texts = []
    for n, t in items.items():
        copies = [[*t[:k], "zzz", *t[k + 1 :]] for k in range(n)] + [t[n // 2 :] + t[: n // 2]]
        for _ in range(60):
            copy = list(t)
            for _ in range(r.randint(1, 3)):
                k = r.randrange(len(copy))
                copy[k : k + r.randint(0, 1)] = ["zzz"] * r.randint(0, 1)
            copies.append(copy)
        texts += [(n, f"{words(r.randint(0, 9), 8)} {' '.join(c)} {words(r.choice((0, 20)), 9)}") for c in copies]
    found = decontaminate.leaks(docs_of(spark, [(i, t, "a") for i, (_, t) in enumerate(texts)]), bench).collect()
    want = {(i, n) for i, (n, t) in enumerate(texts) if plain_leak(t.split(), items[n])}
    assert len(want) > 400
    assert not want ^ {(x.doc_id, x.item_id) for x in found}


def test_fingerprints_equal_counting(spark):
    from pyspark.sql import functions as F

    text = words(40, 8).split()
    df = spark.createDataFrame([(1, text)], "id long, words array<string>")
    hashes = [h & (2**64 - 1) for h in df.select(F.transform("words", lambda w: F.xxhash64(w))).first()[0]]
    found = decontaminate._fingerprints(df).collect()
    assert [r.start for r in found] == list(range(40))
    for r in found:
        for size, f in ((16, r.f16), (8, r.f8), (4, r.f4)):
            own = hashes[r.start : r.start + size]
            if len(own) == size:
                assert f & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > size)
            else:
                assert f is None


def test_items_that_repeat_an_id_and_large_indexes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_ROWS", 50)  # in several turns
    texts = [words(n, 800 + n) for n in (30, 44, 9, 6, 3)]
    bench = spark.createDataFrame([(1, t, "x") for t in texts] + [(2, texts[0], "y"), (2, texts[0], "y")], "item_id long, text string, doc_id string")
    rows = [(k, t if k == 4 else f"{words(10, k)} {t} {words(12, k)}", "a") for k, t in enumerate(texts)] + [(0, texts[1], "a"), (9, words(90, 1), "a"), *ODD]
    found = decontaminate.leaks(docs_of(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.n_words) for r in found} == {(0, 1, 30), (0, 2, 30), (1, 1, 44), (2, 1, 9), (3, 1, 6), (4, 1, 3)}
    assert all(r.similarity == 1 for r in found)


# ---- lines ----

def without(text, gone):
    """A text without some lines, and without blank ones whose neighbours with words both go."""
    lines = text.split("\n")
    real = [k for k, x in enumerate(lines) if WORD.search(x)]
    before = {k: max((j for j in real if j < k), default=None) for k in range(len(lines))}
    after = {k: min((j for j in real if j > k), default=None) for k in range(len(lines))}
    return "\n".join(x for k, x in enumerate(lines) if not (k in gone if k in real else {before[k], after[k]} <= gone))


def plain_lines(rows, least=50):
    """Windows of whole lines, in order, by brute force."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, gone = {}, {d: set() for d in docs}
    spans = []
    for d in docs:
        lines = [(k, x.strip(" \t\x0b\x0c\r"), len(WORD.findall(x))) for k, x in enumerate(d[1].split("\n")) if WORD.search(x)]
        for a in range(len(lines)):
            for step in (1, -1):
                n, b = 0, a
                while 0 <= b < len(lines):
                    n += lines[b][2]
                    if n >= least:
                        lo, hi = min(a, b), max(a, b)
                        spans.append((d, lines[lo][0], lines[hi][0], tuple(x[1] for x in lines[lo : hi + 1])))
                        break
                    b += step
    order = {d: k for k, d in enumerate(docs)}
    for d, a, b, content in spans:
        place = (order[d], a, b)
        seen[content] = min(seen.get(content, place), place)
    for d, a, b, content in spans:
        if (order[d], a, b) > seen[content]:
            gone[d] |= {k for k in range(a, b + 1) if WORD.search(d[1].split("\n")[k])}
    return {d: without(d[1], g) for d, g in gone.items()}


def plain_runs(rows, least=50):
    """Maximal runs of equal lines of every two documents, by brute force."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    lines = [[(k, x.strip(" \t\x0b\x0c\r"), len(WORD.findall(x))) for k, x in enumerate(t.split("\n")) if WORD.search(x)] for _, t in docs]
    out = {}
    for a, d in enumerate(docs):
        gone = set()
        for b in range(a + 1):
            for x in range(len(lines[a])):
                for y in range(len(lines[b]) if b < a else x):
                    n = 0
                    while x + n < len(lines[a]) and y + n < len(lines[b]) and lines[a][x + n][1] == lines[b][y + n][1]:
                        n += 1
                    if sum(w for *_, w in lines[a][x : x + n]) >= least:
                        gone |= {k for k, *_ in lines[a][x : x + n]}
        out[d] = without(d[1], gone)
    return out


@pytest.mark.parametrize("least", [1, 12, 50, 90])
def test_maximal_runs(spark, least):
    r = random.Random(least)
    lines = [words(r.randint(1, 20), 300 + k) for k in range(9)]
    rows = [(k, "\n".join(r.choice([*lines, "", "  "]) for _ in range(r.randint(1, 14)))) for k in range(25)] + [(40, "\n".join([lines[0]] * 30)), (None, rows_of := "\n".join(lines)), (None, rows_of), (41, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_lines long, n_removed string")
    found = linededup.dedup_lines(docs, least).collect()
    assert len(found) == len(rows)
    want = plain_runs(rows, least)
    assert want == plain_lines(rows, least)
    for x in found:
        source = next(t for i, t in rows if i == x.doc_id)
        assert (x.text or "") == want[(x.doc_id, source or "")]


def test_line_dedup(spark):
    r = random.Random(4)
    lines = [words(r.randint(1, 30), 900 + k) for k in range(25)]
    passage = [words(30, 1), "", words(25, 2)]
    rows = []
    for k in range(30):
        own = [r.choice(lines) for _ in range(r.randint(1, 9))]
        if k % 3 == 0:
            own[1:1] = passage
        rows.append((k, "\n".join(own)))
    rows += [(50, words(70, 3)), (51, words(70, 3) + "\nmore"), (52, ""), (53, None), (53, None), (54, "\n" * 50), (None, words(70, 3))]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, gone string")
    found = linededup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    want = plain_lines(rows)
    for x in found.collect():
        source = [t for i, t in rows if i == x.doc_id][0]
        assert (x.text or "") == want[(x.doc_id, source or "")]
        assert (x.text is None) == (source is None)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


# ---- mixing ----

def test_targets(spark):
    sizes = {"a": 1000, "b": 50, "c": 700, "d": 3000, "e": 0, None: 400}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(rows).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, todo = dict.fromkeys(sizes, 0.0), 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9 and todo:
        w = sum(weight[s] for s in todo)
        share = {s: left * weight[s] / w for s in todo}
        left = 0.0
        for s in list(todo):
            target[s] += share[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                todo.discard(s)
    assert {s: pytest.approx(t) for s, t in target.items()} == found


def test_mix(spark):
    rows = [(k, words(20 + k % 50, k), "abc"[k % 3] if k % 7 else None) for k in range(900)] + ODD
    docs = docs_of(spark, rows)
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows)
    taken, target = Counter(), {}
    for r in found:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        biggest = max(r.size for r in found if r.source == s)
        assert abs(taken[s] - t) <= biggest
    assert sorted(map(repr, mixing.mixed(docs.repartition(7)).collect())) == sorted(map(repr, found))
    drawn = mixing.draw(docs)
    assert drawn.columns == docs.columns
    assert drawn.count() == sum(r.copies for r in found)
    assert mixing.draw(docs.limit(0)).count() == 0


def test_mix_of_repeated_ids_and_many_sources(spark):
    rows = [(None, words(5 + k % 3, k), f"s{k % 40}") for k in range(400)] + [(7, words(9, 1), "s1")] * 30
    docs = spark.createDataFrame([(i, t, s, "a", 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size string, target long, taken long")
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows)
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in found)
    assert mixing.mixed(docs).columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    assert sorted(map(repr, mixing.mixed(docs.repartition(5)).collect())) == sorted(map(repr, found))


# ---- shards ----

def test_shards_of_one_id_and_clashing_names(spark):
    rows = [(None, words(3, k), k, 0, "x") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size int, slot int, shard string")
    found = sharding.sharded(docs).collect()
    assert len({r.shard for r in found}) == 1 and sorted(r.slot for r in found) == list(range(200))
    assert len({int(r["size"]) for r in found}) > 1 and found[0].__fields__[0] == "doc_id"


def test_shards(spark):
    rows = [(k, words(k % 9, k), "a") for k in range(3000)] + ODD
    found = sharding.sharded(docs_of(spark, rows)).collect()
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.4 * len(rows) / 16
    moved = sum(r.grown_shard == 16 for r in found)
    assert 0.5 * len(rows) / 17 < moved < 1.6 * len(rows) / 17
    assert sharding.sharded(docs_of(spark, rows).limit(0)).count() == 0


def test_movement_stays_in_subtrees_that_change(spark):
    docs = spark.createDataFrame([(k,) for k in range(4000)], "doc_id long")
    before = {"r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0}}, "r1": {"k2": {3: 2.0}, "k3": {4: 1.0, 5: 1.0}}}
    after = {"r0": before["r0"], "r1": {"k2": {3: 2.0}, "k3": {4: 1.0, 5: 3.0}}}
    both = sharding.placed(sharding.placed(docs, before, "a"), after, "b").collect()
    heavier = {(0, 3), (0, 4), (0, 5), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)}
    assert {(r.a, r.b) for r in both if r.a != r.b} <= heavier  # nothing moves within r0, or out of r1 or k3


# ---- broadcasts ----

def test_broadcasts_are_bound_by_bytes(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "x" * 60, [1, 2]), (2, None, None), (None, "é" * 20, [])], "a long, b string, c array<long>")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.broadcast_if_small(rows)) and hinted(common.broadcast_if_small(rows.limit(0)))
    assert not hinted(common.broadcast_if_small(rows, 2))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    assert not hinted(common.broadcast_if_small(rows)) and hinted(common.broadcast_if_small(rows.select("a")))


def test_results_do_not_depend_on_broadcasts(spark, sf_dir, monkeypatch):
    """What is beyond the bound is joined by a shuffle, with the same rows."""
    queries = quality.query, mixing.query
    before = [sorted(map(repr, q(spark, sf_dir).collect())) for q in queries]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert before == [sorted(map(repr, q(spark, sf_dir).collect())) for q in queries]
