"""Secret scans whose false positives a random forest removes.

Candidates are runs of MIN_LENGTH and more key characters with a digit or mixed
case, values of MIN_ASSIGNED and more printable characters that a secret-like name is
given by = or :, passwords in URLs, and the bodies of PEM blocks, line ends included. Each is described by its length, its
transitions between classes of characters, the share that dictionary words
cover, the path or address that it stands in and the words beside it. The forest is trained on labelled findings. There are
none among the tables, so they are drawn here from stated formats, ROWS of
them: credentials, passwords and phrases in assignments, headers and URLs on one hand; commits, checksums, UUIDs, paths,
addresses, numbers, identifiers, plain words, code and placeholders on the other. Training data
is bounded by that parameter; every candidate of every text is scored.
"""

from __future__ import annotations

import random
import re
import string
import sys
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import table

MIN_LENGTH = 16
MIN_ASSIGNED = 8
ROWS = 6_000
TREES, DEPTH, SEED = 40, 8, 7
THRESHOLD = 0.5
CONTEXT = 48  # characters read on either side

SECRET_WORDS = frozenset("token secret key apikey api_key password passwd pwd auth authorization bearer credential credentials private access access_key client_secret signing".split())
BENIGN_WORDS = frozenset("commit sha sha1 sha256 md5 checksum digest hash revision rev etag uuid guid id build version blob tree object file path href src url page isbn order serial".split())
DICTIONARY = sorted(
    "about after again also and another any are back because been before being between both build but called can change class client code come config could data date day default did different does down each end even example file find first for from function get give good great group had has have help her here high him his home host house how image include index info into its just key know large last left life light like line list little local long look made main make man many method may men might model module more most move much must name need never new next node not now number object off old one only open order other our out over own page part path people place point public read request response right said same sample say see server service set she should show side small some sound source spell state static still string such system take tell temp test than that the their them then there these they thing think this those three through time token too turn two type under until use user value very want was water way well went were what when where which while who why will with word work world would write year you your".split(),
    key=len,
    reverse=True,
)
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "xxxx", "0000", "1234567", "abcdef", "dummy", "sample", "test")

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=.\-]{%d,}" % MIN_LENGTH)
NAME = r"(?i:pass|pwd|secret|token|key|credential|auth|private|access|signing)[A-Za-z0-9_-]{0,32}[\"'`\]]{0,2}[ \t]{0,8}(?::=|=>|=|:)[ \t]{0,8}"
VALUE = r"""(?:"[^"\r\n]{%d,512}"|'[^'\r\n]{%d,512}'|`[^`\r\n]{%d,512}`|[^ \t\r\n"'`][^ \t\r\n]{%d,511})""" % (*[MIN_ASSIGNED] * 3, MIN_ASSIGNED - 1)
IN_URL = r"""://[^ \t\r\n/:@"'`]{0,128}:[^ \t\r\n/"'`]{1,256}@"""
ASSIGNED = re.compile(f"{NAME}(?=({VALUE}))", re.ASCII)  # looks ahead: a value may hold a name itself
URL = re.compile(IN_URL)
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{1,64}-----\s([A-Za-z0-9+/=\s]{%d,16384}?)\s?-----END" % MIN_LENGTH)
ANY = "[A-Za-z0-9_+/=.-]{%d,}|%s%s|%s" % (MIN_LENGTH, NAME, VALUE, IN_URL)  # of Java and Python alike
_WORDS = re.compile("|".join(w for w in DICTIONARY if len(w) >= 3))
_USER = re.compile(r"://[^\s/:@]*:$")
_NEAR = re.compile(r"[A-Za-z][A-Za-z0-9_]*")
FEATURES = ["length", "transitions", "digits", "uppers", "hex_only", "entropy", "coverage", "vowels", "longest_letters", "placeholder", "slashes", "dots", "dashes", "in_path", "secret_near", "secret_distance", "benign_near", "assigned", "quoted", "symbols", "spaces", "url_password", "private_block"]


def _class(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "o"


def features(value: str, left: str, right: str) -> list[float]:
    """A candidate's numbers, in the order of FEATURES."""
    n, low = len(value), value.lower()
    kinds = [_class(c) for c in value]
    counts = Counter(value)
    entropy = -sum(k / n * log2(k / n) for k in counts.values())
    covered = sum(len(m) for m in _WORDS.findall(low))
    runs = re.findall(r"[A-Za-z]+", value)
    before, after = [[w.lower() for w in _NEAR.findall(x)] for x in (left, right)]
    near = before[-3:] + after[:1]
    distance = next((k for k, w in enumerate(reversed(before)) if w in SECRET_WORDS or any(s in w for s in ("token", "secret", "passw", "apikey", "api_key"))), 9)
    tail = left.rstrip("\"'` ")
    return [
        float(n),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        kinds.count("d") / n,
        kinds.count("u") / n,
        float(all(c in "0123456789abcdef" for c in low)),
        entropy,
        covered / n,
        sum(c in "aeiou" for c in low) / n,
        float(max(map(len, runs), default=0)),
        float(any(p in low for p in PLACEHOLDERS)),
        float(value.count("/")),
        float(value.count(".")),
        float(value.count("-")),
        float(left.endswith(("/", "@", "://", "\\")) or right.startswith(("/", "@"))),
        float(distance < 3),
        float(min(distance, 9)),
        float(any(w in BENIGN_WORDS for w in near)),
        float(tail.endswith(("=", ":", "=>")) or tail.lower().endswith("bearer")),
        float(left.endswith(('"', "'", "`"))),
        sum(c in string.punctuation and c not in "_+/=.-" for c in value) / n,
        float(value.count(" ")),
        float(bool(_USER.search(left)) and right.startswith("@")),
        float(left.rstrip().endswith("PRIVATE KEY-----")),
    ]


def labelled_findings(rows: int = ROWS, seed: int = SEED) -> Iterator[tuple[str, str, str, int]]:
    """(left, value, right, secret), half of them secret, from a seeded draw."""
    r = random.Random(seed)
    alnum, hexa, base = string.ascii_letters + string.digits, string.digits + "abcdef", string.ascii_letters + string.digits + "+/"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    letters = lambda: some("etaoinshrdlu", r.randint(2, 9))
    prose = lambda: " ".join(letters() for _ in range(4))
    named = ["token", "api_key", "apikey", "secret", "password", "auth_token", "access_key", "client_secret", "private_key", "secret_key"]
    plain = ["commit", "sha256", "md5", "checksum", "etag", "revision", "build", "uuid", "id", "blob", "digest"]
    leet = str.maketrans("aeios", "43105")
    capital = lambda w: w.capitalize() if r.random() < 0.6 else w
    mark = lambda: r.choice("!@#$%&*?-_.")
    word = lambda: r.choice(DICTIONARY) if r.random() < 0.6 else letters()
    names = [*named, "passwd", "pwd", "db_password", "DB_PASS", "secretKey", "passphrase", "credentials"]
    sign = lambda: r.choice([" = ", "=", ": ", ":", " := ", " => "])
    passwords = [
        lambda: capital(word()).translate(leet) + mark() + capital(word()).translate(leet) + str(r.randint(10, 9999)),
        lambda: word() + str(r.randint(0, 99)) + some(alnum, r.randint(3, 5)),
        lambda: capital(word()) + str(r.randint(0, 9)) + some(string.ascii_letters, 2) + str(r.randint(0, 99)),
        lambda: capital(word()).translate(leet) + mark() + str(r.randint(1900, 2099)) + mark() + word(),
        lambda: some(alnum + "!@#$%^&*?~+-_", r.randint(8, 32)),
        lambda: some(alnum, r.randint(8, 15)),
        lambda: some(string.ascii_lowercase, r.randint(12, 32)),
        lambda: some("bcdfghjklmnpqrstvwxz", r.randint(4, 8)) + some(string.ascii_lowercase, r.randint(8, 12)),
    ]
    others = [
        lambda: "".join(word() for _ in range(3)),
        lambda: capital(letters() + letters()),
        lambda: f"{r.choice(DICTIONARY)}_{r.choice(DICTIONARY)}_{r.choice(named)}",
        lambda: f"get_{r.choice(named)}({r.choice(DICTIONARY)})",
        lambda: f"os.environ['{r.choice(named).upper()}']",
        lambda: f"{r.choice(['self', 'settings', 'config', letters()])}.{r.choice(named)}",
        lambda: f"${{{r.choice(names).upper()}}}",
        lambda: f"<your-{r.choice(named)}>",
        lambda: r.choice(["********", "xxxxxxxxxx", "changeme", "required", "undefined", "password", "placeholder", "12345678", "optional,", "example123"]),
        lambda: " ".join(word() for _ in range(r.randint(2, 8))),
        lambda: f"{letters()}/{letters()}/{letters()}.{r.choice(['pem', 'txt', 'json'])}",
    ]
    for k in range(rows):
        if r.random() < 0.04:
            body = "\n".join(some(base, 64) for _ in range(r.randint(1, 24))) + "\n" + some(base, r.randint(4, 60)) + r.choice(["", "=", "=="])
            kind = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY"] if k % 2 == 0 else ["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "PGP SIGNATURE"])
            yield f"{prose()} -----BEGIN {kind}-----\n", body, f"\n-----END {kind}-----", int(k % 2 == 0)
        elif r.random() < 0.4:
            value = r.choice(passwords if k % 2 == 0 else others)()
            value += (some(alnum, MIN_ASSIGNED) if k % 2 == 0 else letters() * MIN_ASSIGNED)[: max(0, MIN_ASSIGNED - len(value))]
            if r.random() < 0.2:
                value = value if k % 2 == 0 else r.choice(["password", "pass", "PASSWORD", "changeme", "<password>", "${PASSWORD}", "xxxx", "$PASS", "secret"])
                yield f"{prose()} {r.choice(['postgres', 'mysql', 'https', 'amqp', 'redis'])}://{letters()}:", value.replace("@", "!"), f"@{letters()}.{letters()}/{letters()}", int(k % 2 == 0)
            else:
                quote = r.choice(['"', "'", ""]) if " " not in value and "'" not in value else '"'
                yield f"{prose()} {r.choice(names)}{sign()}{quote}", value, f"{quote} {prose()}", int(k % 2 == 0)
        elif k % 2 == 0:
            value = r.choice([lambda: some(hexa, r.choice([32, 40, 64])), lambda: some(base, r.choice([24, 32, 40, 43, 64])), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + some(alnum, 36), lambda: "sk-" + some(alnum, r.choice([32, 48])), lambda: some(alnum, r.randint(16, 40))])()
            name, link, quote = r.choice(named), r.choice([" = ", "=", ": ", ":", " := ", " => "]), r.choice(['"', "'", ""])
            left = r.choice([f"{prose()} {name}{link}{quote}", f"{prose()} {name.upper()}{link}{quote}", f"{prose()} {name} {quote}", f"{prose()} Authorization: Bearer "])
            if r.random() < 0.3:
                value = value.upper() if r.random() < 0.5 else value
            yield left, value, f"{quote} {prose()}", 1
        else:
            made = r.choice(
                [
                    lambda: (f"{prose()} {r.choice(plain)}{r.choice([' ', ': ', '='])}", some(hexa, r.choice([32, 40, 64]))),
                    lambda: (f"{prose()} {r.choice(['uuid', 'id', ''])} ", "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12))),
                    lambda: (f"{prose()} ", some(string.digits, r.randint(16, 19))),
                    lambda: (f"{prose()} https://", f"www.{letters()}.com/{letters()}/{letters()}{r.randint(1, 9999)}.html"),
                    lambda: (f"{prose()} /", "/".join(letters() for _ in range(4)) + f"{r.randint(1, 99)}.py"),
                    lambda: (f"{prose()} ", "".join(letters().capitalize() for _ in range(4)) + str(r.randint(0, 9))),
                    lambda: (f"{prose()} ", "_".join(r.choice(DICTIONARY) for _ in range(4)) + str(r.randint(0, 99))),
                    lambda: (f"{prose()} {r.choice(named)} = \"", r.choice(["your_api_key_goes_here_1", "changeme1234567890", "xxxxxxxxxxxxxxxxxxxx1", "EXAMPLE_TOKEN_0000000000", "test_placeholder_12345"])),
                    lambda: (f"{prose()} ", f"{letters()}.{letters()}{r.randint(1, 99)}.{letters()}.com"),
                    lambda: (f"{prose()} ", some(hexa, r.choice([32, 40]))),
                    lambda: (f"{prose()} v", f"{r.randint(1, 9)}.{r.randint(10, 99)}.{r.randint(1, 99)}-{letters()}.{r.randint(10000, 99999)}"),
                    lambda: (f"{prose()} {r.choice(named)} ", letters() + letters() + letters() + letters() + r.choice(["", "1"])),
                ]
            )()
            yield made[0], made[1] + "a" * max(0, MIN_LENGTH - len(made[1])), f" {prose()}", 0


def trained(spark: SparkSession, findings: list[tuple[str, str, str, int]]) -> PipelineModel:
    """A forest over labelled findings; one partition and a seed make it the same each time."""
    rows = [(*features(value, left, right), float(label)) for left, value, right, label in findings]
    data = spark.createDataFrame(rows, [*FEATURES, "label"]).coalesce(1)
    forest = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="v"), forest]).fit(data)


def _named(text: str) -> Iterator[tuple[int, str]]:
    """(start, value) of what a secret-like name is given, and of passwords in URLs."""
    for m in ASSIGNED.finditer(text):
        value = m.group(1)
        if value[0] in "\"'`":
            yield m.start(1) + 1, value[1:-1]
        else:
            bare = re.split("[\"'`]", value)[0].rstrip(",;)]}")  # what closes a list, a call or a string around it
            yield m.start(1), bare if len(bare) >= MIN_ASSIGNED else value
    for m in URL.finditer(text):
        at = m.group().index(":", 3) + 1
        yield m.start() + at, m.group()[at:-1]


def _runs(text: str) -> Iterator[tuple[int, str]]:
    """(start, value) of long runs of key characters."""
    for m in CANDIDATE.finditer(text):
        value = m.group().strip(".=-/")
        start = m.start() + m.group().index(value) if value else m.start()
        mixed = any(c.isupper() for c in value[1:]) and any(c.islower() for c in value)
        if len(value) >= MIN_LENGTH and (mixed or any(c.isdigit() for c in value)):
            if "=" in value:  # an assignment without spaces
                name, _, rest = value.partition("=")
                if len(rest) >= MIN_LENGTH:
                    start, value = start + len(name) + 1, rest
            yield start, value


def candidates_of(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(start, value, left, right) of every candidate, each once; a run and the same value with = or . at its end are one,
    and so are a PEM block's body and what lies in it."""
    blocks = [(m.start(1), m.group(1)) for m in PEM.finditer(text)] if "-----BEGIN " in text else []
    outside = lambda at: not any(a <= at < a + len(v) for a, v in blocks)
    runs = {start: value for start, value in _runs(text) if outside(start)}
    named = {(start, value) for start, value in _named(text) if outside(start) and runs.get(start) != value.rstrip(".=-/")}
    for start, value in sorted({*runs.items(), *named, *blocks}):
        yield start, value, text[max(0, start - CONTEXT) : start], text[start + len(value) : start + len(value) + CONTEXT]


SCHEMA = ", ".join(["doc_id long", "start long", "value string", *[f"{f} double" for f in FEATURES]])


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs in batches:
        rows = []
        for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
            for start, value, left, right in candidates_of(text):
                rows.append((None if pd.isna(doc_id) else int(doc_id), start, value, *features(value, left, right)))
        yield pd.DataFrame(rows, columns=["doc_id", "start", "value", *FEATURES]).astype({"doc_id": "Int64"})


def scan(docs: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, length, value, probability, is_secret): every candidate of docs(doc_id, text), a secret from the threshold on.

    start counts code points. Null and empty texts have no candidates; a null
    doc_id stays null; repeated rows are scanned each. Only texts with a long
    enough run of key characters, an assignment or a URL's password leave the JVM.
    """
    found = docs.select("doc_id", "text").where(F.col("text").rlike(ANY)).mapInPandas(_found, SCHEMA)
    scored = model.transform(found).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select("doc_id", "start", F.col("length").cast("long").alias("length"), "value", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its verdict; the value by its SHA-256 sum only."""
    model = trained(spark, list(labelled_findings()))
    return scan(table(spark, sf_dir, "documents"), model).withColumn("value", F.sha2("value", 256)).withColumnRenamed("value", "value_sha256")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
