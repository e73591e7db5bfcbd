"""Secret scan: random-looking strings, told from false positives by a random forest.

Candidates are maximal runs of `[A-Za-z0-9_+/=-]` of `MIN_LENGTH` bytes or more that hold a
digit or mix cases. Each is described by its length, the transitions between kinds of
characters, its entropy, how much of it dictionary words cover, whether it is part
of a path or address, and the neighbouring words. A random forest (MLlib), trained
on labelled findings (text, start, end, label), removes the false positives.

`labelled_findings` makes the findings that the query trains on: a bounded,
documented table of keys in many written forms against checksums, identifiers, card
numbers, paths, versions and placeholders. Callers with findings of their own pass those.

Defined cases: null and empty texts have no candidates; each occurrence is a row of
its own, also in repeated documents; a candidate at a text's edge has no
neighbour there; an empty table gives an empty result. Secrets are never
returned in full: `masked` shows the first four characters and the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbatch import pieces, utf8

MIN_LENGTH = 16
THRESHOLD = 0.5
TREES, DEPTH = 30, 8
N_FINDINGS = 4000
NEAR_BYTES = 48
NEAR_BUCKETS = 8

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"_+/=-"]] = True
#: 0 lower case, 1 upper case, 2 digit, 3 mark
_KIND = np.full(256, 3, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103), *range(65, 71), 45]] = True

#: Words whose presence makes a string readable.
DICTIONARY = """
    about access account admin after agent align alpha image index inner input after array asset async author base beta
    block body build button cache call case change check class client close code color column commit common config content
    copy count create data date debug default delete demo desc detail device disable display document domain down edit
    email enable end error event example export false field file filter final first font footer form format from function
    group handle hash head header help hidden home html http icon image import index info inner input insert install int
    item json key label language last layer layout left length level link list load local lock log login main make map
    margin mark master match max media menu message method min model module name new next node none null number object
    off old open option order other output package page param parent part pass path place plain player point port post
    prefix print process product profile project public query queue random range read record release remove replace report
    request reset resource result right role root route row rule run sample save scale screen script search section select
    server service session set show sign simple size slot sort source space sql src stack start state status step stop
    store string style sub sum support switch system tab table tag target task temp template test text theme this time
    title tool top total trace tree true type unit update upload url user util value version video view web width window
    word work wrap write year your changeme placeholder dummy
""".split()
_WORDS = frozenset(w for w in DICTIONARY if len(w) >= 3)
_LONGEST = max(map(len, _WORDS))
#: Neighbouring words that speak for a secret, and against one.
FOR = ("token", "secret", "password", "passwd", "pwd", "api", "apikey", "key", "auth", "bearer", "credential", "private", "access", "signature", "client")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "guid", "id", "isbn", "card", "phone", "order", "revision", "version", "example", "etag", "integrity")
FEATURES = 16 + 9 + 6 + 4 + NEAR_BUCKETS


def coverage(text: str) -> float:
    """Share of characters inside dictionary words, longest first from the left."""
    text, i, covered = text.lower(), 0, 0
    while i < len(text):
        for n in range(min(_LONGEST, len(text) - i), 2, -1):
            if text[i : i + n] in _WORDS:
                covered += n
                i += n
                break
        else:
            i += 1
    return covered / max(len(text), 1)


def features(token: bytes, before: bytes, after: bytes) -> np.ndarray:
    """The forest's input for one candidate and the bytes on either side of it."""
    x = np.frombuffer(token, np.uint8)
    out = np.zeros(FEATURES)
    kind = _KIND[x]
    out[:16] = np.bincount(kind[:-1] * 4 + kind[1:], minlength=16) / max(len(x) - 1, 1)
    share = np.bincount(x, minlength=256) / len(x)
    some = share[share > 0]
    run = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    out[16:25] = [np.log(len(x)), -(some * np.log2(some)).sum(), len(some) / min(len(x), 64), _HEX[x].all(), *(np.bincount(kind, minlength=4) / len(x)), np.diff(np.append(run, len(x))).max() / len(x)]
    text = token.decode("ascii")
    out[25:31] = [coverage(text), token.count(b"/") / len(token), token.count(b"-") / len(token), before[-1:] in (b"/", b".", b"\\"), b"://" in before[-24:], after[:1] in (b"/", b".", b"\\")]
    left, right = before.decode("utf-8", "ignore").lower(), after.decode("utf-8", "ignore").lower()
    split = lambda s: "".join(c if c.isalnum() else " " for c in s).split()
    near = [*split(left)[-3:], *split(right)[:2]]
    parts = set(near)
    out[31:35] = [any(w in parts for w in FOR), any(w in parts for w in AGAINST), left.rstrip("\"' ")[-1:] in ("=", ":") and len(left) > 0, left[-1:] in ("\"", "'", "`") and len(left) > 0]
    for w in near:
        out[35 + sum(w.encode()) % NEAR_BUCKETS] += 1
    return out


def candidates(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of every candidate in some texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TOKEN[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | border))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | border))
    for i in np.flatnonzero(end - start >= MIN_LENGTH):
        a, b = start[i], end[i]
        kinds = np.bincount(_KIND[data[a:b]], minlength=4)
        if kinds[2] or (kinds[0] and kinds[1] > 1 and _KIND[data[a + 1 : b]].min() != 1):
            yield int(np.searchsorted(offsets, a, "right")) - 1, int(a), int(b)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        rows, start, end, masked, x = [], [], [], [], []
        for lo, hi in pieces(offsets):
            part, base = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            for t, a, b in candidates(part, base):
                token = part[a:b].tobytes()
                rows.append(lo + t)
                start.append(a - base[t])
                end.append(b - base[t])
                masked.append(f"{token[:4].decode()}...{b - a}")
                x.append(features(token, part[max(base[t], a - NEAR_BYTES) : a].tobytes(), part[b : min(base[t + 1], b + NEAR_BYTES)].tobytes()).tolist())
        if rows:
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(masked), pa.array(x, pa.list_(pa.float64()))], names=[*names, "start", "end", "masked", "x"])


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, start, end (bytes), masked and x for each candidate."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(_describe, f"{kinds}, start long, end long, masked string, x array<double>")


def labelled_findings(spark: SparkSession, n: int = N_FINDINGS, seed: int = 5) -> DataFrame:
    """(text, label): n lines with one string each, half of them secrets."""
    rng = np.random.default_rng(seed)
    hexa, digits = "0123456789abcdef", "0123456789"
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    pick = lambda xs: xs[rng.integers(0, len(xs))]
    word = lambda: some("abcdefghijklmnopqrstuvwxyz", int(rng.integers(2, 10)))
    rows = []
    for i in range(n):
        name = pick(["token", "secret", "password", "api_key", "apikey", "auth_token", "access key", "client_secret", "private key", "pwd"])
        quote = pick(['"', "'", ""])
        if i % 2:
            key = pick([lambda: some(hexa, 40), lambda: some(hexa, 32), lambda: some(hexa, 64), lambda: some(alnum, int(rng.integers(20, 48))), lambda: "AK" + "IA" + some(alnum[:26] + digits, 16), lambda: pick(["gh" + "p_", "s" + "k_live_", "xo" + "xb-"]) + some(alnum, 36), lambda: some(alnum + "+/", 40) + pick(["", "=", "=="])])()
            lead = pick([f"{name} = {quote}", f"{name}: {quote}", f"{name}={quote}", f"Bearer ", f"{name} {quote}"]) if i % 8 != 7 else pick(["", quote])
            text = f"{word()} {word()} {lead}{key}{quote if lead.endswith(quote) else ''} {word()} {word()}"
        else:
            text = pick([
                lambda: f"{word()} {word()} {some(digits, int(rng.integers(16, 20)))} {word()}",
                lambda: f"{pick(['commit', 'sha1', 'revision', 'checksum', 'md5'])} {some(hexa, int(pick([32, 40, 64])))} {word()}",
                lambda: f"id {some(hexa, 8)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 4)}-{some(hexa, 12)} {word()}",
                lambda: f"{word()} https://{word()}.com/{word()}/{word()}/{word()}-{some(digits, 4)}-{word()}/{word()} {word()}",
                lambda: f"see {word()}/{pick(DICTIONARY)}/{pick(DICTIONARY)}_{some(digits, 2)}/{pick(DICTIONARY)} {word()}",
                lambda: f"{name} = {quote}{pick(['your', 'example', 'test', 'changeme', 'placeholder'])}_{pick(DICTIONARY)}_{pick(DICTIONARY)}_{some(digits, 1)}{quote}",
                lambda: f"{name}={quote}{pick('x0*-=A') * 8}1{'x' * 12}{quote} {word()}",
                lambda: f"{word()} {pick(DICTIONARY).title()}{pick(DICTIONARY).title()}{pick(DICTIONARY).title()}{pick(DICTIONARY).title()} {word()}",
                lambda: f"{word()} 20{some(digits, 2)}-{some(digits, 2)}-{some(digits, 2)}-{some(digits, 6)} {word()}",
                lambda: f"{word()} {'=' * 18}{some(digits, 1)} {word()}",
            ])()
        rows.append((text, float(i % 2)))
    return spark.createDataFrame(rows, "text string, label double")


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest from (text, label); every candidate of a text has its label."""
    rows = described(findings, ["label"]).select("label", array_to_vector("x").alias("features"))
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=3).fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, masked, score and is_secret for every candidate."""
    rows = model.transform(described(docs, ["doc_id"]).withColumn("features", array_to_vector("x")))
    rows = rows.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return rows.select("doc_id", "start", "end", "masked", "score", (F.col("score") >= threshold).alias("is_secret"))
