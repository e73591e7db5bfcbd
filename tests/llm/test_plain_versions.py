"""Language identification and the sharding query against versions in plain Python."""

from __future__ import annotations

import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

from attestor.llm import language_id
from attestor.llm.registry import queries

from .helpers import documents

MASK = (1 << 64) - 1


def buckets(text: str) -> list[int]:
    points = [ord(c) if ord(c) >= 65 else 32 for c in text.lower()]
    out = []
    for n in range(1, language_id.MAX_N + 1):
        for i in range(len(points) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 31 + (points[i + k] + k + 1) * int(language_id._MULTIPLIERS[k])) & MASK
            out.append(((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 & MASK) >> (64 - language_id.BUCKET_BITS))
    return out


def test_language_is_that_of_naive_bayes_with_dicts(spark):
    rng = random.Random(8)
    letters = {"en": "the and of ing er", "fr": "le éa ou que ment", "zz": "日本 の は を"}
    texts = {i: (" ".join(rng.choice(letters[k].split()) + rng.choice("abcé ") for _ in range(rng.randrange(1, 30))), k) for i, k in enumerate(rng.choice(list(letters)) for _ in range(90))}
    rows = spark.createDataFrame([(i, t, k if i % 3 else None) for i, (t, k) in texts.items()], "doc_id long, text string, lang string")
    counts, docs = defaultdict(Counter), Counter()
    for i, (t, k) in texts.items():
        if i % 3:
            counts[k].update(buckets(t))
            docs[k] += 1
    asked = {**{i: t for i, (t, _) in texts.items()}, 900: None, 901: "12 !", 902: "", 903: "the THE thé", 904: "the " * 3000}
    got = {r["doc_id"]: r for r in language_id.predict(documents(spark, asked).repartition(3), language_id.fit(rows)).collect()}
    total = {k: sum(c.values()) + language_id.SMOOTHING * language_id.BUCKETS for k, c in counts.items()}
    for i, text in asked.items():
        if not any(unicodedata.category(c).startswith("L") for c in text or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == (language_id.UNKNOWN, 0.0)
            continue
        seen = Counter(buckets(text))
        logs = {k: math.log(docs[k] / sum(docs.values())) + sum(n * math.log((counts[k][b] + language_id.SMOOTHING) / total[k]) for b, n in seen.items()) for k in docs}
        best = max(sorted(logs), key=logs.__getitem__)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-6


def test_the_sharding_query_keeps_its_law(spark):
    small = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries()["op2_sharding"](spark, small).collect()
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    size = lambda t: len(t.encode()) + 1
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (size(texts[r["doc_id"]]), zlib.crc32(texts[r["doc_id"]].encode()))
    shards = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        shards[r["shard"]].append(r)
    assert all([r["slot"] for r in part] == list(range(len(part))) for part in shards.values()) and set(shards) <= set(range(16))
    ids = [r["doc_id"] for s in sorted(shards) for r in shards[s]]
    assert ids == sorted(texts)  # contiguous
    mean, most = sum(map(size, texts.values())) / 16, max(map(size, texts.values()))
    assert all(abs(sum(r["size"] for r in shards.get(s, [])) - mean) <= most for s in range(16))
