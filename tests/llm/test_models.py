import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from attestor.llm import decontamination, language_id, mixing, quality, registry, secrets, sharding, topk_search

from .helpers import ODD, SCHEMA, documents, prose, rows


def junk(seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["AAA!!", "###", "BUY", "$$$", "now!!!"]) for _ in range(60))


# --- sharding ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 5, 300])
def test_shards_are_cut_at_equal_bytes(spark, n):
    texts = {i: prose(1 + i % 37, i) for i in range(n)} | ODD
    got = sorted(rows(sharding.byte_shards(documents(spark, texts, shard="x", size="y")).select("doc_id", "size", "shard", "slot")))
    total, start = sum(r[1] for r in got), 0
    slots = {}
    for doc_id, size, shard, slot in got:
        assert size == len((texts[doc_id] or "").encode()) + 1
        assert shard == min(15, start * 16 // total)
        assert slot == slots.get(shard, 0)
        slots[shard] = slot + 1
        start += size


def test_shards_of_repeated_rows_null_keys_and_nothing(spark):
    df = spark.createDataFrame([(None, "a", "", "", 1), (3, "b", "", "", 1), (3, "b", "", "", 1)], SCHEMA)
    got = sharding.byte_shards(df)
    assert sorted((r["shard"], r["slot"]) for r in got.collect()) == [(0, 0), (5, 0), (10, 0)]
    assert sharding.byte_shards(spark.createDataFrame([], SCHEMA)).count() == 0


# --- quality ----------------------------------------------------------------------------------------


def test_quality_learns_from_document_labels(spark):
    texts = {i: junk(i) if i % 4 == 0 else prose(120, i) for i in range(200)} | {901: None, 902: "", 903: " \n"}
    docs = documents(spark, texts, score="x", y="z")
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)] + [(None, 1, 0), (3, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(got[i]["predicted"] == int(i % 4 != 0) for i in range(160, 200))
    again = {r["doc_id"]: r["score"] for r in quality.quality(docs, labels).collect()}
    assert all(abs(again[k] - r["score"]) < 1e-9 for k, r in got.items())


def test_quality_without_labels_or_of_one_kind(spark):
    docs = documents(spark, {1: "a b", 2: None})
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0)], none.schema)
    assert {round(r["score"], 6) for r in quality.score(docs, quality.fit(docs, one)).collect()} == {round(2 / 3, 6)}
    assert quality.quality(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(k, quality.FEATURES)) for k in (1, 3, 5, 2) * 12]
    y = np.array([float(b[:, 0].max() > 0.5) for b in bags])
    model = quality.AttentionModel().train(bags, y, epochs=200)
    got = model.score(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]))
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.9


# --- language ---------------------------------------------------------------------------------------

LETTERS = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "äöüßxyzw"}


def test_language_id(spark):
    rng, data = random.Random(3), []
    for i in range(240):
        lang = list(LETTERS)[i % 3]
        text = " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(5)) for _ in range(12))
        data.append((i, text, None if i % 20 == 7 else lang, "s", 1))
    data += [(900, None, "aa", "s", 1), (901, "", "bb", "s", 1), (902, "12 34 !", "bb", "s", 1), (5, data[5][1], data[5][2], "s", 1)]
    got = language_id.language_id(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[k] for k in (900, 901, 902)] == ["und"] * 3
    assert all(by[i] == list(LETTERS)[i % 3] for i in range(240))
    assert any(r["held_out"] for r in got) and not all(r["held_out"] for r in got)
    assert language_id.language_id(spark.createDataFrame([], SCHEMA)).count() == 0
    only = language_id.language_id(spark.createDataFrame([(1, "abc", None, "", 1)], SCHEMA)).collect()
    assert [(r["lang_pred"], r["score"]) for r in only] == [("und", 0.0)]


# --- mixing -----------------------------------------------------------------------------------------


def test_rates_meet_targets_and_stay_nonnegative(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.4, 0.4], 400)
    tokens = rng.integers(1, 500, 400)
    table = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.85, "b": 0.1, "c": 0.05}):
        steps, gap = mixing.fit_rates(table, ["a", "b", "c"], weights)
        rate = np.ones(400)
        for g in steps:
            rate = np.maximum(0, rate - p @ np.array(g))
        share = (rate * tokens) @ p / tokens.sum()
        assert np.allclose(share - np.array(list(weights.values())), gap, atol=1e-9)
        assert np.abs(gap).max() < 2e-3 and rate.min() >= 0


def test_mixing_bears_odd_input(spark):
    texts = {i: ("bad " if i % 5 == 0 else "good ") + prose(20, i) for i in range(60)} | ODD
    docs = documents(spark, texts, p="x", rate="y")
    labels = mixing.label_domains(spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(50)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int"))
    out = mixing.mix(docs.select("doc_id", "text"), labels, docs, {"clean": 0.95, "toxic": 0.05}).collect()
    assert len(out) == len(texts)
    assert all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and abs(sum(r["p"]) - 1) < 1e-9 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[900]["tokens"] == 0 and by[900]["copies"] == 1
    assert by[0]["rate"] < by[1]["rate"]
    assert "Python" not in mixing.mix(docs.select("doc_id", "text"), labels, docs, {"clean": 1.0})._jdf.queryExecution().toString()
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty, labels, empty, {"clean": 1.0}).count() == 0


def test_mixing_knows_held_out_documents_and_meets_shares_of_true_labels(spark):
    rng, texts, truth = np.random.default_rng(4), {}, {}
    for i in range(900):
        kind = ("clean", "clean", "clean", "low", "toxic")[i % 5]
        text = prose(int(rng.integers(30, 200)), i)
        if kind == "low":
            w = text.split()
            text = (" ".join(w[:9]).upper() + "!! " + text.upper(), " | ".join(w), " ".join(f"{w[0]} {w[0]} {w[0]}" for _ in w))[i // 15 % 3]
        if kind == "toxic":
            text += " " + " ".join(rng.choice(["vile", "nasty", "foulest", "rotten"], 3, replace=False))
        texts[i], truth[i] = text, kind
    docs = documents(spark, texts).select("doc_id", "text")
    known = spark.createDataFrame([(i, k) for i, k in truth.items() if i % 3], "doc_id long, domain string")
    model = mixing.fit_domains(docs, known)
    out = mixing.mix(docs.unionByName(docs.where("doc_id < 30")), known, docs, {"clean": 0.9, "low": 0.06, "toxic": 0.04}).collect()
    assert len(out) == 930 and all(abs(x) < 2e-3 for r in out for x in r["gap"])
    one = {r["doc_id"]: r for r in out}
    right = [model[0][int(np.argmax(one[i]["p"]))] == k for i, k in truth.items() if i % 3 == 0]
    assert np.mean(right) > 0.97
    assert len({(r["doc_id"], r["rate"]) for r in out}) == 900  # repeated rows have one rate
    mass = {d: sum(r["tokens"] * r["rate"] for r in one.values() if truth[r["doc_id"]] == d) for d in model[0]}
    for d, share in {"clean": 0.9, "low": 0.06, "toxic": 0.04}.items():
        assert abs(mass[d] / sum(mass.values()) - share) < 0.015


def test_targets_out_of_reach_are_told(spark):
    docs = documents(spark, {i: prose(30, i) for i in range(40)}).select("doc_id", "text")
    labels = spark.createDataFrame([(i, "clean" if i % 2 else "low") for i in range(40)], "doc_id long, domain string")
    with pytest.warns(UserWarning, match="targets are missed"):
        out = mixing.mix(docs, labels, docs, {"clean": 0.99, "low": 0.01}).collect()
    assert max(abs(x) for x in out[0]["gap"]) > 0.1
    with pytest.raises(ValueError, match="domains"):
        mixing.fit_domains(docs, spark.createDataFrame([(i, str(i)) for i in range(20)], "doc_id long, domain string"))
    # without labels there is one domain
    assert {r["rate"] for r in mixing.mix(docs, labels.limit(0), docs, {"clean": 1.0}).collect()} == {1.0}


# --- top-k ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,block", [(3, 64), (500, 16)])
def test_search_matches_brute_force(n, block):
    rng = np.random.default_rng(n)
    x, q = rng.integers(-9, 9, (n, 8)), rng.integers(-9, 9, (20, 8))
    ids, q_ids = rng.permutation(n), np.arange(20)
    score, found = topk_search.search(ids, x, q_ids, q, 5, block)
    for i in range(20):
        best = sorted((-int(x[j] @ q[i]), int(ids[j])) for j in range(n) if ids[j] != q_ids[i])[:5]
        assert [(-int(s), int(f)) for s, f in zip(score[i], found[i], strict=True) if f >= 0] == best


def test_topk_query_with_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=6).tolist(), 1) for i in range(160)]
    data += [(200, None, 1), (201, [1.0, None, 2.0, 0.0, 0.0, 0.0], 1), (202, [float("nan")] * 6, 1), (203, [float("inf")] * 6, 1), (None, [0.0] * 6, 1), (250, data[3][1], 1), (251, data[3][1], 1)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = rows(registry.op6_exact_topk_search(spark, str(tmp_path)))
    duckdb.sql(f"create or replace view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(got) == sorted(duckdb.sql(registry.OP6_SQL).fetchall())
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_top(data, every, k=5):
    x = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in data]
    width = max(len(v) for _, v in x)
    x = [(i, np.pad(v, (0, width - len(v)))) for i, v in x]
    out = []
    for i, q in x:
        if i % every == 0:
            best = sorted((-int(q @ v), j) for j, v in x if j != i)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_thresholds_hold_over_all_ranges_and_skip_blocks_of_clustered_rows(spark, monkeypatch, spread):
    for name, value in (("RANGE_ROWS", 60), ("CHUNK_ROWS", 9), ("BLOCK", 8), ("SUMMARIES", 3)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 2
    data = [(i, [float(v) for v in np.float32(centres[i % 12] + spread * rng.normal(size=16))]) for i in range(900)]
    data += [(900, [1.0, 2.0, 3.0]), (950, [0.0] * 16)] + [(1000 + i, data[7][1]) for i in range(80)]  # shorter, all ties, many equal rows
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk_search.top_k(df, 10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(data, 10)
    scored, there = topk_search.pruning(df, 10)
    assert scored < (0.35 if spread < 0.1 else 1.3) * there


# --- decontamination --------------------------------------------------------------------------------


def test_copies_of_items_are_found(spark):
    items = {1: prose(35, 1), 2: "éÀñ " + prose(30, 2) + " Öst", 3: None, 4: "two words", 5: "", 6: "éÀñ " + prose(30, 2)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    words = items[1].split()
    swapped = " ".join("other" if i % 9 == 4 else w.upper() + "," for i, w in enumerate(words))
    texts = dict(ODD)
    texts |= {10: prose(80, 10) + " " + items[1] + " " + prose(20, 11), 11: prose(50, 12) + " " + swapped, 12: items[2].upper(), 13: prose(9, 5) + " two words " + prose(9, 6), 14: " ".join(words[:9]) + prose(60, 7)}
    texts |= {100 + i: prose(150, 5000 + i) for i in range(40)}
    docs = documents(spark, texts, item_id="x")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_copies(docs, bench).collect()}
    assert set(got) == {(10, 1), (11, 1), (12, 2), (12, 6), (13, 4)}
    assert got[10, 1]["score"] == 1.0 and texts[10][got[10, 1]["start"] : got[10, 1]["end"]] == items[1]
    assert decontamination.find_copies(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert decontamination.find_copies(docs, bench.where("item_id = 3")).count() == 0


def plain_words(text):
    low = "".join(c.lower() if c < "\u0250" else c for c in text or "")
    return "".join(" " if ord(c) < 128 and not c.isalnum() else c for c in low).split()


def smith_waterman(q, t):
    row, best = [0.0] * (len(t) + 1), 0.0
    for a in q:
        new = [0.0]
        for j, b in enumerate(t, 1):
            new.append(max(0.0, row[j - 1] + (1.0 if a == b else -0.5), row[j] - 0.5, new[j - 1] - 0.5))
        row, best = new, max(best, *new)
    return best


@pytest.mark.parametrize("merge", [False, True])
def test_copies_match_alignment_of_all_pairs(spark, monkeypatch, merge):
    if merge:
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(decontamination, "CELLS", 300)
    rng = random.Random(6)
    items = {i: prose(rng.randrange(8, 40), 3000 + i) for i in range(12)} | {50: "echo " * 12, 51: "echo echo"}
    texts = dict(ODD)
    for k in range(40):
        parts = [prose(rng.randrange(0, 60), 4000 + k)]
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(12)].split()
            w = [x if rng.random() > 0.12 else "new" + x for x in w if rng.random() > 0.04]
            parts += [" ".join(w), prose(rng.randrange(0, 30), 5000 + k)]
        texts[k] = " ".join(parts)
    texts |= {60: prose(20, 1) + " echo" * 300 + prose(9, 2), 61: "echo, Echo!", 62: texts[1], 63: None}
    docs = documents(spark, texts)
    rows = decontamination.find_copies(docs.unionByName(docs.where("doc_id < 10")), spark.createDataFrame([*items.items(), (3, items[3])], "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in rows}
    assert len(got) == len(rows)
    best = {(k, i): smith_waterman(plain_words(q), plain_words(t)) / len(plain_words(q)) for k, t in texts.items() for i, q in items.items()}
    assert all(abs(best[k] - x) < 1e-9 for k, x in got.items())
    # below that a copy may share no three words in a row
    assert {k for k, x in best.items() if x >= 0.6} <= set(got) <= {k for k, x in best.items() if x >= 0.5}
    assert (60, 50) in got and (61, 51) in got


def test_alignment_matches_the_textbook():
    rng = np.random.default_rng(2)
    for _ in range(40):
        q, x = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 14)).astype(np.uint64)
        h = np.zeros((len(q) + 1, len(x) + 1))
        for i in range(1, len(q) + 1):
            for j in range(1, len(x) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (1 if q[i - 1] == x[j - 1] else -0.5), h[i - 1, j] - 0.5, h[i, j - 1] - 0.5)
        assert decontamination.align([q], [x])[0][0] == h.max()


# --- secrets ----------------------------------------------------------------------------------------


def test_forest_tells_secrets_from_look_alikes(spark):
    model = secrets.train(secrets.labelled_findings(spark, 1200))
    fresh = secrets.labelled_findings(spark, 400, seed=99).collect()
    texts = {i: r["text"] for i, r in enumerate(fresh)} | {k + 10_000: v for k, v in ODD.items()}
    got = secrets.scan(documents(spark, texts, score="x"), model).collect()
    right = [r["is_secret"] == bool(fresh[r["doc_id"]]["label"]) for r in got if r["doc_id"] < 10_000]
    assert len(right) > 300 and np.mean(right) > 0.95
    assert all(r["end"] - r["start"] >= secrets.MIN_LENGTH and len(r["masked"]) < 12 for r in got)
    assert secrets.scan(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_candidates_are_whole_runs():
    data, offsets = secrets.utf8(pa.array(["key=abcdef0123456789abcdef", None, "abcdefghijklmnopqrstuvwxyz 1234567890123456"]))
    found = [(t, bytes(data[a:b]).decode()) for t, a, b in secrets.candidates(data, offsets)]
    assert found == [(0, "key=abcdef0123456789abcdef"), (2, "1234567890123456")]
