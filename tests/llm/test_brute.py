"""Models, messages, merges and scores against plain loops; columns that clash; archives that are broken; large nodes."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers

from dqspark.llm import ann, bpe, mixing, neardup, pii, quality, toxicity, warc
from dqspark.llm.common import Workspace, hashed_words, long_hash
from dqspark.llm.nets import packed


def texts_of_all_lengths(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 12)))
    return ["", "a", "  ", *(" ".join(word() for _ in range(n)) for n in (1, 2, 3, 50, 400, 3000)), "x" * 9000, "x" * 5000 + " tail of words"]


def one_word_net(seed=2):
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)).astype(np.float32) for k in ("word", "head")}
    for w in toxicity.WIDTHS:
        p[f"conv{w}"] = rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32)
        p[f"bias{w}"] = rng.normal(0, 0.1, toxicity.FILTERS).astype(np.float32)
    p["out"], p["out_bias"] = rng.normal(0, 1, toxicity.FILTERS * len(toxicity.WIDTHS)).astype(np.float32), np.array([0.1], np.float32)
    return toxicity.Net(p)


def test_toxicity_matches_loops_at_any_piece_size():
    net, texts = one_word_net(), texts_of_all_lengths()
    want = []
    for text in texts:
        data, offsets = packed([text])
        a, b, _ = toxicity.tokens(data, offsets)
        x = [net.p["word"][i].astype(float) + net.p["head"][j] for i, j in zip(a, b)]
        z = float(net.p["out_bias"][0])
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                values = [sum(float(x[i + o] @ net.p[f"conv{width}"][o][:, f]) for o in range(width) if i + o < len(x)) for i in range(len(x))]
                z += float(net.p["out"][k * toxicity.FILTERS + f]) * max(0.0, max(values) + float(net.p[f"bias{width}"][f]) if values else 0.0)
        want.append(z)
    for step in (1 << 20, 1000, 64):
        assert np.allclose(net.logits(*packed(texts), step), want, atol=1e-3), step


def test_quality_matches_loops_at_any_piece_size():
    rng = np.random.default_rng(4)
    d = quality.FILTERS + 1
    p = {"embed": rng.normal(0, 1, (256, quality.DIM)), "conv": rng.normal(0, 0.2, (quality.BLOCKS, quality.STRIDE * quality.DIM, quality.FILTERS)), "bias": rng.normal(0, 0.1, quality.FILTERS), "w1": rng.normal(0, 0.3, (2 * d, quality.HIDDEN)), "b1": np.zeros(quality.HIDDEN), "w2": rng.normal(0, 1, quality.HIDDEN), "b2": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    p["embed"][0] = 0
    net, texts = quality.Net(p), texts_of_all_lengths(3)
    width = quality.BLOCKS * quality.STRIDE
    filters = p["conv"].reshape(width * quality.DIM, quality.FILTERS).astype(float)
    want = []
    for text in texts:
        raw = text.encode()
        n = math.ceil(len(raw) / quality.STRIDE)
        padded = np.frombuffer(raw + bytes(width + quality.STRIDE), np.uint8)
        y = [p["embed"][padded[i * quality.STRIDE : i * quality.STRIDE + width]].ravel().astype(float) @ filters for i in range(n)]
        begins = range(0, max(1, n - (quality.CHUNK - quality.HOP)), quality.HOP) if n else ()
        a = [np.append(np.maximum(np.max(y[b : b + quality.CHUNK], 0) + p["bias"], 0), math.log1p(min(quality.CHUNK, n - b)) / math.log1p(quality.CHUNK)) for b in begins]
        v = np.concatenate([np.mean(a, 0), np.max(a, 0)]) if a else np.zeros(2 * d)
        want.append(float(np.maximum(v @ p["w1"], 0) @ p["w2"]))
    for step in (1 << 20, 1500, 1):
        assert np.allclose(net.logits(*packed(texts), step), want, atol=1e-3), step


def test_long_words_hash_by_pieces(monkeypatch):
    data = np.frombuffer(b"abc" * 5000, np.uint8)
    whole = hashed_words(data, np.array([0, len(data)]))[0]
    from dqspark.llm import common

    monkeypatch.setattr(common, "STEP_BYTES", 700)
    assert long_hash(data) == whole[0] and (hashed_words(data, np.array([0, len(data)]))[0] == whole).all()


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (1, "g h i j k l", "s"), (2, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    from pyspark.sql import functions as F

    df = df.withColumns({n: F.lit(n) for n in ("_text", "_filled", "_key", "key", "predicted", "_quality", "_c0", "_whole", "source")})
    assert quality.keep(df, None).columns == df.columns and quality.keep(df, None).select("score", "_text", "_quality").distinct().collect() == [("s", "_text", "_quality")]
    kept = neardup.distinct_documents(df)
    assert kept.columns == df.columns and sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(1, "a b c d e f"), (1, "g h i j k l"), (2, "")]
    assert quality.score(df, None).count() == 4 and mixing.repeated(df).columns == df.columns


# personal data


def test_messages_are_exact_on_trees():
    """Sum-product gives true marginals where links form no loop; those are counted here over all labellings."""
    rng, labels = np.random.default_rng(5), len(pii.KINDS) + 1
    for links in ([(0, 1), (1, 2), (2, 3)], [(0, 1), (0, 2), (0, 3)], [(0, 1), (2, 3)]):
        g = pii.Graph([""])
        g.x, g.kind, g.where = rng.normal(size=(4, pii.N_FEATURES)), np.array([0, 0, 2, 0]), [(0, i, i + 1) for i in range(4)]
        g.chain, g.skip = np.array(links[:1]).reshape(-1, 2), np.array(links[1:]).reshape(-1, 2)
        near, far = (lambda m: (m + m.T) / 2)(rng.normal(size=(labels, labels))), (lambda m: (m + m.T) / 2)(rng.normal(size=(labels, labels)))
        model = {"unary": rng.normal(0, 0.3, (pii.N_FEATURES, labels)), "chain": near, "skip": far}
        unary, total = g.x @ model["unary"], np.zeros((4, labels))
        for y in itertools.product(range(labels), repeat=4):
            if y[2] == 2:  # a base match is fixed
                z = sum(unary[i, y[i]] for i in (0, 1, 3)) + sum(near[y[a], y[b]] for a, b in g.chain) + sum(far[y[a], y[b]] for a, b in g.skip)
                total[range(4), y] += math.exp(z)
        assert np.allclose(pii.marginals(g, model, 40), total / total.sum(1, keepdims=True), atol=1e-3)


# archives


def test_broken_records_are_skipped():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    for bad in (b"WARC/1.1\r\nContent-Length: 2\r\n\r\nno\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: -1\r\n\r\nno\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\n\r\nno\r\n\r\n", b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 999999\r\n\r\nno\r\n\r\n", b"rubbish\r\n\r\n"):
        assert [b for _, b in warc.parse(good + bad + good)] == [b"ok", b"ok"], bad
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"\r\n\r\n")) == []


def test_files_are_bounded_by_bytes(spark):
    work = Workspace(spark, "warc-files")
    df = spark.createDataFrame([(i, "u", "x" * 1000) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write(df, f"{work.path}/a", work, file_bytes=20_000)
    sizes = [len(r[0]) for r in spark.read.format("binaryFile").load(f"{work.path}/a/part-*").select("content").collect()]
    assert len(sizes) > 1 and max(sizes) < 30_000 and warc.captures(spark, f"{work.path}/a", work).count() == 20


# tokens


def test_encoding_matches_a_merge_loop():
    import base64

    import regex

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    def merged(piece: bytes):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    t, r = bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), random.Random(6)
    for _ in range(200):
        text = "".join(r.choice(("the ", "é", "12", "'s", " ", "\n", "!?", "漢", "word", "ing", "Un")) for _ in range(r.randrange(60)))
        want = [i for m in regex.finditer(public_tokenizers.PATTERN, text) for i in merged(m[0].encode())]
        assert [i for p in t.encode(text, 24, 12) for i in p.tolist()] == want


def test_chunks_are_stitched_where_both_agree():
    text = "alpha beta, gamma delta! " * 40
    pieces = bpe.pieces(text, 100, 30)
    assert "".join(pieces) == text and len(pieces) == 10
    assert bpe.stitched([([], [3, 7, 9]), ([2, 7, 8], [4]), ([5], [])]) == [7, None]


# vectors


def test_scores_are_sums_in_order(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 33))
    x[100:200] = x[7]  # equal vectors score alike, wherever they lie
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "vec_id long, embedding array<double>").repartition(5)
    for r in ann.search(df, every=25).collect():
        want = 0.0
        for a, b in zip(x[r["query_id"]], x[r["vec_id"]]):
            want += float(a) * float(b)
        assert r["score"] == want
    tied = [r["vec_id"] for r in ann.search(df, every=25).orderBy("query_id", "rank").collect() if r["query_id"] == 0 and r["vec_id"] >= 100 and r["vec_id"] < 200]
    assert tied == sorted(tied)


# near duplicates


def pairs_at(similarity, n, seed):
    """Pairs of documents whose sets of shingles are about so similar: a run of words at the end differs."""
    r, rows = random.Random(seed), []
    for i in range(n):
        size = r.randrange(60, 200)
        own = [f"w{r.randrange(10**9)}" for _ in range(size + 4)]
        drop = int(size * (1 - similarity) / (1 + similarity))
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[: len(own) - drop] + [f"w{r.randrange(10**9)}" for _ in range(drop)]))]
    return rows


def test_recall_at_the_threshold(spark):
    rows = pairs_at(0.85, 1500, 1)
    out = {r["doc_id"]: r["component_id"] for r in neardup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()}
    w = [t.split() for _, t in rows]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in w]
    linked = [100 * len(sets[i] & sets[i + 1]) >= 85 * len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)]
    assert sum(linked) > 500 and [out[2 * i + 1] == 2 * i for i in range(len(linked))] == linked


def test_large_nodes_branch_on(spark):
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        w[(i * 5) % 150] = f"q{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, t) for i, t in pairs_at(0.9, 20, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = sorted(tuple(r) for r in neardup.dedup(df, 0.85).collect())
    assert sorted(tuple(r) for r in neardup.dedup(df, 0.85, branch_on=4).collect()) == plain


def test_trees_hold_at_any_depth():
    for threshold in (0.8, 0.85, 0.95):
        s = 1.0
        for _ in range(30):
            s = 1 - (1 - threshold * s) ** neardup.BRANCH
        assert (1 - s) ** neardup.trees_for(threshold, neardup.RECALL) <= 1 - neardup.RECALL + 1e-12
    with pytest.raises(ValueError):
        neardup.trees_for(0.4, 0.9)


# mixing


def test_rows_that_are_alike_share_the_edge(spark):
    rows = [(1, "a b c d", "s")] * 900 + [(2, "a b", "t")] * 40 + [(i, "a b c", "u") for i in range(3, 60)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "stu":
        own = [r for r in out if r["source"] == s]
        taken = sum(r["taken"] for r in own)
        assert abs(taken - own[0]["target"]) <= len(own) if s != "u" else abs(taken - own[0]["target"]) <= 1
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    assert len({r["taken"] for r in out if r["source"] == "s"}) == 1


def test_near_duplicates_exchange_little(spark):
    """Payloads are exchanged only for vertices that take part: sketches, wide sketches and sets were, several times each."""
    pick = random.Random(5)
    rows = []
    for i in range(1500):
        words = [f"w{pick.randrange(5000)}" for _ in range(120)]
        copies = 12 if i % 50 == 0 else 1
        for c in range(copies):
            rows.append((len(rows), " ".join([*words[: 108 + c], *[f"x{c}"] * (c > 0), *words[109 + c :]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before, name = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, "-1")

    def written() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    try:
        at = written()
        assert neardup.dedup(df, 0.85).count() == len(rows)
        moved = written() - at
    finally:
        spark.conf.set(name, before)
    size = sum(len(r[1]) for r in rows)
    assert moved < 7 * size
