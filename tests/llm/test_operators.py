"""Each operator against a brute-force version, and on odd tables: nulls, empty and long texts, ties, repeated rows, no rows, other columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
import tiktoken

from dqspark.llm import ann, bpe, mixing, neardup, pii, pivots, quality, suffixes, toxicity, warc
from dqspark.llm.components import components
from dqspark.llm.common import Workspace, hashed_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def words(n, seed=1, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows and ids, and other columns with clashing names."""
    long, base = words(20_000, 3), words(300, 4)
    near = base.split()
    near[150] = "other"
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, " ".join(near), "de", "b", 1), (3, "", "en", "b", 0), (4, None, None, None, None), (None, base, "en", "c", 1), (None, None, "en", None, 0), (5, long, "en", "a", 9),
        (6, long + " tail", "en", "a", 9), (7, "a b c", "en", "b", 5), (8, "A  b\tc", "en", "b", 5), (9, "one", "fr", "c", 3), (9, "one", "fr", "c", 3), (9, "two words", "fr", "c", 3), (10, " \n\t ", "en", "c", 4), (11, "x" * 200_000, "en", "a", 2), (12, "é漢字🙂 " * 50, "en", "a", 2), (-3, base.upper(), "en", "z", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    names = ("key", "score", "uid", "rid", "comp", "size", "h", "bucket", "taken", "spans", "v", "q", "rank", "extra")
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names}), rows


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# toxicity and quality


def labelled(n=240, seed=5):
    r = random.Random(seed)
    texts = [" ".join(r.choice(("alpha", "beta", "gamma", "delta")) + str(r.randrange(40)) for _ in range(r.randrange(20, 60))) for _ in range(n)]
    toxic = [i % 4 == 0 for i in range(n)]
    return [t + " vileword" if x else t for t, x in zip(texts, toxic)], np.array(toxic, float)


def test_toxicity_learns_and_scores_oddities(odd, nothing, spark):
    texts, y = labelled()
    net = toxicity.train(texts, y, ["en"] * len(y), np.array([180.0, 60.0]))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(labelled(200, 6)[0])], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, net).collect()}
    assert np.mean([found[i] == (i % 4 == 0) for i in found]) > 0.95
    df, rows = odd
    out = toxicity.score(df, net)
    assert out.count() == len(rows) and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score(nothing, net).count() == 0 and toxicity.score(df, None).where("predicted = 1").count() == 0
    assert len({r["score"] for r in out.where("doc_id = 9").limit(2).collect()}) >= 1


def test_toxicity_ignores_what_is_no_text(spark):
    texts, y = labelled()
    net = toxicity.train(texts, y, ["en"] * len(y), np.array([180.0, 60.0]))
    a = spark.createDataFrame([(1, texts[0], "en"), (999, texts[0], None)], "doc_id long, text string, lang string")
    assert len({r["score"] for r in toxicity.score(a, net).collect()}) == 1


def test_quality_learns_and_scores_oddities(odd, nothing):
    r = random.Random(7)
    good = [words(r.randrange(40, 200), i) for i in range(150)]
    bad = ["!! ".join(words(60, 1000 + i).upper().split()) for i in range(100)]
    net = quality.train(good + bad, np.array([1.0] * 150 + [0.0] * 100), ["en"] * 250, np.array([100.0, 150.0]))
    texts = [words(100, 5000 + i) for i in range(40)] + ["!! ".join(words(60, 9000 + i).upper().split()) for i in range(40)]
    from dqspark.llm.nets import packed

    p = net.scores(*packed(texts)) >= quality.THRESHOLD
    assert p[:40].mean() > 0.9 and p[40:].mean() < 0.1
    df, rows = odd
    out = quality.score(df, net)
    assert out.count() == len(rows) and out.columns[:5] == df.columns[:5] and out.where("score IS NULL").count() == 0
    assert quality.score(nothing, net).count() == 0 and quality.score(df, None).where("predicted = 0").count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark):
    from pyspark.sql import functions as F

    from dqspark.llm.nets import fold, labelled_sample

    docs = spark.createDataFrame([(i, f"t{i}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 1)], "doc_id long, toxic int, quality int")
    texts, y, _, shares = labelled_sample(docs, labels, "toxic", fold(3) != 1, 100, 1000)
    kept = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(texts) == sorted(f"t{i}" for i in kept) and shares.sum() == len(kept)
    assert labelled_sample(docs, labels.where(F.lit(False)), "toxic", F.lit(True), 10, 1000)[0] == []


# near duplicates


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, threshold):
    sets = [shingle_set(r[1]) for r in rows]
    low = {i: i for i in range(len(rows))}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and len(sets[a] & sets[b]) * 100 >= threshold * 100 * len(sets[a] | sets[b]) - 1e-9:
                low[top(a)] = top(b)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)].append(r[0])
    return [(r[0], len(sets[i]), min(x for x in least[top(i)] if x is not None) if r[0] is not None else None) for i, r in enumerate(rows)]


def test_neardup_oddities(odd, nothing):
    df, rows = odd
    got = plain(neardup.dedup(df, 0.85), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components(rows, 0.85), key=str)
    assert neardup.dedup(nothing).count() == 0
    kept = neardup.distinct_documents(df, 0.8)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"], r["text"] or "") for r in kept.collect() if r["doc_id"] is not None)
    assert [i for i, _ in ids] == [-3, 3, 4, 5, 7, 9, 9, 10, 11, 12] and kept.where("doc_id IS NULL").count() == 2


def test_neardup_groups_match_brute_force(spark):
    r, rows = random.Random(9), []
    for g in range(12):
        base = words(r.randrange(30, 160), 100 + g).split()
        for _ in range(r.randrange(1, 12)):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for threshold in (0.8, 0.85):
        assert plain(neardup.dedup(df, threshold), "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, threshold), key=str)


def test_neardup_large_node_goes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "SAMPLE", 2)
    base = words(200, 77).split()
    rows = []
    for i in range(40):
        w = list(base)
        w[(i * 7) % 200] = f"q{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(neardup.dedup(df, 0.85), "doc_id", "n_shingles", "component_id") == sorted(brute_components(rows, 0.85), key=str)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(plain(components(df, Workspace(spark, "test")), "v", "comp"))
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_word_hashes_do_not_depend_on_place():
    a = "some words here and there".encode()
    one = hashed_words(np.frombuffer(a, np.uint8), np.array([0, len(a)]))[0]
    two = hashed_words(np.frombuffer(b"x " + a + b" y", np.uint8), np.array([0, len(a) + 4]))[0]
    assert (one == two[1:-1]).all() and len(set(one.tolist())) == 5


# repeated byte strings


def brute_spans(rows, length):
    """By row, in the order of id and text."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] or ""))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            if piece in seen:
                gone[s : s + length] = True
            seen.add(piece)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((rows[i][0], len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffixes_oddities(spark, odd, nothing):
    df, rows = odd
    short = [r for r in rows if len(r[1] or "") < 100_000]
    got = plain(suffixes.dedup(df.where("length(coalesce(text, '')) < 100000")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_spans(short, 100)
    assert suffixes.dedup(nothing).count() == 0
    run = suffixes.dedup(df.where("doc_id = 11"), with_text=True).first()
    assert (run["n_removed"], run["n_spans"], len(run["kept"])) == (199_999, 1, 1)


def test_suffixes_match_brute_force(spark):
    r = random.Random(11)
    lines = ["".join(r.choice("ab cé") for _ in range(r.randrange(20, 150))) for _ in range(25)]
    rows = [(i * 3, "".join(r.choice(lines) for _ in range(r.randrange(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert plain(suffixes.dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_spans(rows, 100)


def test_long_text_goes_in_pieces(monkeypatch):
    data = np.frombuffer(("".join(random.Random(2).choice("abcd ") for _ in range(9000))).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    windows = lambda found: {(int(a), int(s) + j) for s, n, a in zip(*found[:3]) for j in range(int(n))}
    whole = windows(suffixes.anchors(data, offsets))
    monkeypatch.setattr(suffixes, "STEP", 1000)
    assert windows(suffixes.anchors(data, offsets)) == whole and len(whole) == 9000 - 99


def test_merge_never_forgets_order():
    r = random.Random(3)
    for runs in (0, 1, 2, 3, 5, 8):
        lists = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(0, 30))) for _ in range(runs)]
        packed = [suffixes.Run(suffixes.Run.pack(x, [b""] * len(x), range(len(x)), range(len(x)), [0] * len(x), [0] * len(x))) for x in lists]
        order, shared = suffixes.merge([p.suffixes() for p in packed])
        heads = [iter(x) for x in lists]
        got = [next(heads[i]) for i in order]
        assert got == sorted(b for x in lists for b in x)
        assert shared == [0 if not i else suffixes.shared_prefix(got[i - 1], got[i], 0) for i in range(len(got))]


# vectors


def vectors(n=700, dim=12, seed=13):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [(n, None), (n + 1, [None] * dim), (n + 2, [float("nan")] * dim), (n + 3, [float("inf")] + [0.0] * (dim - 1)), (None, rows[5][1]), (n + 5, rows[5][1]), (n + 6, rows[5][1]), (n + 7, [1.0]), (n + 8, [0.0] * dim), (n + 9, [])]
    return rows, dim


def exact_ranks(rows, dim, every, k, scaled, nonzero):
    use = [(i, np.pad(np.array(v, float), (0, dim - len(v)))) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    use = [(i, np.floor(1024 * v) if scaled else v) for i, v in use if not nonzero or v.any()]
    out = []
    for q, a in use:
        if q is None or q % every:
            continue
        best = sorted(((-float(a @ b), i is None, i or 0, i) for i, b in use if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(best)]
    return out


@pytest.fixture(scope="module")
def vector_table(spark):
    rows, dim = vectors()
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int"), rows, dim


def test_pivots_are_exact(spark, vector_table):
    df, rows, dim = vector_table
    want = [(q, r, i, int(s)) for q, r, i, s in exact_ranks(rows, dim, 20, 10, True, False)]
    got = [tuple(r) for r in pivots.search(df, every=20).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for job_bytes in (pivots.JOB_BYTES, 0):  # blocks of queries in one job, and a job for each of them
        blocks = [tuple(r) for r in pivots.search(df, every=20, query_block=7, job_bytes=job_bytes).select("query_id", "rank", "vec_id", "score").collect()]
        assert sorted(blocks, key=str) == sorted(want, key=str)
    assert pivots.search(df.limit(0)).count() == 0 and pivots.search(df.where("vec_id = 0")).count() == 0


def test_pivots_skip_what_bounds_exclude():
    r = np.random.default_rng(3)
    centers = r.normal(size=(20, 8)) * 4000
    x = np.floor(centers[r.integers(0, 20, 4000)] + r.normal(size=(4000, 8)) * 40)
    x *= (30_000 / np.linalg.norm(x, axis=1))[:, None]
    x = np.floor(x)
    p = pivots.choose_pivots(x[:500], 32)
    best = pivots.Best(x[:5], np.arange(5), p, 10)
    best.add(x, np.arange(len(x)), pivots.distances(x, p))
    for i in range(5):
        s = x @ x[i]
        want = sorted(((-s[j], j) for j in range(len(x)) if j != i))[:10]
        assert [(-a, int(b)) for a, b in zip(best.score[i], best.found[i])] == want
    assert best.evaluated < 0.6 * 5 * len(x)


def test_ann_recall_and_oddities(spark, vector_table):
    df, rows, dim = vector_table
    want = defaultdict(set)
    for q, _, i, _ in exact_ranks(rows, dim, 20, 20, False, True):
        want[q].add(i)
    for options in ({}, {"block": 50, "query_block": 3}):
        got = defaultdict(dict)
        for r in ann.search(df, every=20, **options).collect():
            got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
        assert sorted(got) == sorted(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
        hits = sum(len({v for v, _ in got[q].values()} & want[q]) for q in want)
        assert hits / sum(map(len, want.values())) >= 0.9
        assert all(a[1] >= b[1] for g in got.values() for a, b in zip([g[i] for i in range(1, 20)], [g[i] for i in range(2, 21)]))
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 0")).count() == 0


def test_ann_partitions_are_balanced():
    x = np.random.default_rng(1).normal(size=(2048, 8))
    label = ann.balanced(x, ann.nearest(x, 10), 8, np.random.default_rng(2))
    assert np.bincount(label, minlength=8).max() <= np.ceil(1.1 * 2048 / 8)
    assert ann.fit(x, 20).probes < 8


# personal data


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_pii_base_matches_brute_force():
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("a1.@+- 123(%4é") for _ in range(r.randrange(0, 60)))
        assert pii.base_spans(text) == brute_pii(text)


def test_pii_linear_on_long_runs():
    for ch in ("1", "1.", "a", "a@", "+1", "1 "):
        assert isinstance(pii.base_spans(ch * 100_000), list)


def sample_texts():
    r = random.Random(4)
    out = []
    for _ in range(400):
        kind = r.randrange(5)
        number = "".join(r.choice("0123456789") for _ in range(8))
        out.append(words(20, r.randrange(10**6)) + " " + ("", f"me{number}@host.org", f"10.{number[0]}.1.{number[1]}", "4111 1111 1111 1111", f"+49 30 {number}")[kind] + f" in {r.randrange(1900, 2030)} and order {number}")
    return out


def test_pii_field_carries_labels_to_repeats(spark, odd, nothing):
    model = pii.train(sample_texts())
    text = "call +49 30 12345678 today; later dial 030 12345678 again"
    (base, every), (clean, clean_all) = pii.spans([text, "in 1999 they built 12345678 and 87654321 of 12345678"], model)
    assert [text[s:e] for s, _, e in base] == ["+49 30 12345678"] and "030 12345678" in [text[s:e] for s, _, e in every]
    assert set(base) <= set(every) and clean == clean_all == []
    df, rows = odd
    out = pii.find(df, model)
    assert out.count() == len(rows) and out.where("base_sha256 != sha2('', 256)").count() == 0
    assert pii.find(nothing).count() == 0
    red = pii.redact(spark.createDataFrame([(1, text, 5), (2, None, 0), (None, "x", 1)], "doc_id long, text string, n_chars long"), model)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in red.collect()}
    assert got[1] == ("call [PHONE] today; later dial [PHONE] again", len(got[1][0])) and got[2] == (None, 0) and got[None] == ("x", 1)


# archives


def test_warc_round_trip(spark):
    pages = [(1, "http://a/1", "same"), (5, "http://a/5\r\nX: y", "same"), (3, None, "same"), (2, "u", ""), (4, "u", None), (6, "u", "line\r\n\r\nWARC/1.1\r\n\r\nend"), (7, "u", "é漢🙂"), (None, "u", "lost"), (8, "u", "lost"), (9, "u", "x" * 300_000), (9, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    got = plain(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, html in pages:
        raw = (html or "").encode()
        first = max((p for p, _, h in pages if (h or "") == (html or "") and p is not None), default=None)
        same = i == first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else first))
    assert got == sorted(want, key=str)
    small = plain(warc.round_trip(df, min_bytes=5), "page_id", "record_type")
    assert dict(small)[1] == "response" and dict(small)[5] == "response"
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_transactions(spark):
    df = spark.createDataFrame([(1, "http://a/1", "body")], "page_id long, url string, html string")
    work = Workspace(spark, "warc-test")
    warc.write(df, f"{work.path}/archives", work)
    r = warc.assemble(warc.read(spark, f"{work.path}/archives", with_payload=True)).first()
    assert r["response"]["payload"] == b"body" and r["request"]["concurrent_to"] is None if "concurrent_to" in r["request"] else True
    assert r["response"]["header_digest"] == r["response"]["payload_digest"] and r["metadata"]["fields"] == "page-id: 1\r\n" and r["request"]["url"] == "http://a/1"


# tokens


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks_encode_like_the_whole(reference):
    t, r = bpe.load(PATH, PATTERN), random.Random(2)
    alphabet = ["ab", "é", "1", "'s", " ", "  ", "\n", "\t", "!", "漢", "。", "\x1c", "'", "-", "re", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(0, 150)))
        assert [i for p in t.encode(text, 16, 8) for i in p.tolist()] == reference.encode_ordinary(text)
    assert len(bpe.pieces("word " * 1000, 64, 16)) > 10 and bpe.pieces("x" * 1000, 64, 16) == ["x" * 1000]


def test_bpe_oddities_and_spread(spark, odd, nothing, reference):
    df, rows = odd
    want = []
    for i, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert plain(bpe.encode(df, PATH, PATTERN), *columns) == sorted(want, key=str)
    assert plain(bpe.encode(df, PATH, PATTERN, chunk=256, overlap=64, spread_chars=1000), *columns) == sorted(want, key=str)
    back = plain(bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN), "doc_id", "text")
    assert back == sorted(((i, text or "") for i, text, *_ in rows), key=str)
    assert bpe.encode(nothing, PATH, PATTERN).count() == 0


# mixing


def filled(sizes, weights, epochs):
    total, cap = sum(sizes), [epochs * s for s in sizes]
    target, held = [0.0] * len(sizes), set()
    while True:
        left = total - sum(cap[i] for i in held)
        weight = sum(w for i, w in enumerate(weights) if i not in held)
        target = [cap[i] if i in held else left * weights[i] / weight for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in held and target[i] > cap[i]}
        if not over:
            return target
        held |= over


def test_mixing_targets_and_repeats(spark):
    r, rows = random.Random(8), []
    for s, n in (("a", 40), ("b", 3), ("c", 1), ("é", 60), ("Z", 5), (None, 4)):
        rows += [(len(rows) + i, words(r.randrange(0, 80), len(rows) + i), s) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = [sum(size(t) for _, t, s in rows if s == n) for n in names]
    target = dict(zip(names, filled(sizes, [(1, 2, 3)[i % 3] for i in range(len(names))], 3)))
    text = {i: t for i, t, _ in rows}
    for n, total in zip(names, sizes):
        own = [r for r in out if r["source"] == n]
        assert all(r["source_size"] == total and abs(r["target"] - target[n]) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target[n]) <= 1
    assert all(r["size"] == size(text[r["doc_id"]]) and 0 <= r["taken"] <= 3 * r["size"] for r in out) and len(out) == len(rows)
    assert plain(mixing.mix(df.repartition(7)), "doc_id", "taken") == plain(mixing.mix(df), "doc_id", "taken")
    again = mixing.repeated(df)
    assert again.columns == df.columns
    counted = defaultdict(int)
    for r in again.collect():
        counted[r["doc_id"]] += size(r["text"])
    assert all(counted[r["doc_id"]] == r["taken"] for r in out)


def test_mixing_oddities(odd, nothing):
    df, rows = odd
    out = mixing.mix(df)
    assert out.count() == len(rows) and out.where("taken > 3 * size OR taken IS NULL").count() == 0
    assert mixing.mix(nothing).count() == 0 and mixing.mix(df.where("text IS NULL")).where("taken != 0").count() == 0
    assert mixing.repeated(df).columns == df.columns and mixing.repeated(nothing).count() == 0


def test_mixing_many_sources(spark):
    df = spark.createDataFrame([(i, "w " * (i % 7), f"s{i:04d}") for i in range(900)], "doc_id long, text string, source string")
    out = mixing.mix(df)
    total = sum(i % 7 for i in range(900))
    assert abs(sum(r["taken"] for r in out.collect()) - total) <= 900 and out.where("target > 3 * source_size + 1e-9").count() == 0
