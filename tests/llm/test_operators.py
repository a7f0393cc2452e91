"""Every operator of siftwell.llm against brute force, round trips and the edge cases its docstring states."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwell.llm import byte_bpe, chat, langid, media, minhash, mixing, quality, queries, sharding, shared, simhash, wavelet

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Size string, component_id string, score string, source_size int, rank int, fp int, h int, n int"


def fixture_rows():
    r = random.Random(5)
    vocab = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "le", "de", "und", "der"]
    base = " ".join(r.choice(vocab) for _ in range(60))
    texts = [None, "", "   ", "\n\t", "x", "two words", "three little words", base, base, base, base + " tail", "Ünïcode ß 日本語 🙂 text\x85 with ␛<|end|> </s>[INST] ok [/INST]", "123 456 789", "!!! ??? ..."]
    texts += [" ".join(r.choice(vocab) for _ in range(r.randint(1, 80))) for _ in range(40)]
    texts.append("long " * 30_000 + "end")
    texts.append("y" * 120_000)
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s1", "s2", None, "é"]), len(t or ""), *["x"] * 3, *[1] * 5) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (7, "another text under the same id", "en", "s1", 1, *["x"] * 3, *[1] * 5), (None, "no id here", "en", "s1", 1, *["x"] * 3, *[1] * 5), (None, None, None, None, None, *[None] * 8)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d.parquet")
    spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1 quality


def test_quality_shrinks_and_keeps(spark, docs, empty, sf_dir):
    all_docs = queries.documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    taught = labels.where("doc_id % 2 = 0")  # the other labels judge
    rows = quality.judged(all_docs, taught, F.col("source"), queries.site_path())[0].collect()
    assert len(rows) == all_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    right = [r["keep"] == bool(truth[r["doc_id"]]) for r in rows if r["doc_id"] % 2 and truth.get(r["doc_id"]) is not None]
    assert sum(right) / len(right) > 0.9
    odd = quality.judged(docs, spark.createDataFrame([(1, 1), (1, 0), (7, 1), (None, 1), (4, 0)], "doc_id long, quality int"), F.col("source"), F.col("lang"))[0]
    assert odd.count() == docs.count() and odd.where("score IS NULL OR keep IS NULL").count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judged(empty, none, F.col("source"), F.col("lang"))[0].count() == 0
    kept = quality.accepted(docs, none, F.col("source"), F.col("lang"))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_quality_posteriors_by_hand(spark):
    scored = spark.createDataFrame([("a", "p", 1.0)] * 30 + [("a", "q", 0.0)] * 2 + [("b", "r", 0.0)] * 30 + [("c", "t", 1.0)], "host string, path string, e double")
    sites, prior, k_host, k_path = quality.sites(scored)
    got = {(r["host"], r["path"]): r for r in sites.collect()}
    assert prior == pytest.approx((31 + 1) / (63 + 2))
    n, e = {"a": 32, "b": 30, "c": 1}, {"a": 30, "b": 0, "c": 1}
    spread = sum(n[h] * ((e[h] / n[h] - prior) ** 2 - prior * (1 - prior) / n[h]) for h in n) / 63
    assert k_host == pytest.approx(quality.strength(prior, spread))
    paths, host = defaultdict(list), {h: (e[h] + k_host * prior) / (n[h] + k_host) for h in n}
    for h, p, x in scored.collect():
        paths[h, p].append(x)
    spread = sum(len(x) * ((sum(x) / len(x) - host[h]) ** 2 - host[h] * (1 - host[h]) / len(x)) for (h, _), x in paths.items()) / 63
    assert k_path == pytest.approx(quality.strength(prior, spread))
    for (h, p), r in got.items():
        assert r["host_posterior"] == pytest.approx(host[h])
        assert r["path_posterior"] == pytest.approx((sum(paths[h, p]) + k_path * host[h]) / (len(paths[h, p]) + k_path))
    assert got["a", "q"]["path_posterior"] < got["a", "p"]["path_posterior"]
    assert abs(got["c", "t"]["host_posterior"] - prior) < abs(1 - prior)


def test_quality_leaves_the_document_out(spark):
    """Scores against a version that sums over all other documents for each."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["aa", "Bb!", "c"]) for _ in range(r.randint(1, 40))), r.choice("xy"), r.choice("pq")) for i in range(40)] + [(99, "alone here", "z", "p"), (100, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = {i: i % 2 for i in range(0, 30, 3)} | {99: 1}
    out, judge = quality.judged(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), F.col("source"), queries.site_path())
    got = {x["doc_id"]: x for x in out.collect()}
    own = {i: labels.get(i, got[i]["doc_score"]) for i in got}
    logit = lambda p: np.log(p / (1 - p))
    for i, x in got.items():
        host = [own[j] for j, y in got.items() if j != i and y["host"] == x["host"]]
        path = [own[j] for j, y in got.items() if j != i and (y["host"], y["path"]) == (x["host"], x["path"])]
        others = (sum(host) + judge.k_host * judge.prior) / (len(host) + judge.k_host)
        others = min(1 - 1e-6, max(1e-6, (sum(path) + judge.k_path * others) / (len(path) + judge.k_path)))
        assert x["others_posterior"] == pytest.approx(others)
        score = 1 / (1 + np.exp(-(logit(x["doc_score"]) + logit(others) - logit(judge.prior))))
        assert x["score"] == pytest.approx(score) and x["keep"] == (score >= 0.5)
    assert got[99]["others_posterior"] == pytest.approx(judge.prior)  # nothing else is known of its site
    kept = quality.accepted(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), F.col("source"), queries.site_path())
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, x in got.items() if x["keep"])


# -- 2 chat


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "␛", "␛␛<|", "<␛|", "<|turn:user|>\n", "a<", "|end|>", "<<SYS>>", "", "a\n\nb", "|>", "x|"]
    for t in nasty:
        turns = [("user", t), ("assistant", t), ("we|ird|>", t)]
        f = chat.locate(turns)
        assert not f.rewrites and chat.read_back(f.text) == turns and [chat.unescape(f.text[a:b]) for a, b in f.bodies] == [t] * 3
        assert f.spans[0][0] == 0 and f.spans[-1][1] == len(f.text) and all(a[1] == b[0] for a, b in zip(f.spans, f.spans[1:]))
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "q"), (3, 0, "assistant", "z" * 200_000)]
    out = {r["conv_id"]: r for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1]["n_turns"] == 3 and out[1]["loss_chars"] == 2
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\nassistant\nb\n").hexdigest()
    assert out[2]["loss_chars"] == 0 and out[None]["n_turns"] == 1 and out[3]["loss_chars"] == 200_000
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_detects_rewriting():
    def trims(turns):  # drops the reasoning of all but the last turn
        return "".join(f"[{r}]{t if i == len(turns) - 1 else t.split('#')[-1]}/" for i, (r, t) in enumerate(turns))

    f = chat.locate([("user", "a"), ("assistant", "think#b"), ("user", "c")], trims)
    assert f.rewrites and f.text == "[user]a/[assistant]b/[user]c/"
    assert [f.text[a:b] for a, b in f.bodies] == ["a", "b", "c"]
    closing = lambda turns: "".join(t + ";" for _, t in turns) + "END"
    assert chat.locate([("user", "a"), ("assistant", "b")], closing).rewrites
    assert not chat.locate([("user", "a")], lambda turns: "<s>" + "".join(t for _, t in turns)).rewrites


def test_chat_marks_are_not_in_the_turns():
    every = "".join(map(chr, range(0xE000, 0xF900)))
    for odd in ("\ue000", "\ue0fe\ue0ff", every):
        turns = [(f"role{odd}", "abc"), ("assistant", f"x{odd}y"), ("user", odd)]
        f = chat.locate(turns)
        assert not f.rewrites and [chat.unescape(f.text[a:b]) for a, b in f.bodies] == ["abc", f"x{odd}y", odd]
        last = lambda turns: f"{len(turns)}:" + "".join(f"[{r}]{t}/" for r, t in turns)
        f = chat.locate(turns, last)
        assert f.rewrites and [f.text[a:b] for a, b in f.bodies] == ["abc", f"x{odd}y", odd]
    shout = chat.locate([("user", "a b"), ("user", "\ue000")], lambda turns: "".join(t.replace("\ue001", "?").strip() + ";" for _, t in turns))
    assert shout.bodies == [(0, 0), (4, 4)]  # the two marks don't agree, so no place is told


# -- 3 media


def test_png_round_trip_and_checksums():
    rng = np.random.default_rng(1)
    for shape in ((1, 64), (7, 5), (20, 9, 3), (3, 9, 4), (6, 7, 2)):
        p = np.sort(rng.integers(0, 256, shape, dtype=np.uint8), axis=0)
        for f in ((0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)):
            assert (media.decode_png(media.encode_png(p, f)) == p).all()
    data = media.encode_png(p)
    for at in range(9, len(data), 7):
        with pytest.raises(media.MediaError):
            media.decode_png(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(media.MediaError):
        media.decode_png(data[:-5])
    for head in (b"\0" * 12, b"\0" * 14, b""):
        with pytest.raises(media.MediaError):
            media.decode_png(media.SIGNATURE + media._chunk(b"IHDR", head) + data[33:])
    bomb = media.SIGNATURE + data[8:33] + media._chunk(b"IDAT", zlib.compress(b"\0" * 50_000_000)) + media._chunk(b"IEND", b"")
    with pytest.raises(media.MediaError):
        media.decode_png(bomb)


def test_media_columns(spark, docs, empty):
    got = media.features(media.stored(docs)).collect()
    want = defaultdict(list)
    for i, t, *_ in fixture_rows():
        data = (t or "").encode()
        size = max(64, -(-len(data) // 64) * 64)
        padded = data.ljust(size, b"\0")
        want[i].append((len(data), size, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    have = defaultdict(list)
    for r in got:
        assert r["error"] is None and len(r["feature"]) == 16
        have[r["doc_id"]].append((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert media.features(media.stored(empty)).count() == 0
    bad = spark.createDataFrame([(1, 2, bytearray(b"junk")), (2, None, None)], "doc_id long, n_bytes long, media binary")
    assert all(r["error"] and r["feature"] is None for r in media.features(bad).collect())
    a, b = np.zeros((64, 64), np.uint8), np.tile(np.arange(64, dtype=np.uint8) * 4, (64, 1))
    assert media.cosine_hash(b) == media.cosine_hash(np.clip(b + 1, 0, 255)) != media.cosine_hash(a)


# -- 4 byte-level BPE


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken(spark, docs, empty):
    ref, e = reference(), byte_bpe.encoder(RANKS, P.PATTERN)
    r = random.Random(2)
    al = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​　'sS'tllab éÉñ中日🙂12３.,;!-_aaaaa"
    texts = ["".join(r.choice(al) for _ in range(r.randint(0, 30))) for _ in range(5000)] + ["ab" * 3000, "a" * 3001, " " * 500, "x " * 100]
    for t, g in zip(texts, e.encode_batch(texts)):
        assert ref.encode_ordinary(t) == np.frombuffer(g, "<u4").tolist() and e.decode(g) == t.encode()
    for t in texts[:300]:
        for m in e.find(t):
            assert e.merge_one(m.encode()) == np.frombuffer(e.merge_many([m.encode()])[0], "<u4").tolist()
    got = byte_bpe.digests(docs, RANKS, P.PATTERN).collect()
    want = sorted((str(i), len(x := ref.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in fixture_rows())
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert byte_bpe.digests(empty, RANKS, P.PATTERN).count() == 0
    back = byte_bpe.decoded(byte_bpe.encoded(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t, *_ in fixture_rows())


# -- 5 wavelet shards


def test_wavelet_shard_against_an_array():
    r = np.random.default_rng(3)
    for bits, n in ((1, 10), (5, 3000), (16, 20_000), (17, 1000)):
        x = r.integers(0, 1 << bits, n)
        s = wavelet.Shard(wavelet.build(x.astype(np.uint32), bits, [1, None], [n - 1, 1]))
        assert (s.ids() == x).all() and s.doc_ids == [1, None]
        for i in r.integers(0, n, 20).tolist():
            c = int(x[i])
            places = np.flatnonzero(x == c)
            k = int(r.integers(0, len(places)))
            a, b = sorted(r.integers(0, n + 1, 2).tolist())
            assert s.access(i) == c and s.count(c) == len(places) and s.find(c, k) == places[k] and s.count(c, a, b) == (x[a:b] == c).sum() and s.find(c, len(places)) is None
    assert len(wavelet.Shard(wavelet.build(np.zeros(0, np.uint16), 16, [], [])).ids()) == 0


def test_token_files(spark, docs, empty):
    t = wavelet.tokenizer(WORDS)
    r = random.Random(3)
    al = " \t\n\r\x1c\x85\xa0　​ sS'tllabéÉñΣσ中日🙂12３.,;!-_aaİıé̈"
    texts = ["".join(r.choice(al) for _ in range(r.randint(0, 30))) + r.choice(["", "<|endoftext|>", ".", "<|ENDOFTEXT|>", ",, ok. "]) for _ in range(5000)]
    plain = lambda x: t.tokenizer.encode(x, add_special_tokens=False).ids
    for x, g in zip(texts, t.encode_batch(texts)):
        assert plain(x) == np.frombuffer(g, t.kind).tolist(), x
    manifest = wavelet.write(docs, shared.new_path(spark, "t"), WORDS, shard_tokens=500)
    got = wavelet.read(manifest).collect()
    rows = sorted(((i, x or "") for i, x, *_ in fixture_rows()), key=lambda p: (p[0] is not None, p[0] or 0, p[1]))
    start, want = 0, []
    for i, x in rows:
        ids = [*plain(x), 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda p: p[1]) == want
    shard = wavelet.load(manifest.first()["path"])
    assert shard.count(1) >= len(shard.doc_ids)
    assert wavelet.read(wavelet.write(empty, shared.new_path(spark, "t"), WORDS)).count() == 0


# -- 6 mixing


def test_mix(spark, sf_dir, docs, empty):
    data = queries.documents(spark, sf_dir)
    big = data.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "src0").otherwise(F.col("source")))
    for table in (data, big, docs):
        got = mixing.plan(table).collect()
        assert len(got) == table.count()
        sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
        for r in got:
            s = r["source"]
            sizes[s] += r["size"]
            taken[s] += r["taken"]
            target[s] = r["target"]
            largest[s] = max(largest[s], r["size"])
            assert r["taken"] <= 2 * r["size"]
        order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        want, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
        while True:
            total = sum(weight[s] for s in open_)
            over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
            if not over:
                want |= {s: left * weight[s] / total for s in open_}
                break
            for s in over:
                want[s] = 2 * sizes[s]
                left -= want[s]
            open_ -= over
        for s in order:
            assert target[s] == pytest.approx(want[s])
            assert abs(taken[s] - want[s]) <= 3 * largest[s]
    again = mixing.plan(big)
    assert sorted(map(str, again.collect())) == sorted(map(str, mixing.plan(big.repartition(3)).collect()))
    assert mixing.plan(empty).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["times"] for r in mixing.plan(docs).collect())


def test_flight_keeps_totals(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 50, 3000):
        x, p = rng.integers(0, 500, n).astype(float), np.full(n, 0.37)
        q = mixing.flight(p, x, np.random.default_rng(n))
        assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and (q * x).sum() == pytest.approx((p * x).sum())
    rows = spark.range(3000).select(F.col("id").alias("row"), F.col("id").alias("doc_id"), (F.col("id") % 97).alias("size"), F.lit("+a").alias("source_key"), F.lit(0.3).alias("pi"), F.xxhash64("id").alias("order"))
    got = mixing.sampled(rows, block=64).collect()
    assert len(got) == 3000 and {r["drawn"] for r in got} <= {0.0, 1.0} and abs(sum(r["drawn"] for r in got) - 900) <= 3


def test_alike_rows_are_blocks_and_keep_their_columns(spark, monkeypatch):
    draw = mixing._block_draw

    def watched(last):
        inner = draw(last)

        def run(key, block):
            assert len(block) <= 64
            return inner(key, block)

        return run

    monkeypatch.setattr(mixing, "_block_draw", watched)
    alike = spark.range(1000).selectExpr("1L AS row", "5L AS doc_id", "7L AS size", "'+a' AS source_key", "0.3D AS pi", "9L AS order")
    got = mixing.sampled(alike, block=64).collect()
    assert len(got) == 1000 and abs(sum(r["drawn"] for r in got) - 300) <= 3
    rows = [(1, "a b", "s", x) for x in ("keepA", "keepB")] + [(2, "c d e", "s", "other"), (3, "f", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string")
    times = {x["doc_id"]: 0 for x in mixing.plan(docs).collect()}
    for x in mixing.plan(docs).collect():
        times[x["doc_id"]] += x["times"]
    out = [(x["doc_id"], x["extra"]) for x in mixing.mixed(docs).collect()]
    assert {i: sum(d == i for d, _ in out) for i in times} == times and times[1] >= 2
    assert abs(out.count((1, "keepA")) - out.count((1, "keepB"))) <= 1


# -- 7 simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    items = sorted(set(prints))
    for i, (a, fa) in enumerate(items):
        for b, fb in items[i + 1 :]:
            if (fa ^ fb).bit_count() <= 2 or a == b:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {a: find(a) for a, _ in items}


def test_golay_neighbours_share_a_codeword():
    e = simhash.PATTERNS
    assert (simhash.COUNTS[[bin(int(p[0])).count("1") < 3 for p in e]] == 1).all() and set(simhash.COUNTS.tolist()) == {1, 6}
    leaders = e[:, 0]  # every word is a codeword and one of these
    table, counts = simhash.codewords(leaders)
    for i in range(23):
        for j in range(i, 23):
            other, n = simhash.codewords(leaders ^ (1 << i | 1 << j))
            meet = (table[:, :, None] == other[:, None, :]) & (np.arange(6)[:, None] < counts[:, None, None]) & (np.arange(6) < n[:, None, None])
            assert meet.any(axis=(1, 2)).all()


def test_simhash_components(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    prints = [(i, slow_fingerprint(t)) for i, t, *_ in fixture_rows()]
    assert sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1) for r in got) == sorted((str(i), f) for i, f in prints)
    want = brute_components([(i, f) for i, f in prints if i is not None])
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert simhash.near_duplicates(empty).count() == 0
    stay = simhash.survivors(docs)
    assert stay.columns == docs.columns
    ids = sorted(r["doc_id"] for r in stay.collect() if r["doc_id"] is not None)
    assert ids == sorted(set(want.values()))


def test_links_in_crowds(spark):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        prints.update(b ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for _ in range(60))
    prints = sorted(prints)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "fp long, rep long")
    want = brute_components(list(enumerate(prints)))
    for hot in (2, 8, 64):
        found = {x["id"]: x["component"] for x in shared.components(simhash.links(nodes, hot), "u", "v").collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_components_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 40)] + [(39, 100), (500, 501), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert set(got) == {*range(5, 40), *range(100, 161), 500, 501} and all(c == (500 if i >= 500 else 5) for i, c in got.items())
    assert shared.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# -- 8 sharding


def brute_capacity(sizes, shards):
    def fits(c):
        n, room = 0, 0
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    low, high = 0, sum(sizes)
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def test_minimax_cuts(spark):
    r = random.Random(4)
    for n, known in ((300, 8), (300, 64), (900, 1 << 17), (5, 8)):
        sizes = [r.choice([17, 20, 500, 90, r.randint(16, 3000)]) for _ in range(n)]
        if n == 900:
            sizes[100] = 400_000  # a hot group
        upto = np.cumsum(sizes).tolist()
        table = spark.createDataFrame(list(zip(sizes, upto)), "size long, upto long").cache()
        for shards in (1, 7, 40):
            capacity, ends = sharding.minimax_cuts(table, upto[-1], max(sizes), shards, known * shards)
            assert capacity == brute_capacity(sizes, shards)
            assert len(ends) == shards and ends[-1] == upto[-1] and set(ends) <= {0, *upto}
            assert max(b - a for a, b in zip([0, *ends], ends)) == capacity


def check_slots(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(40))


def test_sharding_laws(spark, docs, empty, sf_dir):
    for table in (docs, queries.documents(spark, sf_dir)):
        texts = [r["text"] for r in table.collect()]
        want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for t in texts)
        for law in (sharding.by_bytes, sharding.by_rows, sharding.by_key):
            rows = law(table).collect()
            assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
            check_slots(rows)
        counts = defaultdict(int)
        for r in sharding.by_rows(table).collect():
            counts[r["shard"]] += 1
        assert max(counts.values()) - min(counts.values() if len(counts) == 40 else [0]) <= 1
        for r in sharding.by_key(table).collect():
            assert r["grown_shard"] in (r["shard"], 40)
        where = defaultdict(set)
        load = defaultdict(int)
        for r in sharding.by_bytes(table).collect():
            where[r["size"], r["text_crc32"]].add(r["shard"])
            load[r["shard"]] += r["size"]
        groups = defaultdict(int)
        for t in texts:
            groups[t] += len((t or "").encode()) + 16
        assert max(load.values()) <= sum(load.values()) / 40 + max(groups.values())
        first = {}
        for r in table.collect():
            i = -(1 << 63) if r["doc_id"] is None else r["doc_id"]
            first[r["text"]] = min(i, first.get(r["text"], i))
        digest = lambda t: "null" if t is None else hashlib.sha256(t.encode()).hexdigest()
        ordered = [groups[t] for t in sorted(first, key=lambda t: (first[t], digest(t)))]
        assert max(load.values()) == brute_capacity(ordered, 40)
    for law in (sharding.by_bytes, sharding.by_rows, sharding.by_key):
        assert law(empty).count() == 0


# -- 9 language


def test_language(spark, docs, empty, sf_dir):
    data = queries.documents(spark, sf_dir)
    got = {r["doc_id"]: r for r in langid.identified(data).collect()}
    truth = {r["doc_id"]: r["lang"] for r in data.collect()}
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [r["lang_pred"] == truth[i] for i, r in got.items() if r["held_out"]]
    assert sum(held) / len(held) > 0.97
    odd = langid.identified(docs).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert all(r["lang_pred"] == "und" for r in odd if r["doc_id"] in (0, 1, 2, 3, 12, 13))
    assert langid.identified(empty).count() == 0
    kept = langid.accepted(docs, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r["lang_pred"] != "und" for r in odd)


def test_backoff_takes_the_longest_known_gram():
    logs = lambda x: np.array(x, float)
    s = langid.Scorer({"langs": ["a", "b"], "words": {"cat": logs([-1, -9])}, "grams": {"^d": logs([-2, -3]), "do": logs([-4, -1]), "o": logs([-5, -5]), "g": logs([-6, -6]), "$": logs([-1, -1])}})
    assert (s.word("cat") == [-1, -9]).all()
    assert s.word("dog") == pytest.approx(np.mean([[-2, -3], [-4, -1], [-5, -5], [-6, -6], [-1, -1]], axis=0))
    assert s.predict(["cat", "1 2", None]) == (["a", "und", "und"], [pytest.approx(1.0, abs=1e-3), 0.0, 0.0])


# -- 10 minhash


def test_minhash_edits(spark, docs, empty):
    got = minhash.with_edits(docs).collect()
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    rows = sorted(((i, t or "") for i, t, *_ in fixture_rows()), key=lambda p: (p[0] is not None, p[0] or 0, signed(p[1]), p[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - n] + follow[:n]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
    assert minhash.with_edits(empty).count() == 0
    one = minhash.with_edits(docs.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_minhash_likeness_by_loops(spark, monkeypatch):
    """Fingerprints and likeness against plain loops over shingles, also where one id has most rows and ranges have many groups."""
    monkeypatch.setattr(minhash, "GROUP", 2)
    r = random.Random(12)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.choice((0, 1, 4, 5, 60))))) for i in range(20)] + [(7, f"many rows {k} of one id") for k in range(40)] + [(None, f"none {k}") for k in range(9)]
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        got = minhash.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)

    def slow(text):
        words, out = text.encode().split(), [2**32 - 1] * minhash.PERMUTATIONS
        width = min(5, len(words))
        for k in range(len(words) - width + 1 if words else 0):
            h = width
            for j in range(width):
                h = (h + xxhash.xxh64_intdigest(words[k + j], 7) * pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) % 2**64
            h = ((h ^ h >> 31) * 0xBF58476D1CE4E5B9 % 2**64) >> 32
            out = [min(o, (h * int(a) + int(b)) % 2**32) for o, a, b in zip(out, minhash._A, minhash._B)]
        return [x % 65536 for x in out]

    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64))
    rows.sort(key=lambda p: (p[0] is not None, p[0] or 0, signed(p[1]), p[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        follow = rows[(k + 1) % len(rows)][1]
        edit = t[: len(t) - len(t) // 4] + follow[: len(t) // 4]
        own, other, next_ = slow(t), slow(edit), slow(follow)
        like = lambda x: round(sum(p == q for p, q in zip(own, x)) / len(own), 9)  # noqa: B023, E731
        want.append((str(i), "".join(f"{x:04x}" for x in own), "".join(f"{x:04x}" for x in other), like(other), like(next_)))
    assert sorted((str(x["doc_id"]), x["fingerprint"], x["edited_fingerprint"], round(x["near_edited"], 9), round(x["near_next"], 9)) for x in got) == sorted(want)


def test_minhash_estimates_jaccard():
    r = random.Random(1)
    words = [f"w{i}" for i in range(3000)]
    a = [r.choice(words) for _ in range(4000)]
    b = a[:3000] + [r.choice(words) for _ in range(1000)]
    sa, sb = minhash.signatures([" ".join(a), " ".join(b)])
    s = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    true = len(s(a) & s(b)) / len(s(a) | s(b))
    assert abs((sa == sb).mean() - true) < 0.15
    both = minhash.signatures(["a b", "a b", "", ""])
    assert (both[0] == both[1]).all() and (both[2] == both[3]).all()


def test_minhash_classes(spark, empty):
    r = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        base = [r.choice(words) for _ in range(200)]
        texts.append(base)
        for _ in range(3):
            near = list(base)
            near[r.randrange(200)] = "changed"
            texts.append(near)
        texts.append(base[:100] + [r.choice(words) for _ in range(100)])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, None), (9001, ""), (None, "x")]
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    five = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    sets = {i: five(t.split()) for i, t in rows if i is not None and i < 9000}
    want = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = want[i], want[j]
                want = {k: (min(x, y) if v in (x, y) else v) for k, v in want.items()}
    assert {i: got[i] for i in sets} == want and got[9001] == got[9000] == 9000
    assert minhash.near_duplicates(empty).count() == 0
