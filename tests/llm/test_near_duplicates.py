"""The near-duplicate stage against brute force over all pairs."""

import random

import pytest

from siftwell.llm import minhash, queries, shared, simhash, stages


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """Smallest id of each id's class."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def planted():
    """Families at about 0.8 on both sides, a crowd of templated texts, texts with shared boilerplate, short and empty ones."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    draw = lambda n: [r.choice(words) for _ in range(n)]
    texts = []
    for _ in range(12):
        base = draw(120)
        for k in (0, 1, 2, 3, 4, 6):
            near = list(base)
            for at in r.sample(range(120), k):
                near[at] = "changed"
            texts.append(" ".join(near))
    shared = draw(200)
    texts += [" ".join(shared + draw(24)) for _ in range(90)]
    texts += [" ".join(shared[:30] + draw(60)) for _ in range(80)]
    texts += ["", None, "  \n", "a b", "A  b", "a b c", "one two three four five", "ONE two three\tfour five", texts[0].upper()]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [(2, 3), (64, 1024)])
def test_stage_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block[0])
    monkeypatch.setattr(minhash, "STREAM", block[1])
    rows = planted()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class string").repartition(3)
    want = brute_classes(rows)
    stay = stages.near_duplicates(spark, docs, "")
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(want.values()))
    assert max(list(want.values()).count(c) for c in set(want.values())) > 64


def test_stage_on_the_tables(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    want = brute_classes([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in minhash.survivors(docs).collect()) == sorted(set(want.values()))


def test_rows_without_an_id_and_ties(spark):
    rows = [(None, "a b c"), (None, "A b c"), (None, "other words"), (5, "Other words"), (5, "second text"), (9, "second  text"), (5, "second text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.survivors(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["5", "None"] and {r["text"].lower() for r in got if r["doc_id"] is None} == {"a b c"}
    assert minhash.survivors(docs.where("doc_id = 0")).count() == 0


@pytest.mark.parametrize("size", [65, 500])
def test_crowds_against_brute_force(spark, size):
    """Crowds that share a passage, at 0.74 to 0.84 of each other, so that links and no links lie in one band key."""
    r = random.Random(size)
    words = [f"w{i}" for i in range(5000)]
    shared_words = [r.choice(words) for _ in range(200)]
    rows = [(i, " ".join(shared_words + [r.choice(words) for _ in range(r.choice((18, 20, 25, 31)))])) for i in range(size)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == brute_classes(rows)


def test_link_recall(spark):
    """Pairs apart from any crowd, most of them a little over the threshold: each is a class, and at least 0.99 are found."""
    r = random.Random(5)
    rows, linked = [], 0
    for k in range(1500):
        base = [f"w{r.randrange(99999)}" for _ in range(120)]
        near = list(base)
        for at in r.sample(range(120), 2 + k % 2):
            near[at] = "changed"
        linked += len(shingle_set(" ".join(base)) & shingle_set(" ".join(near))) >= 0.8 * len(shingle_set(" ".join(base)) | shingle_set(" ".join(near)))
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(x["class_id"] != x["doc_id"] for x in got)
    assert 0.99 * linked <= found <= linked and linked > 700


def test_nulls_ties_and_tables_left(spark):
    rows = [(None, "a b c"), (None, "a b c"), (3, "A b  c"), (4, None), (5, ""), (4, "x y z"), (7, "x y z"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x["doc_id"]), str(x["class_id"])) for x in minhash.near_duplicates(docs).collect())
    assert got == sorted([("None", "3"), ("None", "3"), ("3", "3"), ("4", "4"), ("5", "4"), ("4", "4"), ("7", "4"), ("None", "None")])
    table = shared.materialize(docs, "gone")
    assert table.count() == 8
    shared.release(table)
    with pytest.raises(Exception, match="(?i)not.exist|no such file"):
        table.count()


def test_fingerprints_have_classes(spark):
    rows = [(i, t) for i, t in planted() if t is None or not any(c.isupper() for c in t)] + [(None, "a b"), (None, "alone"), (3, "more of 3")]
    got = minhash.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    want = brute_classes([(i, t) for i, t in rows if i is not None and t != "more of 3"])
    assert {x["doc_id"]: x["class_id"] for x in got if x["doc_id"] is not None} == want
    short = next(i for i, t in rows if t == "a b")
    assert sorted(str(x["class_id"]) for x in got if x["doc_id"] is None) == sorted([str(want[short]), "None"])
    texts = ["", "é\U0001f642", "x" * 100_000]
    back = shared.packed(spark.createDataFrame([(t,) for t in [*texts, None]], "text string")).collect()
    assert [r["text"] and shared.unpacked(bytes(r["text"])) for r in back] == [*texts, None]


def test_stage_joins_golay_keys_too(spark):
    """A pair at 0.8 that shares no band has equal SimHash fingerprints; a third text has the same and is far from 0.8: it stays."""
    r = random.Random(9888)
    often = " ".join(["again and again and on"] * 60)
    own = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
    rows = [(1, f"{often} {' '.join(own)}"), (2, f"{often} {' '.join([*own[:20], 'x', *own[21:]])}"), (3, f"{often} {' '.join(own[::-1])}"), (4, "apart from all")]
    a, b = minhash.band_keys(minhash.signatures([t for _, t in rows[:2]], minhash.WIDTH, True))
    assert not (a == b).any() and len({simhash.fingerprint_of(t, minhash.WIDTH) for _, t in rows[:3]}) == 1
    want = brute_classes(rows)
    assert want == {1: 1, 2: 1, 3: 3, 4: 4}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x["doc_id"] for x in stages.near_duplicates(spark, docs, "").collect()) == [1, 3, 4]
