"""The pipeline's rows, stage by stage, against planted cases and slow versions."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken

from siftwell.llm import shared, stages
from tests.llm.test_near_duplicates import brute_classes

LETTERS = {"xa": "abcdefgh ", "xb": "mnopqrst "}


def text_of(r, lang, n=60):
    """Words of syllables that the language's letters make, in short lines."""
    half = LETTERS[lang].strip()
    syllables = [a + b for a in half[:4] for b in half[4:]]
    words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 2))) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    r = random.Random(21)
    rows, labels, kind = [], [], {}

    def add(text, lang, what, source=None, quality=None):
        i = len(rows)
        rows.append((i, text, lang, source or f"s{i % 4}", len(text or "")))
        kind[i] = what
        if quality is not None:
            labels.append((i, quality, 0))
        return i

    for k in range(240):
        add(text_of(r, "xa" if k % 2 else "xb"), "xa" if k % 2 else "xb", "clean", quality=1 if k % 3 == 0 else None)
    for k in range(80):  # shouting with marks: bad by label or only by its form
        lang = "xa" if k % 2 else "xb"
        add("!! ".join(text_of(r, lang, 40).upper().split()), lang, "bad", quality=0 if k % 2 == 0 else None)
    for k in range(30):
        add(" ".join("".join(r.choice("zyxwvu0") for _ in range(6)) for _ in range(40)), None, "no language")
    add(None, "xa", "no language")
    add("", "xb", "no language")
    add("123 456 !!", "xa", "no language")
    for k in range(12):  # copies, exact and near
        words = rows[3 * k][1].split()
        add(rows[3 * k][1], rows[3 * k][2], "copy")
        near = list(words)
        near[30] = words[0]
        add(" ".join(near), rows[3 * k][2], "copy")
    folder = tmp_path_factory.mktemp("corpus")
    names = ("doc_id", "text", "lang", "source", "n_chars")
    pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()))}), folder / "documents.parquet")
    pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(("doc_id", "quality", "toxic"), zip(*labels), (pa.int64(), pa.int32(), pa.int32()))}), folder / "labels.parquet")
    return str(folder), {x[0]: x for x in rows}, kind


def test_run_against_slow_stages(spark, planted, monkeypatch):
    folder, rows, kind = planted
    seen, write = {}, shared.materialize

    def watched(df, tag):
        out = write(df, tag)
        if tag.startswith("stage-"):
            seen[tag[6:]] = [x["doc_id"] for x in out.select("doc_id").collect()]
        return out

    monkeypatch.setattr(shared, "materialize", watched)
    final = stages.run(spark, folder).collect()
    assert list(seen) == [name for name, _ in stages.STAGES]
    assert sorted(seen["language"]) == [i for i in rows if kind[i] != "no language"]
    assert sorted(seen["quality"]) == [i for i in rows if kind[i] in ("clean", "copy")]
    classes = brute_classes([(i, rows[i][1]) for i in seen["quality"]])
    assert sorted(seen["near_duplicates"]) == sorted(set(classes.values())) and len(set(classes.values())) == 240
    # the mix: weights 5, 2, 1, 5 over four sources, 150% of all words, no source beyond twice itself
    size = lambda i: len(rows[i][1].split())
    words, largest = Counter(), max(map(size, seen["near_duplicates"]))
    for i in seen["near_duplicates"]:
        words[rows[i][3]] += size(i)
    want, left, open_ = {}, 1.5 * sum(words.values()), dict(zip(sorted(words), (5, 2, 1, 5)))
    while over := [s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * words[s]]:
        for s in over:
            want[s] = 2 * words[s]
            open_.pop(s)
        left = 1.5 * sum(words.values()) - sum(want.values())
    want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    times = Counter(seen["mix"])
    assert set(times) <= set(seen["near_duplicates"]) and max(times.values()) <= 2
    for s in words:
        assert abs(sum(n * size(i) for i, n in times.items() if rows[i][3] == s) - want[s]) <= 3 * largest
    # the tokens of each row of the mix
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(x["doc_id"] for x in final) == times
    for x in final:
        ids = encoding.encode_ordinary(rows[x["doc_id"]][1])
        assert x["n_tokens"] == len(ids) and x["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_take_empty_tables_nulls_and_clashing_names(spark, planted):
    folder, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "ab cd ab", "xa", None, 3), (1, "ab cd ab", "xa", None, 3)], docs.schema)
    for table in (docs.where("doc_id < 0"), docs.where("doc_id < 60").unionByName(odd)):
        named = table.selectExpr("*", "1 AS score", "2 AS `row`", "'x' AS class", "3 AS size", "4 AS n", "'t' AS th", "5 AS host")
        for name, stage in stages.STAGES:
            out = stage(spark, named, folder)
            assert name == "tokens" or out.columns == named.columns, name
            assert out.count() <= 2 * named.count() and (out.count() > 0) == (table.count() > 0)
