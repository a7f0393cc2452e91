"""Rejection of texts in no language."""

import random

from siftwell.llm import langid, queries


def test_junk_goes_and_clean_documents_stay(spark, sf_dir):
    docs = queries.documents(spark, sf_dir).select("doc_id", "text", "lang")
    r = random.Random(4)
    junk = [(10**9 + 3 * i, " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 10))) for _ in range(n)), None) for i, n in enumerate([20, 100] * 20)]
    both = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    stay = {x["doc_id"] for x in langid.accepted(both).select("doc_id").collect()}
    clean = {x["doc_id"] for x in docs.collect() if x["text"] and langid.WORD(x["text"])}
    assert not stay & {i for i, *_ in junk}
    assert len(stay & clean) >= 0.99 * len(clean)


def test_long_runs_teach(spark):
    r = random.Random(6)
    texts = {"xa": lambda: "".join(r.choice("abc") for _ in range(3000)), "xb": lambda: "".join(r.choice("mno") for _ in range(70_000))}
    rows = [(k, texts[lang](), lang) for k, lang in enumerate(["xa", "xb"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model["langs"] == ["xa", "xb"]
    for lang in texts:
        brute = {}
        for _, t, own in rows:
            for i in range(len(t) + 2) if own == lang else ():
                for k in range(1, langid.GRAM + 1):
                    g = f"^{t}$"[i : i + k]
                    brute[g] = brute.get(g, 0) + 1
        assert {g: by[lang] for g, by in model["seen"].items() if lang in by} == brute
    scorer = langid.Scorer(model)
    assert scorer.predict([texts["xa"](), texts["xb"](), "abcab", "monom"])[0] == ["xa", "xb", "xa", "xb"]
    scorer.predict(["abc"])
    assert all(len(w) <= langid.CACHED_CHARS for w in scorer.index)


def test_scripts_without_spaces_and_with_vowel_signs(spark):
    """Chinese, Thai and Hindi clauses: learned from whole runs, told apart on new ones, with scores that grow with the evidence."""
    r = random.Random(9)
    parts = {"zh": "我们 他们 今天 天气 很好 学习 中国 人民 工作 大学 图书 时间".split(), "th": "วันนี้ อากาศ ดีมาก เรียน ภาษา ไทย ทำงาน โรงเรียน หนังสือ เวลา".split(), "hi": "आज मौसम बहुत अच्छा है हम भारत में काम करते हैं समय किताब".split()}
    make = {"zh": lambda n: "".join(r.choice(parts["zh"]) for _ in range(n)), "th": lambda n: "".join(r.choice(parts["th"]) for _ in range(n)), "hi": lambda n: " ".join(r.choice(parts["hi"]) for _ in range(n))}
    rows = [(k, make[lang](60), lang) for k, lang in enumerate(["zh", "th", "hi"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    scorer = langid.Scorer(langid.fit(docs))
    for lang in make:
        found, scores = scorer.predict([make[lang](n) for n in (5, 30, 200)])
        assert found == [lang] * 3 and all(0.5 < x <= 1 for x in scores)
    assert langid.WORD(parts["hi"][1]) == [parts["hi"][1]]  # vowel signs don't cut the word


def test_the_score_is_not_saturated_and_memory_is_bounded(monkeypatch):
    model = {"langs": ["a", "b"], "words": {"x": [-1.0, -1.5], "y": [-2.0, -1.0]}, "grams": {}}
    scorer = langid.Scorer(model)
    even = scorer.predict(["x " * 1000, "x y " * 500])
    assert even[0] == ["a", "b"] and abs(even[1][0] - 1 / (1 + 2.718281828 ** -0.5)) < 1e-6 and even[1][1] < 0.6
    monkeypatch.setattr(langid, "CELLS", 40)
    for k in range(50):
        scorer.predict([f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" + " w" * k])
    assert len(scorer.index) <= 22 and len(scorer.table) <= 256


def test_predictions_against_loops(spark):
    """Word-first backoff in plain loops over a few documents."""
    import math
    import re
    from collections import Counter

    r = random.Random(13)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 30)))
    rows = [(i, make("abcde" if i % 2 else "cdefg"), "xa" if i % 2 else "xb") for i in range(60)] + [(90, "zz qq", None), (91, None, "xa"), (92, "7 8", "xb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identified(docs).collect()}
    import zlib

    words, grams = {"xa": Counter(), "xb": Counter()}, {"xa": Counter(), "xb": Counter()}
    find = re.compile(r"[^\W\d_]+").findall
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 3 != 1:
            for w in find((t or "").lower()):
                words[lang][w] += 1
                f = f"^{w}$"
                grams[lang].update(f[a : a + k] for a in range(len(f)) for k in range(1, 5) if a + k <= len(f))
                # near the end the slices are shorter, and count again
                grams[lang].update(f[a : a + k] for a in range(len(f)) for k in range(1, 5) if a + k > len(f))

    def log(counts, item, lang):
        known = set(counts["xa"]) | set(counts["xb"])
        return math.log((counts[lang][item] + 0.5) / (sum(counts[lang].values()) + 0.5 * len(known)))

    def score(w, lang):
        if w in words["xa"] or w in words["xb"]:
            return log(words, w, lang)
        f, total = f"^{w}$", 0.0
        for a in range(len(f)):
            k = next((k for k in range(min(4, len(f) - a), 0, -1) if f[a : a + k] in grams["xa"] or f[a : a + k] in grams["xb"]), 0)
            total += log(grams, f[a : a + k], lang) if k else -20.0
        return total / len(f)

    for i, t, _ in rows:
        found = find((t or "").lower())
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not found:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        means = {lang: sum(score(w, lang) for w in found) / len(found) for lang in words}
        best = max(sorted(means), key=means.get)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(math.exp(m - means[best]) for m in means.values())) < 1e-9
