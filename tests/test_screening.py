"""Screening semantics against literal expectations."""

import random
import re
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.functions import contracts as C
from siftwell.functions.patterns import glob_regex
from siftwell.operators import classify, discovery, evidence, redaction
from siftwell.plans.session import Session
from siftwell.sources import tree

ITEMS = [(0, "high", "a"), (1, "mid", "b"), (2, "low", "c"), (3, "err", "d"), (4, "bad", "e"), (5, "boom", "f"), (6, "stop", "g")]
TABLE = {"high": 0.9, "mid": 0.5, "low": 0.1, "err": "error", "bad": "malformed", "boom": "throw", "stop": "aborted"}


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "ord int, id string, text string")


def test_thresholds():
    assert C.thresholds(0.7) == C.Thresholds(0.7, 1 - 0.7) and C.thresholds(keep=0.9).drop == 1 - 0.7
    for bad in ({"threshold": 0.5}, {"keep": 1.1}, {"drop": 0.5}, {"threshold": 0.7, "keep": 0.8}):
        with pytest.raises(C.ContractError):
            C.thresholds(**bad)


def test_five_buckets_and_reasons(spark):
    out = {r["id"]: (r["bucket"], r["reason"]) for r in classify.screen(items(spark), classify.lookup_scorer(TABLE), C.thresholds(0.7)).collect()}
    assert out == {"high": ("kept", None), "mid": ("undecided", None), "low": ("dropped", None), "err": ("errors", "classifier_error"), "bad": ("errors", "malformed_answer"), "boom": ("errors", "classifier_exception"), "stop": ("errors", "aborted")}


def test_edges_are_inclusive(spark):
    rows = [(i, str(i), "x") for i in range(4)]
    scorer = classify.lookup_scorer({"0": 0.7, "1": 1 - 0.7, "2": 0.3, "3": float("nan")})
    assert [r["bucket"] for r in classify.screen(items(spark, rows), scorer, C.thresholds(0.7)).orderBy("ord").collect()] == ["kept", "dropped", "dropped", "errors"]


def test_guard_and_validation(spark):
    many = items(spark, [(i, f"i{i}", "t") for i in range(201)])
    assert classify.screen(many, classify.hash_scorer("q"), C.thresholds(), confirm=False).where("reason = 'approval_required'").count() == 201
    assert classify.screen(many.limit(199), classify.hash_scorer("q"), C.thresholds(), confirm=False).where("bucket = 'withheld'").count() == 0
    with pytest.raises(C.ContractError):
        classify.validate(items(spark, [(0, "a", "x"), (1, "a", "y")]))


def test_redaction(spark):
    samples = {
        "Authorization: Bearer " + "a" * 20: "Bearer [REDACTED]", "x gh" + "p_" + "A1" * 10 + " y": "[REDACTED_TOKEN]", "k AKIA" + "A" * 16: "[REDACTED_AWS_ACCESS_KEY]",
        "AIza" + "b" * 35: "[REDACTED_API_KEY]", "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----": "[REDACTED_PRIVATE_KEY]", "password: hunter2hunter2": "[REDACTED]", "étoken = abcdefghij": "[REDACTED]",
    }
    for text, want in samples.items():
        r = spark.createDataFrame([(text,)], "t string").select(redaction.redact(F.col("t")).alias("r")).first()["r"]
        assert want in r["text"] and r["count"] >= 1, text
    r = spark.createDataFrame([('token = "abcdefgh"',)], "t string").select(redaction.redact(F.col("t")).alias("r")).first()["r"]
    assert r["text"] == "token = [REDACTED]" and r["count"] == 2


def test_globs():
    g = lambda pattern, path: bool(re.match(glob_regex(pattern).replace(r"\z", r"\Z"), path))
    assert g("**/*.ts", "a.ts") and g("**/*.ts", "x/y/a.ts") and not g("*.ts", "x/a.ts") and g("a?.ts", "ab.ts") and not g("a.ts", "abts")


def test_offsets_and_zero_width(spark):
    text = "ab\r\ncab xx\ncab"
    files = spark.createDataFrame([("f", text)], "source string, text string")
    source = C.Source(("**",), patterns=(C.Pattern("m", "m", "ab"),))
    got = sorted((r["off"], r["line"], r["column"]) for r in discovery.candidates(files, source).collect())
    assert got == [(0, 1, 1), (5, 2, 2), (12, 3, 2)]
    zero = discovery.located(files.withColumn("text", F.lit("bxa")), (C.Pattern("z", "z", "x*"), C.Pattern("y", "y", r"\b|(?=a)"))).collect()
    assert sorted((r["pattern_id"], r["off"], r["match_text"]) for r in zero) == [("y", 0, ""), ("y", 2, ""), ("y", 3, ""), ("z", 0, ""), ("z", 1, "x"), ("z", 2, ""), ("z", 3, "")]
    hashes = spark.createDataFrame([("catch-clause\0catch (e) {",), ("find-1\0token",), ("é\0x",), ("find-1\0🙂",), ("",)], "t string").select(discovery.short_hash(F.col("t")).alias("h")).collect()
    assert [r["h"] for r in hashes] == ["0f98b96ebdd1", "60248c017787", "1ad0739c188d", "2edecbfb7ac6", "811c9dc59e37"]


def test_empty_matches_are_counted_one_by_one(spark, monkeypatch):
    texts = ["", "a!!b", "!!!", "🙂!", "\n!a\n", None]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "source string, text string")
    patterns = [C.Pattern("p", "p", x) for x in ("!*", r"\b|(?=a)", "(!)?(a)?")]
    want = [[("p", discovery.located(files, (p,)).count())] for p in patterns]
    monkeypatch.delattr(discovery, "_empty_hits")  # a count makes no places
    assert [[tuple(r) for r in discovery.counts(files, (p,)).collect()] for p in patterns] == want
    long = pd.Series(["ab! " * 50_000])
    tracemalloc.start()
    try:
        assert list(discovery._empty_count(patterns[0]).func(long)) == [200_001]
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()


def brute_matches(text, pattern):
    """Places in UTF-16 code units, counted one by one."""
    wide = lambda x: len(x.encode("utf-16-le")) // 2
    return [(wide(text[: m.start()]), text.count("\n", 0, m.start()) + 1, wide(text[: m.start()].rsplit("\n", 1)[-1]) + 1, m[0]) for m in re.finditer(pattern, text)]


def test_places_count_code_units(spark):
    r = random.Random(5)
    texts = ["🙂 ab", "🙂\r\n🙂🙂ab ab\rab\n", "", "ab", "\n\nab", "étoken=ab🙂ab"] + ["".join(r.choice(["ab", "🙂", "x", "\n", "é", "\r\n", " "]) for _ in range(r.choice((3, 40, 3000)))) for _ in range(30)]
    files = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)] + [("null", None)], "source string, text string")
    for pattern in ("ab", "a|b|🙂", "[^x]", "x*(?=a)", "(?=b)"):
        got = {}
        for x in discovery.located(files, (C.Pattern("p", "p", pattern),)).collect():
            got.setdefault(x["source"], []).append((x["off"], x["line"], x["column"], x["match_text"]))
        for i, t in enumerate(texts):
            assert sorted(got.get(f"f{i}", [])) == sorted(brute_matches(t, pattern)), (pattern, t[:40])
        assert {x["n"] for x in discovery.counts(files, (C.Pattern("p", "p", pattern),)).collect()} == {sum(len(brute_matches(t or "", pattern)) for t in [*texts, None])}
    assert got["f0"] == [(4, 1, 5, "")]


def test_windows_cut_at_code_units(spark):
    text = "\n".join(["🙂" * 30] * 4) + "\nhit\n" + "\n".join(f"line {i}" for i in range(6, 12))
    files = spark.createDataFrame([("f", text)], "source string, text string")
    for chars in (60, 61, 75, 5000):
        got = discovery.located(files, (C.Pattern("h", "h", "hit"),), {"w": C.Window(2, 2, chars)}).first()["w"]
        whole = "\n".join(f"{'>' if i == 5 else ' '}{i:>5} | {text.splitlines()[i - 1]}" for i in range(3, 8))
        size = lambda x: len(x.encode("utf-16-le")) // 2
        if size(whole) <= chars:
            assert got == whole
        else:
            body, end = got[: -len("\n[window truncated]")], got[-len("\n[window truncated]") :]
            assert end == "\n[window truncated]" and whole.startswith(body) and chars - 26 < size(body) <= chars - 24


def test_redaction_is_planned_once(spark):
    from siftwell.plans import queries

    docs = spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = docs.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), "text")
    out = classify.retained(classify.screen(queries._redacted(rows).drop("n"), classify.hash_scorer("q"), C.thresholds()))
    plan = out.where("probability > 0.1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 7 and plan.count("regexp_extract_all(") == 7 and plan.count("md5(") == 1


def test_packing_stops_at_the_first_violation(spark):
    r = random.Random(3)
    rows = [(p, i, f"s{r.randint(0, 3)}", "x" * r.randint(1, 400)) for p in range(30) for i in range(r.randint(1, 25))]
    budget = C.Budget(5, 10, 2, 1000)
    got = {(x["p"], x["ord"]) for x in evidence.packed(spark.createDataFrame(rows, "p int, ord int, source string, evidence string"), budget, "p").collect()}
    want = set()
    for p in range(30):
        sources, chars, n = set(), 0, 0
        for _, i, s, e in [x for x in rows if x[0] == p]:
            if n >= 10 or (s not in sources and len(sources) >= 2) or chars + len(e) > 1000:
                break
            sources.add(s)
            chars, n = chars + len(e), n + 1
            want.add((p, i))
    assert got == want


def test_session_from_tree_to_review(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "_u.ts").write_text("try { a() } catch (e) { b() }\n")
    (tmp_path / "x.ts").write_text("p.catch(() => 1)\ntry { a() } catch { }\n")
    (tmp_path / "node_modules" / "d.ts").write_text("catch {")
    preset = C.parse_preset({**C.FALLBACKS, "id": "t", "source": {**C.FALLBACKS["source"], "skipDirs": ["node_modules"]}})
    assert tree.list_files(str(tmp_path), preset.source) == ["_u.ts", "x.ts"]
    s = Session(spark, scorer_of=lambda contract: lambda id_, text: classify.answer(F.lit(0.9)))
    run = s.primary(preset, str(tmp_path))
    assert s.manifest(run).count() == 3 and s.efficiency(run)["cache_hits"] == 0
    assert s.efficiency(s.primary(preset, str(tmp_path), defer_review=True))["cache_hits"] == 3
    packet = s.review_next("review-1")
    assert packet == s.review_next("review-1") and len(packet["items"]) == 3
    ids = [i["id"] for i in packet["items"]]
    with pytest.raises(C.ContractError):
        s.review_commit(packet["packet_id"], [(ids[0], "CONFIRM", "x")], "review-1")
    done = s.review_commit(packet["packet_id"], [(ids[0], "CONFIRM", "x"), (ids[1], "REJECT", "x"), (ids[2], "INSUFFICIENT_EVIDENCE", "x")], "review-1")
    assert done["findings"] == 1 and done["needs_expanded"] == 1
    again = s.review_next("review-1")
    assert again["detail"] == "expanded"
    assert s.review_commit(again["packet_id"], [(ids[2], "INSUFFICIENT_EVIDENCE", "x")], "review-1")["blocked"] == 1
    assert s.review_next("review-1")["status"] == "review_complete_with_blocked_evidence"


def test_presets():
    with pytest.raises(C.ContractError):
        C.parse_preset({**C.FALLBACKS, "dropHints": ["x"] * 9})
    p = C.parse_preset({"id": "a", "source": {"include": "*", "find": "call(a+b)", "match": ["x", "y"]}, "question": "q?"})
    assert [x.id for x in p.source.patterns] == ["find-1", "match-1", "match-2"] and p.primary.thresholds == C.Thresholds(0.7, 0.2)
    with pytest.raises(C.ContractError):
        C.review_contract(C.NEUTRAL[:2])
