"""Providers, backends, evidence by ids and reviews against literal expectations."""

import ast
import json

import pytest
from pyspark.sql import functions as F

from siftwell.functions import contracts as C
from siftwell.operators import backends, classify, review, tables
from siftwell.plans.session import Session, trimmed
from siftwell.sources import providers, python_handlers, tree

STAGE = C.Stage("q?", C.YES, C.NO, C.thresholds(0.7))
PROGRAM = """
class Box:
    value: int
    extra: str = ""


def load(path):
    try:
        return read(path)
    except OSError:
        return None


def wrap(path):
    return load(path)


def use(path):
    found = wrap(path)
    if found is None:
        raise ValueError(path)
    return found


def box(path):
    return Box(wrap(path), extra="x")


def twice(x):
    try:
        return int(x)
    except ValueError:
        if x:
            raise
        return []
"""
OTHER = "def twice(x):\n    return x\n\n\ndef each(xs):\n    out = []\n    for x in xs:\n        try:\n            out.append(twice(x))\n        except ValueError:\n            continue\n        done(x)\n    return out\n\n\ntry:\n    import fast\nexcept ImportError:\n    fast = None\n"


@pytest.fixture(scope="module")
def programs(spark):
    return spark.createDataFrame([("a.py", PROGRAM), ("b.py", OTHER)], "source string, text string")


def lines_of(evidence):
    return dict(line.split("=", 1) for line in evidence.split("\n") if "=" in line and line.split("=", 1)[0].isidentifier())


def test_handler_evidence(spark, programs):
    rows = {r["id"]: lines_of(r["evidence"]) for r in python_handlers.evidence(python_handlers.parsed(programs), "expanded").collect()}
    assert set(rows) == {"a.py:10-11", "a.py:32-35", "b.py:10-11", "b.py:18-19"}
    load = rows["a.py:10-11"]
    assert load["caught"] == "OSError" and load["callers"] == "a.py:15" and load["sentinel_handling"] == "return=None origin=handler@11"
    assert load["interprocedural_flow"] == "return_fanout=1 resolved=1 unresolved=0 edge1=load->wrap return terminal=normal_return; return_fanout=2 resolved=2 unresolved=0 edge2=wrap->use assign binding=found guard@20->raise@21 return@22; edge2=wrap->box argument field=Box.value terminal=mixed:core_call+explicit_failure"
    twice = rows["a.py:32-35"]
    assert twice["interprocedural_flow"] == "terminal=ambiguous definitions=2" and twice["handler_control_flow"] == "branches=1 first=raise@34 fallthrough=no if x->raise@34"
    each = rows["b.py:10-11"]
    assert each["handler_control_flow"].startswith("branches=0 first=continue@11 fallthrough=no skips 1 statements")
    assert json.loads(each["dataflow"]) == {"tracked": ["out"], "pre_try_writes": [[6, "out"]], "mutated": [], "post_handler_reads": [[13, "out"]]}
    assert rows["b.py:18-19"]["interprocedural_flow"] == "" and rows["b.py:18-19"]["scope"] == "<module>"


def test_handler_facts():
    text = """
def run(rows, cfg):
    best, state.last = None, 0
    for row in rows:
        try:
            best = parse(row)
            cfg["k"] = best
            seen.append(row)
        except (KeyError, ValueError):
            if row.ok:
                save_row(row)
                continue
            elif cfg:
                log(row)
            best = []
            break
        use(best)
    if not best:
        raise ValueError
    print(state.last.x)
    return best
"""
    h = python_handlers.parse_file("m.py", text)["handlers"][0]
    assert h["caught"] == "(KeyError, ValueError)" and h["transfer"] == "continue@12" and h["exits"] is True
    assert h["outcomes"] == "if row.ok->continue@12 else->fallthrough; if cfg->fallthrough"
    assert json.loads(h["dataflow"]) == {"tracked": ["best"], "pre_try_writes": [[3, "best"]], "mutated": [], "post_handler_reads": [[17, "best"], [18, "best"], [21, "best"]]}
    assert h["sentinels"] == "best=[] origin=handler@15 guard=guard@18->raise@19 use=passed@17:use"
    assert json.loads(h["hints"]) == {"controls": ["row.ok", "cfg"], "calls": ["save_row", "log"], "persistence": ["save_row"]}
    key = lambda e: python_handlers.expression_key(ast.parse(e, mode="eval").body)
    assert [key(e) for e in ("a", "a.b[0].c", "f().x", "a[1]", "1")] == ["a", "a.b.c", "", "a", ""]
    assert python_handlers.touches("a.b", {"a"}) and python_handlers.touches("a", {"a.b"}) and not python_handlers.touches("ab", {"a"})
    assert python_handlers.line_window(["1", "2", "3", "4"], 2, 1, 100) == "1\n2\n3" and python_handlers.line_window(["123456789"], 1, 5, 8) == "12345..."
    pairs = python_handlers.assigned_pairs(ast.parse("a, (b, c.d) = 1, (None, x)").body[0])
    assert [(k, ast.unparse(v)) for k, v in pairs] == [("a", "1"), ("b", "None"), ("c.d", "x")]


def test_fan_out_is_bounded_and_the_function_itself_no_caller(spark):
    text = "def f(x):\n    try:\n        return f(x - 1)\n    except ValueError:\n        return {}\n\n\ndef g():\n" + "".join(f"    a{i} = f({i})\n" for i in range(9))
    files = lambda n: spark.createDataFrame([("m.py", "\n".join(text.split("\n")[: 8 + n]) + "\n")], "source string, text string")
    flow = lambda n: lines_of(python_handlers.evidence(python_handlers.parsed(files(n)), "expanded").first()["evidence"])["interprocedural_flow"]
    assert flow(9) == "terminal=unknown sites=9"
    assert flow(8).startswith("return_fanout=8 resolved=0 unresolved=8 edge1=f->g assign binding=a0;") and flow(8).endswith("terminal=unknown")
    assert python_handlers.parse_id("pkg/a.py:3-9") == ("pkg/a.py", 3, 9)
    for bad in ("a.py", "a.py:9-3", "a.py:x-3", ":1-2"):
        with pytest.raises(C.ContractError):
            python_handlers.parse_id(bad)


def test_registry():
    r = providers.Registry()
    assert r.list() == [("python-exceptions", "Python exception handlers")] and providers.list_adapters() == r.list()
    with pytest.raises(C.ContractError):
        r.register(providers.PythonProvider())
    for field, value in (("api_version", 2), ("id", " "), ("label", ""), ("discover", None)):
        one = providers.PythonProvider(id="own")
        setattr(one, field, value)
        with pytest.raises(C.ContractError):
            r.register(one)
    r.register(providers.PythonProvider(id="own"))
    assert r.get("own").id == "own"
    with pytest.raises(C.ContractError):
        r.get("none")


def test_model_selection_and_settings():
    m = [backends.Model("a", "x"), backends.Model("a", "y"), backends.Model("b", "y")]
    pick = lambda **k: backends.select_model(m, **k)
    assert pick() == m[0] and pick(provider="b") == m[2] and pick(model="y") == m[1] and pick(provider="b", model="y") == m[2] and pick(preferred="a/y") == m[1]
    assert pick(provider="b", preferred="a/x") == m[2]
    for bad in ({"provider": "c"}, {"model": "z"}, {"preferred": "a"}, {"preferred": "a/"}, {"preferred": "a/z"}):
        with pytest.raises(C.ContractError):
            pick(**bad)
    assert [backends.bounded_int(x, 12, 1, 64) for x in (None, "", "x", "0", "65", "1.5", " 7 ")] == [12, 12, 12, 12, 12, 12, 7]


def test_python_backend(spark, tmp_path):
    secret = "token = " + "abcdefghij"

    def call(question, text):
        if text == "boom":
            raise RuntimeError(f"no answer for boom, {secret}")
        if text == "fail":
            raise backends.BackendError("quota")
        if text == "stop":
            raise backends.Aborted("stopped")
        return {"yes": 0.9, "no": 0.1, "odd": "maybe", "out": 1.5}[text]

    items = spark.createDataFrame(list([(i, t, t) for i, t in enumerate(["yes", "no", "odd", "out", "boom", "fail", "stop", "x" * 400])]), "ord long, id string, text string")
    model = backends.Model("p", "m", 100)
    out = {r["id"][:4]: r for r in backends.screened(items, backends.PythonBackend(call, concurrency=3), STAGE, model).collect()}
    assert {k: (r["bucket"], r["reason"]) for k, r in out.items()} == {"yes": ("kept", None), "no": ("dropped", None), "odd": ("errors", "malformed_answer"), "out": ("errors", "malformed_answer"), "boom": ("errors", "classifier_exception"), "fail": ("errors", "classifier_error"), "stop": ("errors", "aborted"), "xxxx": ("withheld", "too_large")}
    assert out["boom"]["message"] == "no answer for [ITEM_TEXT_REDACTED], token = [REDACTED]" and out["fail"]["message"] == "quota"
    flag = tmp_path / "stop"
    flag.write_text("")
    stopped = backends.screened(items.where("id = 'yes'"), backends.PythonBackend(call, abort=str(flag)), STAGE, model).first()
    assert (stopped["bucket"], stopped["reason"]) == ("errors", "aborted")
    with pytest.raises(C.ContractError):
        backends.PythonBackend(call, concurrency=65)
    shown = classify.manifest(backends.screened(items, backends.PythonBackend(call), STAGE, model), STAGE.thresholds, ("ERROR",)).where("id = 'fail'").first()
    assert shown["reason"] == "classifier_error: quota"


class Forgetful(backends.PythonBackend):
    def scored(self, items, stage, model):
        return super().scored(items, stage, model).where("id <> 'b'")


def test_a_missing_answer_is_an_error_row(spark):
    items = spark.createDataFrame([(0, "a", "x"), (1, "b", "x")], "ord long, id string, text string")
    out = {r["id"]: r["reason"] for r in backends.screened(items, Forgetful(lambda q, t: 0.9), STAGE, backends.Model("p", "m")).collect()}
    assert out == {"a": None, "b": "classifier_exception"}
    assert backends.status({"kept": 0, "dropped": 0, "undecided": 0, "withheld": 0, "errors": 2}) == "error"
    assert backends.status({"kept": 1, "dropped": 0, "undecided": 0, "withheld": 0, "errors": 2}) == "ok"


def test_python_preset_to_the_end(spark, programs):
    s = Session(spark, scorer_of=lambda contract: lambda id_, text: classify.answer(F.lit(0.9)))
    preset = s.get_preset("python-exceptions")
    assert s.discover_count(preset, programs).total == 4 and s.list_presets() == ["python-exceptions", "script-fallbacks"]
    run = s.primary(preset, programs)
    assert s.efficiency(run)["primary_evaluated"] == 4
    assert s.refine(run) == {"retained": 4, "dropped": 0, "yield": 0.0, "low_yield": True}
    packet = s.review_next()
    assert [i["id"] for i in packet["items"]] == ["a.py:10-11", "a.py:32-35", "b.py:10-11", "b.py:18-19"] and packet["items"][0]["evidence"].startswith("id=a.py:10-11\nscope=")
    picks = ["EXPLICIT_FAILURE", "CONFIRM", "INSUFFICIENT_EVIDENCE", "INSUFFICIENT_EVIDENCE"]
    done = s.review_commit(packet["packet_id"], [(i["id"], d, " why ") for i, d in zip(packet["items"], picks)])
    assert (done["reviewed"], done["findings"], done["needs_expanded"], done["blocked"]) == (2, 1, 2, 0)
    with pytest.raises(C.ContractError):
        s.refine(run)
    more = s.review_next()
    assert more["detail"] == "expanded" and "interprocedural_flow=" in more["items"][0]["evidence"]
    s.review_commit(more["packet_id"], [(more["items"][0]["id"], "INSUFFICIENT_EVIDENCE", "no luck"), (more["items"][1]["id"], "UI_ONLY", "x")])
    assert s.review_next()["status"] == "review_complete_with_blocked_evidence"
    assert [tuple(r) for r in s.blocked().collect()] == [("b.py:10-11", "no luck")]
    events, final = ({r["disposition"]: r["n"] for r in d.collect()} for d in s.dispositions())
    assert events["INSUFFICIENT_EVIDENCE"] == 3 and final == {**dict.fromkeys(events, 0), "CONFIRM": 1, "EXPLICIT_FAILURE": 1, "UI_ONLY": 1, "INSUFFICIENT_EVIDENCE": 1}
    broken = spark.createDataFrame([("a.py", "def (")], "source string, text string")
    assert s.discover(preset, broken).status == "error" and s.discover_count(preset, broken).issues


def test_evidence_by_ids(spark):
    preset = C.parse_preset({"id": "t", "source": {"include": "**", "find": "hit"}, "question": "q?"})
    files = spark.createDataFrame([(f"f{i}", f"a\nhit {i}\n" + "x" * 1500) for i in range(4)], "source string, text string")
    s = Session(spark)
    ids = [r["id"] for r in s.discover(preset, files).rows.orderBy("ord").collect()]
    asked = [ids[2], ids[0], ids[3]]
    whole = s.evidence(preset, files, asked)
    assert whole["packet_ids"] == asked and whole["source_count"] == 3 and whole["trim_reason"] == "none" and whole["chars"] == sum(len(i["evidence"]) for i in whole["items"])
    cut = lambda **k: s.evidence(preset, files, asked, budget=C.Budget(**{"target_items": 1, **k}))
    assert (cut(max_items=2)["packet_ids"], cut(max_items=2)["trim_reason"]) == (asked[:2], "adapter_bounds")
    assert cut(max_sources=1)["packet_ids"] == asked[:1] and cut(max_chars=4000)["packet_ids"] == asked[:2]
    assert (len(cut(max_tokens=1000)["packet_ids"]), cut(max_tokens=1000)["trim_reason"]) == (2, "token_budget")
    assert cut(max_items=2, max_tokens=1000)["trim_reason"] == "adapter_bounds" and trimmed(3, 2, 1) == "both"
    stale = s.evidence(preset, files, [ids[0], "gs:find-1:f9:1:1:abc"])
    assert stale["status"] == "error" and "gs:find-1:f9:1:1:abc" in stale["issues"][0] and stale["items"] == []
    assert s.evidence(preset, files, [ids[0], ids[0]])["status"] == "error"
    rude = Session(spark, packet_builder=lambda items: [*items, {"id": "other", "source": "s", "evidence": ""}])
    with pytest.raises(C.ContractError):
        rude.evidence(preset, files, asked)


def test_review_apply_and_contracts(spark):
    s = Session(spark)
    preset = s.get_preset("python-exceptions")
    out = s.review_apply(preset, "expanded", ["a", "b"], [("b", "UI_ONLY", "x"), ("a", "INSUFFICIENT_EVIDENCE", "x")])
    assert out["reviewed"] == ["b"] and out["blocked"] == ["a"] and out["counts"]["UI_ONLY"] == 1 and not out["findings"]
    for bad in ([("a", "UI_ONLY", "x")], [("a", "NO_SUCH", "x"), ("b", "UI_ONLY", "x")], [("a", "UI_ONLY", " "), ("b", "UI_ONLY", "x")]):
        with pytest.raises(C.ContractError):
            s.review_apply(preset, "standard", ["a", "b"], bad)
    d = list(C.NEUTRAL)
    for bad in (C.Disposition("LATER", False, False, "x"), C.Disposition("SAFE", True, False, " "), C.Disposition("FOUND", True, True, "x"), C.Disposition("lower", True, False, "x")):
        with pytest.raises(C.ContractError):
            C.review_contract((*d, bad))
    assert len(C.review_contract((*d, C.Disposition("SAFE_VARIANT", True, False, "x")))) == 4


def test_redaction_totals_guard_and_window(spark):
    items = spark.createDataFrame([(0, "a", "token = abcdefghij and AKIA" + "A" * 16), (1, "b", "plain"), (2, "c", "x" * 4000)], "ord long, id string, text string")
    s = Session(spark, backend=backends.ColumnBackend(window=1000), call_limit=2, fraction=0.5)
    held = s.screen(items, "q?")
    assert s.summary(held)["withheld"] == 3 and held.evaluated == 0
    done = s.screen(items, "q?", confirm=True)
    n = s.summary(done)
    assert n["redaction_items"] == 1 and n["redaction_count"] == 2 and n["withheld"] == 1 and done.evaluated == 2
    again = s.screen(items, "q?", confirm=True)
    assert again.evaluated == 0 and again.outcomes.where("hit").count() == 2


def test_ranked_and_packets(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("target"), F.when(F.col("id") % 3 == 0, "needs_expanded").otherwise("pending").alias("state"))
    got = sorted((r["rank"], r["target"]) for r in tables.ranked(rows, ["target"], "rank", "t").collect())
    assert got == [(i, i) for i in range(1000)]
    packs = review.packets(rows, 7).groupBy("detail", "packet").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("a"), F.max("target").alias("b")).collect()
    for detail in ("standard", "expanded"):
        mine = sorted((p["packet"], p["n"], p["a"], p["b"]) for p in packs if p["detail"] == detail)
        assert [p[0] for p in mine] == list(range(len(mine))) and all(p[1] == 7 for p in mine[:-1]) and all(x[3] < y[2] for x, y in zip(mine, mine[1:]))


def test_files_by_path_and_uri(spark, tmp_path):
    for name, text in (("b.txt", "x\r\ny"), ("a/c.txt", "é"), ("a/.h.txt", "z"), ("skip/d.txt", "no"), ("a/e.md", "no"), ("b/_f.txt", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "link.txt").symlink_to(tmp_path / "b.txt")
    source = C.Source(("**/*.txt",), skip_dirs=("skip",))
    for scope in (str(tmp_path), f"file://{tmp_path}"):
        assert tree.list_files(scope, source) == ["a/.h.txt", "a/c.txt", "b/_f.txt", "b.txt"]
        assert {r["source"]: r["text"] for r in tree.read_tree(spark, scope, source).collect()} == {"a/.h.txt": "z", "a/c.txt": "é", "b/_f.txt": "", "b.txt": "x\r\ny"}
    assert [tuple(r) for r in tree.read_tree(spark, str(tmp_path / "b.txt"), source).collect()] == [("b.txt", "x\r\ny")]
    with pytest.raises(C.ContractError):
        tree.list_files(str(tmp_path / "none"), source)
    with pytest.raises(C.ContractError):
        tree.list_files(str(tmp_path), C.Source(("**/*.txt",), limits=C.Limits(files=2)))
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    s = Session(spark)
    preset = C.parse_preset({"id": "t", "source": {"include": "**/*.txt", "find": "x"}, "question": "q?"})
    assert s.discover(preset, str(tmp_path)).status == "error" and s.discover(preset, str(tmp_path / "none")).status == "error"


def test_whole_results(spark):
    from siftwell.plans.result_cache import ResultCache

    cache, calls, model = ResultCache(2), [], backends.Model("p", "m")
    table = lambda *texts: spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "ord long, id string, text string")

    def run(p):
        def made():
            calls.append(p)
            return classify.screen(table("x"), classify.lookup_scorer({"0": p}), STAGE.thresholds)

        return made

    ask = lambda items, p, **k: (lambda out: (out[0].first()["probability"], out[1]))(cache.screened(items, STAGE, model, run(p), **k))
    assert ask(table("x"), 0.91) == (0.91, False) and ask(table("x"), 0.73) == (0.91, True)
    assert ask(table("x"), 0.73, rescreen=True) == (0.73, False) and ask(table("x"), 0.5) == (0.73, True)
    assert ask(table("x"), 0.5, confirm=True) == (0.5, False) and ask(table("y"), 0.8) == (0.8, False)
    assert ask(table("x"), 0.6) == (0.6, False)  # two others came since
    assert ask(table("z"), "error")[1] is False and ask(table("z"), 0.9) == (0.9, False)  # errors aren't kept
