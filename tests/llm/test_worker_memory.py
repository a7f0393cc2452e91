"""What Python workers hold from stage to stage, and what the language model takes in each."""

import gc
import pickle
import tracemalloc

import public_tokenizers
import pyarrow as pa
from pyspark import SparkContext

from siftwell.llm import byte_bpe, langid, shared


def alive(docs):
    """The encoders that the worker of a next step still holds."""

    def compute(texts):
        kinds = [type(x).__name__ for x in gc.get_objects()]
        return [pa.array([kinds.count("Encoder")] * len(texts), pa.int64())]

    return {x["n"] for x in shared.append(docs, "text", [("n", "long")], compute).collect()}


def test_a_worker_drops_the_tokens_tables_before_the_next_step(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    before = byte_bpe.digests(docs, path, public_tokenizers.PATTERN).collect()
    assert alive(docs) == {0}
    assert byte_bpe.digests(docs, path, public_tokenizers.PATTERN).collect() == before
    assert byte_bpe.encoder(path, public_tokenizers.PATTERN) is byte_bpe.encoder(path, public_tokenizers.PATTERN)
    shared.forget()


def test_workers_get_the_language_model_in_little_memory(spark, monkeypatch):
    names = [f"w{i:06d}" for i in range(20_000)]
    counts = {w: {"xa": 1 + i % 7, "xb": 1 + i % 5} for i, w in enumerate(names)}
    logs = langid._logs(counts, ["xa", "xb"])
    model = {"langs": ["xa", "xb"], "words": logs, "grams": logs, "seen": counts}
    sent, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: (sent.append(value), broadcast(self, value))[1])
    docs = spark.createDataFrame([(1, "w000003 w000010")], "doc_id long, text string")
    langid.with_language(docs, model, "lang_pred", "score")
    data = pickle.dumps(sent[-1])
    tracemalloc.start()
    try:
        there = pickle.loads(data)
        scorer = langid.Scorer(there)
        taken = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert taken < 400 * len(names)
    assert all((scorer.word(w) == logs[w]).all() for w in names[:100])
    assert scorer.seen == {lang: {w: by[lang] for w, by in counts.items()} for lang in ("xa", "xb")}
