"""Language identification, word first with backoff to character n-grams.

Learning counts the words (runs of letters, lower case) of labelled documents by language. A word that is among the ``WORDS`` most
frequent of some language scores by its smoothed log frequency in each. Any other word is read as ``^word$``: at every position
the longest known character n-gram (``GRAM`` down to one character) gives its log frequency, and the word scores their mean. A
document's language is the one with the highest mean over its words, its score the softmax of the means, which doesn't saturate
with the length. The softmax says nothing of a text that is in no language at all, so :func:`accepted` asks for fluency, the mean
log-likelihood of a character in that language, with a floor between its training documents and the same documents with shuffled
letters.

The fit is bounded: at most about ``FIT_DOCS`` labelled documents, taken by a hash of their ids (all of them where there are
fewer), and at most ``WORDS`` words and ``GRAMS`` n-grams of each of the ``LANGS`` most frequent languages. Prediction reads every
whole text, and so does learning: words of any length count with all their n-grams, long ones under a digest. What a worker keeps
of the words it has met is bounded by ``CACHED`` words and twice ``CELLS`` numbers. A null text, or one without a letter, is ``und`` with
score 0, as is every text if nothing could be learned. Null languages teach nothing. Repeated rows stay rows; an empty table gives
an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

FIT_DOCS, WORDS, GRAMS, GRAM, LANGS = 20_000, 20_000, 10_000, 4, 256
SMOOTHING, CACHED, CELLS, CACHED_CHARS, ADDED = 0.5, 300_000, 1 << 21, 48, 1 << 15
#: Log-likelihood of a step back to a shorter n-gram, and of an unseen character; documents of each language that teach its floor.
BACK, UNSEEN, FLOOR_DOCS = -0.9, -20.0, 200
PIECE, LONG = 1 << 15, "#"
UNDETERMINED = "und"
#: Marks that follow letters, such as the vowel signs of Indic scripts, are part of the word.
MARKS = "".join(c for c in map(chr, range(0x300, 0xFFFE)) if unicodedata.category(c)[0] == "M")
WORD = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*").findall


def named(word: str) -> str:
    """The word, or of a long one LONG and a digest, so that the model stays small."""
    return word if len(word) <= CACHED_CHARS else LONG + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training(docs: DataFrame, lang_col: str, text_col: str, id_col: str, fit_docs: int) -> DataFrame:
    """(id, lang, text) of the documents that teach."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    n = rows.count()
    if n > fit_docs:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_003)) < int(1_000_003 * fit_docs / n))
    return rows


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", fit_docs: int = FIT_DOCS) -> dict:
    """The model as a small dict; ``docs`` are the rows to learn from."""
    shared.bounded_batches(docs.sparkSession)
    rows = training(docs, lang_col, text_col, id_col, fit_docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(words: Counter, grams: Counter) -> pa.RecordBatch:
            out = [(lang, w, None, k) for (lang, w), k in words.items()] + [(lang, None, g, k) for (lang, g), k in grams.items()]
            columns = list(zip(*out)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["lang", "word", "g", "n"])

        shared.forget()
        for batch in batches:
            words, grams = Counter(), Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in WORD(text.lower()):
                    words[lang, named(word)] += 1
                    if len(word) > CACHED_CHARS:
                        w = f"^{word}$"
                        for at in range(0, len(w), PIECE):  # a very long run goes in pieces
                            grams.update((lang, w[i : i + k]) for i in range(at, min(at + PIECE, len(w))) for k in range(1, GRAM + 1))
                            if len(grams) > CACHED:
                                yield rows_of(Counter(), grams)
                                grams = Counter()
            yield rows_of(words, grams)

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, word string, g string, n long").groupBy("lang", "word", "g").agg(F.sum("n").alias("n"))
    counts = shared.materialize(counts, "lang-words")
    words = counts.where("word IS NOT NULL").select("lang", "word", "n")
    langs = [r[0] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS).collect()]
    among = F.col("lang").isin(langs) if langs else F.lit(True)
    words = words.where(among)
    # the n-grams of longer words are counted above, since a word may be a whole text
    framed = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    spot = F.explode(F.sequence(F.lit(1), F.length(framed)))
    grams = words.where(~F.col("word").startswith(LONG)).select("lang", "n", framed.alias("w"), spot.alias("at")).select("lang", "n", F.explode(F.array(*[F.substring(F.col("w"), F.col("at"), F.lit(k)) for k in range(1, GRAM + 1)])).alias("g"))
    grams = grams.unionByName(counts.where("g IS NOT NULL").where(among).select("lang", "n", "g"))
    grams = grams.groupBy("lang", "g").agg(F.sum("n").alias("n"))

    def top(table: DataFrame, key: str, most: int) -> dict[str, dict[str, int]]:
        best = Window.partitionBy("lang").orderBy(F.desc("n"), key)  # the fit is bounded, so is a language's table
        out: dict[str, dict[str, int]] = {}
        for lang, item, k in table.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).select("lang", key, "n").collect():
            out.setdefault(item, {})[lang] = k
        return out

    langs.sort()
    seen = top(grams, "g", GRAMS)
    return {"langs": langs, "words": _logs(top(words, "word", WORDS), langs), "grams": _logs(seen, langs), "seen": seen}


def _logs(counts: dict[str, dict[str, int]], langs: list[str]) -> dict[str, np.ndarray]:
    items = sorted(counts)
    if not items:
        return {}
    table = np.array([[counts[i].get(lang, 0) for lang in langs] for i in items], float)
    logs = np.log((table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * len(items)))
    return {item: row for item, row in zip(items, logs)}


def packed(model: dict) -> dict:
    """The model as workers get it: lists of names beside one array each, which take far less memory than an array for each name."""
    langs, seen = model["langs"], model.get("seen", {})
    by: dict[str, list[tuple[str, int]]] = {lang: [] for lang in langs}
    for gram, counts in seen.items():
        for lang, k in counts.items():
            by[lang].append((gram, k))
    at = {g: i for i, g in enumerate(dict.fromkeys([*model["grams"], *seen]))}
    out = {"packed": True, "langs": langs, "grams": list(at), "seen": {lang: (np.array([at[g] for g, _ in x], np.int32), np.array([k for _, k in x], np.int64)) for lang, x in by.items()}}
    for kind in ("words", "grams"):
        out[f"{kind[:-1]}_logs"] = np.array(list(model[kind].values()), float).reshape(len(model[kind]), len(langs))
    return out | {"words": list(model["words"])}


class Scorer:
    """Scores words and remembers them: a row of log-likelihoods by language, and of fluency where it was asked for."""

    def __init__(self, model: dict) -> None:
        if "packed" not in model:
            model = packed(model)
        self.langs, self.word_logs = model["langs"], model["word_logs"]
        self.known = {w: i for i, w in enumerate(model["words"])}
        self.grams = {g: i for i, g in enumerate(model["grams"][: len(model["gram_logs"])])}
        self.gram_logs = np.concatenate([model["gram_logs"], np.full((1, len(self.langs)), -20.0)])
        name = model["grams"].__getitem__
        self.seen: dict[str, dict[str, int]] = {lang: dict(zip(map(name, at.tolist()), n.tolist())) for lang, (at, n) in model["seen"].items()}
        self.letters = {lang: sum(k for g, k in by.items() if len(g) == 1) for lang, by in self.seen.items()}
        self.steps: dict[str, dict[str, float]] = {lang: {} for lang in self.langs}
        self.index: dict[str, int] = {}  # rows of the three
        self.long: list[str] = []  # words with the last rows
        self.table = np.zeros((256, len(self.langs)))
        self.fluent = np.full((256, len(self.langs)), np.nan)
        self.sizes = np.zeros(256)

    def backoff(self, word: str) -> np.ndarray:
        """The mean over the positions of ``^word$`` of the longest known n-gram there."""
        w = f"^{word}$"
        get, rows = self.grams.get, []
        for i in range(len(w)):
            for k in range(min(GRAM, len(w) - i), 0, -1):
                found = get(w[i : i + k])
                if found is not None:
                    rows.append(found)
                    break
            else:
                rows.append(-1)
        return self.gram_logs[rows].mean(axis=0)

    def word(self, word: str) -> np.ndarray:
        found = self.known.get(named(word))
        return self.backoff(word) if found is None else self.word_logs[found]

    def _step(self, gram: str, found: int, lang: str) -> float:
        """The log-likelihood of a gram's last character after those before it."""
        steps = self.steps[lang]
        if gram not in steps:
            steps[gram] = min(0.0, math.log(found / (self.seen[lang].get(gram[:-1], found) if len(gram) > 1 else self.letters[lang])))
        return steps[gram]

    def characters(self, word: str, lang: str) -> float:
        """The log-likelihood of the characters of ``word$``, each after at most GRAM - 1 before it; every step back costs BACK."""
        w, seen, steps, total = f"^{word}$", self.seen[lang], self.steps[lang], 0.0
        for i in range(1, len(w)):
            most = min(GRAM - 1, i)
            for k in range(most, -1, -1):
                gram = w[i - k : i + 1]
                found = seen.get(gram)
                if found:
                    total += (steps[gram] if gram in steps else self._step(gram, found, lang)) + (most - k) * BACK
                    break
            else:
                total += UNSEEN
        return total

    def rows(self, words: list[str]) -> np.ndarray:
        """The words' rows. Words of more than CACHED_CHARS letters are forgotten at the next call."""
        for w in self.long:
            del self.index[w]
        self.long = []
        if len(self.index) > min(CACHED, CELLS // max(1, len(self.langs))):
            self.index.clear()
        found = list(map(self.index.get, words))
        if None in found:
            for w in sorted({w for w, at in zip(words, found) if at is None}, key=len):  # so that long words have the last rows
                at = self.index[w] = len(self.index)
                if at == len(self.table):  # twice as many rows, or ADDED more
                    self.table, self.fluent, self.sizes = (np.concatenate([x, np.full_like(x[:ADDED], np.nan)]) for x in (self.table, self.fluent, self.sizes))
                self.table[at], self.fluent[at], self.sizes[at] = self.word(w), np.nan, len(w) + 1
                if len(w) > CACHED_CHARS:
                    self.long.append(w)
            found = list(map(self.index.__getitem__, words))
        return np.array(found, np.int64)

    def fluency(self, words: list[str], lang: str) -> float:
        """The mean log-likelihood of a character of ``words`` in ``lang``."""
        return self._fluency(words, self.rows(words), self.langs.index(lang))

    def _fluency(self, words: list[str], rows: np.ndarray, k: int) -> float:
        found = self.fluent[rows, k]
        missing = np.flatnonzero(np.isnan(found)).tolist()
        if missing:
            for at, i in {rows[i]: i for i in missing}.items():
                self.fluent[at, k] = self.characters(words[i], self.langs[k])
            found = self.fluent[rows, k]
        return float(found.sum() / self.sizes[rows].sum())

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        judged = [self.judge(WORD(t.lower()) if t else []) for t in texts]
        return [lang for lang, _, _ in judged], [score for _, score, _ in judged]

    def judge(self, words: list[str], fluency: bool = False) -> tuple[str, float, float]:
        """The language of a text's words, its score and, if asked for, its fluency in that language."""
        if not self.langs or not any(c.isalpha() for w in words for c in w):
            return UNDETERMINED, 0.0, 0.0
        rows = self.rows(words)
        mean = self.table[rows].mean(axis=0)
        p = np.exp(mean - mean.max())
        best = int(mean.argmax())  # of equal means the first by name
        return self.langs[best], float(p[best] / p.sum()), self._fluency(words, rows, best) if fluency else 0.0


def with_language(docs: DataFrame, model: dict, lang_name: str, score_name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the predicted language and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(packed(model))
    hold: list[Scorer] = []

    def compute(texts: list[str | None]) -> list[pa.Array]:
        if not hold:
            hold.append(Scorer(sent.value))
        langs, scores = hold[0].predict(texts)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return shared.append(docs, text_col, [(lang_name, "string"), (score_name, "double")], compute)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    out = with_language(rows, model, "lang_pred", "score")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def floors(rows: DataFrame, model: dict) -> dict[str, tuple[float, float]]:
    """For each language (floor, usual): the usual fluency is the median of its training documents (id, lang, text), the floor lies
    halfway from there to the median of the same documents with their letters shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(packed(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared.forget()
        scorer = Scorer(sent.value)
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD(text.lower())
                if not words or lang not in scorer.seen:
                    continue
                letters = list("".join(words))
                random.Random(len(letters)).shuffle(letters)
                mixed, at = "".join(letters), 0
                shuffled = [mixed[at : (at := at + len(w))] for w in words]
                out.append((lang, scorer.fluency(words, lang), scorer.fluency(shuffled, lang)))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())], names=["lang", "own", "shuffled"])

    some = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("floor"), "id"), "text"))).where(F.col("r") <= FLOOR_DOCS)
    found = some.select("lang", "text").mapInArrow(run, "lang string, own double, shuffled double").groupBy("lang").agg(F.median("own"), F.median("shuffled")).collect()
    return {lang: (own - max(0.5, (own - junk) / 2), own) for lang, own, junk in found}


def accepted(docs: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are fluent in the language found, by ``least`` or more, all columns kept: a logistic value of the
    fluency, which is 0.5 at the language's floor. A text between two close languages is so kept as either."""
    taught = docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    model = fit(taught, text_col=text_col)
    bounds = floors(training(taught, "lang", text_col, "doc_id", FIT_DOCS), model)
    lang, score = shared.fresh(docs, "found_lang"), shared.fresh(docs, "found_score")
    sent = docs.sparkSession.sparkContext.broadcast(packed(model))
    hold: list[Scorer] = []

    def compute(texts: list[str | None]) -> list[pa.Array]:
        if not hold:
            hold.append(Scorer(sent.value))
        langs, scores = [], []
        for t in texts:
            found, share, fluency = hold[0].judge(WORD(t.lower()) if t else [], True)
            if found in bounds:
                floor, usual = bounds[found]
                far = 4 * (fluency - floor) / (usual - floor)
                share = 1 / (1 + math.exp(-max(-50.0, min(50.0, far))))
            langs.append(found)
            scores.append(share)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    out = shared.append(docs, text_col, [(lang, "string"), (score, "double")], compute)
    return out.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
