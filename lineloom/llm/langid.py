"""Hierarchical language identification: family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineloom.llm.common import documents, small_side
from lineloom.session import materialize

#: The fit takes at most so many labelled rows of a language, chosen by a hash of the key; every language is
#: learned.  With more languages than the second figure the sample stays in the tasks, which fit the machines.
FIT_ROWS, DRIVER_LANGUAGES = 200, 64
#: Buckets of hashed character n-grams (bytes of lower-case words, padded with a space).
BUCKETS = 4096
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_NO_LETTERS = np.zeros(256, bool)
_NO_LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = True
_MULTIPLIERS = (1, 0x9E3779B1, 0x85EBCA77)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(text: str) -> np.ndarray:
    """Square roots of n-gram shares of the whole text, with length 1."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    raw = np.where(_NO_LETTERS[raw], 32, raw)
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    codes = np.concatenate(([32], raw[keep], [32])).astype(np.uint32)
    total = np.zeros(BUCKETS, np.float64)
    for order in ORDERS:
        if len(codes) < order:
            break
        mixed = np.zeros(len(codes) - order + 1, np.uint32)
        for k in range(order):
            mixed = (mixed ^ (codes[k : len(codes) - order + 1 + k] + np.uint32(257 * order))) * np.uint32(_MULTIPLIERS[k % 3] | 1)
            mixed ^= mixed >> np.uint32(15)
        counts = np.bincount(mixed & np.uint32(BUCKETS - 1), minlength=BUCKETS)
        total += counts / max(1, counts.sum())
    total = np.sqrt(total)
    return (total / np.linalg.norm(total)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, strength: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of an averaged hinge-loss fit by sub-gradient steps; ``y`` is +1 or -1."""
    rng = np.random.default_rng(7)
    w, b = np.zeros(x.shape[1]), 0.0
    mean_w, mean_b, taken, step = np.zeros_like(w), 0.0, 0, 0
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    for turn in range(rounds):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            step += 1
            rate = 1.0 / (strength * (step + 1000))
            wrong = batch[y[batch] * (x[batch] @ w + b) < 1]
            g = (share[wrong] * y[wrong]) @ x[wrong] / max(1, len(batch)) if len(wrong) else 0.0
            w = (1 - rate * strength) * w + min(rate, 2.0) * g
            b += min(rate, 2.0) * float((share[wrong] * y[wrong]).sum()) / max(1, len(batch))
            if turn >= rounds // 2:
                taken += 1
                mean_w += (w - mean_w) / taken
                mean_b += (b - mean_b) / taken
    return mean_w, mean_b


def families(means: dict[str, np.ndarray], names: list[str]) -> list[list[str]]:
    """Languages grouped by agglomeration on mean features: the closest groups join until about sqrt(n) are left."""
    groups = [[n] for n in sorted(names)]
    centre = [np.mean([means[n] for n in g], axis=0) for g in groups]
    apart = np.full((len(groups), len(groups)), np.inf)
    for a, b in combinations(range(len(groups)), 2):
        apart[a, b] = np.linalg.norm(centre[a] - centre[b])
    while len(groups) > max(1, round(len(names) ** 0.5)):
        a, b = (int(i) for i in np.unravel_index(np.argmin(apart), apart.shape))
        groups[a] += groups.pop(b)
        centre.pop(b)
        apart = np.delete(np.delete(apart, b, axis=0), b, axis=1)
        centre[a] = np.mean([means[n] for n in groups[a]], axis=0)
        for i in range(len(groups)):
            if i != a:
                apart[min(i, a), max(i, a)] = np.linalg.norm(centre[i] - centre[a])
    return [sorted(g) for g in groups]


class LanguageModel:
    """Family by one linear SVM per pair of families, then language by one per pair of its languages."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        names = sorted(set(langs))
        self.families = families({n: x[langs == n].mean(axis=0) for n in names}, names) if names else []
        of = {n: i for i, g in enumerate(self.families) for n in g}
        family = np.array([of[v] for v in langs], dtype=int)
        self.top = self._pairs(x, family, list(range(len(self.families))))
        self.within = [self._pairs(x[np.isin(langs, g)], langs[np.isin(langs, g)], g) for g in self.families]

    @classmethod
    def of(cls, grouped: list[list[str]], top, within: list) -> LanguageModel:
        """A model of machines fitted elsewhere."""
        made = cls.__new__(cls)
        made.families, made.top, made.within = grouped, top, within
        return made

    @staticmethod
    def _fitted(x, labels, a, b) -> tuple[np.ndarray, float]:
        rows = (labels == a) | (labels == b)
        return linear_svm(x[rows].astype(np.float64), np.where(labels[rows] == a, 1.0, -1.0))

    @classmethod
    def _pairs(cls, x, labels, names):
        return cls._machine([(a, b, *cls._fitted(x, labels, names[a], names[b])) for a, b in combinations(range(len(names)), 2)], len(names))

    @staticmethod
    def _machine(fitted: list, n: int):
        pairs = [(a, b) for a, b, _, _ in fitted]
        w = np.array([f[2] for f in fitted], np.float32).reshape(len(fitted), BUCKETS)
        return pairs, w, np.array([f[3] for f in fitted], np.float32), n

    @staticmethod
    def _vote(machine, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs, w, bias, n = machine
        if not pairs:
            return np.zeros(len(x), int), np.ones(len(x))
        margins = x @ w.T + bias
        votes, sums = np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (a, b) in enumerate(pairs):
            votes[np.arange(len(x)), np.where(margins[:, k] >= 0, a, b)] += 1
            sums[:, a] += margins[:, k]
            sums[:, b] -= margins[:, k]
        best = np.argmax(votes + 1e-6 * np.tanh(sums), axis=1)
        return best, 1 / (1 + np.exp(-2 * sums[np.arange(len(x)), best] / max(1, n - 1)))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and a score from 0 to 1 for every row."""
        family, score = self._vote(self.top, x)
        langs = np.empty(len(x), dtype=object)
        for i, group in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            if len(rows):
                inner, more = self._vote(self.within[i], x[rows])
                langs[rows] = np.array(group, dtype=object)[inner]
                score[rows] *= more
        return langs.tolist(), score


def _array(raw) -> np.ndarray:
    return np.array([np.frombuffer(r, np.float16) for r in raw]).astype(np.float32).reshape(-1, BUCKETS)


def _fit_in_tasks(sample: DataFrame) -> LanguageModel:
    """The model of ``sample(lang, pick, x)``: one mean a language and one weight vector a machine reach the driver.

    Each pair of families, and each pair of languages within one, is a group of rows that one task fits; a
    group has at most the sampled rows of its languages.
    """

    def centre(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "mean": [_array(part["x"]).mean(axis=0).astype(np.float32).tobytes()]})

    means = sample.groupBy("lang").applyInPandas(centre, "lang string, mean binary").collect()
    means = {r["lang"]: np.frombuffer(r["mean"], np.float32) for r in means}
    grouped = families(means, sorted(means))
    # The machines a language takes part in: (family or -1 for the top, first, second, whether it is the first's).
    roles = []
    for i, group in enumerate(grouped):
        for j, name in enumerate(group):
            roles += [(name, -1, min(i, k), max(i, k), i < k) for k in range(len(grouped)) if k != i]
            roles += [(name, i, min(j, k), max(j, k), j < k) for k in range(len(group)) if k != j]
    parts = sample.sparkSession.createDataFrame(roles, "name string, family int, a int, b int, ahead boolean")
    dealt = sample.join(small_side(parts, len(roles)), sample["lang"] == parts["name"])

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["lang", "pick", "x"])
        w, bias = linear_svm(_array(part["x"]).astype(np.float64), np.where(part["ahead"], 1.0, -1.0))
        one = part.iloc[0]
        return pd.DataFrame({"family": [one["family"]], "a": [one["a"]], "b": [one["b"]], "w": [w.astype(np.float32).tobytes()], "bias": [float(bias)]})

    kept = dealt.select("family", "a", "b", "ahead", "lang", "pick", "x")
    fitted: dict[int, list] = {}
    for r in kept.groupBy("family", "a", "b").applyInPandas(fit, "family int, a int, b int, w binary, bias double").toLocalIterator():
        fitted.setdefault(r["family"], []).append((r["a"], r["b"], np.frombuffer(r["w"], np.float32), r["bias"]))
    machine = lambda i, n: LanguageModel._machine(sorted(fitted.get(i, []), key=lambda f: f[:2]), n)
    return LanguageModel.of(grouped, machine(-1, len(grouped)), [machine(i, len(g)) for i, g in enumerate(grouped)])


def fit_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS, driver_languages: int = DRIVER_LANGUAGES) -> LanguageModel | None:
    """Fit on at most ``fit_rows`` rows of each language of ``labelled``; null languages and letterless texts are left out.

    Every language with a text is learned.  Features are computed by the tasks.  Up to ``driver_languages`` languages the
    driver gets one vector per sampled row and fits; beyond, the tasks fit and the driver gets the machines.
    None if no row is left.
    """
    known = labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_n"))
    known, seen = materialize(known, "lang-counts", n=F.count(F.lit(1)))
    if not seen["n"]:
        return None
    # A row is drawn by its hash with twice the chance it takes to fill the language, then cut to the bound.
    pick = F.pmod(F.xxhash64(F.lit(11), key, text), F.lit(1 << 40))
    bar = (F.least(F.lit(1.0), F.lit(2.0 * fit_rows + 50) / F.col("_n")) * (1 << 40)).cast("long")
    bars = small_side(known.select("_lang", bar.alias("_bar")), seen["n"])
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("pick", T.LongType()), T.StructField("x", T.BinaryType())])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, p, features(t).astype(np.float16).tobytes()) for n, p, t in batch.itertuples(index=False) if has_letter(t)]
            yield pd.DataFrame(rows, columns=["lang", "pick", "x"])

    drawn = labelled.join(bars, (F.col(lang) == F.col("_lang")) & (pick < F.col("_bar")))
    sample = drawn.select(F.col(lang).alias("lang"), pick.alias("pick"), F.col(text).alias("t")).mapInPandas(vectors, schema)
    if seen["n"] > driver_languages:
        first = F.row_number().over(W.partitionBy("lang").orderBy("pick", "x"))
        sample, left = materialize(sample.withColumn("turn", first).where(F.col("turn") <= fit_rows).drop("turn"), "lang-sample", n=F.count(F.lit(1)))
        return _fit_in_tasks(sample) if left["n"] else None
    by: dict[str, list] = {}
    for r in sample.collect():
        by.setdefault(r["lang"], []).append(r)
    rows = [r for name in sorted(by) for r in sorted(by[name], key=lambda r: (r["pick"], bytes(r["x"])))[:fit_rows]]
    if not rows:
        return None
    return LanguageModel(_array([r["x"] for r in rows]), np.array([r["lang"] for r in rows], dtype=object))


def predict_languages(docs: DataFrame, model: LanguageModel | None, text: str = "text", key: str = "doc_id", carry: tuple[Column, ...] = ()) -> DataFrame:
    """Key, carried columns, ``lang_pred`` and ``score`` of every row, from its whole text alone.

    ``und`` with score 0 where the text is null, empty or without a letter, or where nothing was
    learned.  Rows keep their repeats.  The model, which goes to every task, has one
    vector per pair of families and per pair of languages within a family.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shared.value
        for texts in batches:
            langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            rows = [i for i, t in enumerate(texts) if fitted is not None and has_letter(t)]
            for at in range(0, len(rows), 512):
                part = rows[at : at + 512]
                found, sure = fitted.predict(np.array([features(texts.iloc[i]) for i in part]))
                for i, name, s in zip(part, found, sure):
                    langs[i], scores[i] = name, s
            yield pd.DataFrame({"lang": langs, "score": scores})

    rows = docs.select(F.col(key), *carry, predict(F.col(text)).alias("_said"))
    return rows.select(*[c for c in rows.columns if c != "_said"], F.col("_said.lang").alias("lang_pred"), F.col("_said.score").alias("score"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit_languages(docs.where(~held).where("lang IS NOT NULL"))
    return predict_languages(docs, model, carry=(held.alias("held_out"),)).select("doc_id", "held_out", "lang_pred", "score")
