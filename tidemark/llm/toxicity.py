"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features: densities of a stated and of a learned lexicon, their proximity to second-person words, capitals, punctuation
and obfuscation rates. Trees, calibration and the learned lexicon come from a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, kept_by_text, read_table, slices, small_batches, uniform, written
from .pretokens import Remembering

#: Labelled documents that lexicon, trees and calibration are fitted on, as an expected number.
SAMPLE_DOCS = 8_000
#: Stated insults and second-person words.
INSULTS = frozenset("idiot moron loser pathetic worthless scum clown disgusting trash stupid dumb imbecile fool garbage vermin filth ugly crap shit bastard jerk hate kill idiota imbécil estúpido basura asqueroso tonto abruti connard imbécile débile ordure crétin dummkopf trottel arschloch abschaum idiotin".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr sie usted ustedes vosotros".split())
#: Stems are the first characters of words, of these lengths.
STEMS = (4, 5, 6, 7, 8)
#: A learned entry occurs in so many toxic documents of the sample at least, and in so many times more of them than of others.
LEAST_DOCS, LEAST_RATIO, LEXICON = 4, 8.0, 4000
#: Trees, their depth, step, bins of a feature and least rows of a leaf.
TREES, DEPTH, STEP, BINS, LEAST_LEAF = 80, 3, 0.15, 32, 5
#: Entries of each of the two generations of a worker's cache of words, about 300 bytes each.
CACHE_WORDS = 60_000

STRIP = ".,;:!?\"'()[]{}|<>*#%$&@~_-+=/\\^`" + "“”‘’«»…¡¿–—"
#: Characters that stand for letters within disguised words.
LEET = str.maketrans("013457@$", "oieastas")
SPELT = re.compile(r"(?:(?<=\s)|^)(?:[^\W\d_][ .\-*_]){3,}[^\W\d_](?=\s|$)")


def words_of(text: str) -> list[str]:
    return [w.strip(STRIP) for w in text.lower().split()]


def plain(word: str) -> str:
    """The word with stand-ins read as letters and inner signs left out."""
    word = word.translate(LEET)
    return word if word.isalpha() else "".join(c for c in word if c.isalpha())


def stems(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]


def _keys_of(text: str) -> set[str]:
    return {s for w in set(words_of(text)) if w for s in stems(w)}


#: Parts that the sample is dealt to; entries of a task's counts that are sent on at once.
FOLDS, COUNTED = 5, 200_000


def key_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, toxic, text) to (key, part, toxic, n): of so many documents a word or a stem (marked by a hyphen) is one."""

    def rows() -> pa.RecordBatch:
        keys, n = list(counts), list(counts.values())
        counts.clear()
        return pa.RecordBatch.from_pydict({"key": pa.array([k[0] for k in keys], pa.string()), "part": pa.array([k[1] for k in keys], pa.int32()), "toxic": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array(n, pa.int64())})

    counts: Counter = Counter()
    for batch in slices(batches):
        for part, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts.update((k, part, toxic) for k in _keys_of(text))
            if len(counts) > COUNTED:
                yield rows()
    yield rows()


def learn_lexicon(seen: list[tuple[str, int, int]], documents: tuple[int, int]) -> dict[str, float]:
    """Log ratios of words and stems that toxic documents have far oftener than others; the LEXICON strongest.

    seen: key, toxic and other documents that have it; documents: toxic and other ones in all.
    """
    found = {}
    for key, toxic, other in seen:
        ratio = (toxic / max(documents[0], 1)) / ((other + 0.5) / max(documents[1], 1))
        if toxic >= LEAST_DOCS and ratio >= LEAST_RATIO:
            found[key] = (float(np.log(ratio)) * min(1.0, toxic / 10), toxic)
    best = sorted(found.items(), key=lambda x: (-x[1][0] * x[1][1], x[0]))[:LEXICON]
    return {k: weight for k, (weight, _) in best}


def lexicons(sample: DataFrame, sizes: np.ndarray) -> list[dict[str, float]]:
    """A lexicon of all parts but one for each part, then one of all. sizes: documents by part, toxic first, then others.

    Words are counted on the workers; what comes to the driver passes for at least one of the lexicons.
    """
    counts = sample.mapInArrow(key_counts, "key string, part int, toxic int, n long")
    cells = [F.sum(F.when((F.col("part") == p) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{p}_{t}") for p in range(FOLDS) for t in (1, 0)]
    counts = counts.groupBy("key").agg(*cells)
    passes = F.lit(False)
    for left_out in [*range(FOLDS), None]:
        parts = [p for p in range(FOLDS) if p != left_out]
        toxic, other = (sum((F.col(f"n{p}_{t}") for p in parts), F.lit(0)) for t in (1, 0))
        n = sizes[parts].sum(axis=0)
        passes = passes | ((toxic >= LEAST_DOCS) & (toxic / F.lit(float(max(n[0], 1))) >= LEAST_RATIO * 0.999 * (other + 0.5) / F.lit(float(max(n[1], 1)))))
    found = counts.where(passes).toPandas()
    cells = found[[f"n{p}_{t}" for p in range(FOLDS) for t in (1, 0)]].to_numpy().reshape(-1, FOLDS, 2)
    out = []
    for left_out in [*range(FOLDS), None]:
        parts = [p for p in range(FOLDS) if p != left_out]
        n = cells[:, parts].sum(axis=1)
        out.append(learn_lexicon(list(zip(found["key"], n[:, 0].tolist(), n[:, 1].tolist(), strict=True)), tuple(sizes[parts].sum(axis=0).tolist())))
    return out


N_FEATURES = 15
PLAIN = (0.0, False, False, False)


class Scanner:
    """Turns texts to feature rows; remembers what it has found of each word."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.words = Remembering(self.word, CACHE_WORDS)

    def word(self, raw: str) -> tuple[float, bool, bool, bool]:
        """Learned weight, whether a stated insult, whether in disguise, whether a second-person word."""
        word = raw.lower().strip(STRIP)
        bare = plain(word)
        weight = max((self.lexicon.get(s, 0.0) for s in stems(word) + (stems(bare) if bare != word else [])), default=0.0)
        insult = word in INSULTS or bare in INSULTS
        if not insult and not weight and word not in SECOND_PERSON:
            return PLAIN
        return (weight, insult, bare != word and (insult or weight > 0) and word not in self.lexicon, word in SECOND_PERSON)

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = text.split()
        n = len(words)
        marks = list(map(self.words.__getitem__, words))
        hits = [i for i, m in enumerate(marks) if m[0] > 0 or m[1]]
        weight = sum(marks[i][0] for i in hits)
        stated = sum(marks[i][1] for i in hits)
        disguised = sum(marks[i][2] for i in hits)
        near = 0
        for i in hits:
            near += any(m[3] for m in marks[max(0, i - 4) : i + 5])
        spelt = 0
        for run in SPELT.findall(text):
            joined = "".join(c for c in run.lower() if c.isalpha())
            spelt += joined in INSULTS or any(s in self.lexicon for s in stems(joined))
        size = max(len(text), 1)
        shout = text.count("!")
        letters = sum(map(str.isupper, words))
        per = 100.0 / max(n, 1)
        return [
            weight, weight * per, float(len(hits)), len(hits) * per, float(stated), stated * per, near * per, disguised * per, float(spelt),
            letters * per, shout / size, (text.count("?") + shout) / size, sum(map(text.count, "*#$%&@")) / size, float(np.log1p(n)), max((marks[i][0] for i in hits), default=0.0),
        ]


# trees


@dataclass(frozen=True)
class Trees:
    """Cut points of features, and trees of equal depth as arrays of feature, cut and leaf values."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), int)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (binned[rows, f[at]] > c[at])
            out += leaf[at - len(f)]
        return out


def split_gains(binned: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """For every feature and cut the gain of sending bins up to the cut to one side; 0 where a side has too few rows."""
    n, k = binned.shape
    at = (binned + np.arange(k) * width).ravel()
    gs, hs, ns = (np.cumsum(np.bincount(at, weights=np.repeat(v, k), minlength=k * width).reshape(k, width), axis=1) for v in (g, h, np.ones(n)))
    left, right = [v[:, :-1] for v in (gs, hs, ns)], [v[:, -1:] - v[:, :-1] for v in (gs, hs, ns)]
    gain = left[0] ** 2 / (left[1] + 1) + right[0] ** 2 / (right[1] + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
    gain[(left[2] < LEAST_LEAF) | (right[2] < LEAST_LEAF)] = 0
    return gain


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees of second-order gradient boosting for logistic loss, on histograms of binned features."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, BINS // 2)) if len(v := x[x[:, j] > 0, j]) else c])) for j, c in enumerate(cuts)]
    width = max(len(c) for c in cuts) + 1
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)])
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    margin = np.full(len(y), start)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, c = np.zeros(inner, int), np.full(inner, width)
        at = np.zeros(len(y), int)
        for level in range(DEPTH):
            for node in range((1 << level) - 1, (1 << level + 1) - 1):
                mine = np.flatnonzero(at == node)
                if len(mine) >= 2 * LEAST_LEAF:
                    gain = split_gains(binned[mine], g[mine], h[mine], width)
                    j, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if gain[j, k] > 1e-6:
                        f[node], c[node] = j, k
                at[mine] = 2 * node + 1 + (binned[mine, f[node]] > c[node])
        gs, hs = (np.bincount(at - inner, weights=v, minlength=leaves) for v in (g, h))
        leaf = -STEP * gs / (hs + 1)
        margin += leaf[at - inner]
        features.append(f)
        thresholds.append(c)
        values.append(leaf)
    return Trees(cuts, np.array(features), np.array(thresholds), np.array(values), start)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the non-decreasing probabilities at them."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, least and greatest margin
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([t, 1.0, m, m])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, w, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = hi
    points, values = [], []
    for s, w, lo, hi in blocks:
        for m in dict.fromkeys((lo, hi)):
            points.append(m)
            values.append((s + 0.02) / (w + 0.04))
    return np.array(points), np.maximum.accumulate(np.array(values))


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    trees: Trees
    points: np.ndarray
    values: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.trees.margin(x), self.points, self.values), 0.0, 1.0)


def fold_features(sample: DataFrame, lexicons: list[dict[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, features and label of the sample's rows, the features of a part by the lexicon of the others; made on the workers."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicons)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans: dict[int, Scanner] = {}
        for batch in slices(batches):
            parts, texts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            x = [scans.setdefault(p, Scanner(shared.value[p])).features(t) for p, t in zip(parts, texts, strict=True)]
            yield pa.RecordBatch.from_pydict({"part": batch.column(0), "toxic": batch.column(1), "x": pa.array(x, pa.list_(pa.float64()))})

    rows: pd.DataFrame = sample.mapInArrow(run, "part int, toxic int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), N_FEATURES)
    order = np.lexsort([*x.T, rows["toxic"], rows["part"]])  # reruns add up in the same order
    return rows["part"].to_numpy()[order], x[order], rows["toxic"].to_numpy(float)[order]


def fit(sample: DataFrame) -> Model:
    """Lexicon, trees and calibration from labelled_texts.

    The features of a part come from a lexicon of the other parts, so densities mean the same to the trees as on new
    documents; the margins for calibration come from trees of the other parts. Only counts that pass and features, N_FEATURES
    numbers a row, come to the driver.
    """
    small_batches(sample.sparkSession)
    sizes = np.zeros((FOLDS, 2), int)
    for r in sample.groupBy("part", "toxic").count().collect():
        sizes[r["part"], 1 - r["toxic"]] = r["count"]
    found = lexicons(sample, sizes)
    part, x, y = fold_features(sample, found)
    if not len(y):
        part, x, y = np.zeros(1, int), np.zeros((1, N_FEATURES)), np.zeros(1)
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        inside = part == k
        if inside.any():
            margin[inside] = (boost(x[~inside], y[~inside]) if (~inside).any() else boost(x, y)).margin(x[inside])
    return Model(found[-1], boost(x, y), *isotonic(margin, y))


def labelled_texts(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(part, toxic, text) of about sample_docs labelled documents, drawn and dealt by doc_id; labels of null are left out.

    Of several labels of an id the greatest holds. A written table.
    """
    told = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = told.count()
    told = told.where(uniform(F.col("doc_id"), "toxic:") < min(1.0, sample_docs / max(n, 1)))
    joined = docs.select("doc_id", "text").join(F.broadcast(told), "doc_id")  # sample_docs rows or so
    part = F.least(F.floor(uniform(F.col("doc_id"), "toxic-part:") * FOLDS), F.lit(FOLDS - 1)).cast("int")
    toxic = F.greatest(F.lit(0), F.least(F.lit(1), F.col("toxic").cast("int")))
    return written(joined.select(part.alias("part"), toxic.alias("toxic"), F.coalesce("text", F.lit("")).alias("text")), "toxicity-sample")


def score_documents(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep and toxicity, the calibrated score of each row's whole text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(shared.value.lexicon)
        for batch in slices(batches):
            x = np.array([scan.features(t) for t in batch.column(0).to_pylist()]).reshape(batch.num_rows, -1)
            score = shared.value.scores(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_pydict(dict(zip(keep, batch.columns[1:], strict=True)) | {"toxicity": pa.array(score, pa.float64())})

    rows = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "toxicity double"])
    return rows.mapInArrow(run, schema)


def held_out_rows(parts: int = 5, rest: int = 0) -> Column:
    return F.coalesce(fold("doc_id", parts) == rest, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns from labels of rows whose crc32(doc_id) mod 5 is not 0. Null and empty texts are scored like any other, by
    features of no words. Repeated rows each give a row; a null id is not held out and never labelled; of several labels of
    an id the greatest holds; other columns are not read; with no labels every score is that of the base rate.
    """
    model = fit(labelled_texts(docs, labels.where(~held_out_rows())))
    rows = score_documents(docs.select("doc_id", held_out_rows().alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with their columns.

    A null text is scored as the empty one. Rows are judged one by one, so repeated ones stay or go together; an empty table
    gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scanners: list[Scanner] = []

    def keeps(texts: list) -> list[bool]:
        if not scanners:
            scanners.append(Scanner(shared.value.lexicon))
        x = np.array([scanners[0].features(t) for t in texts]).reshape(len(texts), N_FEATURES)
        return (shared.value.scores(x) < limit).tolist()

    return kept_by_text(docs, keeps)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the toxicity of every document."""
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
