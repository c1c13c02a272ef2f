"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded sample of labelled
documents, then calibrated by a temperature on the part of the sample that training has not seen. Scoring reads whole
texts: letters are hashed to small codes, n-grams of one to three codes to features, all by array operations.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, kept_by_text, read_table, release_memory, slices, small_batches, uniform

#: Labelled documents that the classifier is fitted on, as an expected number shared out among the languages evenly, and
#: those of a language at least; a language with fewer gives all it has. This bounds what comes to the driver.
SAMPLE_DOCS, LEAST_DOCS = 4000, 100
FEATURES = 1 << 18
#: FTRL-proximal step size and smoothing, penalties on absolute values and squares, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 2e-4, 1e-4, 3
UNDETERMINED = "und"
#: Characters that are scored at once, and features that weights are made of at once.
BLOCK, FEATURES_AT_ONCE = 400_000, 1 << 14


def _is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def _letter_codes() -> tuple[np.ndarray, np.ndarray]:
    """A code of 1 to 255 for the lower case of every letter and combining mark of the basic plane, 0 for all else, which
    parts words; and which characters are letters."""
    codes, letters = np.zeros(0x10000, np.uint32), np.zeros(0x10000, bool)
    for c in range(0x10000):
        letters[c] = _is_letter(chr(c))
        if letters[c] or unicodedata.category(chr(c))[0] == "M":
            low = chr(c).lower()[0]
            codes[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 2654435761 >> 7) % 229
    return codes, letters


_CODES: list = []


def codes_of(text: str) -> np.ndarray:
    """Codes of a text's characters with runs of other characters as one 0, and a 0 at either end; empty without letters."""
    if not _CODES:
        _CODES.extend(_letter_codes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, 0xFFFF)
    codes, lettered = _CODES[0][low], bool(_CODES[1][low].any())
    beyond = points >= 0x10000
    if beyond.any():
        kinds = [unicodedata.category(chr(p))[0] for p in points[beyond].tolist()]
        codes[beyond] = [28 + p % 227 if k in "LM" else 0 for p, k in zip(points[beyond].tolist(), kinds, strict=True)]
        lettered |= "L" in kinds
    if not lettered:
        return np.empty(0, np.uint32)
    codes = codes[(codes > 0) | (np.concatenate([[1], codes[:-1]]) > 0)]
    return np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1 if codes[-1] else 0, np.uint32)]).astype(np.uint32)


def grams_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the n-grams of one, two and three codes that end at each position."""
    mixed = lambda x, n: ((x * np.uint32(2654435761)) ^ (x >> np.uint32(5)) * np.uint32(40503) + np.uint32(n * 977)) & np.uint32(FEATURES - 1)
    two = codes[:-1] << np.uint32(8) | codes[1:]
    three = two[:-1] << np.uint32(8) | codes[2:]
    return codes, mixed(two, 2), mixed(three, 3)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All features of the text and their shares among its n-grams."""
    codes = codes_of(text)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0)
    ids, n = np.unique(np.concatenate(grams_of(codes)), return_counts=True)
    return ids.astype(np.int64), n / n.sum()


@dataclass(frozen=True)
class Model:
    """weights: a row of zeros, then one for each of features, which the penalties have left a weight of any language, in
    languages' order, inverse document frequencies and scale included."""

    languages: list[str]
    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def rows(self) -> np.ndarray:
        """For every feature its row in weights."""
        at = np.zeros(FEATURES, np.int32)
        at[self.features] = np.arange(1, len(self.features) + 1)
        return at

    def logits(self, sums: np.ndarray) -> np.ndarray:
        return (sums + self.bias) / self.temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


#: Shares of n-grams are small; scaled so, they suit the step size.
SCALE = 100.0


class Made(Sequence):
    """n rows, each made when it is asked for, so that what they are made of is held once."""

    def __init__(self, n: int, make: Callable[[int], tuple]):
        self.n, self.make = n, make

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return self.make(i)


def ftrl(rows: Sequence[tuple[int, np.ndarray, np.ndarray]], n_features: int, n_classes: int, passes: int = PASSES) -> np.ndarray:
    """Weights after passes over rows (class, features, values) in a fixed random order; a row a feature, the last the bias."""
    z, n = np.zeros((n_features + 1, n_classes)), np.zeros((n_features + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    order = np.random.default_rng(11)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            truth, ids, values = rows[i]
            at, x = np.append(ids, n_features), np.append(values, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[truth] -= 1.0
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    for start in range(0, n_features + 1, FEATURES_AT_ONCE):  # weights take the place of z
        at = np.arange(start, min(start + FEATURES_AT_ONCE, n_features + 1))
        z[at] = weights(at)
    return z


def train(rows: Sequence[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Fit to (language, features, shares); a fifth of the rows, dealt by position, sets the temperature.

    Rows are asked for one at a time, again in each pass, and none is kept, so they may be Made.
    """
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.empty(0, np.int64), np.zeros((1, 0), np.float32), np.zeros(0), 1.0)
    held = Made(len(rows) // 5, lambda i: rows[5 * i + 4])
    fit = Made(len(rows) - len(held), lambda i: rows[i // 4 * 5 + i % 4])
    df = np.zeros(FEATURES)
    for _, ids, _ in fit:
        df[ids] += 1
    seen = np.flatnonzero(df)  # state is kept for these alone
    place = np.zeros(FEATURES, np.int32)
    place[seen] = np.arange(len(seen))
    scale = (np.log((1 + len(fit)) / (1 + df[seen])) + 1.0) * SCALE

    def placed(i: int) -> tuple[int, np.ndarray, np.ndarray]:
        lang, ids, share = fit[i]
        return languages.index(lang), place[ids], share * scale[place[ids]]

    full = ftrl(Made(len(fit), placed), len(seen), len(languages))
    weighted, bias = full[:-1], full[-1].copy()
    weighted *= scale[:, None]
    used = np.flatnonzero(weighted.any(axis=1))
    weights = np.zeros((len(used) + 1, len(languages)), np.float32)
    weights[1:] = weighted[used]
    del full, weighted
    model = Model(languages, seen[used], weights, bias, 1.0)
    if not held:
        return model
    at = model.rows()
    logits = np.array([(model.weights[at[ids]].astype(np.float64) * share[:, None]).sum(axis=0) + bias for _, ids, share in held])
    truth = np.array([languages.index(r[0]) for r in held])
    choices = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    # smoothed by one document's worth of doubt, so a part without errors doesn't make scores certain
    doubt = 1 / (len(truth) + 2)
    logs = [np.log(np.maximum(_softmax(logits / t), 1e-12)) for t in choices]
    loss = [-(1 - doubt) * x[np.arange(len(truth)), truth].mean() - doubt * x.mean() for x in logs]
    return replace(model, temperature=float(choices[int(np.argmin(loss))]))


def sample_grams(docs: DataFrame, held_out, sample_docs: int = SAMPLE_DOCS) -> Made:
    """(language, features, shares) of labelled documents out of the held-out part, drawn by doc_id, each language's share alike.

    They come to the driver, and stay there, as flat arrays of eight bytes a feature of a document.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    wanted = max(LEAST_DOCS, sample_docs // max(len(sizes), 1))
    shares = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1.0, wanted / n))) for lang, n in sizes.items()], F.lit(0.0))
    drawn = labelled.where(uniform(F.col("doc_id"), "lang:") < shares).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [counts_of(t) for t in batch.column(2).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(ids) for ids, _ in found)]), pa.int32())
            flat = [np.concatenate([x[k] for x in found]).astype(kind) for k, kind in enumerate((np.int32, np.float32))]
            ids, shares = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in flat)
            made = pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.string()), "lang": batch.column(1), "ids": ids, "shares": shares})
            yield made.filter(pc.greater(pc.list_value_length(ids), 0))

    small_batches(docs.sparkSession)
    rows = drawn.mapInArrow(run, "doc_id string, lang string, ids array<int>, shares array<float>").toArrow().combine_chunks()
    order = pc.sort_indices(rows.select(["doc_id", "lang"]), [("doc_id", "ascending"), ("lang", "ascending")]).to_numpy()
    langs = rows["lang"].to_pylist()
    ends = np.cumsum([0, *pc.list_value_length(rows["ids"]).to_pylist()])
    ids, shares = (pc.list_flatten(rows[c]).to_numpy() for c in ("ids", "shares"))

    def row(i: int) -> tuple[str, np.ndarray, np.ndarray]:
        at = slice(*ends[order[i] : order[i] + 2])
        return langs[order[i]], ids[at].astype(np.int64), shares[at].astype(np.float64)

    return Made(len(order), row)


def score_texts(texts: list, model: Model) -> tuple[list[str], list[float]]:
    """Language and calibrated probability of each text; und and 0 for a null text or one without letters."""
    k, rows = len(model.languages), model.rows()
    names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not k:
        return names, scores
    block: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not block:
            return
        lengths = np.array([len(c) for _, c in block])
        sums = np.zeros((len(block), k))
        codes = np.concatenate([c for _, c in block])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ends = starts + lengths
        one, two, three = grams_of(codes)
        # n-grams that begin in one text and end in the next are taken off again
        for feature, width in ((one, 1), (two, 2), (three, 3)):
            at_row = rows[feature]
            for j in range(k):
                w = model.weights[:, j][at_row]
                for cut in range(1, width):
                    at = ends[:-1] - cut
                    w[at[(at >= 0) & (at < len(w))]] = 0.0
                total = np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)])
                sums[:, j] += total[np.minimum(ends, len(w))] - total[np.minimum(starts, len(w))]
        grams = lengths + np.maximum(lengths - 1, 0) + np.maximum(lengths - 2, 0)
        p = _softmax(model.logits(sums / grams[:, None]))
        for (i, _), best, row in zip(block, p.argmax(axis=1), p, strict=True):
            names[i], scores[i] = model.languages[best], float(min(1.0, row[best]))
        block.clear()

    size = 0
    for i, text in enumerate(texts):
        codes = codes_of(text) if text else ()
        if len(codes):
            block.append((i, codes))
            size += len(codes)
            if size > BLOCK:
                flush()
                size = 0
    flush()
    return names, scores


def fit_language_model(docs: DataFrame, held_out=None) -> Model:
    model = train(sample_grams(docs, F.lit(False) if held_out is None else held_out))
    release_memory()
    return model


def predict_language(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep with lang_pred and score appended, for every row and whole texts."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # rows with a weight, at most FEATURES of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, scores = score_texts(batch.column(0).to_pylist(), shared.value)
            yield pa.RecordBatch.from_pydict(dict(zip(keep, batch.columns[1:], strict=True)) | {"lang_pred": pa.array(names, pa.string()), "lang_score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "lang_pred string, lang_score double"])
    return rows.mapInArrow(run, schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    Learns from text and lang of rows whose crc32(doc_id) mod 4 is not 2. A null text or one without letters is und with
    score 0, as is every text where no row is labelled. Repeated rows each give a row; a null id is not held out; other
    columns are not read; an empty table gives an empty table.
    """
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = fit_language_model(docs.select("doc_id", "lang", "text"), held)
    rows = docs.select("doc_id", held.alias("held_out"), "text")
    return predict_language(rows, model, ["doc_id", "held_out"]).withColumnRenamed("lang_score", "score")


#: A document whose best language is less probable than this is rejected, as is one without letters.
LEAST_PROBABLE = 0.4


def in_a_language(docs: DataFrame, model: Model, least: float = LEAST_PROBABLE) -> DataFrame:
    """The documents that are in one of the model's languages, with their columns.

    A null text, or one without letters, is in none. Rows are judged one by one, so repeated ones stay or go together and
    order doesn't matter; an empty table gives an empty table, as does a model without languages.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keeps(texts: list) -> list[bool]:
        return [n != UNDETERMINED and p >= least for n, p in zip(*score_texts(texts, shared.value), strict=True)]

    return kept_by_text(docs, keeps)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the language of every document's whole text."""
    return identify_languages(read_table(spark, sf_dir, "documents"))
