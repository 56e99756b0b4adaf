"""Toxicity by compression distance, with zstandard dictionaries.

Dictionaries are trained on windows of toxic text and of ordinary text.  A text is cut
into windows of words, and each window is compressed twice: with the ordinary
dictionary, and with the toxic one in front of the ordinary one.  The bytes that the toxic
dictionary saves are the window's distance.  As the second dictionary holds all of the
first, what is common in either kind of text saves nothing.

Toxic text is mostly ordinary words, so most of what is trained on it tells nothing.  The toxic
texts are halved; a dictionary is trained on the raw windows of either half, and its content is
tried on the other half and on ordinary texts, part by part: a part that saves bytes in several times as
large a share of toxic texts is halved and its halves are tried, down to a few bytes, and
what passes at the end is the toxic dictionary.  Only compressed lengths decide this.

A text's features (its largest distances, their sum, how many windows reach which distance, and
its length) become a probability by logistic regression on the training labels.

Only fitting sees labels, and works on a bounded sample: at most ``most_rows`` labelled
texts of each class, chosen by a hash of the id.  Scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import ready_python

_STEPS = (1, 2, 3, 4, 5, 6, 8, 10)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def windows(text: str, words: int) -> list[bytes]:
    """Windows of ``words`` words of a lower-cased text; neighbours share a word."""
    w = [x for x in _SPACE.split(text.lower()) if x]
    return [f" {' '.join(w[i : i + words])} ".encode() for i in range(0, max(len(w) - 1, 1), words - 1)] if w else []


@dataclass
class Pair:
    """An ordinary and a toxic dictionary's content."""

    ordinary: bytes
    toxic: bytes
    level: int

    def __post_init__(self):
        self._plain = self._both = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._plain = self._both = None

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        p = zstandard.ZstdCompressionParameters.from_level(self.level, source_size=256, dict_size=len(content), min_match=6, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def distances(self, some: list[bytes]) -> np.ndarray:
        if self._plain is None:
            self._plain, self._both = self._compressor(self.ordinary), self._compressor(self.ordinary + self.toxic)
        plain, both = self._plain.compress, self._both.compress
        return np.fromiter((len(plain(x)) - len(both(x)) for x in some), np.int64, len(some))


@dataclass
class Model:
    """The dictionaries and the calibration."""

    pair: Pair
    words: int
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def features(self, text: str | None) -> np.ndarray:
        some = windows(text or "", self.words)
        d = self.pair.distances(some) if some else np.zeros(1, np.int64)
        top = np.sort(np.maximum(d, 0))[::-1][:3]
        counts = np.array([(d >= s).sum() for s in _STEPS])
        return np.r_[np.log1p(max(len(some), 1)), top[0], top.mean(), np.log1p(d[d > 0].sum()), np.minimum(counts, 5), counts > 0, np.log1p(counts[2]) / np.log1p(len(d) + 1)]

    def score(self, text: str | None) -> float:
        x = (self.features(text) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30))))


def _dictionary(size: int, samples: list[bytes], k: int, d: int) -> bytes:
    """A trained dictionary's content; too little text to train on is the content itself.

    The trainer stops early if segments of ``k`` bytes are short against how the text repeats; then longer
    ones are tried.
    """
    best = b""
    for longer in (1, 2, 4, 16):
        try:
            best = max(best, zstandard.train_dictionary(size, samples, k=k * longer, d=d).as_bytes(), key=len)
        except zstandard.ZstdError:
            pass
        if len(best) >= size // 2:
            return best
    return best or b"".join(samples)[:size]


@dataclass
class Proof:
    """Windows of texts of both classes, to try parts of a dictionary on.

    ``least``: a part must save bytes in so many toxic texts.  ``ratio``: and in so many times as large a
    share of these (less one standard deviation of their number) as of ordinary ones, for one of the
    ``steps``, the bytes saved in a text.
    """

    ordinary: bytes
    level: int
    windows: list[bytes]
    owner: np.ndarray
    label: np.ndarray  # of each owner
    plain: np.ndarray  # lengths with the ordinary dictionary
    least: int = 6
    ratio: float = 6.0
    steps: tuple[int, ...] = (1, 2, 3, 5, 8)
    small: int = 10
    overlap: int = 6

    @staticmethod
    def of(toxic: list[str], ordinary: list[str], content: bytes, words: int, level: int) -> Proof:
        each = [windows(t, words) for t in [*toxic, *ordinary]]
        some = [w for x in each for w in x]
        compress = Pair(content, b"", level)._compressor(content).compress
        owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
        return Proof(content, level, some, owner, np.r_[np.ones(len(toxic), int), np.zeros(len(ordinary), int)], np.fromiter((len(compress(w)) for w in some), np.int64, len(some)))

    def parts(self, content: bytes) -> list[tuple[float, bytes]]:
        """The parts that pass, with how many times as often they save bytes in toxic texts."""
        toxic, found = self.label == 1, []
        pair, todo = Pair(self.ordinary, b"", self.level), [(content, np.arange(len(self.windows)))]
        while todo:
            part, at = todo.pop()
            compress = pair._compressor(self.ordinary + part).compress
            saved = self.plain[at] - np.fromiter((len(compress(self.windows[i])) for i in at), np.int64, len(at))
            at, saved = at[saved > 0], saved[saved > 0]
            total = np.bincount(self.owner[at], weights=saved, minlength=len(self.label))
            reach = [((total[toxic] >= s).sum(), (total[~toxic] >= s).sum()) for s in self.steps]
            reach = [(t, o) for t, o in reach if t >= self.least]
            if not reach:
                continue
            if len(part) <= self.small:
                times = max((t - t**0.5) / (o + 1) for t, o in reach) * max((~toxic).sum(), 1) / toxic.sum()
                if times >= self.ratio:
                    found.append((float(times), part))
            else:
                half = len(part) // 2
                todo += [(part[: half + self.overlap // 2], at), (part[half - self.overlap // 2 :], at)]
        return found


def _in_turn(job: Callable, pieces: list[bytes]) -> list:
    return [job(x) for x in pieces]


def _on_spark(spark: SparkSession) -> Callable[[Callable, list[bytes]], list]:
    """Runs a job on pieces in tasks; the results come in the pieces' order."""

    def run(job: Callable, pieces: list[bytes]) -> list:
        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for n, piece in zip(batch["n"], batch["piece"], strict=True):
                    found = job(bytes(piece))
                    yield pd.DataFrame({"n": [n] * len(found), "times": [x[0] for x in found], "part": [x[1] for x in found]})

        table = spark.createDataFrame(list(enumerate(pieces)), "n int, piece binary").repartition(max(1, len(pieces) // 4))
        rows = table.mapInPandas(some, "n int, times double, part binary").collect()
        out: list[list] = [[] for _ in pieces]
        for r in rows:
            out[r["n"]].append((r["times"], bytes(r["part"])))
        return out

    return run


def proven(toxic: list[str], ordinary: list[str], content: bytes, words: int, level: int, size: int, most: int, run: Callable) -> bytes:
    """The toxic dictionary: the parts of dictionaries of either half that tell in the other one, best last."""
    found: list[tuple[float, bytes]] = []
    for half in (0, 1):
        own = _dictionary(size, [w for t in toxic[half::2] for w in windows(t, 12)], 16, 6)
        proof = Proof.of(toxic[1 - half :: 2][:most], ordinary[: 2 * most], content, words, level)
        step = 256
        for some in run(proof.parts, [own[i : i + step + proof.overlap] for i in range(0, len(own), step)]):
            found += some
    return b" ".join(x for _, x in sorted(set(found)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (first: the intercept) by Newton's method; ``weight``: of each row."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    penalty = np.diag(np.r_[1e-6, np.full(x.shape[1] - 1, ridge)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: pd.DataFrame, *, words: int = 10, level: int = 6, toxic_bytes: int = 32 << 10, ordinary_bytes: int = 64 << 10, most_proof: int = 200, run: Callable = _in_turn) -> Model:
    """Fits a model to ``text`` and ``label`` (1: toxic); ``weight``: how many labelled rows a row stands for.

    Two thirds of the rows, by turns, train the dictionaries, and the calibration is
    fitted to the last third, which the dictionaries have not seen.  Parts of the toxic dictionary are tried on at
    most ``most_proof`` toxic and twice as many ordinary texts.  If no part passes, the whole
    trained content stays.  Without both classes the score is the share of label 1.
    """
    labelled = labelled.sort_values("id", kind="stable").reset_index(drop=True)
    texts, y = labelled["text"].fillna("").tolist(), labelled["label"].to_numpy(np.float64)
    turn = np.zeros(len(y), np.int64)
    for c in (0, 1):
        turn[y == c] = np.arange((y == c).sum())
    first = turn % 3 != 2
    toxic = [t for t, c, f in zip(texts, y, first, strict=True) if f and c == 1]
    ordinary = [t for t, c, f in zip(texts, y, first, strict=True) if f and c == 0]
    start = _dictionary(ordinary_bytes, [w for t in ordinary for w in windows(t, 12)], 64, 8)
    content = proven(toxic, ordinary, start, words, level, toxic_bytes, most_proof, run) if toxic and ordinary else b""
    content = content or _dictionary(toxic_bytes, [w for t in toxic for w in windows(t, 12)], 16, 6)
    model = Model(Pair(start, content, level), words)
    rest = np.flatnonzero(~first)
    x = np.array([model.features(texts[i]) for i in rest]) if len(rest) else np.zeros((0, len(model.features(""))))
    model.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
    model.scale = np.where(x.std(0) > 1e-9, x.std(0), 1.0) if len(x) else np.ones(x.shape[1])
    weight = labelled["weight"].to_numpy(np.float64) if "weight" in labelled else np.ones(len(y))
    share = np.average(y, weights=weight) if len(y) else 0.0
    if len({*y[rest]}) == 2:
        model.weights = _logistic((x - model.mean) / model.scale, y[rest], weight[rest] / weight[rest].mean())
    else:
        model.weights = np.r_[np.log((share + 1e-9) / (1 - share + 1e-9)), np.zeros(x.shape[1])]
    return model


def sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, most_rows: int) -> pd.DataFrame:
    """At most ``most_rows`` labelled texts of each class, by a hash of the id; one per id.

    ``weight``: the labelled rows of the class for each row taken, which calibrates scores to how frequent the classes are.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label"))
    parts = []
    for c in (0, 1):
        order = F.xxhash64(F.lit("toxicity sample"), id_col)
        few = known.where(F.col("label") == c).orderBy(order, id_col).limit(most_rows)
        ids = [r[0] for r in few.select(id_col).collect()]
        rows = docs.where(F.col(id_col).isin(ids)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        part = rows.groupBy("id").agg(F.min("text").alias("text")).withColumn("label", F.lit(c)).toPandas()
        parts.append(part.assign(weight=known.where(F.col("label") == c).count() / max(len(ids), 1)))
    return pd.concat(parts, ignore_index=True)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1, higher: more likely toxic) and ``predicted`` to every document.

    Null and empty texts have no window and get the score of such.  Rows are scored on
    their own, so ties, repeated rows and empty tables need no care; columns named like
    the new ones are replaced.
    """
    spark = docs.sparkSession
    ready_python(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series([m.score(x) for x in texts], dtype="float64")

    out = docs.withColumn("__score", run(text_col)).drop("score", "predicted")
    return out.withColumn("score", F.col("__score")).withColumn("predicted", (F.col("__score") >= threshold).cast("int")).drop("__score")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 1500, **options) -> Model:
    """Fits a model on a bounded sample of the labelled documents; see ``fit`` and ``sample``."""
    ready_python(docs.sparkSession)
    return fit(sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, most_rows=most_rows), run=_on_spark(docs.sparkSession), **options)
