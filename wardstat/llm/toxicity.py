"""Operator 6: toxicity by compression distance.

Two zstandard dictionaries are trained on the driver from a bounded sample of labelled
texts (``TRAIN_DOCS`` of each class in expectation, ``TRAIN_CHARS`` characters of each):
words common in ordinary texts go into both, and the toxic one has, before them,
the words and word beginnings that toxic texts share and ordinary texts lack.
Every text is cut at white space into windows of about ``WINDOW`` bytes; a
window's distance is its compressed size with the ordinary dictionary less that
with the toxic one, so it is above 0 where only the toxic dictionary knows what
is written. A text's score comes from a logistic fit, on texts that the dictionaries
were not trained on, to the largest distance, the number of windows
above the window threshold, the sum of the distances and the number of windows.

Defined cases: null and empty texts get the score of a text without windows;
repeated rows score alike; null labels are not learned; a document with both labels
is taken as it comes; with no labelled row of one class every score is 0; a null doc_id is in no fold (held_out is null).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm import textbytes as tb
from wardstat.llm.tables import crc_mod, documents, pick

TRAIN_DOCS = 2500
TRAIN_CHARS = 20_000
WINDOW = 64
LEVEL = 6
TOXIC_BYTES = 8 << 10
COMMON_BYTES = 8 << 10
FOLDS, HELD = 5, 0
SEED = 20240607
MIN_MATCH = 5
#: ends every window and both dictionaries, so that no window is stored raw and each match counts
PAD = b"\n0123456789-=+_)(*&^%$#@!~0123456789|/?.,<>;:[]{}9876543210 \n" * 2
MIN_RATIO = 10
MIN_DOCS = 4
CHANCE = 0.05
#: part of the classes' weight in the fit that makes them even
EVEN = 0.5
MAX_PIECES = 400

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = re.compile(rb"[a-z\x80-\xff]{3,24}")


@dataclass
class Model:
    """Dictionary contents, the window threshold and the logistic weights (none: nothing learned)."""

    ordinary: bytes
    toxic: bytes
    edge: float
    weights: np.ndarray | None


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, start, end`` of windows over all bytes, ending at white space where there is some near."""
    n = -(-np.diff(offsets) // size)
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    mark = offsets[row] + nth * size
    space = np.append(np.flatnonzero(_SPACE[data]), len(data) + size)
    moved = space[np.searchsorted(space, mark)]
    start = np.where(nth == 0, mark, np.where(moved - mark < size // 2, moved, mark))
    start = np.minimum(start, offsets[row + 1])
    end = np.append(start[1:], len(data))
    end = np.where(np.append(row[1:] != row[:-1], True) if len(row) else np.empty(0, bool), offsets[row + 1], end)
    return row, start, end


def _padded(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, bytes]:
    """The windows, each followed by ``PAD``, and their segments."""
    size = end - start
    at = np.cumsum(size + len(PAD)) - size - len(PAD)
    out = np.empty(int(size.sum()) + len(PAD) * len(size), np.uint8)
    out[(at + size)[:, None] + np.arange(len(PAD))] = np.frombuffer(PAD, np.uint8)
    steps = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + steps] = data[np.repeat(start, size) + steps]
    return out.tobytes(), np.stack([at, size + len(PAD)], 1).astype("<u8").tobytes()


class Distances:
    """Window distances by the two dictionaries."""

    def __init__(self, model: Model):
        kind = zstandard.DICT_TYPE_RAWCONTENT
        self.pair = []
        for content in (model.ordinary, model.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=kind)
            params = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False, min_match=MIN_MATCH)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        folded = _FOLD[data]
        row, start, end = windows(folded, offsets)
        some = end > start
        row, start, end = row[some], start[some], end[some]
        if not len(row):
            return row, np.empty(0)
        raw, segments = _padded(folded, start, end)
        a, b = (self._sizes(c, raw, segments) for c in self.pair)
        return row, (a - b).astype(np.float64)

    @staticmethod
    def _sizes(compressor: zstandard.ZstdCompressor, raw: bytes, segments: bytes) -> np.ndarray:
        packed = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(raw, segments), threads=1)
        return np.fromiter((len(s) for s in packed), np.int64, len(packed))


def features(row: np.ndarray, distance: np.ndarray, n_rows: int, edge: float) -> np.ndarray:
    """Bias, largest distance, logs of the windows above the edge, of the sum of the positive distances, and of the windows."""
    largest = np.zeros(n_rows)
    np.maximum.at(largest, row, distance)
    above = np.bincount(row, distance >= edge, n_rows)
    gained = np.bincount(row, np.maximum(distance, 0), n_rows)
    n = np.bincount(row, minlength=n_rows)
    return np.stack([np.ones(n_rows), largest, np.log1p(above), np.log1p(gained), np.log(np.maximum(n, 1))], 1)


def _fold_text(text: str) -> bytes:
    return _FOLD[np.frombuffer(text.encode(), np.uint8)].tobytes()


def train(texts: list[tuple[str, int]]) -> Model:
    """Dictionaries, threshold and weights from ``(text, label)``."""
    seen, kept = set(), []
    for text, label in sorted(set(texts)):
        raw = _fold_text(text)
        words = _WORD.findall(raw)
        prints = sorted({hash_bytes(b" ".join(words[i : i + 4])) for i in range(max(len(words) - 3, 1))})[:8] if words else []
        known = sum(p in seen for p in prints)  # near copies would make their own words look typical
        seen.update(prints)
        if not prints or known * 2 <= len(prints):
            kept.append((raw, label))
    order = np.random.default_rng(SEED).permutation(len(kept))
    half = [kept[i] for i in order[: (len(kept) * 2) // 3]]
    rest = [kept[i] for i in order[(len(kept) * 2) // 3 :]]
    n = Counter(label for _, label in half)
    none = Model(b"", b"", 1.0, None)
    if not n[0] or not n[1] or {y for _, y in rest} != {0, 1}:
        return none
    df = {0: Counter(), 1: Counter()}
    for raw, label in half:
        df[label].update(set(_WORD.findall(raw)))
    common = sorted(df[0], key=lambda w: (-(df[0][w] * (len(w) - 2)), w))
    telling = _telling(df, n)
    shared = _content(common, COMMON_BYTES)
    own = _content(telling, TOXIC_BYTES)
    # the common part ends both at the same place, so its words cost the same in both
    model = Model(b"\0" * len(own) + shared + PAD, own + shared + PAD, 1.0, None)
    if not own:
        return none
    distances = Distances(model)
    data, offsets = tb.texts(pa.array([raw.decode() for raw, _ in rest]))
    row, dist = distances(data, offsets)
    y = np.array([label for _, label in rest], float)
    # the window threshold that tells the classes best by their largest distance
    largest = features(row, dist, len(rest), 1.0)[:, 1]
    edges = np.unique(largest)[1:]
    if len(edges):
        balance = [(largest[y == 1] >= e).mean() - (largest[y == 0] >= e).mean() for e in edges]
        model.edge = float(edges[int(np.argmax(balance))])
    model.weights = _logistic(features(row, dist, len(rest), model.edge), y)
    return model


def _telling(df: dict[int, Counter], n: Counter) -> list[bytes]:
    """Word beginnings that toxic texts have far oftener than ordinary ones, most telling first.

    Only those whose log likelihood ratio chance would hardly reach among as many candidates (at a
    level of ``CHANCE``): rare words that happen to stand in toxic texts only are
    matched by ordinary texts as well. Of beginnings that go on alike (nine in ten times) the
    longest is taken, and none that only lengthens another one taken.
    """
    begins = {0: Counter(), 1: Counter()}
    for label, words in df.items():
        for w, k in words.items():
            for m in range(4, min(len(w), 16) + 1):
                begins[label][w[:m]] += k  # with the space before it, a match
    candidates = [(w, k, begins[0][w]) for w, k in begins[1].items() if k >= MIN_DOCS]
    share, need = n[1] / (n[0] + n[1]), np.log(max(len(candidates), 1) / CHANCE)
    worth = {}
    for w, k, other in candidates:
        ratio = ((k + 0.5) / n[1]) / ((other + 0.5) / n[0])
        likelihood = k * np.log(k / ((k + other) * share)) + (other * np.log(other / ((k + other) * (1 - share))) if other else 0)
        if ratio >= MIN_RATIO and likelihood >= need:
            worth[w] = k * np.log(ratio)
    taken: list[bytes] = []
    for w in sorted(worth, key=lambda w: (-worth[w], len(w), w)):
        if any(w.startswith(t) or t.startswith(w) for t in taken):
            continue
        longer = [x for x in begins[1] if x.startswith(w) and begins[1][x] >= 0.9 * begins[1][w]]
        taken.append(max(longer, key=len))
        if len(taken) >= MAX_PIECES:
            break
    return taken


def _content(words: list[bytes], size: int) -> bytes:
    """The first words that fit, the first of all at the end (nearest)."""
    out, used = [], 0
    for w in words:
        if used + len(w) + 1 > size:
            break
        out.append(b" " + w)
        used += len(w) + 1
    return b"".join(reversed(out))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps of a lightly ridged logistic fit; the rarer class weighs more, by ``EVEN``."""
    w = np.zeros(x.shape[1])
    rate = np.where(y == 1, y.mean(), 1 - y.mean())
    c = EVEN / (2 * rate) + 1 - EVEN
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - y)) + ridge * w
        h = (x * (c * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def hash_bytes(word: bytes) -> int:
    """A number that mixes a word's bytes (the same in every process)."""
    import zlib

    return (zlib.crc32(word) * 0x9E3779B1) & 0xFFFFFFFF


def sample(docs: DataFrame, labels: DataFrame, learn, most: int = TRAIN_DOCS) -> list[tuple[str, int]]:
    """At most ``2 * most`` labelled texts of each class."""
    marks = pick(labels, [("doc_id", "long"), ("toxic", "int")]).where(learn & F.col("toxic").isin(0, 1))
    counts = dict(marks.groupBy("toxic").count().collect())
    u = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, most / max(counts.get(1, 1), 1)))).otherwise(F.lit(min(1.0, most / max(counts.get(0, 1), 1))))
    chosen = marks.where(u < share).limit(4 * most)
    rows = documents(docs).join(chosen, "doc_id").select(F.substring(F.coalesce("text", F.lit("")), 1, TRAIN_CHARS).alias("text"), "toxic")
    return [(r.text, r.toxic) for r in rows.limit(4 * most).collect()]


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labels outside the held-out fold."""
    return train(sample(docs, labels, crc_mod("doc_id", FOLDS) != HELD))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, largest, above`` of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(model) if model.weights is not None else None
        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            x = np.zeros((batch.num_rows, 5))
            s = np.zeros(batch.num_rows)
            for i, j in tb.blocks(offsets, 1 << 20) if distances else ():
                row, dist = distances(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                x[i:j] = features(row, dist, j - i, model.edge)
                s[i:j] = 1 / (1 + np.exp(-np.clip(x[i:j] @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(s), "largest": pa.array(x[:, 1]), "above": pa.array(np.expm1(x[:, 2]).round().astype(np.int64))})

    return documents(docs).mapInArrow(run, "doc_id long, score double, largest double, above long")
