"""Operator 3: licence scans by a trained paragraph classifier.

A paragraph is a line of a text. Its features are hashed words and word pairs; a
multinomial logistic regression (classes: the licence families, ``unknown``
for licence talk of no family, and ordinary text) is trained in numpy on the driver from
the templates in ``licence_texts``, altered at random (cut, words changed,
words of ordinary text added), and from a bounded sample of the corpus's own
paragraphs (``NEGATIVES`` in expectation) as ordinary text. Of the altered ones and the
sample a part is held out, on which two thresholds are calibrated: the least probability of
being licence talk, which at most ``FALSE_SHARE`` of ordinary paragraphs reach and (up to 0.95)
all but ``LOST_SHARE`` of the licence paragraphs do, and the
least probability of a family at which ``PRECISION`` of its claims are right.

Of the ``LIKELY`` likeliest families the one with the nearest template is taken,
and confirmed when that shares ``CONFIRM`` of the word triples of the shorter of the two; what is not confirmed, or under the
second threshold, is ``unknown`` if ``TALK_PAIRS`` of its word pairs are those of
licence texts, and nothing otherwise.

A notice within a longer line is found by ``WINDOWS``: overlapping runs of words, each classified
like a paragraph, of lines that nothing was found in and of all that are longer than the longest template.
A window of licence talk counts for the families of whose template it holds ``CONFIRM`` of the word triples (a triple
counts for one family), else for ``unknown`` by its word pairs; what is reported is the paragraph, once for each family.

Defined cases: null, empty and blank texts have no paragraphs; repeated rows are scanned
alike; an empty corpus trains on templates alone; a text of one very long line is one paragraph.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm import textbytes as tb
from wardstat.llm.licence_texts import TEMPLATES, UNKNOWN
from wardstat.llm.tables import documents

BITS = 14
NEGATIVES = 6000
VARIANTS = 40
CONFIRM = 0.6
LIKELY = 3
TALK_PAIRS = 0.3
PRECISION = 0.98
FALSE_SHARE = 0.002
LOST_SHARE = 0.02
EPOCHS = 150
SEED = 20240607
PIECE_CHARS = 2000
#: words and steps; the words less the step are the longest notice that surely lies within one window
WINDOWS = ((8, 2), (12, 3), (18, 4), (27, 6), (40, 8), (64, 12))
WINDOW_WORDS = 1 << 16

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Model:
    """Class names (ordinary last), weights (features x classes), bias, and the two thresholds."""

    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    talk: float
    sure: float


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, start, end`` of the non-empty lines of each row."""
    cut = data == 10
    begins = ~cut
    begins[1:] &= cut[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = ~cut[first]
    ends = ~cut
    ends[:-1] &= cut[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = ~cut[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return np.searchsorted(offsets, start, "right") - 1, start, end


def word_prints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of each paragraph, and the paragraph of each."""
    word = _WORD[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    begins[start] = word[start]
    ends[end - 1] = word[end - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    owner = np.searchsorted(start, a, "right") - 1
    return tb.fingerprints(tb.running(_FOLD[data]), a, b) if len(a) else np.empty(0, np.uint64), owner


def logits(model_weights: np.ndarray, bias: np.ndarray, prints: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Class scores of n paragraphs."""
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else owner
    features, owners = _features(prints, pair), np.concatenate([owner, owner[pair]])
    counts = np.bincount(owners, minlength=n)
    out = np.empty((n, len(bias)), np.float32)
    one, two = features[: len(prints)], features[len(prints) :]
    out[:] = 0
    for some, own in ((one, owner), (two, owner[pair])):
        if len(some):
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            out[own[edge]] += np.add.reduceat(model_weights[some], edge, axis=0)
    return out / np.sqrt(np.maximum(counts, 1))[:, None] + bias


def _features(prints: np.ndarray, pair: np.ndarray) -> np.ndarray:
    two = tb.mix64(prints[pair] * _ONE + prints[pair + 1] * _TWO) if len(pair) else np.empty(0, np.uint64)
    return (np.concatenate([prints, two]) >> np.uint64(64 - BITS)).astype(np.int64)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _prints(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tb.texts(pa.array([line.replace("\n", " ") + "\n" for line in lines], pa.string()))
    return word_prints(data, offsets[:-1], offsets[1:])


def triples(line: str) -> frozenset[int]:
    """Fingerprints of a line's word triples (of all its words, if fewer)."""
    prints, _ = _prints([line])
    if len(prints) < 3:
        return frozenset(tb.mix64(np.array([prints.sum()], np.uint64)).tolist()) if len(prints) else frozenset()
    return frozenset(tb.mix64(prints[:-2] * _ONE + prints[1:-1] * _TWO + prints[2:]).tolist())


_TEMPLATE_TRIPLES: dict[str, list[frozenset[int]]] = {}


def template_share(own: frozenset[int], family: str) -> float:
    """The largest share of word triples, of the shorter text's, in common with a template of the family."""
    if not _TEMPLATE_TRIPLES:
        _TEMPLATE_TRIPLES.update({f: [triples(t) for t in ts] for f, ts in (*TEMPLATES.items(), ("unknown", UNKNOWN))})
    return max((len(own & t) / max(min(len(own), len(t)), 1) for t in _TEMPLATE_TRIPLES.get(family, ())), default=0.0)


def confirmed(line: str, family: str, least: float = CONFIRM) -> bool:
    """Whether a template of the family shares enough word triples with the line."""
    return template_share(triples(line), family) >= least


def confirm(line: str, names: list[str], p: np.ndarray, sure: float) -> int | None:
    """Of the likeliest families that are ``sure`` together, the one whose templates are nearest, if near enough."""
    likely = np.argsort(-p[:-2], kind="stable")[:LIKELY]
    if p[likely].sum() < sure:
        return None
    own = triples(line)
    best = max(likely.tolist(), key=lambda k: (template_share(own, names[k]), p[k]))
    return best if template_share(own, names[best]) >= CONFIRM else None


_PAIRS: set[int] = set()


def licence_talk(line: str, least: float = TALK_PAIRS) -> bool:
    """Whether enough of the line's word pairs are those of licence texts of any kind."""
    return licence_pairs(_pairs(line), least)


def licence_pairs(own: list[int], least: float = TALK_PAIRS) -> bool:
    if not _PAIRS:
        for text in (*UNKNOWN, *(t for ts in TEMPLATES.values() for t in ts)):
            _PAIRS.update(_pairs(text))
    return len(own) > 0 and sum(p in _PAIRS for p in own) >= least * len(own)


def _pairs(line: str) -> list[int]:
    prints, _ = _prints([line])
    return tb.mix64(prints[:-1] * _ONE + prints[1:] * _TWO).tolist() if len(prints) > 1 else []


def talk_windows(model: Model, prints: np.ndarray, owner: np.ndarray, look: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """``line, first word, end, probability`` of the windows of licence talk in the lines to ``look`` at."""
    size = np.bincount(owner, minlength=len(look))
    first = np.cumsum(size) - size
    for c in range(0, len(prints), WINDOW_WORDS):
        top = min(c + WINDOW_WORDS, len(prints))
        own = owner[c:top]
        if not look[own].any():
            continue
        some = prints[c : top + WINDOWS[-1][0]]
        features = _features(some, np.arange(len(some) - 1))
        one, two = (np.zeros((len(f) + 1, len(model.bias))) for f in (features[: len(some)], features[len(some) :]))
        np.cumsum(model.weights[features[: len(some)]], axis=0, out=one[1:])
        np.cumsum(model.weights[features[len(some) :]], axis=0, out=two[1:])
        at = np.arange(c, top) - first[own]
        left = size[own] - at
        for words, step in WINDOWS:
            a = np.flatnonzero(look[own] & (size[own] > words) & (left >= words) & ((at % step == 0) | (left == words)))
            z = (one[a + words] - one[a] + two[a + words - 1] - two[a]) / np.sqrt(2 * words - 1) + model.bias
            talk = 1 - _softmax(z)[:, -1]
            for k in np.flatnonzero(talk >= model.talk):
                yield int(own[a[k]]), int(c + a[k]), int(c + a[k] + words), float(talk[k])


def held(windows: list[tuple[int, int, float]], prints: np.ndarray) -> list[tuple[str, float]]:
    """Families, and their probabilities, of one line's windows of licence talk."""
    template_share(frozenset(), "")  # so that the templates' triples are there
    near, talk = [], []
    for a, b, score in windows:
        own = frozenset(tb.mix64(prints[a : b - 2] * _ONE + prints[a + 1 : b - 1] * _TWO + prints[a + 2 : b]).tolist())
        hits = [(len(own & t), score, family, own & t, len(t)) for family, ts in _TEMPLATE_TRIPLES.items() for t in ts if t and len(own & t) >= CONFIRM * len(t)]
        near += hits
        if not hits and licence_pairs(tb.mix64(prints[a : b - 1] * _ONE + prints[a + 1 : b] * _TWO).tolist()):
            talk.append(score)
    used: set[int] = set()
    out: dict[str, float] = {}
    for _, score, family, hit, n in sorted(near, key=lambda x: (-x[0], -x[1], x[2])):
        if family not in out and len(hit - used) >= CONFIRM * n:
            out[family] = score
            used |= hit
    return sorted(out.items()) if out or not talk else [("unknown", max(talk))]


def train(ordinary: list[str], seed: int = SEED) -> Model:
    """Fit and calibrate on the templates and ordinary paragraphs."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    names = [*families, "unknown", "ordinary"]
    clean = sorted({p for p in ordinary if p.strip() and not any(confirmed(p, f, 0.5) for f in (*families, "unknown"))})
    filler = " ".join(clean[:2000]).split() or ["text"]
    lines, label = [], []
    for k, name in enumerate(names[:-1]):
        for text in TEMPLATES.get(name, UNKNOWN):
            words = text.split()
            for v in range(VARIANTS):
                own = list(words)
                if v:
                    keep = int(np.ceil(len(own) * rng.uniform(0.7, 1)))
                    at = int(rng.integers(0, len(own) - keep + 1))
                    own = own[at : at + keep]
                    own = [filler[int(rng.integers(len(filler)))] if len(own) > 6 and rng.random() < 0.05 else w for w in own]
                    if rng.random() < 0.4:
                        some = [filler[int(rng.integers(len(filler)))] for _ in range(int(rng.integers(1, 6)))]
                        own = some + own if rng.random() < 0.5 else own + some
                lines.append(" ".join(own))
                label.append(k)
    lines += clean
    label = np.array(label + [len(names) - 1] * len(clean))
    prints, owner = _prints(lines)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    features, owners = _features(prints, pair), np.concatenate([owner, owner[pair]])
    scale = 1 / np.sqrt(np.maximum(np.bincount(owners, minlength=len(lines)), 1))
    fit = rng.random(len(lines)) < 0.7
    used = fit[owners]
    rows, cols, value = owners[used], features[used], scale[owners[used]].astype(np.float32)
    k = len(names)
    w, b = np.zeros((1 << BITS, k), np.float32), np.zeros(k, np.float32)
    target = np.eye(k, dtype=np.float32)[label]
    weight = (1 / np.maximum(np.bincount(label[fit], minlength=k), 1))[label] * fit
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    order = np.argsort(cols, kind="stable")
    edge = np.flatnonzero(np.append(True, np.diff(cols[order]) != 0))
    at = cols[order][edge]
    mw, vw = np.zeros((len(at), k), np.float32), np.zeros((len(at), k), np.float32)
    mb, vb = np.zeros(k), np.zeros(k)
    rise = np.argsort(rows, kind="stable")
    begin = np.flatnonzero(np.append(True, np.diff(rows[rise]) != 0))
    who = rows[rise][begin]
    for step in range(1, EPOCHS + 1):
        z = np.tile(b, (len(lines), 1))
        z[who] += np.add.reduceat((w[cols] * value[:, None])[rise], begin, axis=0)
        d = (_softmax(z) - target) * weight
        g = np.add.reduceat((d[rows] * value[:, None])[order], edge, axis=0) + 1e-5 * w[at]
        for p, gr, m, v, i in ((w, g, mw, vw, at), (b, d.sum(axis=0), mb, vb, slice(None))):
            m *= 0.9
            m += 0.1 * gr
            v *= 0.99
            v += 0.01 * gr * gr
            p[i] -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    p = _softmax(logits(w, b, prints, owner, len(lines)))
    held = ~fit if (~fit).any() else fit
    return Model(names, w, b, *_calibrate(p[held], label[held], k))


def _calibrate(p: np.ndarray, label: np.ndarray, k: int) -> tuple[float, float]:
    talk = 1 - p[:, -1]
    ordinary = np.sort(talk[label == k - 1])
    least = float(ordinary[min(int(len(ordinary) * (1 - FALSE_SHARE)), len(ordinary) - 1)]) if len(ordinary) else 0.5
    family = p[:, : k - 2]
    top, best = family.max(axis=1), family.argmax(axis=1)
    right = best == label
    for edge in np.arange(0.3, 0.96, 0.05):
        claims = top >= edge
        if claims.any() and right[claims].mean() >= PRECISION:
            break
    # between what ordinary paragraphs reach and what all but a few licence paragraphs do
    reached = float(np.quantile(talk[label < k - 1], LOST_SHARE)) if (label < k - 1).any() else 1.0
    return max(0.5, least + 1e-6, min(reached, 0.95)), float(edge)


def sample(docs: DataFrame, most: int = NEGATIVES) -> list[str]:
    """A paragraph each of about ``most`` documents (twice that at most), chosen by a hash of id and text."""
    rows = documents(docs).where("text is not null")
    share = min(1.0, most / max(rows.count(), 1))
    lines = rows.select(F.xxhash64("doc_id", "text").alias("h"), F.split("text", "\n").alias("ls"))
    u = F.pmod(F.xxhash64("h", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    pick_ = F.element_at("ls", (F.pmod("h", F.size("ls")) + 1).cast("int"))
    chosen = lines.where(u < share).select(F.substring(pick_, 1, PIECE_CHARS).alias("line")).limit(2 * most)
    return [r.line for r in chosen.collect()]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_paragraphs, found`` with ``found`` an array of
    (paragraph, start, end, family, score): bytes ``[start, end)`` of the text."""
    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("score", pa.float64())]))

    longest = max(len(_prints([t])[0]) for ts in (UNKNOWN, *TEMPLATES.values()) for t in ts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            counts, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for i, j in tb.blocks(offsets, 1 << 20):
                own, part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if not len(own):
                    continue
                row, start, end = paragraphs(own, part)
                counts[i:j] = np.bincount(row, minlength=j - i)
                if not len(row):
                    continue
                prints, owner = word_prints(own, start, end)
                p = _softmax(logits(model.weights, model.bias, prints, owner, len(row)))
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                said: dict[int, dict[str, float]] = {}
                for k in np.flatnonzero(1 - p[:, -1] >= model.talk):
                    line = own[start[k] : end[k]].tobytes().decode()
                    best = confirm(line, model.names, p[k], model.sure)
                    if best is None and not licence_talk(line):
                        continue  # unlike ordinary text, and unlike licences too
                    said[int(k)] = {model.names[best] if best is not None else "unknown": float(1 - p[k, -1])}
                look = np.bincount(owner, minlength=len(row)) > longest
                look |= ~np.isin(np.arange(len(row)), list(said))
                inside: dict[int, list] = {}
                for k, a, b, score in talk_windows(model, prints, owner, look):
                    inside.setdefault(k, []).append((a, b, score))
                for k, some in inside.items():
                    families = dict(held(some, prints))
                    if set(families) - {"unknown"}:
                        said.get(k, {}).pop("unknown", None)
                    if families:
                        said[k] = families | said.get(k, {})
                for k in sorted(said):
                    at = part[row[k]]
                    found[i + row[k]] += [(int(nth[k]), int(start[k] - at), int(end[k] - at), family, score) for family, score in sorted(said[k].items())]
            lists = pa.array([[dict(zip(("paragraph", "start", "end", "family", "score"), f)) for f in fs] for fs in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), lists], ["doc_id", "n_paragraphs", "found"])

    return documents(docs).mapInArrow(
        run, "doc_id long, n_paragraphs long, found array<struct<paragraph:long,start:long,end:long,family:string,score:double>>"
    )
