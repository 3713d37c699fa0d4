"""Operator 2: language ID by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time, on the
driver, from a bounded sample: at most ``TRAIN_DOCS`` labelled documents,
the same number of each language in expectation, ``TRAIN_BYTES`` bytes of each.
It then labels every byte of every text: a text is cut into
windows of ``WINDOW`` bytes, both directions run through each window, and each
position gets a probability for each language. A document's probabilities are
the means over its letter bytes (ASCII letters and bytes of longer characters);
``lang_pred`` is the likeliest language and ``score`` its probability.

Gates use x / (1 + |x|) for the sigmoid's and the tangent's shape.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is
every text when no labelled row is left to learn from; ties go to the language first
by code point; repeated rows are predicted alike; labels that are null are not learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm import textbytes as tb
from wardstat.llm.tables import crc_mod, pick

HIDDEN = 8
WINDOW = 64
LANES = 2048
TRAIN_DOCS = 6000
TRAIN_BYTES = 256
EPOCHS = 8
MIN_STEPS = 240
FOLDS, HELD = 4, 2
SEED = 20240607

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    """``x``: 2 x 3H x 256 input table, ``u``: 2 x 3H x H, ``out``: L x (2H + 1)."""

    langs: list[str]
    x: np.ndarray
    u: np.ndarray
    out: np.ndarray


def _squash(a: np.ndarray) -> np.ndarray:
    return a / (np.abs(a) + 1)


def _pass(x: np.ndarray, u: np.ndarray, seq: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states T x H x B of one direction over byte rows ``seq`` (T x B)."""
    h_size = u.shape[1]
    steps, lanes = seq.shape
    states = np.empty((steps, h_size, lanes), np.float32)
    h = np.zeros((h_size, lanes), np.float32)
    a, g, gates = (np.empty((3 * h_size, lanes), np.float32) for _ in range(3))
    zr = gates[: 2 * h_size]
    for t in range(steps):
        np.take(x, seq[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=g)
        np.add(a[: 2 * h_size], g[: 2 * h_size], out=zr)
        np.abs(zr, out=a[: 2 * h_size])
        a[: 2 * h_size] += 2  # softsign of half the sum, then to 0..1
        zr /= a[: 2 * h_size]
        zr *= 0.5
        zr += 0.5
        z, r = gates[:h_size], gates[h_size : 2 * h_size]
        n = gates[2 * h_size :]
        np.multiply(r, g[2 * h_size :], out=n)
        n += a[2 * h_size :]
        np.abs(n, out=a[:h_size])
        a[:h_size] += 1
        n /= a[:h_size]
        if keep is not None:
            keep.append((z.copy(), r.copy(), n.copy(), g[2 * h_size :].copy()))
        new = states[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        h = new
    return states


def _back(u: np.ndarray, seq: np.ndarray, states: np.ndarray, keep: list, d_states: np.ndarray):
    """Gradients of the input table and of ``u``."""
    steps, h_size, lanes = states.shape
    d_u = np.zeros_like(u)
    d_a = np.empty((steps, 3 * h_size, lanes), np.float32)
    dh = np.zeros((h_size, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, n, gn = keep[t]
        h0 = states[t - 1] if t else np.zeros_like(dh)
        dh = dh + d_states[t]
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = dh * (h0 - n) * 0.25 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * gn * 0.25 * (1 - np.abs(2 * r - 1)) ** 2
        d_a[t] = np.concatenate([dz, dr, dn])
        dg = np.concatenate([dz, dr, dn * r])
        d_u += dg @ h0.T
        dh = dh * z + u.T @ dg
    flat = d_a.transpose(1, 0, 2).reshape(3 * h_size, -1)
    where = seq.ravel()
    d_x = np.stack([np.bincount(where, row, 256) for row in flat]).astype(np.float32)
    return d_x, d_u


def _probabilities(out: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """T x L x B position probabilities."""
    h = ahead.shape[1]
    logits = np.matmul(out[:, :h], ahead)
    logits += np.matmul(out[:, h : 2 * h], behind)
    logits += out[:, 2 * h :]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def positions(model: Model, seq: np.ndarray) -> np.ndarray:
    """T x L x B probabilities of every position of byte windows ``seq`` (T x B)."""
    ahead = _pass(model.x[0], model.u[0], seq)
    behind = _pass(model.x[1], model.u[1], seq[::-1])[::-1]
    return _probabilities(model.out, ahead, behind)


def train(pieces: list[tuple[bytes, str]], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit the network to ``(bytes, language)`` pieces."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in pieces})
    index = {lang: k for k, lang in enumerate(langs)}
    windows, labels = [], []
    for raw, lang in sorted(pieces):
        for i in range(0, len(raw), WINDOW):
            windows.append(np.frombuffer(raw[i : i + WINDOW].ljust(WINDOW, b"\0"), np.uint8))
            labels.append(index[lang])
    data, label = np.array(windows).reshape(-1, WINDOW), np.array(labels, np.int64)
    model = Model(
        langs,
        rng.normal(0, 0.5, (2, 3 * hidden, 256)).astype(np.float32),
        rng.normal(0, 0.3, (2, 3 * hidden, hidden)).astype(np.float32),
        rng.normal(0, 0.3, (len(langs), 2 * hidden + 1)).astype(np.float32),
    )
    if len(langs) < 2 or not len(data):
        return model
    share = np.bincount(label, minlength=len(langs)) / len(label)
    weight = (1 / np.maximum(share, 1e-6))[label]
    weight /= weight.mean()
    params = [model.x, model.u, model.out]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    # few windows: smaller batches and more rounds, so that any sample gets MIN_STEPS steps
    batch, step = min(512, max(64, len(data) // 8)), 0
    epochs = max(epochs, -(-MIN_STEPS // -(-len(data) // batch)))
    total = epochs * -(-len(data) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), batch):
            pick_ = order[i : i + batch]
            seq = np.ascontiguousarray(data[pick_].T)
            mask = _LETTER[seq] * weight[pick_].astype(np.float32)
            kept: list[list] = [[], []]
            ahead = _pass(model.x[0], model.u[0], seq, kept[0])
            rev = _pass(model.x[1], model.u[1], seq[::-1], kept[1])
            behind = rev[::-1]
            d = _probabilities(model.out, ahead, behind)
            d[:, label[pick_], np.arange(len(pick_))] -= 1
            d *= (mask / max(mask.sum(), 1))[:, None, :]
            d_out = np.concatenate(
                [np.einsum("tlb,thb->lh", d, ahead, optimize=True), np.einsum("tlb,thb->lh", d, behind, optimize=True), d.sum(axis=(0, 2))[:, None]], 1
            )
            d_ahead = np.matmul(model.out[:, :hidden].T, d)
            d_behind = np.matmul(model.out[:, hidden : 2 * hidden].T, d)
            fx, fu = _back(model.u[0], seq, ahead, kept[0], d_ahead)
            bx, bu = _back(model.u[1], seq[::-1], rev, kept[1], d_behind[::-1])
            step += 1
            rate = 0.02 * (1 - (step - 1) / total) + 0.0005
            for p, g, (m, v) in zip(params, (np.stack([fx, bx]), np.stack([fu, bu]), d_out), moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a letter of any script."""
    ascii_letters = np.append(0, np.cumsum(_LETTER[data] & (data < 128)))
    others = np.append(0, np.cumsum(data >= 128))
    out = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~out & (others[offsets[1:]] > others[offsets[:-1]])):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def pooled(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean position probabilities over the letter bytes of each row (rows x L)."""
    n_rows = len(offsets) - 1
    per_row = -(-np.diff(offsets) // WINDOW)
    row = np.repeat(np.arange(n_rows), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = offsets[row] + nth * WINDOW
    size = np.minimum(offsets[row + 1] - start, WINDOW)
    sums = np.zeros((n_rows, len(model.langs)))
    counts = np.zeros(n_rows)
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    for i in range(0, len(row), LANES):
        at = slice(i, i + LANES)
        seq = padded[start[at] + np.arange(WINDOW)[:, None]]
        letters = _LETTER[seq] & (np.arange(WINDOW)[:, None] < size[at])
        seq[np.arange(WINDOW)[:, None] >= size[at]] = 0
        p = positions(model, seq)
        p *= letters[:, None, :]
        by_lane = p.sum(axis=0)
        for k in range(len(model.langs)):
            sums[:, k] += np.bincount(row[at], by_lane[k], n_rows)
        counts += np.bincount(row[at], letters.sum(axis=0), n_rows)
    return sums / np.maximum(counts, 1)[:, None]


def sample(docs: DataFrame, learn, most: int = TRAIN_DOCS) -> list[tuple[bytes, str]]:
    """At most ``2 * most`` pieces, about ``most`` in expectation, spread evenly over the languages."""
    rows = pick(docs, [("doc_id", "long"), ("text", "string"), ("lang", "string")]).where(learn & F.col("lang").isNotNull())
    counts = dict(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect())
    if not counts:
        return []
    each = most / len(counts)
    shares = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, each / n))) for k, n in counts.items()], F.lit(0.0))
    u = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    length = F.length("text")
    at = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.greatest(length - TRAIN_BYTES, F.lit(1))) + 1
    chosen = rows.where((length > 0) & (u < shares)).limit(2 * most)
    got = chosen.select(F.substring("text", at.cast("int"), F.lit(TRAIN_BYTES)).alias("piece"), "lang").collect()
    return [(r.piece.encode()[:TRAIN_BYTES], r.lang) for r in got]


def identify(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns of each row with ``lang_pred`` and ``score``; ``text`` is read."""
    carry = ["doc_id"] if carry is None else carry
    at = carry.index("text") if "text" in carry else len(carry)
    langs = np.array([*model.langs, "und"], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.texts(batch.column(at).cast(pa.string()))
            best, score = np.full(batch.num_rows, len(langs) - 1), np.zeros(batch.num_rows)
            for i, j in tb.blocks(offsets):
                own, part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if not len(own) or not model.langs:
                    continue
                p = pooled(model, own, part)
                ok = has_letter(own, part)
                best[i:j] = np.where(ok, p.argmax(axis=1), len(langs) - 1)
                score[i:j] = np.where(ok, np.clip(p.max(axis=1), 0, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(carry)], pa.array(langs[best], pa.string()), pa.array(score)], [*[f"c{k}" for k in range(len(carry))], "p", "s"]
            )
        pa.default_memory_pool().release_unused()  # the worker lives on

    from pyspark.sql.types import StructType

    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carry)], *([] if at < len(carry) else [F.col("text").cast("string").alias("t")]))
    schema = StructType(rows.schema.fields[: len(carry)]).add("p", "string").add("s", "double")
    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carry)], F.col("p").alias("lang_pred"), F.col("s").alias("score"))


def learned(docs: DataFrame) -> Model:
    """A model of the rows outside the held-out fold."""
    return train(sample(docs, crc_mod("doc_id", FOLDS) != HELD))
