"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is encoded from its bytes and
words; gated attention, learnt from document labels alone, weighs the encoded passages; the weighted sum is scored.
The network has a few hundred weights and travels with the scoring function; passages never leave their task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytegrams import Hashes, utf8, words
from .common import slices, texts

PASSAGE = 50
#: Passages of a text that training sees; every passage counts for a score.
TRAINED = 64
_B = np.arange(256)
#: Byte classes whose shares describe a passage.
CLASSES = np.stack([(_B >= 65) & (_B < 91), (_B >= 97) & (_B < 123), (_B >= 48) & (_B < 58), _B == 33, _B == 124, np.isin(_B, list(b".,;:?'\"-")), np.isin(_B, list(b"#$%&*+/<=>@[\\]^_`{}~()")), _B >= 128, _B == 10])
HASHED = 16
WIDTH = len(CLASSES) + 7 + HASHED


def passages(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the passages before each text. A text without words is one passage."""
    s, e, first = words(data, off)
    n = np.diff(first)
    count = np.maximum(1, -(-n // PASSAGE))
    at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    w0 = np.minimum(first[doc] + (np.arange(at[-1]) - at[doc]) * PASSAGE, first[doc + 1])
    w1 = np.minimum(w0 + PASSAGE, first[doc + 1])
    some = w1 > w0
    out = np.zeros((at[-1], WIDTH), np.float32)
    if not some.any():
        return out, at
    a, b = w0[some], w1[some]
    lo, hi = s[a], e[b - 1]
    size, k = (hi - lo).astype(float), (b - a).astype(float)
    span = lambda v, x, y: (c := np.concatenate([[0], np.cumsum(v)]))[y] - c[x]
    cols = [span(member[data], lo, hi) / size for member in CLASSES]
    h = Hashes(data).of(s, e)
    length = (e - s).astype(float)
    same = np.concatenate([[False], h[1:] == h[:-1]])
    word_passage = np.repeat(np.arange(len(a)), b - a)
    order = np.lexsort((h, word_passage))
    ho, po = h[order], word_passage[order]
    fresh = np.concatenate([[True], (ho[1:] != ho[:-1]) | (po[1:] != po[:-1])])
    mean = span(length, a, b) / k
    first_upper = CLASSES[0][data[s]]
    cols += [
        span(same, a + (b > a), b) / k, np.bincount(po, fresh, len(a)) / k, mean / 10, np.sqrt(np.maximum(0, span(length**2, a, b) / k - mean**2)) / 10,
        span(first_upper, a, b) / k, k / PASSAGE, span(length > 20, a, b) / k,
    ]
    # Short words by hash: the little words that running prose is made of.
    bucket = np.where(length <= 3, (h >> np.uint64(20)) % np.uint64(HASHED - 1) + np.uint64(1), 0).astype(np.int64)
    cols += list((np.bincount(word_passage * HASHED + bucket, minlength=len(a) * HASHED).reshape(-1, HASHED) / k[:, None]).T)
    out[some] = np.stack(cols, axis=1)
    return out, at


class AttentionNetwork:
    """tanh encoder, gated attention over the passages of a document, logistic output."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        shapes = {"W": (WIDTH, hidden), "b": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "w": (gate,), "c": (hidden,), "d": (1,)}
        self.p = {k: r.normal(0, 0.3 if len(v) > 1 or k in "wc" else 0.0, v) for k, v in shapes.items()}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, at: np.ndarray) -> dict:
        p, doc = self.p, np.repeat(np.arange(len(at) - 1), np.diff(at))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        e = np.exp(s - np.maximum.reduceat(s, at[:-1])[doc])
        a = e / np.add.reduceat(e, at[:-1])[doc]
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        y = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "doc": doc}

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.forward(x, at)["y"]

    def gradients(self, f: dict, at: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict:
        p, doc = self.p, f["doc"]
        dy = (f["y"] - target) * weight / weight.sum()
        dz = dy[:, None] * p["c"]
        dh = f["a"][:, None] * dz[doc]
        da = (f["h"] * dz[doc]).sum(axis=1)
        ds = f["a"] * (da - np.add.reduceat(f["a"] * da, at[:-1])[doc])
        dt = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh += dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - f["h"] ** 2)
        return {"c": f["z"].T @ dy, "d": np.array([dy.sum()]), "w": (f["t"] * f["g"]).T @ ds, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "W": f["x"].T @ du, "b": du.sum(axis=0)}

    def fit(self, x: np.ndarray, at: np.ndarray, target: np.ndarray, rounds: int = 12, batch: int = 256, rate: float = 0.01, seed: int = 11) -> AttentionNetwork:
        """Adam on the log loss, for ``rounds`` over the sample and 400 steps at least. Both labels weigh the square root
        of their odds, so a rare label is not drowned."""
        rounds = max(rounds, -(-400 // -(-len(target) // batch)))
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        r, n = np.random.default_rng(seed), len(target)
        share = np.clip(np.array([np.mean(target == 0), np.mean(target == 1)]), 1e-3, 1)
        weights = (1 / np.sqrt(share))[target.astype(int)]
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for turn in range(rounds):
            order = r.permutation(n)
            for lo in range(0, n, batch):
                pick = np.sort(order[lo : lo + batch])
                size = np.diff(at)[pick]
                own = np.concatenate([[0], np.cumsum(size)])
                rows = np.arange(own[-1]) + np.repeat(at[pick] - own[:-1], size)
                grads = self.gradients(self.forward(x[rows], own), own, target[pick], weights[pick])
                step += 1
                for k, g in grads.items():
                    g = g + 1e-4 * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (0.3 if turn > rounds * 2 // 3 else 1) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def labelled_passages(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, offsets and labels of at most ``sample`` labelled documents outside the held-out fifth, chosen by the
    hash of their ids: one row of each, and at most ``TRAINED`` passages, evenly spaced, of a text."""
    pick = labels.select("doc_id", F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out())
    pick = pick.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, at = passages(*utf8(b.column("text")))
            rows = [x[np.unique(np.linspace(lo, hi - 1, min(hi - lo, TRAINED)).astype(int))].tobytes() for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "x"])

    found = texts(docs).join(F.broadcast(pick), "doc_id").mapInArrow(run, "doc_id long, label int, x binary")
    rows = found.groupBy("doc_id", "label").agg(F.min("x").alias("x")).collect()  # ``sample`` rows of ``TRAINED`` passages at most
    rows = sorted(rows, key=lambda r: (r.doc_id, bytes(r.x)))
    x = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in rows]
    at = np.concatenate([[0], np.cumsum([len(i) for i in x])]).astype(int)
    return np.concatenate(x) if x else np.zeros((0, WIDTH), np.float32), at, np.array([r.label for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> AttentionNetwork | None:
    """A network trained on at most ``sample`` labelled documents, or None where they do not show both labels."""
    x, at, target = labelled_passages(docs, labels, sample)
    return AttentionNetwork().fit(x, at, target) if len(set(target)) == 2 else None


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row and whole text.

    A null, empty or blank text is one passage without words and is scored like any other. Where the labels do not
    show both classes every score is 1. A null doc_id is scored and not held out. Repeated rows are scored alike. An
    empty table gives no rows. Labels, lang, source, doc_id and any other columns are no inputs of a score.
    """
    net = train(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = net.score(*passages(*utf8(b.column("text")))) if net else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``threshold`` at least (see ``quality_scores``)."""
    net = train(docs, labels, sample)
    if net is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(net.score(*passages(*utf8(b.column("text")))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
