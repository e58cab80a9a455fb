"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads stretches of ``STRETCH`` bytes from both ends, each with the bytes around
it as a run-up, gives a distribution over the languages at every byte, and a document's
probabilities are the mean over all its bytes.  It is trained in NumPy by backpropagation through time, on a bounded sample
of labelled documents; all documents, and all of each, are then labelled.  Of the learning documents, too, every
stretch may be drawn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from denspark.llm.words import chunks, text_buffer

#: Bytes that the network sees together; documents are cut into as many stretches as they need.
STRETCH = 64
#: Bytes before and after a stretch that bring the two states up to it.
RUN_UP = 16
HIDDEN = 8
#: Stretches that go through the network at a time.
LANES = 8192
#: The sample to learn from: documents of each language.
SAMPLE_DOCUMENTS = 500
STEPS = 220
BATCH = 128
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """``inputs[d]`` 256 x 3H, ``states[d]`` H x 3H for both directions, ``out`` 2H x K, ``bias`` K; gates in the order update, reset, new."""

    def __init__(self, labels: list[str], seed: int = 7):
        random = np.random.default_rng(seed)
        self.labels, h, k = labels, HIDDEN, max(len(labels), 1)
        self.weights = [random.normal(0, 0.3, (256, 3 * h)), random.normal(0, 0.3, (256, 3 * h)), random.normal(0, 0.3, (h, 3 * h)), random.normal(0, 0.3, (h, 3 * h)), random.normal(0, 0.3, (2 * h, k)), np.zeros(k)]
        self.weights = [x.astype(np.float32) for x in self.weights]

    # -- learning ---------------------------------------------------------------------

    def _run(self, direction: int, x: np.ndarray):
        """All states of one direction over x (time, lanes), and what the way back needs."""
        w, u, h = self.weights[direction], self.weights[2 + direction], HIDDEN
        state = np.zeros((x.shape[1], h), u.dtype)
        kept, states = [], np.empty((*x.shape, h), u.dtype)
        for t in range(x.shape[0]) if direction == 0 else range(x.shape[0] - 1, -1, -1):
            given, past = w[x[t]], state @ u
            gates = _sigmoid(given[:, : 2 * h] + past[:, : 2 * h])
            z, r, m = gates[:, :h], gates[:, h:], past[:, 2 * h :]
            new = np.tanh(given[:, 2 * h :] + r * m)
            kept.append((t, state, z, r, m, new))
            state = new + z * (state - new)
            states[t] = state
        return states, kept

    def _back(self, direction: int, x: np.ndarray, kept, d_states: np.ndarray):
        u, h = self.weights[2 + direction], HIDDEN
        d_u, d_given = np.zeros_like(u), np.empty((*x.shape, 3 * h), u.dtype)
        ahead = np.zeros((x.shape[1], h), u.dtype)
        for t, state, z, r, m, new in reversed(kept):
            d = d_states[t] + ahead
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (state - new) * z * (1 - z)
            d_r = d_new * m * r * (1 - r)
            past = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_u += state.T @ past
            ahead = d * z + past @ u.T
            d_given[t, :, : 2 * h], d_given[t, :, 2 * h :] = past[:, : 2 * h], d_new
        flat = x.ravel()
        d_w = np.stack([np.bincount(flat, c, 256) for c in d_given.reshape(-1, 3 * h).T], axis=1)
        return d_w.astype(u.dtype), d_u

    def slopes(self, part: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of all bytes of ``part`` (time, lanes), zero bytes left out, and its derivative by each weight."""
        lanes = part.shape[1]
        (f, kept_f), (b, kept_b) = self._run(0, part), self._run(1, part)
        both = np.concatenate([f, b], axis=2)
        logits = both @ self.weights[4] + self.weights[5]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        real = part != 0
        share = real[:, :, None] / max(1, real.sum())
        loss = float(-(np.log(np.maximum(p[:, np.arange(lanes), labels], 1e-30)) * share[:, :, 0]).sum())
        p[:, np.arange(lanes), labels] -= 1
        p *= share
        d_both = p @ self.weights[4].T
        d_w0, d_u0 = self._back(0, part, kept_f, d_both[:, :, :HIDDEN])
        d_w1, d_u1 = self._back(1, part, kept_b, d_both[:, :, HIDDEN:])
        return loss, [d_w0, d_w1, d_u0, d_u1, both.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, p.shape[2]), p.sum(axis=(0, 1))]

    def learn(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        """Adam on the mean cross-entropy; languages are drawn equally often, in each its documents, in each its stretches."""
        random = np.random.default_rng(seed)
        own = [np.flatnonzero(labels == i) for i in range(len(self.labels))]
        pieces = np.array([max(1, -(-len(x) // STRETCH)) for x in texts])
        for step in range(1, steps + 1):
            pick = np.array([random.choice(own[i]) for i in random.integers(0, len(own), BATCH)])
            begin = random.integers(0, pieces[pick]) * STRETCH
            cuts = [texts[i][a : a + STRETCH].ljust(STRETCH, b"\0") for i, a in zip(pick.tolist(), begin.tolist(), strict=True)]
            part = np.frombuffer(b"".join(cuts), np.uint8).reshape(BATCH, STRETCH).T.copy()
            upper = random.random(BATCH) < 0.15
            part[:, upper] = np.where((part[:, upper] >= 97) & (part[:, upper] <= 122), part[:, upper] - 32, part[:, upper])
            _, slopes = self.slopes(part, labels[pick])
            rate = 0.03 * min(1.0, 2 * (1 - (step - 1) / steps))
            if step == 1:
                first, second = ([np.zeros_like(w) for w in self.weights] for _ in range(2))
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                self.weights[i] = self.weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
        self.weights = [w.astype(np.float32) for w in self.weights]

    # -- labelling --------------------------------------------------------------------

    def prepare(self) -> None:
        """Weights with lanes last, and with the sigmoid's halves worked in."""
        half = np.concatenate([np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)[:, None]
        self._given = [np.ascontiguousarray(self.weights[d].T * half) for d in (0, 1)]
        self._past = [np.ascontiguousarray(self.weights[2 + d].T * half) for d in (0, 1)]
        self._read = [np.ascontiguousarray(self.weights[4].T[:, :HIDDEN]), np.ascontiguousarray(self.weights[4].T[:, HIDDEN:])]

    def positions(self, x: np.ndarray, wanted: slice = slice(None)) -> np.ndarray:
        """Probabilities (time, label, lane) for the wanted ones of the bytes x (time, lane); a zero byte leaves the states at rest."""
        time, lanes, h = *x.shape, HIDDEN
        begin, end, _ = wanted.indices(time)
        out = np.empty((end - begin, len(self.labels), lanes), np.float32)
        out[:] = self.weights[5][None, :, None]
        past, given, gap = np.empty((3 * h, lanes), np.float32), np.empty((3 * h, lanes), np.float32), np.empty((h, lanes), np.float32)
        for d in (0, 1):
            state = np.zeros((h, lanes), np.float32)
            for t in range(end) if d == 0 else range(time - 1, begin - 1, -1):
                np.take(self._given[d], x[t], axis=1, out=given, mode="clip")
                np.matmul(self._past[d], state, out=past)
                gates = past[: 2 * h]
                gates += given[: 2 * h]
                np.tanh(gates, out=gates)
                gates *= 0.5
                gates += 0.5
                new = past[2 * h :]
                new *= gates[h:]
                new += given[2 * h :]
                np.tanh(new, out=new)
                np.subtract(state, new, out=gap)
                gap *= gates[:h]
                np.add(new, gap, out=state)
                if (bare := (x[t] == 0)).any():
                    state[:, bare] = 0
                if begin <= t < end:
                    out[t - begin] += self._read[d] @ state
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities (document, label), and the share of bytes labelled so."""
        sizes = np.diff(offsets)
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        real = np.minimum(offsets[owner + 1] - start, STRETCH)
        padded = np.concatenate([np.zeros(RUN_UP, np.uint8), data, np.zeros(STRETCH + RUN_UP, np.uint8)])
        total, votes = (np.zeros((len(sizes), len(self.labels))) for _ in range(2))
        steps = np.arange(-RUN_UP, STRETCH + RUN_UP)[:, None]
        for a in range(0, len(owner), LANES):
            own, at, n = owner[a : a + LANES], start[a : a + LANES], real[a : a + LANES]
            known = (at[None, :] + steps >= offsets[own]) & (at[None, :] + steps < offsets[own + 1])  # of the same document
            p = self.positions(np.where(known, padded[at[None, :] + steps + RUN_UP], 0), slice(RUN_UP, RUN_UP + STRETCH))
            inside = (steps < n)[RUN_UP : RUN_UP + STRETCH]
            p *= inside[:, None, :]
            best = p.argmax(axis=1)
            for k in range(len(self.labels)):
                total[:, k] += np.bincount(own, p[:, k].sum(axis=0, dtype=np.float64), len(sizes))
                votes[:, k] += np.bincount(own, ((best == k) & inside).sum(axis=0), len(sizes))
        length = np.maximum(sizes, 1)[:, None]
        return total / length, votes / length


def train(docs: DataFrame, learn_from: Column, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> Network | None:
    """Learn from about ``SAMPLE_DOCUMENTS`` whole documents of each label, chosen by a hash of id and text; of copies one."""
    text = F.col(f"`{text_col}`").cast("string")
    known = docs.where(learn_from & F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{label_col}`").cast("string").alias("label"), F.xxhash64(F.col(f"`{id_col}`"), text, F.lit("sample")).alias("lot"), text.alias("text"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    chance = F.create_map(*[x for k in sorted(counts) for x in (F.lit(k), F.lit(min(1.0, SAMPLE_DOCUMENTS / counts[k])))])
    draw = F.shiftrightunsigned("lot", 11).cast("double") / F.lit(float(1 << 53))
    picked = known.where((draw < chance[F.col("label")]) & F.col("text").rlike("\\p{L}")).dropDuplicates(["label", "lot"]).select("label", "text")
    rows = sorted((r["label"], r["text"].encode("utf-8", "surrogatepass")) for r in picked.collect())
    labels = sorted({label for label, _ in rows})
    if not labels:
        return None
    network = Network(labels)
    number = {label: i for i, label in enumerate(labels)}
    network.learn([text for _, text in rows], np.array([number[label] for label, _ in rows]))
    return network


def _labelled(network: Network | None, with_text: bool):
    def apply(batches):
        if network is not None:
            network.prepare()
        for batch in chunks(batches, size=1 << 20):
            n, letter = batch.num_rows, batch.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            label, score, share = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
            if network is not None:
                p, votes = network.documents(*text_buffer(batch.column("text")))
                best = p.argmax(axis=1)
                label[letter] = np.array(network.labels, object)[best[letter]]
                score[letter], share[letter] = p.max(axis=1)[letter], votes[np.arange(n), best][letter]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("held_out"), pa.array(label.tolist(), pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(np.clip(share, 0, 1)), *[batch.column("text")] * with_text],
                ["row", "held_out", "lang_pred", "score", "share", *["text"] * with_text],
            )

    return apply


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", with_text: bool = False) -> DataFrame:
    """Predict the language of every document.

    Learns from documents with a label whose ``crc32(id) % folds`` is not ``held_out``.
    Returns ``row`` (the columns of ``docs`` but for the text), ``held_out``, ``lang_pred``,
    ``score`` (mean probability of that language over all bytes) and ``share`` (of the bytes
    that are labelled with it), and the ``text`` if asked for.

    * null text, or one without a letter: ``und``, score 0;
    * null id: never learned from, counted as held out;
    * no labelled document at all: every prediction is ``und``, score 0;
    * ties: the first label in alphabetical order;
    * very long texts: every byte, a part of them at a time;
    * other columns keep their names inside ``row``, so none can clash;
    * repeated rows are labelled alike; an empty table gives an empty table.
    """
    fold = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds
    network = train(docs, F.coalesce(fold != held_out, F.lit(False)), text_col, label_col, id_col)
    text = F.col(f"`{text_col}`").cast("string")
    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        F.coalesce(fold == held_out, F.lit(True)).alias("held_out"),
        F.coalesce(text.rlike("\\p{L}"), F.lit(False)).alias("letter"),
        text.alias("text"),
    )
    out = StructType().add("row", given.schema["row"].dataType).add("held_out", BooleanType()).add("lang_pred", StringType()).add("score", DoubleType()).add("share", DoubleType())
    return given.mapInArrow(_labelled(network, with_text), out.add("text", StringType()) if with_text else out)
