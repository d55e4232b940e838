"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word is lower-cased and stripped of all but letters and digits. Its input is
a vector of its own, if it is among the commonest of the training sample or
tells on the label there, beside the mean of the vectors of its character
trigrams. The network reads
windows of 32 words that overlap by eight; attention pools the states of a
window, and a logistic unit scores it. A second one scores the document from its
three worst windows and the mean of all: a word that is toxic in company may
stand alone in a clean text.

Training is done in numpy, by one task, on a bounded sample of labelled rows:
``SAMPLE`` of them by hash of the id, as long as they have ``SAMPLE_CHARS``
characters together; no text is too long by itself, but a document teaches by
``TAUGHT`` windows at most, drawn from its whole text, so that no long one
outweighs the others. Of rows that repeat an id and label the one of least text
hash teaches. Labels belong to
documents, not windows: after a first pass in which every window bears its
document's label, a toxic document teaches by its worst windows only.

Scoring covers every window of every whole text, chunk by chunk; distinct words
of a chunk are put through the input layer once.

Cases: a null or empty text, or one without words, scores 0; a null id is not
held out; repeated rows get
the same score; labels that are null are ignored; without labels of both kinds
every score is 0; other columns are ignored, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.llm.words import chunks, mix, ragged, release, split_words

SAMPLE = 4000
SAMPLE_CHARS = 16_000_000
TAUGHT = 140
MIN_DOCS = 4
COMMON, TELLING = 300, 15.0
THRESHOLD = 0.7
WINDOW, STEP = 32, 24
STATE, WORD_DIM, CHAR_DIM, TRIGRAMS = 8, 8, 8, 4096
_BATCH = 256
DROP, DECAY = 0.25, 0.1


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and length of all overlapping windows."""
    number = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STEP)), 0)
    doc = np.repeat(np.arange(len(counts)), number)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * STEP
    return doc, first, np.minimum(WINDOW, counts[doc] - first)


def sampled_windows(doc: np.ndarray, most: int) -> np.ndarray:
    """Which windows are among the first ``most`` of their document in a random order; ``doc`` ascends."""
    order = np.lexsort((mix(np.arange(len(doc))), doc))
    before = np.searchsorted(doc, doc[order])
    out = np.empty(len(doc), bool)
    out[order] = np.arange(len(doc)) - before < most
    return out


def stems_of(vocabulary: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct stems, and the stem of every word."""
    stems = pc.replace_substring_regex(pc.utf8_lower(vocabulary), r"[^\pL\pN]+", "").dictionary_encode()
    return stems.dictionary, stems.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def trigrams_of(stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of every stem, with an edge at both ends, and how many each has."""
    joined = pc.binary_join_element_wise(pa.scalar("\x02", stems.type), stems, pa.scalar("\x03", stems.type), pa.scalar("", stems.type))
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8).astype(np.uint64)
    count = np.maximum(np.diff(ends) - 2, 0)
    at = ragged(ends[:-1], count)
    code = (data[at] << np.uint64(16)) | (data[at + 1] << np.uint64(8)) | data[at + 2] if len(at) else np.zeros(0, np.uint64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64) % TRIGRAMS, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _segment_mean(table: np.ndarray, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(count) + 1, table.shape[1]), table.dtype)
    full = count > 0
    if full.any():
        begin = (np.cumsum(count) - count)[full]
        sums[:-1][full] = np.add.reduceat(table[flat], begin, axis=0)
    return sums[:-1] / np.maximum(count, 1)[:, None]


def _gru(x: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: bool):
    """States of all steps. ``x``: (steps, rows, 3 states) inputs to reset, update and candidate."""
    steps, rows, _ = x.shape
    size = u.shape[0]
    h = np.zeros((rows, size), x.dtype)
    states, trace = np.empty((steps, rows, size), x.dtype), []
    for t in range(steps):
        hu = h @ u
        gates = _sigmoid(x[t, :, : 2 * size] + hu[:, : 2 * size])
        reset, update = gates[:, :size], gates[:, size:]
        new = np.tanh(x[t, :, 2 * size :] + reset * hu[:, 2 * size :])
        out = np.where(mask[t][:, None], (1 - update) * new + update * h, h)
        if keep:
            trace.append((h, hu, reset, update, new))
        h = states[t] = out
    return states, trace


def _gru_back(grad: np.ndarray, u: np.ndarray, mask: np.ndarray, trace: list):
    """Gradients of the inputs and of ``u`` from those of the states."""
    size = u.shape[0]
    dx, du = np.zeros((*grad.shape[:2], 3 * size), grad.dtype), np.zeros_like(u)
    dh = np.zeros(grad.shape[1:], grad.dtype)
    for t in range(len(grad) - 1, -1, -1):
        h, hu, reset, update, new = trace[t]
        total = dh + grad[t]
        live = mask[t][:, None]
        d = np.where(live, total, 0)
        dnew = d * (1 - update) * (1 - new**2)
        dupdate = d * (h - new) * update * (1 - update)
        dreset = dnew * hu[:, 2 * size :] * reset * (1 - reset)
        dx[t] = np.concatenate([dreset, dupdate, dnew], axis=1)
        dhu = np.concatenate([dreset, dupdate, dnew * reset], axis=1)
        du += h.T @ dhu
        dh = np.where(live, d * update + dhu @ u.T, total)
    return dx, du


def document_features(doc: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of the three worst windows of each document, and the mean score of all; worst ones repeat if there are fewer."""
    order = np.lexsort((-scores, doc))
    count = np.bincount(doc, minlength=n)
    begin = np.cumsum(count) - count
    out = np.zeros((n, 4))
    some = count > 0
    odds = np.clip(scores[order].astype(np.float64), 1e-4, 1 - 1e-4)
    odds = np.log(odds / (1 - odds))
    for k in range(3):
        out[some, k] = odds[(begin + np.minimum(k, count - 1))[some]]
    out[some, 3] = 10 * np.bincount(doc, scores, n)[some] / count[some]
    return out


class Network:
    """Parameters and passes of the network; ``words`` are the words with a vector of their own."""

    def __init__(self, words: pa.Array, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.words = words
        normal = lambda *shape, scale: (draw.standard_normal(shape) * scale).astype(np.float32)
        size, inputs = STATE, WORD_DIM + CHAR_DIM
        self.p = {
            "word": np.concatenate([np.zeros((1, WORD_DIM), np.float32), normal(len(words), WORD_DIM, scale=0.1)]),
            "char": normal(TRIGRAMS, CHAR_DIM, scale=0.1),
            "input": normal(inputs, 6 * size, scale=0.5), "bias": np.zeros(6 * size, np.float32),
            "forward": normal(size, 3 * size, scale=0.3), "backward": normal(size, 3 * size, scale=0.3),
            "attend": normal(2 * size, size, scale=0.5), "query": normal(size, scale=0.5),
            "out": normal(2 * size, scale=0.5), "shift": np.full(1, -2.0, np.float32),
        }
        self.m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.turn = 0
        self.document = np.array([1.0, 0, 0, 0, 0])

    def fit_documents(self, features: np.ndarray, labels: np.ndarray) -> None:
        """Weights of the unit that scores documents, by Newton's method with a little shrinkage."""
        x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = _sigmoid(x @ w)
            hessian = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            w += np.linalg.solve(hessian, x.T @ (labels - p) - w)
        self.document = w

    def documents(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(features @ self.document[:-1] + self.document[-1])

    def word_numbers(self, stems: pa.Array) -> np.ndarray:
        """Row of the word table for each stem; 0, which stays zero, for words without one."""
        found = pc.index_in(stems, value_set=self.words.cast(stems.type))
        return pc.fill_null(pc.add(found, 1), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def inputs(self, numbers: np.ndarray, flat: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.concatenate([self.p["word"][numbers], _segment_mean(self.p["char"], flat, count)], axis=1)

    def pool(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Scores of windows from projected inputs (steps, rows, 6 states)."""
        size, p = STATE, self.p
        ahead, trace_a = _gru(x[:, :, : 3 * size], p["forward"], mask, keep)
        back, trace_b = _gru(x[::-1, :, 3 * size :], p["backward"], mask[::-1], keep)
        states = np.concatenate([ahead, back[::-1]], axis=2)
        inner = np.tanh(states @ p["attend"])
        weight = np.where(mask, inner @ p["query"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        score = _sigmoid(pooled @ p["out"] + p["shift"])
        return score, (states, inner, weight, pooled, trace_a, trace_b)

    def scores(self, stems: pa.Array, tokens: np.ndarray, begin: np.ndarray, length: np.ndarray, rows: int = 2048) -> np.ndarray:
        """Scores of windows over ``tokens``, which are numbers of stems."""
        flat, count = trigrams_of(stems)
        projected = self.inputs(self.word_numbers(stems), flat, count) @ self.p["input"] + self.p["bias"]
        out = np.zeros(len(begin), np.float32)
        steps = np.arange(WINDOW)[:, None]
        for a in range(0, len(begin), rows):
            mask = steps < length[a : a + rows]
            at = np.where(mask, begin[a : a + rows] + steps, 0)
            out[a : a + rows] = self.pool(projected[tokens[at]], mask)[0]
        return out

    def learn(self, numbers, flat, count, tokens, begin, length, labels, rate: float, draw) -> None:
        """One step of Adam on a batch of windows; a part of the words is read without its own vector or trigrams."""
        steps = np.arange(WINDOW)[:, None]
        mask = steps < length
        stems, place = np.unique(tokens[np.where(mask, begin + steps, begin)], return_inverse=True)
        place = place.reshape(mask.shape)
        starts = np.cumsum(count) - count
        own_flat, own_count = flat[ragged(starts[stems], count[stems])], count[stems]
        source = self.inputs(numbers[stems], own_flat, own_count)
        drop = np.ones_like(source)
        drop[:, :WORD_DIM] *= (draw.random(len(stems)) >= DROP)[:, None]
        drop[:, WORD_DIM:] *= (draw.random(len(stems)) >= DROP)[:, None]
        source *= drop
        x = (source @ self.p["input"] + self.p["bias"])[place]
        score, (states, inner, weight, pooled, trace_a, trace_b) = self.pool(x, mask, keep=True)
        p, size, grad = self.p, STATE, {}
        d = ((score - labels) / len(labels)).astype(np.float32)
        grad["out"], grad["shift"] = pooled.T @ d, d.sum(keepdims=True)
        dpooled = d[:, None] * p["out"]
        dweight = (states * dpooled).sum(axis=2)
        dlogit = weight * (dweight - (weight * dweight).sum(axis=0))
        dinner = dlogit[:, :, None] * p["query"] * (1 - inner**2)
        grad["query"] = (inner * dlogit[:, :, None]).sum(axis=(0, 1))
        grad["attend"] = np.einsum("tbi,tbj->ij", states, dinner)
        dstates = weight[:, :, None] * dpooled + dinner @ p["attend"].T
        da, grad["forward"] = _gru_back(dstates[:, :, :size], p["forward"], mask, trace_a)
        db, grad["backward"] = _gru_back(dstates[::-1, :, size:], p["backward"], mask[::-1], trace_b)
        dx = np.concatenate([da, db[::-1]], axis=2)
        dproj = np.zeros((len(stems), 6 * size), np.float32)
        order = np.argsort(place, axis=None, kind="stable")
        at = np.flatnonzero(np.diff(place.reshape(-1)[order], prepend=-1))
        dproj[:] = np.add.reduceat(dx.reshape(-1, 6 * size)[order], at, axis=0)
        grad["input"], grad["bias"] = source.T @ dproj, dproj.sum(axis=0)
        dsource = (dproj @ p["input"].T) * drop
        grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(grad["word"], numbers[stems], dsource[:, :WORD_DIM])
        grad["word"][0] = 0
        np.add.at(grad["char"], own_flat, np.repeat(dsource[:, WORD_DIM:] / np.maximum(own_count, 1)[:, None], own_count, axis=0))
        self.turn += 1
        for k, g in grad.items():
            first, second = self.m[k]
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            step = first / (1 - 0.9**self.turn) / (np.sqrt(second / (1 - 0.99**self.turn)) + 1e-8)
            if k in ("word", "char"):
                p[k] *= 1 - rate * DECAY
            p[k] -= rate * step.astype(np.float32)


def own_words(owner: np.ndarray, tokens: np.ndarray, n_stems: int, labels: np.ndarray) -> np.ndarray:
    """Which words get a vector of their own: the commonest, and those that tell on the label.

    A rare word that leans to no label could only learn its documents by heart.
    The measure is the likelihood ratio of the documents with the word.
    """
    pairs = np.unique(owner * np.int64(max(n_stems, 1)) + tokens)
    stem, toxic = pairs % max(n_stems, 1), labels[pairs // max(n_stems, 1)]
    n = np.bincount(stem, minlength=n_stems).astype(float)
    hit = np.bincount(stem, toxic, minlength=n_stems)
    base = labels.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(hit > 0, hit * np.log(hit / (n * base)), 0) + np.where(n > hit, (n - hit) * np.log((n - hit) / (n * (1 - base))), 0))
    common = n >= max(np.sort(n)[-COMMON:].min(initial=np.inf), MIN_DOCS)
    return (n >= MIN_DOCS) & (common | ((ratio >= TELLING) & (hit > n * base)))


def train(texts, labels: np.ndarray, epochs: int = 14, negatives: int = 8000, seed: int = 7) -> Network | None:
    """Fit a network to documents; None without labels of both kinds."""
    labels = np.asarray(labels, np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return None
    words = split_words(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()))
    stems, stem_of = stems_of(words.vocabulary)
    tokens, owner = stem_of[words.ids], words.owner
    net = Network(stems.filter(pa.array(own_words(owner, tokens, len(stems), labels))), seed)
    numbers, (flat, count) = net.word_numbers(stems), trigrams_of(stems)
    doc, first, length = windows_of(words.counts)
    begin = words.starts[doc] + first
    some = sampled_windows(doc, TAUGHT)
    toxic = np.flatnonzero((labels[doc] == 1) & some)
    clean = np.flatnonzero((labels[doc] == 0) & some)
    if not len(toxic) or not len(clean):
        return None
    draw = np.random.default_rng(seed)
    for epoch in range(epochs):
        chosen = toxic
        if epoch >= 3:
            score = net.scores(stems, tokens, begin[toxic], length[toxic])
            worst = np.zeros(len(labels), np.float32)
            np.maximum.at(worst, doc[toxic], score)
            chosen = toxic[(score >= 0.5) & ((score >= 0.9 * worst[doc[toxic]]) | (score >= 0.8))]
        if len(chosen) > negatives // 2:
            chosen = draw.choice(chosen, negatives // 2, replace=False)
        other = draw.choice(clean, min(len(clean), negatives), replace=False)
        both = draw.permutation(np.concatenate([chosen, other]))
        rate = 0.01 if epoch < epochs - 4 else 0.003
        for a in range(0, len(both), _BATCH):
            at = both[a : a + _BATCH]
            target = labels[doc[at]]
            net.learn(numbers, flat, count, tokens, begin[at], length[at], target, rate, draw)
    scores = net.scores(stems, tokens, begin, length)
    some = np.flatnonzero(words.counts > 0)
    net.fit_documents(document_features(doc, scores, len(labels))[some], labels[some])
    del net.m
    return net


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> bytes:
    """A pickled network, trained on the sample of labelled rows that are not held out; of None without labels of both kinds."""
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
        .orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    )
    found = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "id")  # ``sample`` rows at most
        .where(F.col("text").isNotNull())
        .groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    )
    upto = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("id"), "id", "label"))  # over the sample only
    rows = found.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_CHARS).select("id", "label", "text")

    def teach(batches):
        table = pa.Table.from_batches(list(batches), pa.schema([("id", kind), ("label", pa.int32()), ("text", pa.string())]))
        order = sorted(range(len(table)), key=list(zip(table["id"].to_pylist(), table["label"].to_pylist())).__getitem__)
        net = train(table["text"].take(pa.array(order, pa.int64())), table["label"].to_numpy()[order])
        yield pa.RecordBatch.from_pydict({"net": pa.array([cloudpickle.dumps(net)], pa.binary())})
        release()

    kind = to_arrow_type(rows.schema["id"].dataType)
    one = rows.withColumn("label", F.col("label").cast("int")).coalesce(1)
    taught = one.mapInArrow(teach, "net binary").collect()  # no task runs without a labelled row
    return taught[0]["net"] if taught else cloudpickle.dumps(None)


def with_score(docs: DataFrame, net: bytes, name: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score of every row as ``name``; rows stay in their task."""
    model = docs.sparkSession.sparkContext.broadcast(net)  # its size follows from the sample's bound
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index(text_col)
    rest = F.struct(*(f"c{i}" for i in range(len(names)) if i != at)) if len(names) > 1 else F.struct(F.lit(0).alias("none"))
    source = plain.select(rest.alias("row"), F.col(f"c{at}").alias("text"))

    def score(batches):
        net = cloudpickle.loads(model.value)
        for chunk in chunks(batches, "text", 4 << 20):
            words = split_words(chunk["text"])
            out = np.zeros(len(words.counts))
            if net is not None and len(words.ids):
                stems, stem_of = stems_of(words.vocabulary)
                doc, first, length = windows_of(words.counts)
                scores = net.scores(stems, stem_of[words.ids], words.starts[doc] + first, length)
                some = words.counts > 0
                out[some] = net.documents(document_features(doc, scores, len(out)))[some]
            yield pa.RecordBatch.from_arrays(
                [chunk["row"].combine_chunks(), chunk["text"].combine_chunks(), pa.array(out)], ["row", "text", "score"]
            )

    scored = source.mapInArrow(score, T.StructType([*source.schema, T.StructField("score", T.DoubleType())]))
    columns = [F.col("text" if i == at else f"row.c{i}").alias(f"c{i}") for i in range(len(names))]
    return scored.select(*columns, "score").toDF(*names, name)


def score_texts(docs: DataFrame, net: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, _hash (xxhash64 of the text) and score of every row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_score(source, net, "score").select(F.col("id").alias(id_col), F.xxhash64("text").alias("_hash"), "score")


def toxic_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, _hash, held_out, score and predicted of every document."""
    scored = score_texts(docs, fit(docs, labels))
    return scored.select(
        "doc_id", "_hash", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
