"""Masked pseudo-likelihood of documents under a bidirectional window network (operator 8).

Every word of a text is predicted from the SIDE words before and the SIDE words after it; the sum of the log-probabilities of
all its words is a text's score. The network adds up one vector for each place of the window, cuts off below zero (HIDDEN
units) and predicts the word in two steps, its class and then itself among the class's words. Classes are WIDTH words of
neighbouring frequency; the last class holds WIDTH hash buckets for all words outside the vocabulary, and what such a word
costs inside its bucket is a spelling model's: bytes that follow bytes.

All documents are gathered from. Word and byte-pair counts of the whole corpus choose the vocabulary and set the biases, so
that training begins at the corpus's own word frequencies. Then, in each of ROUNDS rounds, every task trains a copy of the
network on its documents with Adagrad, predicting the positions whose turn it is (each position has one round); what its rows
have moved by, weighted with its positions, is shuffled by row, added up in whole numbers (so that the order doesn't show)
and averaged. Shuffled data grows with the input; what reaches the driver is one network, whose size is fixed.

Words are runs of characters other than ASCII white space, with A-Z in lower case. Texts are read whole. A null text counts
as empty; a text without words has n_words 0, log_prob 0.0 and a null mean_log_prob. Repeated rows each get their score, rows
with a null key too. An empty table gives no rows. How the input is split among tasks has a slight influence on the network.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.shingles import mix, word_hashes
from quillmill.runtime import materialize, prepare, release

SIDE, HIDDEN, WIDTH, ROUNDS, STEP, RATE = 2, 32, 64, 2, 4096, 0.12
WORDS = WIDTH * WIDTH
EDGE = WORDS  # stands before and after a text
_NAMED, _TEXTS, _HELD, _SLICE = WORDS - WIDTH, 4_000_000, 1_000_000, 1 << 15
_UNIT = 1 << 24  # float16 has no finer steps
#: Rows of HIDDEN numbers: window vectors by place and word, hidden bias, class and word vectors, class and word biases.
_PLACES = [i for i in range(-SIDE, SIDE + 1) if i]
_INPUT = len(_PLACES) * (WORDS + 1)
_CUTS = np.cumsum([0, _INPUT, 1, WIDTH, WORDS, WIDTH // HIDDEN, WORDS // HIDDEN]).tolist()
ROWS = _CUTS[-1]


class Network:
    """Views of one matrix of ROWS rows, or of what follows the window vectors if ``skipped`` rows are left out."""

    def __init__(self, rows: np.ndarray, skipped: int = 0):
        self.rows = rows
        parts = [rows[max(a - skipped, 0) : b - skipped] for a, b in zip(_CUTS, _CUTS[1:], strict=False)]
        self.window = None if skipped else parts[0].reshape(len(_PLACES), WORDS + 1, HIDDEN)
        self.bias = parts[1][0]
        self.classes, self.words = parts[2], parts[3].reshape(WIDTH, WIDTH, HIDDEN)
        self.class_bias, self.word_bias = parts[4].reshape(-1), parts[5].reshape(WIDTH, WIDTH)


def begin(counts: np.ndarray) -> np.ndarray:
    """The rows that training begins with; counts: how often each of the WORDS occurs."""
    net = Network((np.random.default_rng(1).standard_normal((ROWS, HIDDEN)) * 0.1).astype(np.float32))
    each = np.maximum(counts.reshape(WIDTH, WIDTH), 0.5)
    net.bias[:] = 0.1
    net.word_bias[:] = np.log(each / each.sum(axis=1, keepdims=True))
    net.class_bias[:] = np.log(each.sum(axis=1) / each.sum())
    return net.rows


def _hidden(net: Network, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = net.window[0][padded[at + _PLACES[0]]]
    for table, place in zip(net.window[1:], _PLACES[1:], strict=True):
        total += table[padded[at + place]]
    total += net.bias
    return np.maximum(total, 0, out=total)


def _weights(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """Exponentials of the columns of x less a number each, the sums of each column, and that number; x is overwritten."""
    less: np.ndarray | float = 0.0
    if x.size and (x.max() > 60 or x.min() < -60):  # float32 holds what lies between
        less = x.max(axis=0)
        x -= less
    np.exp(x, out=x)
    return x, x.sum(axis=0), less


def _log_of(x: np.ndarray, chosen: np.ndarray | int) -> np.ndarray:
    """The log-softmax of each column of x at its chosen row."""
    at = x[chosen] if isinstance(chosen, int) else x[chosen, np.arange(x.shape[1])]
    at = at.copy()
    _, total, less = _weights(x)
    return at - less - np.log(total)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by class, and (class, begin, end) in that order."""
    kind = (target // WIDTH).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    ends = np.cumsum(np.bincount(kind, minlength=WIDTH)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]


def log_probs(net: Network, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log p(word | window) for the words at these places of a padded sequence of words."""
    out = np.empty(len(at))
    for i in range(0, len(at), _SLICE):
        here = at[i : i + _SLICE]
        order, groups = _by_class(padded[here])
        here = here[order]
        hidden, member = np.ascontiguousarray(_hidden(net, padded, here).T), padded[here] % WIDTH
        found = np.empty(len(here), np.float32)
        for k, a, b in groups:
            first, second = net.classes @ hidden[:, a:b], net.words[k] @ hidden[:, a:b]
            first += net.class_bias[:, None]
            second += net.word_bias[k][:, None]
            found[a:b] = _log_of(first, k) + _log_of(second, member[a:b])
        out[i + order] = found
    return out


def gradient(net: Network, padded: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray | slice, np.ndarray]]:
    """Of the mean negative log-probability at these places: rows, and the slope by each of them."""
    tail = np.zeros((ROWS - _INPUT, HIDDEN), np.float32)
    out = Network(tail, _INPUT)
    order, groups = _by_class(padded[at])
    at = at[order]
    hidden, target, share = _hidden(net, padded, at), padded[at], np.float32(1 / len(at))
    # A column for each place, so that sums and maxima run along the places.
    across = np.ascontiguousarray(hidden.T)
    first, total, _ = _weights(net.classes @ across + net.class_bias[:, None])
    first *= share / total
    first[target // WIDTH, np.arange(len(at))] -= share
    out.classes[:], out.class_bias[:] = first @ hidden, first.sum(axis=1)
    back = net.classes.T @ first
    for k, a, b in groups:
        second, total, _ = _weights(net.words[k] @ across[:, a:b] + net.word_bias[k][:, None])
        second *= share / total
        second[target[a:b] % WIDTH, np.arange(b - a)] -= share
        out.words[k], out.word_bias[k] = second @ hidden[a:b], second.sum(axis=1)
        back[:, a:b] += net.words[k].T @ second
    back *= across > 0
    back = np.ascontiguousarray(back.T)
    out.bias[:] = back.sum(axis=0)
    yield slice(_INPUT, ROWS), tail
    for i, place in enumerate(_PLACES):
        near = padded[at + place]
        by = np.argsort(near.astype(np.uint16), kind="stable")
        near = near[by]
        starts = np.flatnonzero(np.diff(near, prepend=-1))
        yield near[starts] + i * (WORDS + 1), np.add.reduceat(back[by], starts, axis=0)


class Trainer:
    """Adagrad over the places it is given, in steps of STEP of them."""

    def __init__(self, rows: np.ndarray):
        self.start, self.net = rows, Network(rows.copy())
        self.seen, self.places = np.full((ROWS, HIDDEN), 1e-6, np.float32), 0

    def learn(self, padded: np.ndarray, at: np.ndarray) -> None:
        for i in range(0, len(at), STEP):
            for rows, slope in list(gradient(self.net, padded, at[i : i + STEP])):
                self.seen[rows] += slope * slope
                slope /= np.sqrt(self.seen[rows])
                slope *= RATE
                self.net.rows[rows] -= slope
        self.places += len(at)

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that have moved, and by how much, as float16."""
        moved = np.flatnonzero((self.net.rows != self.start).any(axis=1))
        return moved, (self.net.rows[moved] - self.start[moved]).astype(np.float16)


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        """hashes: of at most WORDS - WIDTH words, most frequent first."""
        self.size = 1 << 20
        self.first = np.full(self.size, -1, np.int16)
        self.hashes, at = hashes, (hashes & np.uint64(self.size - 1)).astype(np.int64)
        self.first[at[::-1]] = np.arange(len(hashes), dtype=np.int16)[::-1]
        shares = self.first[at] != np.arange(len(hashes))
        self.rest = {h: i for i, h in zip(np.flatnonzero(shares).tolist(), hashes[shares].tolist(), strict=True)}

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word: its rank, or WORDS - WIDTH and above for the bucket of a word that isn't in the vocabulary."""
        found = self.first[hashes & np.uint64(self.size - 1)].astype(np.int64)
        bucket = (hashes >> np.uint64(40)).astype(np.int64) % WIDTH + _NAMED
        if not len(self.hashes):
            return bucket
        out = np.where((found >= 0) & (self.hashes[found] == hashes), found, bucket)
        for h, i in self.rest.items():
            out[hashes == np.uint64(h)] = i
        return out


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = 0
    while begin < len(texts):
        end, size = begin + 1, len(texts[begin])
        while end < len(texts) and size + len(texts[end]) < _TEXTS:
            size, end = size + len(texts[end]), end + 1
        yield begin, end
        begin = end


def _spelling_codes(texts: list[bytes]) -> np.ndarray:
    """Byte and the byte before it, as one number, for each byte of the texts with a space on either side; white space is a space."""
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    data = np.where((data == 32) | ((data >= 9) & (data <= 13)), np.uint8(32), data)
    return data[:-1].astype(np.int64) * 256 + data[1:]


def _as_bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode().lower() for t in column.to_pylist()]


def corpus_counts(df: DataFrame) -> DataFrame:
    """(kind, item, n): of kind 0 how often each word (by hash) occurs, of kind 1 each pair of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, size = np.zeros(1 << 16, np.int64), [], 0

        def rows(kind: int, item: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(item), kind, np.int32)), pa.array(item.view(np.int64)), pa.array(n)], ["kind", "item", "n"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            item, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return item, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        for batch in batches:
            texts = _as_bytes(batch.column(0))
            for a, b in _groups(texts):
                pairs += np.bincount(_spelling_codes(texts[a:b]), minlength=1 << 16)
                held.append(np.unique(word_hashes(texts[a:b])[0], return_counts=True))
                size += len(held[-1][0])
                if size > _HELD:
                    held = [merged()]
                    size = len(held[0][0])
                if size > _HELD // 2 and len(held) == 1:
                    yield rows(0, *held.pop())
                    size = 0
        if held:
            yield rows(0, *merged())
        some = np.flatnonzero(pairs)
        yield rows(1, some, pairs[some])

    counted = df.mapInArrow(run, "kind int, item long, n long")
    return counted.groupBy("kind", "item").agg(F.sum("n").alias("n"))


def _sequence(texts: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with SIDE edges around each text, the words' places, their texts, and their first and end bytes in their text."""
    hashes, owner, begins, ends = word_hashes(texts)
    at = np.arange(len(hashes)) + SIDE * (owner + 1)
    padded = np.full(len(hashes) + SIDE * (len(texts) + 1), EDGE, np.int64)
    padded[at] = vocabulary.ids(hashes)
    return padded, at, owner, begins, ends


def train(df: DataFrame, key: str = "doc_id", text: str = "text") -> dict[str, np.ndarray]:
    """A model of all texts of df: ``hashes`` of the vocabulary, ``rows`` of the network, ``spelling`` log-probabilities."""
    prepare(df.sparkSession)
    docs = df.select(F.col(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("doc_id"))
    counts = materialize(corpus_counts(docs.select("text")))
    words = counts.where("kind = 0")
    top = words.orderBy(F.col("n").desc(), "item").limit(_NAMED).select("item", "n").toPandas()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pairs = np.full((256, 256), 0.01)
    for item, n in counts.where("kind = 1").select("item", "n").collect():
        pairs[item >> 8, item & 255] += n
    release(counts)
    pairs[32, 32] = 0  # no empty words
    pairs /= pairs.sum(axis=1, keepdims=True)
    spelling = np.log(np.maximum(pairs, 1e-30))
    hashes, each = top["item"].to_numpy(np.int64).view(np.uint64), np.zeros(WORDS)
    each[: len(top)] = top["n"]
    each[_NAMED:] = (total - each.sum()) / WIDTH
    rows = begin(each)
    for number in range(ROUNDS):
        rows = _round(docs, hashes, rows, number)
    return {"hashes": hashes, "rows": rows, "spelling": spelling.ravel()}


def turns(ids: np.ndarray, owner: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The round in which each position is predicted; every position has one."""
    return (mix(mix(ids.astype(np.uint64))[owner] + begins.astype(np.uint64)) % np.uint64(ROUNDS)).astype(np.int64)


def _round(docs: DataFrame, hashes: np.ndarray, rows: np.ndarray, number: int) -> np.ndarray:
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, vocabulary = Trainer(rows), Vocabulary(hashes)
        for batch in batches:
            texts, ids = _as_bytes(batch.column(0)), batch.column(1).to_numpy()
            for a, b in _groups(texts):
                padded, at, owner, begins, _ = _sequence(texts[a:b], vocabulary)
                trainer.learn(padded, at[turns(ids[a:b], owner, begins) == number])
        moved, by = trainer.moves()
        for i in range(0, len(moved), 4096):
            some = by[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(moved[i : i + 4096].astype(np.int32)), pa.array(np.full(len(some), trainer.places)), pa.array([x.tobytes() for x in some], pa.binary())], ["row", "places", "by"])
        # Places without a move of their own count as well.
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([trainer.places], pa.int64()), pa.array([b""], pa.binary())], ["row", "places", "by"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, places = np.zeros((ROWS + 1, HIDDEN), np.int64), 0
        for batch in batches:
            row, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places += int(n[row < 0].sum())
            row, n, by = row[row >= 0], n[row >= 0], b"".join(x for x in batch.column(2).to_pylist() if x)
            move = np.rint(np.frombuffer(by, np.float16).astype(np.float64) * _UNIT).astype(np.int64).reshape(-1, HIDDEN)
            np.add.at(total, row, move * n[:, None])
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array([*(x.tobytes() for x in total[some]), places.to_bytes(8, "little")], pa.binary())], ["row", "total"])

    moves = docs.mapInArrow(learn, "row int, places long, by binary")
    # Rows are dealt out by number; each has one entry a task at most, and a task's sums have a fixed size.
    summed = moves.repartition("row").mapInArrow(add, "row int, total binary").collect()
    places = sum(int.from_bytes(x, "little") for row, x in summed if row < 0)
    out = rows.copy()
    for row, x in summed:
        if row >= 0:
            out[row] += (np.frombuffer(x, np.int64) / (_UNIT * max(places, 1))).astype(np.float32)
    return out


def score(df: DataFrame, model: dict[str, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) for each row of df. No shuffle; the model has a fixed size."""
    prepare(df.sparkSession)
    columns = ["doc_id", "n_words", "log_prob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, vocabulary = Network(model["rows"]), Vocabulary(model["hashes"])
        for batch in batches:
            texts = _as_bytes(batch.column(1))
            for a, b in _groups(texts):
                padded, at, owner, begins, ends = _sequence(texts[a:b], vocabulary)
                found = log_probs(net, padded, at)
                # What a word outside the vocabulary costs in its bucket: its bytes and the space after it.
                cost = np.concatenate([[0.0], np.cumsum(model["spelling"][_spelling_codes(texts[a:b])])])
                offset = np.cumsum([0, *(len(t) + 1 for t in texts[a : b - 1])])[owner]
                outside = padded[at] >= _NAMED
                found[outside] += np.log(WIDTH) + (cost[offset + ends + 1] - cost[offset + begins])[outside]
                n = np.bincount(owner, minlength=b - a)
                total = np.bincount(owner, found, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(total)], columns)

    scored = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_words long, log_prob double")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))
