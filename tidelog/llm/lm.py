"""Scoring texts with a causal self-attention model on subword ids, beside a word frequency base.

The model reads the ids of a public subword vocabulary. Its input is the id (or, for rare ids, a group of
them); it attends to the 16 to 31 ids before through one head with learned distance biases, and predicts the
next id in two steps: one of 32 clusters of ids that stand in like places, then one of its 32 members. A member is
a frequent id or a set of rare ones, told apart by their frequencies. Texts are cut into windows
of two blocks, where the first block is context and the second is scored, so that each id is scored once.
Everything that depends on one id alone is folded into tables after training.

All of it is learned from all training rows: counts of ids and of pairs of symbols are sums over them, and the
attention's weights are fitted on every window of them. The driver makes a start on LEAST_WINDOWS, drawn by a hash; then
tasks go on from it, each over all windows of the rows dealt to it, and their weights are averaged.

Texts are tokenised once, and their ids stored; all later passes read these. Word counts are exact counts over all
training rows. Words that are frequent in a bounded sample are counted in arrays and their counts broadcast, the list
being bounded; all other words go through a join by word.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import _LOWER, Words, binaries, blocks, flat_values, list_of, long_array, mix, stored
from tidelog.llm.linear import Lookup, sample

#: Windows that the driver's start is made on; windows of a step there; of a run, a step and a task of the fit on all windows.
LEAST_WINDOWS, WINDOWS_A_STEP, RUN, WINDOWS_A_LATER_STEP, WINDOWS_A_TASK = 1 << 16, 160, 16, 320, 1 << 17
#: Rows that the list of words counted in arrays is drawn from, and its length.
LISTED_ROWS, FREQUENT = 1200, 1 << 16
#: Ids in a block; symbols, and how many of these are sets of rare ids; clusters of the output (and members of each).
BLOCK = 16
SYMBOLS, RARE_SETS = 1024, 24
SIDE = 32
WIDTH, HIDDEN = 8, 16
#: Ids scored at once; bounds the working arrays at about 1 kB for each.
AT_ONCE = 8192
#: Words that a worker remembers the ids of.
WORDS_KEPT = 150_000


class Subwords:
    """Ids of words, each with a space before it, in a tiktoken vocabulary. The end of a text has an id of its own."""

    _open: dict[tuple[str, str], Subwords] = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.size = self.end + 1
        self.begins = np.zeros(self.size, dtype=bool)
        self.begins[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        """Known words: sorted hashes, the place of each one's ids and their number, and all ids."""
        self.keys, self.at, self.many, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @classmethod
    def of(cls, source: tuple[str, str]) -> Subwords:
        if source not in cls._open:
            cls._open[source] = cls(*source)
        return cls._open[source]

    def encode(self, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of each word's ids) of words with a space before each.

        A word starts where an id's bytes start with a space.
        """
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int32)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) == words:
            return ids, np.diff(np.append(starts, len(ids)))
        parts = [self.encoding.encode_ordinary(" " + w) for w in text[1:].split(" ")]
        return np.array([i for p in parts for i in p], dtype=np.int32), np.array([len(p) for p in parts], dtype=np.int64)

    def ids(self, data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word)."""
        distinct, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > WORDS_KEPT:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero(self.keys[np.minimum(place, len(self.keys) - 1)] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            begins, sizes = words.starts[first[new]] - 1, words.ends[first[new]] - words.starts[first[new]] + 1
            lead = np.cumsum(sizes) - sizes
            from_ = np.arange(sizes.sum()) + np.repeat(begins - lead, sizes)
            letters = _LOWER[data[from_]]
            letters[lead] = 32
            ids, many = self.encode(letters.tobytes().decode(), len(new))
            self.keys, order = np.concatenate([self.keys, distinct[new]]), None
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(many) - many])
            self.many, self.flat = np.concatenate([self.many, many]), np.concatenate([self.flat, ids])
            order = np.argsort(self.keys, kind="stable")
            self.keys, self.at, self.many = self.keys[order], self.at[order], self.many[order]
            place = np.searchsorted(self.keys, distinct)
        of_word, begin = self.many[place][inverse], self.at[place][inverse]
        return self.flat[np.arange(of_word.sum()) + np.repeat(begin - np.cumsum(of_word) + of_word, of_word)], of_word


def _sequences(coder: Subwords, data: np.ndarray, offsets: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(ids with the end of each text, text bounds among them)."""
    ids, sizes = coder.ids(data, words)
    bounds = np.concatenate([[0], np.cumsum(sizes)])[words.first]
    return np.insert(ids, bounds[1:], coder.end), bounds + np.arange(len(bounds))


def _symbols(counts: np.ndarray) -> np.ndarray:
    """The symbol of each id: the most frequent ids have their own, others share the last RARE_SETS by rank."""
    order = np.argsort(-counts, kind="stable")
    symbol = np.empty(len(counts), dtype=np.int32)
    alone = SYMBOLS - RARE_SETS
    symbol[order[:alone]] = np.arange(alone)
    symbol[order[alone:]] = alone + np.arange(len(counts) - alone) % RARE_SETS
    return symbol


def _clusters(pairs: np.ndarray) -> np.ndarray:
    """Number (cluster * SIDE + member) of each symbol, from the counts of the symbols before it.

    The symbols are halved again and again at the median of the main direction of their square-rooted shares.
    """
    shares = np.sqrt(pairs / np.maximum(pairs.sum(axis=0), 1)).T  # [symbol, before]
    order = [np.arange(SYMBOLS)]
    while len(order) < SIDE:
        halves = []
        for part in order:
            x = shares[part] - shares[part].mean(axis=0)
            v = np.linspace(1, 2, x.shape[0]) @ x + 1e-9
            for _ in range(30):
                v = (x @ v) @ x
                v /= np.linalg.norm(v) + 1e-12
            by = part[np.argsort(x @ v, kind="stable")]
            halves += [by[: len(by) // 2], by[len(by) // 2 :]]
        order = halves
    number = np.empty(SYMBOLS, dtype=np.int64)
    number[np.concatenate(order)] = np.arange(SYMBOLS)
    return number


@dataclass
class Attention:
    """Parameters of the model, and the tables they are folded into."""

    symbol: np.ndarray  # id -> symbol; symbol SYMBOLS stands before a text
    number: np.ndarray  # id -> cluster * SIDE + member
    within: np.ndarray  # id -> log probability among the ids of its symbol
    cluster_after: np.ndarray  # [symbol, cluster] log probability after a symbol alone
    member_after: np.ndarray  # [symbol, cluster, member] log probability within the cluster
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    tables: dict[str, np.ndarray] = field(default_factory=dict)

    def fold(self) -> None:
        """Tables of what depends on one symbol or on a distance alone."""
        self.tables = {"symbol": _table(self.weights), "distance": _distance(self.weights["d"])}

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log probability of each text's ids."""
        symbols, place, _ = _tiles(self.symbol[ids], np.arange(len(ids)), bounds, SYMBOLS)
        out, numbers, step = np.zeros(len(ids), dtype=np.float32), self.number[ids].astype(np.int16), AT_ONCE // BLOCK
        for k in range(0, len(symbols) - 1, step):
            x, at = symbols[k : k + step + 1].reshape(1, -1), place[k + 1 : k + step + 1].ravel()
            h = _attend(self.tables["symbol"], self.tables["distance"], x)[3].reshape(-1, HIDDEN)
            real = np.flatnonzero(at >= 0)
            real = real[np.argsort(numbers[at[real]], kind="stable")]
            at = at[real]
            h, before, number = h.take(real, axis=0), x[0, BLOCK:][real].astype(np.int32), numbers[at].astype(np.int32)
            cluster, member = number // SIDE, number % SIDE
            z = h @ self.weights["o"]
            z += self.cluster_after.take(before, axis=0)
            got = _log_share(z, cluster)
            edges = np.searchsorted(cluster, np.arange(SIDE + 1)).tolist()
            z = self.member_after.reshape(-1, SIDE).take(before * np.int32(SIDE) + cluster, axis=0)
            for c in range(SIDE):
                i, j = edges[c], edges[c + 1]
                if j > i:
                    z[i:j] += h[i:j] @ self.weights["m"][c]
            got += _log_share(z, member)
            out[at] = got
        out += self.within[ids]
        sums = np.concatenate([[0.0], np.cumsum(out, dtype=np.float64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]


def _log_share(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log softmax of each row at one place; overwrites z, whose entries are log probabilities plus small terms."""
    got = z.ravel()[np.arange(len(z)) * z.shape[1] + chosen]
    np.exp(z, out=z)
    return got - np.log(z @ np.ones(z.shape[1], z.dtype))


def windows(symbols: np.ndarray, bounds: np.ndarray, before: int, chosen=None) -> tuple[np.ndarray, np.ndarray]:
    """(input symbols [window, 2 * BLOCK], places of the ids predicted by the second block, -1 for none).

    A text's id i is predicted from the symbols before it; ``before`` stands ahead of the text. ``chosen`` picks windows
    by their texts and their numbers in these.
    """
    sizes = np.diff(bounds)
    many = -(-sizes // BLOCK)
    text = np.repeat(np.arange(len(sizes)), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    if chosen is not None:
        picked = chosen(text, step)
        text, step = text[picked], step[picked]
    inside = (step[:, None] * BLOCK + np.arange(-BLOCK, BLOCK)).astype(np.int32)  # place in the text of the id that a position predicts
    good = (inside > 0) & (inside < sizes[text][:, None])
    padded = np.append(symbols, before).astype(np.int32)
    x = padded[np.where(good, bounds[:-1][text][:, None] + inside - 1, len(symbols))]
    here = inside[:, BLOCK:]
    place = np.where(here < sizes[text][:, None], bounds[:-1][text][:, None] + here, -1)
    return x, place


def _tiles(symbols: np.ndarray, numbers: np.ndarray, bounds: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``windows`` gives, each block once: (input symbols, numbers to predict with -1 for none, first blocks of all windows).

    A window is a block and the one after it, of which the second one's numbers are predicted.
    """
    sizes = np.diff(bounds)
    many = -(-sizes // BLOCK) + 1
    last = np.cumsum(many) - 1
    at = np.arange(len(symbols)) + np.repeat((last - many + 2) * BLOCK - bounds[:-1], sizes)
    x, goal = np.full(many.sum() * BLOCK + 1, before, dtype=np.int16), np.full(many.sum() * BLOCK, -1, dtype=numbers.dtype)
    x[at + 1], goal[at] = symbols, numbers
    x[at[bounds[1:][sizes > 0] - 1] + 1] = before  # nothing is predicted from a text's last symbol
    first = np.ones(many.sum(), dtype=bool)
    first[last] = False
    return x[:-1].reshape(-1, BLOCK), goal.reshape(-1, BLOCK), np.flatnonzero(first)


def _distance(d: np.ndarray) -> np.ndarray:
    """[query, key] biases; keys after the query are shut out."""
    gap = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)
    return np.where(gap >= 0, d[np.clip(gap, 0, 2 * BLOCK - 1)], np.float32(-1e9)).astype(np.float32)


#: Columns of the table of what depends on one symbol alone, but for the last, which is all ones and stands behind _V.
_Q, _K, _R, _V = slice(0, WIDTH), slice(WIDTH, 2 * WIDTH), slice(2 * WIDTH, 2 * WIDTH + HIDDEN), slice(2 * WIDTH + HIDDEN, 2 * WIDTH + 2 * HIDDEN)


def _table(w: dict[str, np.ndarray]) -> np.ndarray:
    """[symbol, scaled query, key, what is added for the query itself, value, 1]."""
    e = w["e"]
    return np.hstack([e @ w["q"] / np.sqrt(np.float32(WIDTH)), e @ w["k"], e @ w["r"] + w["c"], e @ w["v"], np.ones((SYMBOLS + 1, 1), np.float32)])


def _views(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries of each window's second block, keys of both, values of both with the ones) of a run's rows of the table."""
    runs, places, _ = t.shape
    many = places // BLOCK - 1
    both = np.lib.stride_tricks.as_strided(t, (runs, many, 2 * BLOCK, t.shape[2]), (t.strides[0], BLOCK * t.strides[1], *t.strides[1:]), writeable=False)
    return both[:, :, BLOCK:, _Q], both[..., _K], both[..., _V.start :]


def _attend(table: np.ndarray, distance: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(rows of the table, shares before division, sums of values and of shares, hidden state) of runs of blocks."""
    t = table.take(x, axis=0)
    q, k, v = _views(t)
    a = np.matmul(q, k.swapaxes(2, 3))
    a += distance
    # where no share can run out of its range, the largest needn't be taken off
    if np.sqrt((table[:, _Q] ** 2).sum(axis=1).max() * (table[:, _K] ** 2).sum(axis=1).max()) + abs(distance[distance > -1e8]).max() > 30:
        a -= a.max(axis=3, keepdims=True)
    np.exp(a, out=a)
    sums = np.matmul(a, v)
    h = sums[..., :HIDDEN] / sums[..., HIDDEN:]
    h += t[:, BLOCK:, _R].reshape(h.shape)
    np.maximum(h, 0, out=h)
    return t, a, sums, h


def _pairs(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number before * SYMBOLS + symbol of each place; SYMBOLS stands before a text."""
    before = np.concatenate([[SYMBOLS], symbols[:-1]])[: len(symbols)].astype(np.int64)
    before[bounds[:-1][np.diff(bounds) > 0]] = SYMBOLS
    return before * SYMBOLS + symbols


def _counting(size: int, numbers):
    """(name, n): how often each number stands in the rows of a task. ``numbers`` gives those of a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, dtype=np.int64)
        for batch in batches:
            sums += np.bincount(numbers(batch), minlength=size)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.int64())], names=["name", "n"])

    return count


def total(rows: DataFrame, size: int, numbers) -> np.ndarray:
    """Counts of the numbers from 0 to ``size`` over all rows; no more than ``size`` rows come to the driver."""
    got = rows.mapInArrow(_counting(size, numbers), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[got["name"].to_numpy()] = got["n"].to_numpy()
    return out


def _drawing(rate: float, model):
    """Windows drawn by a hash of row and place: symbols and numbers (-1 for none), in 16 bits, and the hash."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, number, kind = model.value
        limit = np.uint64(min(rate, 1.0) * ((1 << 63) - 1))
        for batch in batches:
            ids, bounds = flat_values(batch.column("ids"), kind)
            rows, hashes = batch.column("row").to_numpy().astype(np.uint64), []

            def chosen(text, step, rows=rows, hashes=hashes):
                h = mix(mix(rows[text] + np.uint64(1)) + step.astype(np.uint64)) >> np.uint64(1)
                picked = np.flatnonzero(h <= limit)
                hashes.append(h[picked])
                return picked

            x, place = windows(symbol[ids], bounds, SYMBOLS, chosen)
            goal = np.append(number[ids], -1)[place].astype("<i2")
            pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([pack(x.astype("<i2")), pack(goal), long_array(hashes[0])], names=["symbols", "goal", "hash"])

    return draw


def _unpacked(symbols: pa.Array, goal: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    of = lambda c, n: np.frombuffer(b"".join(c.to_pylist()), dtype="<i2").reshape(-1, n).astype(np.int32)
    return of(symbols, 2 * BLOCK), of(goal, BLOCK)


class Descent:
    """Adam on the attention's weights."""

    def __init__(self, model: Attention):
        self.model, self.step = model, 0
        self.moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in model.weights.items()}

    def down(self, x: np.ndarray, goal: np.ndarray, rate: float) -> None:
        self.step += 1
        for n, g in _gradients(self.model, x, goal).items():
            m, v = self.moments[n]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.model.weights[n] -= (rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)).astype(np.float32)


def _further(start, kind: np.dtype, most: int):
    """Weights after all windows of a task's rows, begun from the driver's, with their number. most: about as many windows.

    A step takes runs of windows that follow one another, drawn without return from some 512 rows, so that a block is
    looked up once for both windows that hold it.
    """

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, rng = start.value, 0, np.random.default_rng(20240601)
        model.weights = {n: v.copy() for n, v in model.weights.items()}
        descent, numbers, a_step = Descent(model), model.number.astype(np.int16), WINDOWS_A_LATER_STEP // RUN
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                ids, bounds = flat_values(whole.column("ids").slice(begin, 512), kind)
                x, goal, _ = _tiles(model.symbol[ids], numbers[ids], bounds, SYMBOLS)
                fill = ((0, -(len(x) - 1) % RUN), (0, 0))
                x, goal = np.pad(x, fill, constant_values=SYMBOLS), np.pad(goal, fill, constant_values=-1)
                runs = rng.permutation((len(x) - 1) // RUN) * RUN
                for at in np.array_split(runs, -(-len(runs) // a_step) or 1):
                    rows = at[:, None] + np.arange(RUN + 1)
                    descent.down(x[rows].reshape(len(at), -1).astype(np.int64), goal[rows[:, 1:]].reshape(len(at), -1), 0.02 * max(0.05, 1 - seen / most))
                    seen += np.count_nonzero((goal[rows[:, 1:]] >= 0).any(axis=2))
        if seen:
            values = np.concatenate([v.ravel() for v in model.weights.values()])
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), list_of(values, np.array([len(values)]), pa.float32())], names=["n", "values"])

    return go_on


def frequencies(counts: np.ndarray, pairs: np.ndarray) -> Attention:
    """The model's tables of frequencies, from the counts of all training rows, and first weights."""
    symbol = _symbols(counts)
    rng = np.random.default_rng(20240601)
    smooth = counts + 0.05
    within = np.log(smooth / np.bincount(symbol, weights=smooth, minlength=SYMBOLS)[symbol])
    of = _clusters(pairs)
    by_number = np.empty_like(pairs)
    by_number[:, of] = pairs
    by_number = by_number.reshape(SYMBOLS + 1, SIDE, SIDE).astype(np.float64)
    total = by_number.sum(axis=0) + 0.5
    share = total.sum(axis=1) / total.sum()
    clusters = by_number.sum(axis=2)
    cluster_after = np.log((clusters + 20 * share) / (clusters.sum(axis=1, keepdims=True) + 20))
    member_after = np.log((by_number + 5 * total / total.sum(axis=1, keepdims=True)) / (clusters[:, :, None] + 5))
    model = Attention(symbol, of[symbol], *(v.astype(np.float32) for v in (within, cluster_after, member_after)))
    small = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    model.weights = {"e": rng.standard_normal((SYMBOLS + 1, WIDTH)).astype(np.float32) * 0.5, "q": small(WIDTH, WIDTH), "k": small(WIDTH, WIDTH), "v": small(WIDTH, HIDDEN), "r": small(WIDTH, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "d": np.zeros(2 * BLOCK, np.float32), "o": np.zeros((HIDDEN, SIDE), np.float32), "m": np.zeros((SIDE, HIDDEN, SIDE), np.float32)}
    return model


def begin(model: Attention, x: np.ndarray, goal: np.ndarray, steps: int = 400) -> None:
    """The first fit, on windows in random order."""
    rng, descent = np.random.default_rng(20240601), Descent(model)
    for step in range(1, steps + 1 if len(x) else 0):
        pick = rng.integers(0, len(x), WINDOWS_A_STEP)
        descent.down(x[pick], goal[pick], 0.01 * min(1, step / 20) * (1 - step / (steps + 1)))


def train(training: DataFrame, coder: Subwords) -> Attention:
    """The model of stored training rows (row, ids)."""
    spark, kind, size = training.sparkSession, coder.kind, coder.size
    counts = total(training.select("ids"), size, lambda batch: flat_values(batch.column("ids"), kind)[0]).astype(np.float64)
    symbols = spark.sparkContext.broadcast(_symbols(counts))

    def follow(batch: pa.RecordBatch) -> np.ndarray:
        ids, bounds = flat_values(batch.column("ids"), kind)
        return _pairs(symbols.value[ids], bounds)

    model = frequencies(counts, total(training.select("ids"), (SYMBOLS + 1) * SYMBOLS, follow).reshape(-1, SYMBOLS))
    most = training.select(F.sum(F.ceil(F.octet_length("ids") / (BLOCK * kind.itemsize)))).first()[0] or 0
    tables = spark.sparkContext.broadcast((model.symbol, model.number, kind))
    drawn = training.select("row", "ids").mapInArrow(_drawing(1.05 * LEAST_WINDOWS / max(most, 1), tables), "symbols binary, goal binary, hash long")
    first = drawn.orderBy("hash", "symbols", "goal").limit(LEAST_WINDOWS).toArrow()
    begin(model, *_unpacked(first["symbols"].combine_chunks(), first["goal"].combine_chunks()))
    tasks = max(1, -(-most // WINDOWS_A_TASK))
    parts = training.select("row", "ids").repartition(tasks, "row").sortWithinPartitions(F.xxhash64("row"), "row")
    mean = parts.mapInArrow(_further(spark.sparkContext.broadcast(model), kind, -(-most // tasks)), "n long, values array<float>").select("n", F.posexplode("values").alias("place", "v"))
    mean = mean.groupBy("place").agg((F.sum(F.col("v").cast("double") * F.col("n")) / F.sum("n")).alias("v")).orderBy("place").toArrow()["v"].to_numpy().astype(np.float32)
    at = 0
    for n, v in model.weights.items():
        if len(mean):
            model.weights[n] = mean[at : at + v.size].reshape(v.shape)
        at += v.size
    model.fold()
    return model


def _gradients(model: Attention, x: np.ndarray, goal: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean loss over the real places of runs; ``goal`` holds the numbers to predict, -1 for none.

    A run (a row of x) is one or more blocks after a first one, which is context alone. What depends on one symbol alone is
    folded into a table first. The sums over symbols are counts by column.
    """
    w, e, many = model.weights, model.weights["e"], goal.shape[1] // BLOCK
    of = np.hstack([w["q"] / np.sqrt(np.float32(WIDTH)), w["k"], w["r"], w["v"]])
    t, a, sums, h = _attend(_table(w), _distance(w["d"]), x)
    part = 1 / sums[..., HIDDEN:]
    alone = sums[..., :HIDDEN] * part
    number = goal.ravel().astype(np.int16)
    at = np.argsort(number, kind="stable")[np.count_nonzero(number < 0) :]
    number, before, flat = number[at].astype(np.int64), x[:, BLOCK:].ravel()[at], h.reshape(-1, HIDDEN).take(at, axis=0)
    cluster, weight = number // SIDE, np.float32(1 / max(len(at), 1))
    z, df, edges = np.empty((len(at), 2 * SIDE), np.float32), np.empty_like(flat), np.searchsorted(cluster, np.arange(SIDE + 1)).tolist()
    parts, to = [(c, slice(i, j)) for c, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i], np.concatenate([np.broadcast_to(w["o"], w["m"].shape), w["m"]], axis=2)
    for c, rows in parts:
        np.matmul(flat[rows], to[c], out=z[rows])
    z[:, :SIDE] += model.cluster_after.take(before, axis=0)
    z[:, SIDE:] += model.member_after.reshape(-1, SIDE).take(before * SIDE + cluster, axis=0)
    np.exp(z, out=z)
    halves = z.reshape(-1, SIDE)
    halves *= (weight / (halves @ np.ones(SIDE, z.dtype)))[:, None]
    for start, chosen in ((0, cluster), (SIDE, number % SIDE)):
        z.ravel()[np.arange(start, z.size, 2 * SIDE) + chosen] -= weight
    led = np.zeros(to.shape, np.float32)
    for c, rows in parts:
        np.matmul(flat[rows].T, z[rows], out=led[c])
        np.matmul(z[rows], to[c].T, out=df[rows])
    out = {"o": led[:, :, :SIDE].sum(axis=0), "m": led[:, :, SIDE:]}
    df *= flat > 0
    back = np.zeros((len(x), many + 1, BLOCK, of.shape[1]), np.float32)  # slopes of what was taken from the table
    dh = np.zeros((len(x), many, BLOCK, HIDDEN), np.float32)
    dh.reshape(-1, HIDDEN)[at] = df
    back[:, 1:, :, _R] = dh
    g = np.empty_like(sums)
    np.multiply(dh, part, out=g[..., :HIDDEN])
    np.negative(np.einsum("abij,abij->abi", g[..., :HIDDEN], alone), out=g[..., HIDDEN])
    q, k, v = _views(t)
    da = np.matmul(g, v.swapaxes(2, 3))
    da *= a
    back[:, 1:, :, _Q] = np.matmul(da, k)
    for columns, slopes in ((_K, np.matmul(da.swapaxes(2, 3), q)), (_V, np.matmul(a.swapaxes(2, 3), g[..., :HIDDEN]))):
        back[:, :-1, :, columns] = slopes[:, :, :BLOCK]
        back[:, 1:, :, columns] += slopes[:, :, BLOCK:]
    gap = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)
    out["d"] = np.bincount(np.clip(gap, 0, None).ravel(), weights=(da.sum(axis=(0, 1)) * (gap >= 0)).ravel(), minlength=2 * BLOCK).astype(np.float32)
    rows = back.reshape(-1, of.shape[1])
    out["e"] = np.stack([np.bincount(x.ravel(), slopes, SYMBOLS + 1) for slopes in of @ rows.T], axis=1).astype(np.float32)
    led = e.take(x.ravel(), axis=0).T @ rows
    return out | {"c": df.sum(axis=0), "q": led[:, _Q] / np.sqrt(np.float32(WIDTH)), "k": led[:, _K], "v": led[:, _V], "r": led[:, _R]}


ENCODED = "doc_id long, held_out boolean, n_tokens long, words binary, ids binary, rare array<long>, times array<int>"


def _encoding(frequent, source):
    """Each row's ids and frequent words, with its other words and how often they stand there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, coder = Lookup(frequent.value), Subwords.of(source)
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column("text")):
                words, rows = Words(data, offsets), last - first
                place, number = lookup.find(words.hashes)
                owner = words.texts()
                rest = np.ones(len(owner), dtype=bool)
                rest[place] = False
                who, what = owner[rest], words.hashes[rest]
                order = np.lexsort((what, who))
                who, what = who[order], what[order]
                new = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (what[1:] != what[:-1]))[: len(who)])
                sizes = np.bincount(who[new], minlength=rows)
                ids, bounds = _sequences(coder, data, offsets, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[first:last],
                        batch.column("held_out")[first:last],
                        pa.array(words.counts() + 1, pa.int64()),
                        binaries(number.astype("<u2"), np.bincount(owner[place], minlength=rows)),
                        binaries(ids.astype(coder.kind), np.diff(bounds)),
                        list_of(long_array(what[new]), sizes, pa.int64()),
                        list_of(np.diff(np.append(new, len(who))).astype(np.int32), sizes, pa.int32()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "words", "ids", "rare", "times"],
                )

    return encode


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, base_part double, known_part long, model double"


def _scoring(counts, model, kind, end_known: bool):
    """Each row's model score, and what its frequent words give for the base."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.append(np.log10(counts.value + 0.1), 0)
        known = np.append(counts.value > 0, False)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                words, edges = flat_values(batch.column("words"), np.dtype("<u2"))
                owner = np.repeat(np.arange(batch.num_rows), np.diff(edges))
                base = np.bincount(owner, weights=weight[words], minlength=batch.num_rows)
                seen = np.bincount(owner, weights=known[words], minlength=batch.num_rows).astype(np.int64) + int(end_known)
                logs = model.value.score(*flat_values(batch.column("ids"), kind))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out", "n_tokens")), pa.array(base), pa.array(seen), pa.array(logs / np.log(10))], names=["row", "doc_id", "held_out", "n_tokens", "base_part", "known_part", "model"])

    return score


def score(df: DataFrame, vocabulary: tuple[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    vocabulary: path of a tiktoken file, on all machines, and its pattern. Rows whose id's CRC-32 (of its decimal digits; a null
    id is empty) is divisible by ten are held out: neither counts nor the model have seen them. Null texts are
    empty and consist of the end token. Repeated rows keep their rows and count as often. An empty table gives no rows; with
    no training row at all, no word is known and the model has seen nothing.
    """
    spark = df.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = sample(docs.filter(~F.col("held_out")), "doc_id", LISTED_ROWS, "text").select("text").toArrow()["text"].combine_chunks()
    hashes, seen = np.unique(np.concatenate([np.zeros(0, np.uint64), *(Words(data, offsets).hashes for _, _, data, offsets in blocks(packed))]), return_counts=True)
    names = hashes[np.argsort(-seen, kind="stable")[:FREQUENT]]
    coder, frequent = Subwords.of(vocabulary), spark.sparkContext.broadcast(names)
    encoded = stored(docs.mapInArrow(_encoding(frequent, vocabulary), ENCODED).withColumn("row", F.monotonically_increasing_id()), "encoded")
    training = encoded.filter(~F.col("held_out"))
    model = spark.sparkContext.broadcast(train(training, coder))
    counts = total(training.select("words"), max(1, len(names)), lambda batch: flat_values(batch.column("words"), np.dtype("<u2"))[0])
    ends, tokens = training.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "words", "ids").mapInArrow(_scoring(spark.sparkContext.broadcast(counts), model, coder.kind, ends > 0), SCORED)
    rare = encoded.select("row", "held_out", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", "held_out", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    rare_counts = stored(rare.filter(~F.col("held_out")).groupBy("word").agg(F.sum("times").alias("c")), "rare_counts")
    kinds = int((counts > 0).sum()) + rare_counts.count() + int(ends > 0)
    whole = tokens + 0.1 * (kinds + 1)
    told = rare.join(rare_counts, "word", "left").select("row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    told = told.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("base"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    base = F.col("base_part") + F.coalesce("base", F.lit(0.0)) + float(np.log10(ends + 0.1)) - F.col("n_tokens") * float(np.log10(whole))
    return scored.join(told, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known_part") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), F.col("model").alias("score"))
