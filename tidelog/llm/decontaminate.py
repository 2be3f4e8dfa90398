"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

A benchmark item of n words is contained in a document if some passage is within n // EDITS_PER word edits
of it (a fifth, by default). Windows of an item's length are embedded by CGK random walks, which turn edit distance into
Hamming distance. Each LSH table has a walk of its own and samples places of the embedding; the sampled values name
a bucket, and the items of a window's buckets are its candidates. The number of tables follows from the target recall
and the least chance that two texts at the edit limit share a bucket. Candidates are decided by the exact edit distance.

Only windows that can match at all are embedded: if n words differ by k edits, one of the k + 1 stretches
between edits stays whole and has at least ceil((n - k) / (k + 1)) words, so that a match holds such a run of some item
of its length, and begins so many words ahead of it as in the item. This drops no match and keeps the work in
proportion to the text; ``everywhere`` embeds all windows.

Items of more than PART words are searched by parts: edits that the whole allows can't be more than a fifth of every
part, so that some part lies within its own limit. A part that is found is followed by the exact edit distance of the whole
item around it. Documents are
never shuffled; the benchmark goes to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Words, blocks, grams, mix, tidy

#: One edit is allowed for so many words of an item.
EDITS_PER = 5
#: Share of the matches at the edit limit that the tables find at least; places sampled in each table, out of the first
#: REACHED n steps of a walk over n words, most of which it takes before its text ends.
RECALL, SAMPLED, REACHED = 0.999, 2, 1.5
#: Text bytes of the benchmark that go to the tasks in one pass; a larger one takes several passes.
ITEM_BYTES = 16 << 20
_LUT_BITS = 20
#: Words of the longest text that is embedded as a whole: by deletions alone, walks over longer ones part too soon.
PART = 80
#: Letters, digits and all bytes beyond ASCII make words; punctuation doesn't.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Windows embedded at once.
AT_ONCE = 256


def allowed(n: int) -> int:
    return n // EDITS_PER


def run_length(n: int) -> int:
    """Words of an item of n words that stay together at least, whatever the allowed edits."""
    k = allowed(n)
    return -(-(n - k) // (k + 1))


def tables(n: int) -> int:
    """LSH tables for items of n words.

    Two texts at the edit limit share a bucket of a table with a chance of at least min(0.18, 0.7 / sqrt(n)), as
    measured over random edits for lengths from 5 to 200.
    """
    return math.ceil(math.log(1 - RECALL) / math.log(1 - min(0.18, 0.7 / math.sqrt(n))))


def sampled_places(n: int) -> np.ndarray:
    """[table, sample]: steps of the walks over n words whose symbols name the buckets."""
    return np.sort(np.random.default_rng((20240203, n)).integers(0, max(1, int(REACHED * n)), (tables(n), SAMPLED)), axis=1)


def buckets(symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Bucket keys [table, window] of ``symbols[begin:end]``, embedded as texts of n words.

    At each step a walk writes its present symbol and moves on by a bit that depends on table, step and symbol
    alone; past the end it writes 0.
    """
    places = sampled_places(n)
    seeds = mix(np.arange(1, len(places) + 1, dtype=np.uint64))[:, None]
    at = np.repeat(begins[None], len(places), axis=0)
    keys, top = np.zeros(at.shape, dtype=np.uint64), len(symbols) - 1
    for j in range(int(places.max()) + 1):
        now = np.where(at < ends, symbols[np.minimum(at, top)], np.uint64(0))
        for k in range(SAMPLED):
            rows = np.flatnonzero(places[:, k] == j)
            keys[rows] = mix(keys[rows] + now[rows] + np.uint64(k + 1))
        at += (mix(now ^ (seeds * np.uint64(2 * j + 1))) & np.uint64(1)).astype(np.int64)
    return mix(keys ^ (seeds + np.uint64(n)))


def edit_match(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Least edits between the item and any passage of ``words``, with that passage's first word and end."""
    n, m = len(item), len(words)
    steps = np.arange(m + 1)
    cost, begin = np.zeros(m + 1, dtype=np.int64), steps.copy()
    for i in range(n):
        swap, drop = np.append(cost[0] + 1, cost[:-1] + (words != item[i])), cost + 1
        swap[0] = drop[0]
        pick = swap <= drop
        new = np.where(pick, swap, drop)
        origin = np.where(pick, np.append(begin[0], begin[:-1]), begin)
        best = np.minimum.accumulate(new - steps)
        source = np.maximum.accumulate(np.where(new - steps == best, steps, 0))
        cost, begin = best + steps, origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


@dataclass
class Items:
    """Prepared benchmark items, and their parts: words, run lookup and embeddings."""

    ids: list[int]
    texts: list[str]
    #: Words of each item; words of each part, its item and its first word there.
    items: list[np.ndarray] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    item: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)

    def __post_init__(self):
        packed = [t.encode() for t in self.texts]
        offsets = np.cumsum([0, *map(len, packed)])
        found = Words(np.frombuffer(b"".join(packed), dtype=np.uint8), offsets, _WORD)
        kept = [(i, found.hashes[a:b]) for i, a, b in zip(self.ids, found.first[:-1], found.first[1:], strict=True) if b > a]
        self.ids, self.items = [i for i, _ in kept], [w for _, w in kept]
        for k, w in enumerate(self.items):
            for part in np.array_split(np.arange(len(w)), -(-len(w) // PART)):
                self.words.append(w[part])
                self.item.append(k)
                self.offset.append(int(part[0]))
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for q in sorted({run_length(int(n)) for n in self.sizes}):
            rows = [(g, np.full(len(g), k), np.arange(len(g))) for k, w in enumerate(self.words) if run_length(len(w)) == q for g in [grams(w, q)]]
            keys, owner, place = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.argsort(keys, kind="stable")
            lut = np.zeros(1 << _LUT_BITS, dtype=bool)
            lut[keys & np.uint64((1 << _LUT_BITS) - 1)] = True
            self.runs[q] = keys[order], owner[order], place[order], lut
        self.lengths = np.unique(self.sizes)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each length: sorted bucket keys of all tables, their items
        for n in self.lengths.tolist():
            mine = np.flatnonzero(self.sizes == n)
            keys = buckets(np.concatenate([self.words[k] for k in mine]), np.arange(len(mine)) * n, np.arange(1, len(mine) + 1) * n, n).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables[n] = keys[order], np.tile(mine, len(keys) // len(mine))[order]

    def windows(self, words: Words, everywhere: bool) -> np.ndarray:
        """Distinct (text, length, first word in the block) of the windows to embed."""
        text, found = words.texts(), [np.zeros((0, 3), np.int64)]
        if everywhere:
            found += [np.stack([text, np.full(len(text), n), np.arange(len(text))], axis=1) for n in self.lengths.tolist()]
        for q, (keys, owner, place, lut) in self.runs.items() if not everywhere else ():
            runs = grams(words.hashes, q)
            hit = np.flatnonzero(lut[runs & np.uint64((1 << _LUT_BITS) - 1)])
            hit = hit[text[hit] == text[hit + q - 1]]
            at, which = _spread(keys, runs[hit])
            found.append(np.stack([text[hit[at]], self.sizes[owner[which]], hit[at] - place[which]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def candidates(self, words: Words, everywhere: bool = False) -> np.ndarray:
        """Distinct (text, part, first word) of windows and parts that share a bucket."""
        rows, out = self.windows(words, everywhere), [np.zeros((0, 3), np.int64)]
        for n, (keys, owner) in self.tables.items():
            mine = rows[rows[:, 1] == n]
            for k in range(0, len(mine), AT_ONCE):
                text, _, start = mine[k : k + AT_ONCE].T
                named = buckets(words.hashes, np.maximum(start, words.first[text]), np.minimum(start + n, words.first[text + 1]), n)
                at, which = _spread(keys, named.ravel())
                at %= len(text)
                out.append(np.unique(np.stack([text[at], owner[which], start[at]], axis=1), axis=0))
        return np.concatenate(out)

    def matches(self, words: Words, everywhere: bool = False) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, end word) of the best passage of each text and item within the limit."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: dict[tuple[int, int], list[int]] = {}

        def passage(pattern: np.ndarray, text: int, start: int) -> tuple[int, int, int]:
            most = allowed(len(pattern))
            low, high = max(int(words.first[text]), start - 2 * most), min(int(words.first[text + 1]), start + len(pattern) + 2 * most)
            edits, a, b = edit_match(pattern, words.hashes[low:high]) if high > low else (len(pattern), 0, 0)
            return edits, low + a, low + b

        for text, part, start in self.candidates(words, everywhere).tolist():
            item, pattern = self.item[part], self.words[part]
            if best.get((text, item), (1,))[0] == 0:
                continue
            whole, start_of = self.items[item], start - self.offset[part]
            most = allowed(len(whole))
            if len(pattern) < len(whole):
                # Where the whole has been tried so near, all passages that this part may belong to have been seen.
                if any(abs(start_of - x) <= most // 2 for x in tried.get((text, item), ())) or passage(pattern, text, start)[0] > allowed(len(pattern)):
                    continue
                tried.setdefault((text, item), []).append(start_of)
            found = passage(whole, text, start_of)
            if found[0] <= most:
                best[text, item] = min(best.get((text, item), found), found)
        return [(*key, *value) for key, value in best.items()]


def _spread(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in values, places in the sorted keys) of all equal pairs."""
    low, high = np.searchsorted(keys, values), np.searchsorted(keys, values, side="right")
    many = high - low
    at = np.repeat(np.arange(len(values)), many)
    return at, np.arange(len(at)) + np.repeat(low - np.cumsum(many) + many, many)


_prepared: dict[int, Items] = {}


def _items(shared) -> Items:
    """A worker prepares each broadcast block once."""
    if shared.id not in _prepared:
        _prepared.clear()
        _prepared[shared.id] = Items(*shared.value)
    return _prepared[shared.id]


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast else 0

    @property
    def value(self):
        return self.broadcast.value


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator:
    """Broadcasts of the benchmark, ITEM_BYTES of text or a little more in each."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // ITEM_BYTES) or 1
    for k in range(count):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))


PAIRS = "doc_id long, item_id long, edits int, item_words int, start_byte long, end_byte long"


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = _items(shared)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, _, data, offsets in blocks(batch.column("text")):
                words = Words(data, offsets, _WORD)
                rows = [(ids[first + t], items.ids[i], edits, len(items.items[i]), int(words.starts[a] - offsets[t]), int(words.ends[b - 1] - offsets[t])) for t, i, edits, a, b in items.matches(words)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "edits", "item_words", "start_byte", "end_byte"])

    return find


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, edits, item_words, start_byte, end_byte) of each benchmark item found in each document.

    The passage is the one with the fewest edits, the first of several. Null and empty texts and items match
    nothing, nor do items without a letter or digit. Repeated rows and repeated items give repeated pairs; a null id
    stays null. Empty tables give no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for items in _item_blocks(benchmark, item_id_col, item_text_col):
        part = docs.mapInArrow(tidy(_finder(_Shared(items))), PAIRS)
        out = part if out is None else out.union(part)
    return out


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text holds no benchmark item."""

    def keeper(shared):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = _items(shared)
            for batch in batches:
                good = np.ones(batch.num_rows, dtype=bool)
                for first, _, data, offsets in blocks(batch.column(batch.schema.get_field_index(text_col))):
                    for match in items.matches(Words(data, offsets, _WORD)):
                        good[first + match[0]] = False
                yield batch.filter(pa.array(good))

        return keep

    for items in _item_blocks(benchmark, item_id_col, item_text_col):
        df = df.mapInArrow(tidy(keeper(_Shared(items))), df.schema)
    return df
