"""Removal of repeated passages by suffix automata and matching statistics.

The reference of a document is all text before it, so that it is as large as the corpus and can't go to every task
whole. It is cut into shards by content: a document's windows of ``length`` words are grouped into stretches, runs of
windows whose smallest word gram stands in one place. Equal windows have equal smallest grams, so that all that a
window may repeat lies in the shard of its gram. A shard's suffix automaton is built in order of place, and each stretch
is streamed through it for its matching statistics: how long a run of words, ending at each word, has come before.

1. Grams of one stretch alone repeat nothing: a bitmap of grams that occur twice sorts these out.
2. Of equal stretches the first stays and the others go as a whole; a grouped minimum, summed up before the shuffle,
   finds the first.
3. Only first stretches whose gram has several different ones, or that repeat a window within themselves, need an
   automaton. Shards of more than HOT stretches are cut further, by single windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Words, binaries, bitmap, blocks, flat_values, grams, held, list_of, long_array, mix, powers, stored

LENGTH = 20
#: Words of the grams by which windows are dealt to shards.
GRAM = 8
#: Different stretches of one gram that a shard may hold; beyond, it is dealt out by windows.
HOT = 1024
_LAST = (1 << 63) - 1
_FIRST, _SHARED, _HOT = 0, 1, 2


@dataclass
class Stretches:
    """Stretches of a block of texts: their text, first window and number of windows there, gram, digest and whether a window occurs twice."""

    text: np.ndarray
    begin: np.ndarray
    windows: np.ndarray
    gram: np.ndarray
    digest: np.ndarray
    twice: np.ndarray
    #: Place of the first word among the words of the block.
    at: np.ndarray

    def of(self, keep: np.ndarray) -> Stretches:
        return Stretches(*(getattr(self, f)[keep] for f in self.__dataclass_fields__))


def stretches(words: Words, length: int) -> tuple[Stretches, np.ndarray]:
    """The stretches of all texts of a block, and the hashes of all windows (some of which span two texts)."""
    n = len(words.hashes) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none), none.astype(np.uint64)
    gram = min(GRAM, length)
    g, width = grams(words.hashes, gram), length - gram + 1
    place = sliding_window_view(g, width).argmin(axis=1) + np.arange(n)
    owner = words.texts()
    whole = owner[:n] == owner[length - 1 :]
    new = np.append(True, (place[1:] != place[:-1]) | (owner[1:n] != owner[: n - 1]) | (whole[1:] != whole[:-1]))
    up, down = powers(len(words.hashes) + 1)
    sums = np.zeros(len(words.hashes) + 1, np.uint64)
    np.cumsum(mix(words.hashes ^ np.uint64(length)) * up[: len(words.hashes)], out=sums[1:])
    window = mix((sums[length:] - sums[:n]) * down[:n])
    number, again = np.cumsum(new) - 1, np.zeros(n, bool)
    for step in range(1, min(width, n)):
        again[:-step] |= (window[:-step] == window[step:]) & (number[:-step] == number[step:])
    first = np.flatnonzero(new)
    end = np.append(first[1:], n)
    twice = np.add.reduceat(again, first, dtype=np.int64) > 0
    digest = mix((sums[end + length - 1] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    out = Stretches(owner[first], first - words.first[owner[first]], end - first, g[place[first]], digest, twice, first)
    return out.of(whole[first]), window


def _cut(column: pa.Array, length: int) -> Iterator[tuple[int, int, Words, Stretches, np.ndarray, np.ndarray, np.ndarray]]:
    for first, last, data, offsets in blocks(column):
        words = Words(data, offsets, fold=False)
        yield first, last, words, *stretches(words, length), data, offsets


def _grams(length: int):
    """(key, n): the grams of a batch and in how many of its stretches each stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x[3].gram for x in _cut(batch.column("text"), length)]
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([long_array(keys), pa.array(n)], names=["key", "n"])

    return count


def _occurrences(bits, length: int):
    """Stretches whose gram may stand in another one, with their places."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = (batch.column(c).to_numpy() for c in ("doc", "text_hash"))
            for first, _, _, s, _, _, _ in _cut(batch.column("text"), length):
                s = s.of(held(bits.value, s.gram))
                yield pa.RecordBatch.from_arrays([long_array(s.gram), long_array(s.digest), pa.array(s.twice), pa.array(doc[first + s.text]), pa.array(text_hash[first + s.text]), pa.array(s.begin.astype(np.int32))], names=["gram", "digest", "twice", "doc", "text_hash", "begin"])

    return find


def _pairs(column: pa.Array, names: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, both values) of a column of lists of structs."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    flat = pc.list_flatten(column)
    return np.repeat(np.arange(len(column)), sizes), *(flat.field(n).to_numpy().astype(np.int64) for n in names)


def _kinds(s: Stretches, first: int, rows: np.ndarray, begins: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The kind of each stretch that is the first of its like, else -1. rows and begins: of the first ones of the batch."""
    known = (rows << 32) | begins
    order = np.argsort(known)
    known, kinds = known[order], kinds[order]
    asked = ((first + s.text) << 32) | s.begin
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    return np.where(known[at] == asked, kinds[at], -1) if len(known) else np.full(len(asked), -1)


def _shared(bits, length: int):
    """(shard, doc, text_hash, begin, words): the first stretches that need an automaton, as word hashes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_hash = (batch.column(c).to_numpy() for c in ("doc", "text_hash"))
            rows, begins, kinds = _pairs(batch.column("firsts"), ("begin", "kind"))
            if not (kinds != _FIRST).any():
                continue
            for first, _, words, s, window, _, _ in _cut(batch.column("text"), length):
                s = s.of(held(bits.value, s.gram))
                kind = _kinds(s, first, rows, begins, kinds)
                plain, hot = s.of(kind == _SHARED), s.of(kind == _HOT)
                inner = np.arange(hot.windows.sum()) - np.repeat(np.cumsum(hot.windows) - hot.windows, hot.windows)
                each = lambda x, hot=hot: np.repeat(x, hot.windows)
                at = np.concatenate([plain.at, each(hot.at) + inner])
                sizes = np.concatenate([plain.windows, np.ones(len(inner), np.int64)]) + length - 1
                shard = np.concatenate([plain.gram, mix(each(hot.gram) ^ window[each(hot.at) + inner])])
                text, begin = np.concatenate([plain.text, each(hot.text)]), np.concatenate([plain.begin, each(hot.begin) + inner])
                flat = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                yield pa.RecordBatch.from_arrays([long_array(shard), pa.array(doc[first + text]), pa.array(text_hash[first + text]), pa.array(begin.astype(np.int32)), binaries(words.hashes[flat], sizes)], names=["shard", "doc", "text_hash", "begin", "words"])

    return find


class Automaton:
    """Suffix automaton of several sequences; adding one tells its matching statistics against all before it and itself."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A copy of ``target`` for the shorter of its sequences, those that end a sequence of ``state``."""
        copy = len(self.link)
        self.next.append(self.next[target].copy())
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: list[int]) -> list[int]:
        """For each symbol, the length of the longest run ending there that also ends at an earlier place."""
        out, state = [], 0
        for symbol in sequence:
            target = self.next[state].get(symbol)
            if target is not None:  # all of the sequence so far has come before
                state = target if self.length[target] == self.length[state] + 1 else self._split(state, symbol, target)
                out.append(self.length[state])
                continue
            new = len(self.link)
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[state] + 1)
            while state >= 0 and symbol not in self.next[state]:
                self.next[state][symbol] = new
                state = self.link[state]
            if state >= 0:
                target = self.next[state][symbol]
                self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, symbol, target)
            state = new
            out.append(self.length[self.link[new]])
        return out


def _matched(length: int):
    """(doc, text_hash, first, last): runs of windows that come earlier; rows are sorted by shard, then place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, place, automaton = None, None, Automaton()
        for batch in batches:
            values, bounds = flat_values(batch.column("words"), np.dtype(np.uint64))
            symbols, out = values.tolist(), []
            for k, (s, doc, text_hash, begin) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "doc", "text_hash", "begin")), strict=True)):
                if s != shard:
                    shard, place, automaton = s, None, Automaton()
                if place == (doc, text_hash, begin):  # an equal row
                    continue
                place = (doc, text_hash, begin)
                runs = np.array(automaton.add(symbols[bounds[k] : bounds[k + 1]])) >= length
                for first, end in np.flatnonzero(np.diff(runs, prepend=False, append=False)).reshape(-1, 2).tolist():
                    out.append((doc, text_hash, begin + first - length + 1, begin + end - length))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc", "text_hash", "first", "last"])

    return run


def _removed(bits, length: int):
    """Take out the words of all windows that come earlier."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begins, kinds = _pairs(batch.column("firsts"), ("begin", "kind"))
            cut_rows, cut_first, cut_last = _pairs(batch.column("cuts"), ("first", "last"))
            for first, last, words, s, _, data, offsets in _cut(batch.column("text"), length):
                s = s.of(held(bits.value, s.gram))
                s = s.of(_kinds(s, first, rows, begins, kinds) < 0)
                here = (cut_rows >= first) & (cut_rows < last)
                base = words.first[cut_rows[here] - first]
                # Words from the first window's first word to the last window's last word go.
                edge = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(edge, np.concatenate([s.at, base + cut_first[here]]), 1)
                np.add.at(edge, np.concatenate([s.at + s.windows + length - 1, base + cut_last[here] + length]), -1)
                gone = np.cumsum(edge[:-1]) > 0
                owner, n = words.texts(), last - first
                start = gone & np.append(True, ~gone[:-1] | (owner[1:] != owner[:-1])) if len(gone) else gone
                end = gone & np.append(~gone[1:] | (owner[1:] != owner[:-1]), True) if len(gone) else gone
                place = np.arange(len(gone)) - words.first[owner]
                spans = pa.StructArray.from_arrays([pa.array(place[start].astype(np.int32)), pa.array((place[end] + 1).astype(np.int32))], names=["start", "end"])
                per = np.zeros(n + 1, np.int32)
                np.cumsum(np.bincount(owner[start], minlength=n), out=per[1:])
                # Each kept word takes the byte after it along as a space; the last one of a text doesn't.
                mark = np.zeros(len(data) + 1, np.int64)
                kept = ~gone
                left, seen = np.bincount(owner[kept], minlength=n), np.cumsum(kept)
                final = kept & (seen - (np.cumsum(left) - left)[owner] == left[owner])
                np.add.at(mark, words.starts[kept], 1)
                np.add.at(mark, words.ends[kept] + ~final[kept], -1)
                mask = np.cumsum(mark[:-1]) > 0
                out = data.copy()
                out[words.ends[kept & ~final]] = 0x20
                sizes = np.append(0, np.cumsum(mask))[offsets]
                text = pa.Array.from_buffers(pa.large_utf8(), n, [None, pa.py_buffer(np.ascontiguousarray(sizes.astype(np.int64))), pa.py_buffer(np.ascontiguousarray(out[mask]))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[first:last], pa.array(words.counts().astype(np.int64)), pa.array(np.bincount(owner[gone], minlength=n).astype(np.int64)), pa.ListArray.from_arrays(pa.array(per), spans), text.cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept"],
                )

    return clean


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of each row: its text without the passages that come earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if it lies in a window of ``length`` words whose sequence also starts
    earlier: in a document of a smaller id, or earlier in the same one. ``spans`` are the maximal runs of words removed
    (start, end: after the last), ``kept`` the other words, joined by one space. Words are compared by 64-bit hashes.

    A null text has no words. Rows without an id come after all others. Rows of one id come in the order of a hash of
    their texts; equal rows are one document, whose result each of them has. An empty table gives no rows; columns other
    than the two named are left out.
    """
    if length < 2:
        raise ValueError("length must be at least 2 words")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    counts = docs.select("text").mapInArrow(_grams(length), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    bits = spark.sparkContext.broadcast(bitmap(counts.filter("n > 1")))
    found = docs.select("doc", "text_hash", "text").mapInArrow(_occurrences(bits, length), "gram long, digest long, twice boolean, doc long, text_hash long, begin int")
    firsts = found.groupBy("gram", "digest", "twice").agg(F.min(F.struct("doc", "text_hash", "begin")).alias("at")).select("gram", "twice", "at.*")
    firsts = stored(firsts, "firsts")
    several = firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.bool_or("twice").alias("inner")).filter("n > 1 or inner").select("gram", F.when(F.col("n") > HOT, _HOT).otherwise(_SHARED).alias("shared"))
    of_doc = firsts.join(several, "gram", "left").groupBy("doc", "text_hash").agg(F.collect_list(F.struct("begin", F.coalesce("shared", F.lit(_FIRST)).alias("kind"))).alias("firsts"))
    known = docs.join(of_doc, ["doc", "text_hash"], "left")
    shards = known.mapInArrow(_shared(bits, length), "shard long, doc long, text_hash long, begin int, words binary")
    matched = shards.repartition("shard").sortWithinPartitions("shard", "doc", "text_hash", "begin").mapInArrow(_matched(length), "doc long, text_hash long, first int, last int")
    cuts = matched.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    return known.join(cuts, ["doc", "text_hash"], "left").mapInArrow(_removed(bits, length), "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")
