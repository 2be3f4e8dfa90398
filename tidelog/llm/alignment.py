"""Alignment of two tokenizers' tokens, with corpus counts of linked id pairs under a minimal perfect hash.

A text is cut into units before each space or line feed that follows anything but white space. No token of either tokenizer crosses
these cuts, so that a unit's tokens, groups and links are the same wherever it stands; a task aligns a unit once.

1. A first pass aligns all texts and stores how often each batch links each pair of ids.
2. The distinct pairs are dealt to shards; each shard builds levels of bits in which a pair that is alone in its place
   sets the bit, and others go to the next level. A pair's index is the rank of its bit. Pairs are kept in the order
   of their index, which tells a pair that isn't one of them.
3. Stored counts are added up in dense vectors by index, and the vectors summed in a tree.
4. A second pass aligns the texts again and looks the counts up.

The table is broadcast in slices of a bounded size; where it has several, texts are aligned once for each.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import mix, stored

#: Distinct pairs of a shard, pairs of a broadcast slice (some 17 bytes each), counts of a segment, vectors summed at once.
SHARD_PAIRS, SLICE_PAIRS, SEGMENT, FAN = 1 << 17, 4 << 20, 1 << 16, 16
#: Bits of a level for each pair that is left, and levels at most.
SPREAD, LEVELS = 1.6, 48
#: Units that a task keeps, and bytes of them.
KEPT_UNITS, KEPT_BYTES = 300_000, 32 << 20
#: Bytes of texts whose results are sent on at once.
SENT_BYTES = 4 << 20
_B_BITS = 16
#: Where a text is cut into units; white space ahead of a cut hinders the quick way of cutting.
_CUTS, _GAPS = re.compile(r"(?<=\S)(?=[ \n])"), re.compile(r"\s[ \n]")
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Both tokenizers with the bytes of each id, and the units aligned so far."""

    _known: dict[tuple[str, str], Tokenizers] = {}

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Tokenizers:
        if (a_path, b_path) not in cls._known:
            cls._known[a_path, b_path] = cls(a_path, b_path)
        return cls._known[a_path, b_path]

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        with open(a_path, encoding="utf-8") as f:
            file = json.load(f)
        self.encode_a, a_bytes = _byte_level(file)
        self.a_size = np.array([len(x) for x in a_bytes], np.int64)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        # Ids with what follows them in groups, of A then of B: another id of the side, or the side's end.
        n, m = len(a_bytes), len(pieces)
        self.shown = np.array([f"{k}{x}" for size, marks in ((n, ",|"), (m, ",;")) for x in marks for k in range(size)], dtype=object)
        self._shown_at = (0, n, 2 * n, 2 * n + m)
        if len(pieces) >= 1 << _B_BITS or any("▁" in x.lstrip("▁") or "\n" in x for x in pieces):
            raise ValueError("B's pieces must have their spaces at the front and no line feeds, and ids below 65,536")
        self._letter = len(self.b.encode("a"))
        self.clear()

    def clear(self) -> None:
        """Forget all units. A unit's row of ``sums``: tokens of A and of B, groups, links, best links, sum of counts, and whether its bytes differ."""
        self.codes: dict = {}
        self.links: list[np.ndarray] = []
        self.groups: list[str] = []
        self.sums = np.zeros((1 << 12, 7), np.int64)
        self.size = 0

    def full(self) -> bool:
        return len(self.codes) > KEPT_UNITS or self.size > KEPT_BYTES

    def add(self, docs: list[list], with_groups: bool) -> tuple[int, np.ndarray]:
        """Align the units that aren't known yet; the number of those known before, and the links of the new ones."""
        known = len(self.codes)
        new = [k for k in dict.fromkeys(itertools.chain.from_iterable(docs)) if k not in self.codes]
        self.codes.update(zip(new, range(known, known + len(new)), strict=True))
        units = [_unit(k) for k in new]
        # B adds the space that a unit begins with; where there is none, or nothing else, a letter ahead keeps it from adding one.
        quick = [u[0] == " " and bool(u.strip(" ")) for u in units]
        b = self.b.encode([u[1:] if q else "a" + u for u, q in zip(units, quick, strict=True)], num_threads=1) if units else []
        b = [x if q else x[self._letter :] for x, q in zip(b, quick, strict=True)]
        a = [*map(self.encode_a, units)]
        sums, links, groups = self._align([u.encode() for u in units], a, b, with_groups)
        while len(self.sums) < known + len(new):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[known : known + len(new)] = sums
        self.links.append(links)
        self.groups += groups
        self.size += sum(map(len, units))
        return known, links

    def _align(self, raw: list[bytes], a: list[list[int]], b: list[list[int]], with_groups: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Rows of ``sums``, the links of all units one after the other, and the groups of each.

        The units stand in a row as one text. Each stretch between two ends of tokens, of either side, is one link: of the
        tokens that cover it.
        """
        n = len(raw)
        flat = [np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (a, b)]
        owner = [np.repeat(np.arange(n), [len(x) for x in side]) for side in (a, b)]
        size = [self.a_size[flat[0]], self.b_size[flat[1]]]
        want = np.array([len(x) for x in raw], np.int64)
        differs = np.zeros(n, bool)
        for k in (0, 1):
            differs |= np.bincount(owner[k], size[k], n).astype(np.int64) != want
        for k, (text, ids) in enumerate(zip(raw, b, strict=True)):
            if not differs[k] and b"".join([self.b_bytes[i] for i in ids]) != text:
                differs[k] = True
        for k in (0, 1):
            keep = ~differs[owner[k]]
            flat[k], owner[k], size[k] = flat[k][keep], owner[k][keep], size[k][keep]
        ends = [np.cumsum(x) for x in size]
        every = np.union1d(*ends)
        at = [np.searchsorted(e, every) for e in ends]
        links = flat[0][at[0]] << _B_BITS | flat[1][at[1]]
        of = owner[0][at[0]]
        common = np.isin(ends[0], ends[1], assume_unique=True)
        sums = np.zeros((n, 7), np.int64)
        for k, x in enumerate((owner[0], owner[1], owner[0][common], of)):
            sums[:, k] = np.bincount(x, minlength=n)
        sums[:, 6] = differs
        if not with_groups:
            return sums, links, []
        # Groups end at common ends; ids of A come first in each.
        last = [common, np.isin(ends[1], ends[0], assume_unique=True)]
        number = [np.cumsum(x) - x for x in last]
        order = np.argsort(np.concatenate([2 * number[0], 2 * number[1] + 1]), kind="stable")
        which = np.concatenate([flat[0] + np.where(last[0], self._shown_at[1], self._shown_at[0]), flat[1] + np.where(last[1], self._shown_at[3], self._shown_at[2])])
        shown = self.shown[which[order]].tolist()
        bounds = np.append(0, np.cumsum(sums[:, 0] + sums[:, 1])).tolist()
        return sums, links, ["".join(shown[i:j])[:-1] for i, j in itertools.pairwise(bounds)]


def _byte_level(file: dict):
    """(encode, bytes of each id) of a byte-level BPE file of the tokenizers library.

    Where the order of merges is that of ids, as usual, the ids are ranks, by which tiktoken merges alike and faster.
    """
    model, cut = file["model"], file["pre_tokenizer"] or {}
    shown = _byte_symbols()
    raw = lambda t: bytes(shown[ch] for ch in t) if all(ch in shown for ch in t) else t.encode()
    tokens = model["vocab"] | {t["content"]: t["id"] for t in file["added_tokens"]}
    by_id = [b""] * (max(tokens.values()) + 1)
    for t, i in tokens.items():
        by_id[i] = raw(t)
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    special = {t["content"] for t in file["added_tokens"] if t["special"]}
    alike = model["type"] == "BPE" and not file["normalizer"] and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and special == {t["content"] for t in file["added_tokens"]}
    if alike and not model.get("ignore_merges") and not model.get("dropout") and all(model["vocab"].get(m) == 256 + k for k, m in enumerate(merges)):
        import tiktoken

        ranks = {raw(t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("own", pat_str=_PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, by_id
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(json.dumps(file))
    own.encode_special_tokens = True
    own.no_truncation()
    own.no_padding()
    return lambda unit: own.encode(unit, add_special_tokens=False).ids, by_id


def _byte_symbols() -> dict[str, int]:
    """The byte for each symbol of byte-level vocabularies: printable bytes stand for themselves, others come after 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _unit(key) -> str:
    """The unit that a key stands for: most begin with a space, which is left out."""
    return key[0] if isinstance(key, tuple) else key if key[:1] == "\n" else " " + key


def _keys(raw: bytes | None) -> list:
    """Keys of the units of a space and the text; none for a null or empty text, or for bytes that aren't UTF-8.

    A unit begins with the space or line feed after anything but white space.
    """
    if not raw:
        return []
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return []
    if not _GAPS.search(" " + text):
        return text.replace("\n", " \n").split(" ")
    return [u if u[0] == "\n" else u[1:] if u[1:2] != "\n" else (u,) for u in _CUTS.split(" " + text)]


def _runs(texts: list[bytes | None]) -> Iterator[tuple[int, list[list]]]:
    """Runs of texts of a bounded size: the first one's number and the keys of each."""
    first, size, part = 0, 0, []
    for k, raw in enumerate(texts):
        part.append(_keys(raw))
        size += len(raw or b"")
        if size >= SENT_BYTES:
            yield first, part
            first, size, part = k + 1, 0, []
    if part:
        yield first, part


def _coded(docs: list[list], of: Tokenizers) -> Iterator[list[int]]:
    """Codes of each text's units; none where one of them doesn't keep its bytes."""
    get = of.codes.__getitem__
    differs = of.sums[:, 6]
    for d in docs:
        codes = [*map(get, d)]
        yield [] if codes and differs[codes].any() else codes


def _counted(a_path: str, b_path: str):
    """(pair, n): how often a task links each pair of ids, a row for each pair and some KEPT_UNITS units."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Tokenizers.of(a_path, b_path)
        of.clear()
        times = np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            links, sizes = np.concatenate([np.zeros(0, np.int64), *of.links]), of.sums[: len(of.codes), 3]
            pairs, place = np.unique(links, return_inverse=True)
            sums = np.bincount(place, np.repeat(np.pad(times, (0, len(sizes) - len(times))), sizes), len(pairs)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[sums > 0]), pa.array(sums[sums > 0])], names=["pair", "n"])

        for batch in batches:
            for _, docs in _runs(batch.column("text").to_pylist()):
                of.add(docs, False)
                seen = np.bincount(np.fromiter(itertools.chain.from_iterable(_coded(docs, of)), np.int64), minlength=len(times))
                times = seen + np.pad(times, (0, len(seen) - len(times)))
                if of.full():
                    yield rows()
                    of.clear()
                    times = np.zeros(0, np.int64)
        yield rows()

    return count


def _shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (mix(pairs.astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _slot(pairs: np.ndarray, level: int) -> np.ndarray:
    return mix(pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD1B54A32D192ED03 % (1 << 64)))


def _dealt(shards: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("pair"), pa.array(_shard(batch.column("pair").to_numpy(), shards).astype(np.int32))], names=["pair", "shard"])

    return deal


def build(pairs: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all bits, the pairs in the order of their bits) of distinct pairs."""
    sizes, bits, order, left = [], [], [], pairs
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("pairs are not distinct")
        size = 64 * math.ceil(SPREAD * len(left) / 64)
        slot = (_slot(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(slot, minlength=size) == 1
        placed = alone[slot]
        order.append(left[placed][np.argsort(slot[placed])])
        sizes.append(size)
        bits.append(alone)
        left = left[~placed]
    return sizes, np.concatenate([np.zeros(0, bool), *bits]), np.concatenate([np.zeros(0, np.int64), *order])


def _built(group: pa.Table) -> pa.Table:
    sizes, bits, order = build(group["pair"].to_numpy())
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "sizes": pa.array([sizes], pa.list_(pa.int32())), "bits": pa.array([packed], pa.binary()), "pairs": pa.array([order.tobytes()], pa.binary())})


class PairIndex:
    """Minimal perfect hash over the pairs of some shards: each has an index of its own below their number."""

    def __init__(self, shards: int, rows: list[tuple[int, list[int], bytes, bytes]]):
        """rows: (shard, sizes, bits, pairs) of ``build``."""
        self.shards = shards
        self.sizes = np.ones((shards, LEVELS), np.int64)
        self.begin = np.zeros((shards, LEVELS), np.int64)
        self.levels = np.zeros(shards, np.int64)
        words, pairs, at = [], [], 0
        for shard, sizes, bits, keys in sorted(rows):
            self.levels[shard] = len(sizes)
            self.sizes[shard, : len(sizes)] = sizes
            self.begin[shard, : len(sizes)] = at + np.cumsum([0, *sizes[:-1]])
            at += sum(sizes)
            words.append(np.frombuffer(bits, np.uint64))
            pairs.append(np.frombuffer(keys, np.int64))
        self.words = np.concatenate([np.zeros(0, np.uint64), *words])
        self.pairs = np.concatenate([np.zeros(0, np.int64), *pairs])
        self.before = np.cumsum(np.bitwise_count(self.words), dtype=np.int64) - np.bitwise_count(self.words)

    def __len__(self) -> int:
        return len(self.pairs)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The index of each pair; -1 for pairs that aren't held, as their key tells."""
        out = np.full(len(pairs), -1, np.int64)
        shard = _shard(pairs, self.shards)
        left = np.flatnonzero(self.levels[shard] > 0)
        for level in range(LEVELS):
            if not len(left):
                break
            s = shard[left]
            place = self.begin[s, level] + (_slot(pairs[left], level) % self.sizes[s, level].astype(np.uint64)).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            index = self.before[place >> 6] + np.bitwise_count(below)
            out[left[hit]] = index[hit]
            left = left[~hit & (self.levels[s] > level + 1)]
        held = out >= 0
        wrong = np.flatnonzero(held)[self.pairs[out[held]] != pairs[held]]
        out[wrong] = -1
        return out


def _vectors(index):
    """(part, segment, counts): each task's dense vector of counts by index, in segments; those of zeros are left out."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = index.value
        total = np.zeros(-(-len(of) // SEGMENT) * SEGMENT, np.int64)
        for batch in batches:
            at = of.find(batch.column("pair").to_numpy())
            np.add.at(total, at[at >= 0], batch.column("n").to_numpy()[at >= 0])
        part = TaskContext.get().partitionId()
        for k in range(len(total) // SEGMENT):
            x = total[k * SEGMENT : (k + 1) * SEGMENT]
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["part", "segment", "counts"])

    return add


def _summed(group: pa.Table) -> pa.Table:
    total = np.zeros(SEGMENT, np.int64)
    for x in group["counts"]:
        total += np.frombuffer(x.as_buffer(), np.int64)
    return pa.table({"part": group["part"][:1], "segment": group["segment"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _slices(spark, partial: DataFrame):
    """(shards, shards of each slice, index rows) of the distinct pairs of ``partial``."""
    distinct = stored(partial.select("pair").distinct(), "pairs")
    n = distinct.count()
    shards = max(1, -(-n // SHARD_PAIRS))
    dealt = distinct.mapInArrow(_dealt(shards), "pair long, shard int")
    rows = stored(dealt.groupBy("shard").applyInArrow(_built, "shard int, sizes array<int>, bits binary, pairs binary"), "index")
    sizes = rows.select("shard", (F.octet_length("pairs") / 8).cast("long").alias("n")).orderBy("shard").collect()  # SHARD_PAIRS pairs a row
    slices: list[list[int]] = [[]]
    held = 0
    for r in sizes:
        if held + r["n"] > SLICE_PAIRS and slices[-1]:
            slices.append([])
            held = 0
        slices[-1].append(r["shard"])
        held += r["n"]
    return shards, slices, rows


def _tables(spark, partial: DataFrame) -> Iterator[tuple[PairIndex, np.ndarray]]:
    """The index and the counts of the pairs of each slice."""
    shards, slices, rows = _slices(spark, partial)
    for part in slices:
        got = [tuple(r) for r in rows.filter(F.col("shard").isin(part)).select("shard", "sizes", "bits", "pairs").collect()] if part else []
        index = PairIndex(shards, got)
        shared = spark.sparkContext.broadcast(index)
        vectors, parts = partial.mapInArrow(_vectors(shared), "part long, segment int, counts binary"), partial.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // FAN)
            vectors = vectors.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "segment").applyInArrow(_summed, "part long, segment int, counts binary")
        counts = np.zeros(-(-len(index) // SEGMENT) * SEGMENT, np.int64)
        for r in vectors.toLocalIterator():  # as many counts as the slice has pairs
            counts[r["segment"] * SEGMENT : (r["segment"] + 1) * SEGMENT] += np.frombuffer(r["counts"], np.int64)
        shared.unpersist()
        yield index, counts[: len(index)]


def _looked_up(a_path: str, b_path: str, table):
    """Align each text and look up the counts of its links."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Tokenizers.of(a_path, b_path)
        of.clear()
        index, counts, best = table.value
        for batch in batches:
            for first, docs in _runs(batch.column("text").to_pylist()):
                if of.full():
                    of.clear()
                known, links = of.add(docs, True)
                sizes = of.sums[known : len(of.codes), 3]
                at = index.find(links)
                count = np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(links), np.int64)
                top = (at >= 0) & (count == best[links & ((1 << _B_BITS) - 1)])
                ends = np.append(0, np.cumsum(sizes))
                for column, x in ((4, top), (5, count)):
                    of.sums[known : known + len(sizes), column] = np.diff(np.append(0, np.cumsum(x.astype(np.int64)))[ends])
                sums, groups, text = np.zeros((len(docs), 6), np.int64), [], of.groups.__getitem__
                for k, codes in enumerate(_coded(docs, of)):
                    if codes:
                        sums[k] = of.sums[codes, :6].sum(axis=0)
                    groups.append(";".join(map(text, codes)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first : first + len(docs)], *(pa.array(sums[:, k]) for k in range(6)), pa.array(groups, pa.string())], names=["doc_id", *_SUMS, "groups"])

    return align


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in _SUMS) + ", groups string"


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _partial(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return stored(docs.select("text").mapInArrow(_counted(a_path, b_path), "pair long, n long"), "links")


def pair_counts(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(A ids, B ids, counts) of the linked pairs of all texts, a slice of SLICE_PAIRS pairs at a time."""
    for index, counts in _tables(df.sparkSession, _partial(_docs(df, id_col, text_col), a_path, b_path)):
        yield index.pairs >> _B_BITS, index.pairs & ((1 << _B_BITS) - 1), counts


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each row.

    A space and the text are encoded by the byte-level tokenizer A and by the piece model B (which adds the space).
    Offsets where tokens of both end cut them into groups; links are all pairs of tokens whose bytes overlap. The count
    of a pair of ids is the number of links that hold it in all texts; n_best counts the links whose count is the highest
    of their B id, count_sum adds the counts up. ``groups``: ``a1,a2|b1;a3|b2,b3``, ids in order.

    Texts that are null, empty, no UTF-8, or that one of the tokenizers doesn't give back byte by byte have no tokens:
    zeros and empty groups. Null and repeated ids are kept, one row for each input row, and each row counts; other columns
    are left out. An empty table gives no rows. The files must lie at the same paths on all machines.
    """
    spark = df.sparkSession
    docs = _docs(df, id_col, text_col)
    partial = _partial(docs, a_path, b_path)
    best, folder = np.zeros(1 << _B_BITS, np.int64), []
    for index, counts in _tables(spark, partial):
        np.maximum.at(best, index.pairs & ((1 << _B_BITS) - 1), counts)
        folder.append((index, counts))
    parts = [docs.mapInArrow(_looked_up(a_path, b_path, spark.sparkContext.broadcast((index, counts, best))), _RESULT) for index, counts in folder]
    if len(parts) == 1:
        return parts[0]
    same = [c.split()[0] for c in _RESULT.split(", ") if c.split()[0] not in ("n_best", "count_sum")]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    # Equal rows have equal sums, so that each has its share of theirs.
    out = every.groupBy(*same).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.count(F.lit(1)).alias("rows"))
    copies = F.expr(f"rows div {len(parts)}")
    return out.withColumn("copies", copies).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.expr("n_best div copies").alias("n_best"), F.expr("count_sum div copies").alias("count_sum"), "groups")
