"""BPE encoding and decoding that reuses content-defined chunks.

Texts are cut where a rolling hash of the last bytes says so, so that a passage that stands in several
documents is cut alike in each of them. Chunks that occur more than once are encoded once, in one place, and
their ids are sent to the documents that hold them. Documents encode what is theirs alone. A cut may fall
inside a word: each join of two chunks is repaired by encoding a window around it anew, widened until the
window's ids agree with the ids on both sides.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelog.llm.common import blocks, stored, tidy

#: The rolling hash sees so many bytes; a chunk has this many bytes on average, and at most the greatest number.
WINDOW, AVERAGE, GREATEST = 32, 512, 8192
LEAST = 128
#: Least and most bits of the sketch of repeated chunk hashes, and bits for each of these chunks between them. A chunk
#: that is in it by accident is encoded apart and sent, no more.
SKETCH_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 28, 16
_BITMAP_BITS = 8 * 4096
DIGEST = 12
#: Encoded words that a worker remembers in each of two generations.
WORDS_KEPT = 100_000
_GEAR = np.random.default_rng(20240701).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Chunk edges of each text (first 0, last its length), never inside a UTF-8 sequence.

    The rolling hash is the sum of a random number of each of the last WINDOW bytes, shifted by the byte's distance;
    it is summed up by doubling.
    """
    rolled, k = _GEAR[data], 1
    while k < WINDOW:
        rolled[k:] += rolled[:-k] << np.uint32(k)
        k *= 2
    found = np.flatnonzero(rolled < np.uint32((1 << 32) // AVERAGE)) + 1
    out = []
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        edges, last = [0], begin
        for place in [*found[np.searchsorted(found, begin + WINDOW) : np.searchsorted(found, end)].tolist(), end]:
            if place != end and place - last < LEAST:
                continue
            while place - last > GREATEST:
                step = last + GREATEST
                while step > last + 1 and data[step] & 0xC0 == 0x80:
                    step -= 1
                edges.append(step - begin)
                last = step
            while place < end and data[place] & 0xC0 == 0x80:
                place += 1
            if place > last:
                edges.append(place - begin)
                last = place
        out.append(np.array(edges))
    return out


def chunk_digest(chunk: bytes) -> bytes:
    """96 bits, so that different chunks don't meet by chance in a large corpus."""
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


class Encoder:
    """Encodes and decodes with one tokenizer file, remembering words.

    White space (the six ASCII characters) must be dropped by the tokenizer and part what stands beside it, so that
    a text's ids are those of its words in order; and there must be no decoder. Other files are refused.
    """

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        if self.tokenizer.decoder is not None or ids(" \ta\n\r\x0b\x0cb ") != ids("a") + ids("b"):
            raise ValueError(f"{path}: a tokenizer that drops white space and has no decoder is needed")
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.pieces, self.special = _ascii_pieces(json.loads(self.tokenizer.to_str()))

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def learn(self, words: set[bytes]) -> None:
        """Encode the words not yet known. Words that come up again stay known when a new generation begins."""
        if len(self.words) > WORDS_KEPT:
            self.words, self.before = {}, self.words
        known, before, new, ids = self.words, self.before, [], {}
        tokenize, pieces, special = self.tokenizer.model.tokenize, self.pieces, self.special
        for w in words:
            if w in known:
                continue
            if w in before:
                known[w] = before[w]
            elif pieces and w.isascii() and (text := w.decode()).isprintable() and not special(text):
                # Printable ASCII is cut by the tokenizer's pattern, and its pieces go to the model one by one.
                whole = b""
                for piece in pieces(text.lower()):
                    if piece not in ids:
                        ids[piece] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(piece)])
                    whole += ids[piece]
                known[w] = whole
            else:
                new.append(w)
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        return [b"".join([self.words[w] for w in ws]) for ws in split]

    def decode(self, ids: bytes) -> str:
        """The tokenizer's decode without a decoder part: the tokens, parted by spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def _ascii_pieces(file: dict):
    """(how the file's pattern cuts a word of printable, lower-case ASCII; whether a text holds a special token).

    None for files whose steps ahead of the model do more to such a word than to lower it, cut it by one pattern
    and map its bytes to characters.
    """
    steps = lambda part, many: (part or {}).get(many, [part] if part else [])
    normal, cut = steps(file["normalizer"], "normalizers"), steps(file["pre_tokenizer"], "pretokenizers")
    special = re.compile("|".join(re.escape(t["content"]) for t in file["added_tokens"]) or "(?!)").search
    plain = {x["type"] for x in normal} in ({"NFC", "Lowercase"}, {"NFC", "Lowercase", "Replace"}) and all(x["pattern"] == {"Regex": r"\s+"} for x in normal if x["type"] == "Replace")
    split = [x for x in cut if x["type"] == "Split"]
    if not plain or [x["type"] for x in cut] != ["Split", "ByteLevel"] or file["post_processor"] or not (split[0]["invert"] and split[0]["behavior"] == "Removed" and "Regex" in split[0]["pattern"]) or cut[1]["use_regex"] or cut[1]["add_prefix_space"]:
        return None, special
    return re.compile(split[0]["pattern"]["Regex"].replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall, special


def _plain(byte: int) -> bool:
    return byte not in b" \t\n\r\x0b\x0c"


def joined(text: bytes, edges: list[int], parts: list[bytes], encode) -> bytes:
    """The ids of ``text`` from the ids of its chunks.

    Around each edge a window is encoded anew, from the start of the word before it to the end of the word after
    it. The window holds if its left rest ends the ids so far and its right rest begins the next chunk's ids; if
    not, it is widened by a word on both sides, at last to both chunks.
    """
    out = bytearray(parts[0])
    for k in range(1, len(parts)):
        edge, end, part = edges[k], edges[k + 1], parts[k]
        left = right = edge
        if left and _plain(text[left - 1]) and _plain(text[right]):
            while True:
                while left and _plain(text[left - 1]):
                    left -= 1
                while right < end and _plain(text[right]):
                    right += 1
                before, after, window = encode([text[left:edge], text[edge:right], text[left:right]])
                if out.endswith(before) and part.startswith(after):
                    out[len(out) - len(before) :] = window
                    part = part[len(after) :]
                    break
                if not left and right == end:
                    out[:], part = window, b""
                    break
                while left and not _plain(text[left - 1]):
                    left -= 1
                while right < end and not _plain(text[right]):
                    right += 1
        out += part
    return bytes(out)


def _repeated(chunks: DataFrame) -> bytes:
    """Bitmap of the chunks that occur more than once; its size follows from their number, within bounds."""
    seen = stored(chunks.groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1").select("digest"), "repeated")
    size = min(MOST_BITS, max(SKETCH_BITS, 1 << (seen.count() * BITS_EACH).bit_length()))
    bit = F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(size))
    rows = (
        seen.select(F.floor(bit / _BITMAP_BITS).cast("int").alias("bucket"), F.pmod(bit, F.lit(_BITMAP_BITS)).alias("bit"))
        .groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).toLocalIterator()
    )
    out = bytearray(size // 8)
    for r in rows:
        out[r["bucket"] * 4096 : r["bucket"] * 4096 + 4096] = r["bits"]
    return bytes(out)


def _in(bits: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Which chunks are in the sketch; the first six bytes of a digest are its number there."""
    first = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, DIGEST)[:, :6].astype(np.int64)
    place = (first << np.arange(40, -1, -8)).sum(axis=1) % (8 * len(bits))
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _chunked(column: pa.Array) -> Iterator[tuple[int, list[tuple[bytes, list[int], list[bytes]]]]]:
    """For each block of rows: its first row, and (text, edges, chunk digests) of each."""
    for first, _, data, offsets in blocks(column):
        whole, rows = data.tobytes(), []
        for begin, end, edges in zip(offsets[:-1].tolist(), offsets[1:].tolist(), cuts(data, offsets), strict=True):
            text, e = whole[begin:end], edges.tolist()
            rows.append((text, e, [chunk_digest(text[i:j]) for i, j in zip(e[:-1], e[1:], strict=True)]))
        yield first, rows


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key and chunk digests, one after the other, of each row."""
    for batch in batches:
        for first, rows in _chunked(batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("key")[first : first + len(rows)], pa.array([b"".join(r[2]) for r in rows], pa.binary())], names=["key", "digests"])


def _parted(digests: bytes) -> list[bytes]:
    return [digests[k : k + DIGEST] for k in range(0, len(digests), DIGEST)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(d for x in batch.column("digests").to_pylist() for d in _parted(x))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])


def _shared_chunks(bits):
    """Each block's chunks that may be repeated, once a block, with their texts."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            for _, rows in _chunked(batch.column("text")):
                got: dict[bytes, bytes] = {}
                for text, edges, digests in rows:
                    for k in np.flatnonzero(_in(sketch, digests)).tolist():
                        got[digests[k]] = text[edges[k] : edges[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.binary())], names=["digest", "chunk"])

    return find


def _places(bits):
    """(key, digest) of the distinct repeated chunks of each document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            held = set()
            for key, digests in zip(*(batch.column(c).to_pylist() for c in ("key", "digests")), strict=True):
                parts = _parted(digests)
                held.update((key, parts[i]) for i in np.flatnonzero(_in(sketch, parts)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.binary())], names=["key", "digest"])

    return find


def _encode_chunks(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            ids = encoder.encode([x.as_py() for x in batch.column("chunk")])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([_packed(x) for x in ids], pa.binary())], names=["digest", "ids"])

    return encode


def _packed(ids: bytes) -> bytes:
    """Ids as 16-bit values where they fit (first byte 2), else as 32-bit ones (4)."""
    x = np.frombuffer(ids, dtype="<u4")
    return b"\2" + x.astype("<u2").tobytes() if not len(x) or x.max() < 65536 else b"\4" + ids


def _unpacked(ids: bytes) -> bytes:
    return np.frombuffer(ids, dtype="<u2", offset=1).astype("<u4").tobytes() if ids[0] == 2 else ids[1:]


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
OUTPUT = f"{RESULT}, ids binary"


def _rows(keys: pa.Array, encoder: Encoder, encoded: list[bytes], with_ids: bool) -> dict[str, pa.Array]:
    return {
        "doc_id": keys,
        "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in encoded], pa.string()),
    } | ({"ids": pa.array(encoded, pa.binary())} if with_ids else {})


def _own(path: str, bits, with_ids: bool):
    """Documents without repeated chunks are done here; the texts of the others go on, compressed."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sketch, pack = Encoder.of(path), np.frombuffer(bits.value, dtype=np.uint8), zstandard.ZstdCompressor(3)
        for batch in batches:
            for first, rows in _chunked(batch.column("text")):
                alone = [not _in(sketch, digests).any() for _, _, digests in rows]
                encoded = iter(encoder.encode([r[0] for r, a in zip(rows, alone, strict=True) if a]))
                done = [next(encoded) if a else b"" for a in alone]
                out = _rows(batch.column("doc_id")[first : first + len(rows)], encoder, done, with_ids)
                yield pa.RecordBatch.from_pydict({"key": batch.column("key")[first : first + len(rows)], "packed": pa.array([None if a else pack.compress(r[0]) for r, a in zip(rows, alone, strict=True)], pa.binary())} | out)

    return encode


def _joined(path: str, with_ids: bool):
    """Put the ids of the repeated chunks together with those of the runs between them."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, unpack = Encoder.of(path), zstandard.ZstdDecompressor()
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                out = {k: part.column(k) for k in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")} | ({"ids": part.column("ids")} if with_ids else {})
                open_rows = [k for k, x in enumerate(part.column("packed")) if x.is_valid]
                if open_rows:
                    texts = [unpack.decompress(part.column("packed")[k].as_py()) for k in open_rows]
                    given = [{x["digest"]: x["ids"] for x in part.column("chunks")[k].as_py() or []} for k in open_rows]
                    plans = []  # of each text: edges of runs, and the given ids or None
                    for text, known in zip(texts, given, strict=True):
                        data = np.frombuffer(text, dtype=np.uint8)
                        edges = cuts(data, np.array([0, len(data)]))[0].tolist()
                        runs, ids = [0], []
                        for i, j in zip(edges[:-1], edges[1:], strict=True):
                            got = known.get(chunk_digest(text[i:j]))
                            if got is None and ids and ids[-1] is None:
                                runs[-1] = j
                            else:
                                runs.append(j)
                                ids.append(got)
                        plans.append((text, runs, ids))
                    fresh = iter(encoder.encode([t[r[k] : r[k + 1]] for t, r, ids in plans for k, x in enumerate(ids) if x is None]))
                    encoded = []
                    for text, runs, ids in plans:
                        parts = [next(fresh) if x is None else _unpacked(x) for x in ids]
                        encoded.append(joined(text, runs, parts, encoder.encode) if parts else b"")
                    rows = _rows(part.column("doc_id").take(pa.array(open_rows)), encoder, encoded, with_ids)
                    out = {k: _put(v, open_rows, rows[k]) for k, v in out.items()}
                yield pa.RecordBatch.from_pydict(out)

    return assemble


def _put(column: pa.Array, places: list[int], values: pa.Array) -> pa.Array:
    picks = np.arange(len(column))
    picks[places] = len(column) + np.arange(len(places))
    return pa.concat_arrays([column, values.cast(column.type)]).take(pa.array(picks))


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row, as the tokenizer encodes its whole text.

    ``ids`` are little-endian unsigned 32-bit values. A null text is empty and has no ids. Null and repeated ids
    are kept, one row for each input row; other columns are left out. An empty table gives no rows. The tokenizer
    file has to lie at the same path on all machines; one that keeps white space or has a decoder is refused.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    digests = stored(docs.select("key", "text").mapInArrow(tidy(_digests), "key long, digests binary"), "digests")
    bits = spark.sparkContext.broadcast(_repeated(digests.select("digests").mapInArrow(tidy(_counted), "digest binary, n long")))
    chunks = docs.select("text").mapInArrow(tidy(_shared_chunks(bits)), "digest binary, chunk binary").groupBy("digest").agg(F.first("chunk").alias("chunk"))
    ids = chunks.mapInArrow(tidy(_encode_chunks(tokenizer_path)), "digest binary, ids binary")
    places = digests.mapInArrow(tidy(_places(bits)), "key long, digest binary").distinct()
    given = places.join(ids, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "ids")).alias("chunks"))
    result = OUTPUT if with_ids else RESULT
    own = docs.mapInArrow(tidy(_own(tokenizer_path, bits, with_ids)), f"key long, packed binary, {result}")
    return own.join(given, "key", "left").drop("key").mapInArrow(tidy(_joined(tokenizer_path, with_ids)), result)


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from the ids that ``encode`` gives; null ids decode to an empty text."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([encoder.decode(x.as_py() or b"") for x in batch.column("ids")], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(tidy(back), "doc_id long, text string")
