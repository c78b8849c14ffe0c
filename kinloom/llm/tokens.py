"""Token-ID output with Elias-Fano boundaries (operator 3).

A dataset is a folder of Parquet files of blocks, in ascending doc_id order or in the order of the files that the texts
come from. A block is one binary value: a header, the Elias-Fano code of its document boundaries, and the concatenated
ids in two or four bytes each. Spark's own writer puts
the files, so a lost executor's files are never seen half-written. Readers take a document's boundaries by select on the
code; there is no table of 64-bit offsets.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialise, place_in_files, prefix_hash, running, shared_path, small, span_hash

#: Ids after which a block is closed, and characters that are split at once.
BLOCK_IDS, CHUNK_CHARS = 1 << 18, 1 << 17
MAGIC = b"KEF1"
_HEADER = struct.Struct("<4sBBHIIQQ")  # magic, id bytes, low bits, sample step, boundaries, samples, high bytes, ids


# Elias-Fano: n ascending values below u keep log2(u / n) low bits each; the rest is a unary code of about 2n bits.


def ef_encode(values: np.ndarray, step: int = 64) -> tuple[int, bytes, bytes, np.ndarray]:
    """(low bits, packed low parts, high bits, positions of every ``step``-th one) of ascending ``values``."""
    n, u = len(values), int(values[-1]) + 1
    low = max(0, (u // n).bit_length() - 1)
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    high[ones] = 1
    return low, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::step].astype("<u4")


class Boundaries:
    """select(i) and all values of an Elias-Fano code, read from a block's bytes."""

    def __init__(self, n: int, low: int, step: int, lows: memoryview, highs: memoryview, samples: np.ndarray):
        self.n, self.low, self.step, self.samples = n, low, step, samples
        self.lows, self.highs = np.frombuffer(lows, np.uint8), np.frombuffer(highs, np.uint8)

    def select(self, i: int) -> int:
        """Value i: from the sample before it, count ones byte by byte to the i-th."""
        at = int(self.samples[i // self.step])
        left, byte = i % self.step, at // 8
        now = int(self.highs[byte]) >> (at % 8) << (at % 8)
        while (c := now.bit_count()) <= left:
            left, byte = left - c, byte + 1
            now = int(self.highs[byte])
        for _ in range(left):
            now &= now - 1
        high = byte * 8 + (now & -now).bit_length() - 1 - i
        bit, end = i * self.low, (i + 1) * self.low
        lows = int.from_bytes(self.lows[bit // 8 : (end + 7) // 8].tobytes(), "little") >> bit % 8
        return high << self.low | lows & (1 << self.low) - 1

    def span(self, i: int) -> tuple[int, int]:
        """Where document i begins and ends: two selects."""
        return self.select(i), self.select(i + 1)

    def all(self) -> np.ndarray:
        ones = np.nonzero(np.unpackbits(self.highs, bitorder="little"))[0][: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low).astype(np.int64)
        return (ones << self.low) + (bits << np.arange(self.low)).sum(axis=1)


def pack(documents: list[np.ndarray], id_bytes: int) -> bytes:
    """A block of documents' ids."""
    ends = np.zeros(len(documents) + 1, dtype=np.uint64)
    np.cumsum([len(d) for d in documents], out=ends[1:])
    low, lows, highs, samples = ef_encode(ends)
    ids = np.concatenate(documents).astype(f"<u{id_bytes}")
    return _HEADER.pack(MAGIC, id_bytes, low, 64, len(ends), len(samples), len(highs), len(ids)) + lows + highs + samples.tobytes() + ids.tobytes()


def unpack(block: bytes) -> tuple[Boundaries, np.ndarray]:
    """The boundaries (one more than documents) and the ids of a block."""
    magic, id_bytes, low, step, n, n_samples, n_high, n_ids = _HEADER.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    view, at, n_low = memoryview(block), _HEADER.size, (n * low + 7) // 8
    lows, highs = view[at : at + n_low], view[at + n_low : at + n_low + n_high]
    at += n_low + n_high
    samples = np.frombuffer(block, "<u4", n_samples, at)
    ids = np.frombuffer(block, f"<u{id_bytes}", n_ids, at + samples.nbytes)
    return Boundaries(n, low, step, lows, highs, samples), ids


# Encoding. A byte-level BPE encodes each piece of its split pattern by itself, so pieces are found for many documents at
# once with array operations, and each distinct piece is given to the tokenizer once.

_LETTER, _NUMBER, _SPACE, _OTHER, _END = 1, 2, 3, 4, 5
_KNOWN = 0x2100
#: No piece goes over the place between what isn't white space and a space or line feed.
_CUT = re.compile(r"(?<=\S)[ \n]")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point in the split pattern; 0: texts that hold it go to the tokenizer whole."""
    out = np.zeros(_KNOWN + 1, dtype=np.uint8)
    for c in range(_KNOWN):
        kind = unicodedata.category(chr(c))
        if c in (9, 10, 11, 12, 13, 32):
            out[c] = _SPACE
        elif kind[0] in "PS" or kind[0] in "LN" and c < 0x500:
            out[c] = {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)
    out[0] = _END
    return out


def usual_characters() -> np.ndarray:
    """True for each code point whose class in the split pattern is beyond doubt."""
    found = _classes() > 0
    found[0] = found[_KNOWN] = False
    return found


@lru_cache(1)
def _table() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, _KNOWN + 1, dtype=np.uint64)


def split_starts(cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Where pieces of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+`` start; 0 ends a document."""
    start = np.empty(len(cp), dtype=bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start |= cls == _END
    space = cls == _SPACE
    last = np.nonzero(space[:-1] & ~space[1:] & (cls[1:] != _END))[0]  # a run's last space goes with what follows, or stands alone
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    quotes = np.nonzero((cp == 39) & start)[0]
    if len(quotes):
        a, b = cp[quotes + 1], cp[np.minimum(quotes + 2, len(cp) - 1)]
        two = np.isin(a, [ord(x) for x in "stmd"])
        three = (a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108)
        start[quotes[two | three] + 1] = False
        start[quotes[two] + 2] = True
        start[quotes[three] + 3] = True
    return start


#: Masks of the first so many bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _same_pieces(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each piece [start, end) of ``cp``, first piece of each code); pieces share a code only if they are equal.

    Hashes propose which are; the code points of each are then held against the first's, and those that differ get a code of
    their own.
    """
    code, _ = pd.factorize(span_hash(prefix_hash(cp, _table()), start, end))
    first = np.zeros(code.max(initial=-1) + 1, dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    again = np.nonzero(first[code] != np.arange(len(code)))[0]
    of = first[code[again]]
    size = end[again] - start[again]
    unlike = size != end[of] - start[of]
    alike = np.nonzero(~unlike)[0]
    if len(cp) and cp.max() < 256:
        # Eight characters at each place, as one number: the first and the last eight are all of a piece of up to sixteen.
        eight = np.ndarray(len(cp), "<u8", cp.astype(np.uint8).tobytes() + bytes(8), strides=(1,)).copy()
        x, y, n = start[again[alike]], start[of[alike]], size[alike]
        unlike[alike] = ((eight[x] ^ eight[y]) & _FIRST[np.minimum(n, 8)]) != 0
        last = np.maximum(n - 8, 0)
        unlike[alike] |= (n > 8) & (eight[x + last] != eight[y + last])
        alike = alike[n > 16]
    if len(alike):
        n = size[alike]
        at = np.repeat(start[again[alike]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        other = np.nonzero(cp[at] != cp[at + np.repeat(start[of[alike]] - start[again[alike]], n)])[0]
        unlike[alike[np.unique(np.searchsorted(np.cumsum(n), other, "right"))]] = True
    wrong = again[unlike]
    if len(wrong):
        code[wrong] = len(first) + np.arange(len(wrong))
        first = np.concatenate([first, wrong])
    return code, first


class Known:
    """Ids of pieces, side by side: what is known of a piece is its number, where its ids start, and how many they are."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.offset, self.length, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def put(self, pieces: list[str], ids: np.ndarray, length: np.ndarray) -> None:
        """New pieces with their ids, one after another, and how many each has."""
        k, n = len(self.known), len(pieces)
        if k + n > len(self.offset):
            self.offset, self.length = np.resize(self.offset, 2 * (k + n)), np.resize(self.length, 2 * (k + n))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.offset[k : k + n], self.length[k : k + n] = self.used + np.cumsum(length) - length, length
        self.used += len(ids)
        self.known.update(zip(pieces, range(k, k + n), strict=True))

    def ids(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces with these numbers, one after another, and how many each has."""
        length = self.length[of]
        before = np.cumsum(length) - length
        return self.flat[np.repeat(self.offset[of] - before, length) + np.arange(length.sum())], length


class Encoder(Known):
    """Encodes lists of texts as the tokenizer does, without special tokens."""

    def __init__(self, path: str, most_pieces: int = 400_000):
        self.tok = Tokenizer.from_file(path)
        config = self.tok.pre_tokenizer.__getstate__() if self.tok.pre_tokenizer else b""
        self.by_piece = self.tok.normalizer is None and b'"ByteLevel"' in config and b'"add_prefix_space":false' in config and b'"use_regex":true' in config
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        super().__init__(most_pieces)

    def _learn(self, pieces: list[str]) -> None:
        """Pieces that start with a space are encoded many in a string: there, and nowhere else, a token starts with a space."""
        plain, rest = [], []
        for p in pieces:
            (plain if p[0] == " " and len(p) > 1 and not p[1].isspace() else rest).append(p)
        joined = self.tok.encode_batch_fast(["".join(plain[at : at + 64]) for at in range(0, len(plain), 64)], add_special_tokens=False)
        ids = np.array([i for e in joined for i in e.ids], dtype=np.uint32)
        self.put(plain, ids, np.diff(np.nonzero(self.spaced[ids])[0], append=len(ids)))
        found = [e.ids for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
        self.put(rest, np.array([i for x in found for i in x], dtype=np.uint32), np.array([len(x) for x in found], dtype=np.int64))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_piece:
            return self._whole(texts)
        odd = [("\0" in t) or any(s in t for s in self.special) for t in texts]
        joined = "".join("\0" if o else t + "\0" for t, o in zip(texts, odd, strict=True))
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cls = _classes()[np.minimum(cp, _KNOWN)]
        ends = np.nonzero(cls == _END)[0]
        for d in np.unique(np.searchsorted(ends, np.nonzero(cls == 0)[0])).tolist():
            odd[d] = True
        if any(odd):
            whole = [t for t, o in zip(texts, odd, strict=True) if o]
            done, rest = iter(self._whole(whole)), iter(self._pieces([t for t, o in zip(texts, odd, strict=True) if not o]))
            return [next(done) if o else next(rest) for o in odd]
        return self._split(joined, cp, cls, len(texts))

    def encode_parts(self, text: str) -> np.ndarray:
        """One text of any length, in parts of about CHUNK_CHARS characters; one that holds a special token goes whole."""
        if len(text) <= CHUNK_CHARS or not self.by_piece or any(s in text for s in self.special):
            return self.encode([text])[0]
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + CHUNK_CHARS)
            end = cut.start() if cut else len(text)
            out.append(self.encode([text[at:end]])[0])
            at = end
        return np.concatenate(out)

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(t + "\0" for t in texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        return self._split(joined, cp, _classes()[np.minimum(cp, _KNOWN)], len(texts))

    def _split(self, joined: str, cp: np.ndarray, cls: np.ndarray, n_texts: int) -> list[np.ndarray]:
        if not n_texts:
            return []
        start = np.nonzero(split_starts(cp, cls))[0]
        end = np.append(start[1:], len(cp))
        text = np.cumsum(cls[start] == _END)
        real = cls[start] != _END
        start, end, text = start[real], end[real], text[real]
        code, first = _same_pieces(cp, start, end)
        pieces = [joined[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.known) + len(pieces) > self.most:
            self.forget()
        found = list(map(self.known.get, pieces))
        if new := [at for at, k in enumerate(found) if k is None]:
            self._learn(list(dict.fromkeys(pieces[at] for at in new)))
            for at in new:
                found[at] = self.known[pieces[at]]
        of = np.array(found, dtype=np.int64)[code]
        ids, length = self.ids(of)
        per_text = np.bincount(text, weights=length, minlength=n_texts).astype(np.int64)
        return np.split(ids, np.cumsum(per_text)[:-1])


def chunks(texts: list[str], chars: int | None = None) -> Iterator[tuple[int, int]]:
    """[from, to) of texts that are encoded together: of ``chars`` (CHUNK_CHARS) characters, or one longer text."""
    chars = chars or CHUNK_CHARS
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= chars):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


@lru_cache(2)
def _encoder(path: str, most_pieces: int) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; each thread would keep memory of its own
    return Encoder(path, most_pieces)


#: A block stands where its first row does: in which range or file, and at which row of it.
BLOCKS = "part string, row long, n_ids long, doc_ids array<long>, bytes binary"


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text",
    id_bytes: int | None = None, partitions: int | None = None, in_order: bool = False,
    most_pieces: int = 400_000, keep_pieces: bool = True,
) -> None:
    """Write the ids of every whole text, in ascending doc_id order, as a folder of blocks at ``path``.

    With ``in_order`` in the order of the files that ``docs`` is read from, and nothing is shuffled: Spark numbers the files
    that it writes in the order of their rows, and a block never goes over the end of a file or of a task's part of it.
    Rows that don't come from files are written by doc_id then, too. A worker knows up to
    ``most_pieces`` pieces (it forgets all at more) and keeps them for its next task; without ``keep_pieces`` they go when a
    task ends, for jobs whose other stages use the same workers.

    ``end_id`` is put after each document. Null text counts as empty; null doc_ids come first; rows that repeat a
    doc_id all count, in order of their texts' hashes. An empty table writes no blocks. Extra columns are ignored. Texts move
    once, in a range shuffle by doc_id; each task encodes its sorted range and closes a block at BLOCK_IDS ids.
    """
    if id_bytes is None:
        id_bytes = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id or 0) < 1 << 16 else 4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = _encoder(tokenizer, most_pieces), np.array([] if end_id is None else [end_id], dtype=np.uint32)
        names, waiting, n, first, follows = [], [], 0, ("", 0), None

        def close() -> pa.RecordBatch:
            cols = [[first[0]], [first[1]], [n], [names], [pack(waiting, id_bytes)]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "row", "n_ids", "doc_ids", "bytes"])

        for b in batches:
            ids, texts, parts, rows = (b.column(k).to_pylist() for k in range(4))
            for at, to in chunks(texts):
                found = encoder.encode(texts[at:to]) if to > at + 1 else [encoder.encode_parts(texts[at])]
                for name, part, row, one in zip(ids[at:to], parts[at:to], rows[at:to], found, strict=True):
                    if names and (part, row) != follows:
                        yield close()
                        names, waiting, n = [], [], 0
                    first, follows = first if names else (part, row), (part, row + 1)
                    one = np.concatenate([one, tail])
                    names.append(name)
                    waiting.append(one)
                    n += len(one)
                    if n >= BLOCK_IDS:
                        yield close()
                        names, waiting, n = [], [], 0
        if names:
            yield close()
        if not keep_pieces:
            encoder.forget()
        pa.default_memory_pool().release_unused()  # workers are used again by other stages

    own = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")]
    where = place_in_files(docs)
    if where and in_order:
        # part-100000 comes after part-99999.
        part = F.concat(F.lpad(F.regexp_extract(where[0], r"part-(\d+)[^/]*$", 1), 12, "0"), where[0])
        rows = docs.select(*own, part.alias("part"), where[1].alias("row"))
    else:
        n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Many rows may share an id or have none: a range is cut by the texts' hashes, too, and equal rows by their places.
        rows = docs.select(*own, F.xxhash64(*where).alias("place") if where else F.monotonically_increasing_id().alias("place"))
        order = ["doc_id", F.xxhash64("text"), "place"]
        rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        # Number in the range's order: partitions are ranges, and the id counts up within one.
        rows = rows.select("doc_id", "text", F.lpad(F.spark_partition_id().cast("string"), 10, "0").alias("part"), F.monotonically_increasing_id().alias("row"))
    rows.mapInArrow(work, BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian unsigned 32-bit) for each document of a folder of blocks.

    A block starts where the ids of all blocks before it end: running sums over blocks, ranges of them first.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    bases = materialise(running(blocks.select("part", "row", "n_ids"), ["part", "row"], "no", "token-blocks", base="n_ids").select("part", "row", "base"), "bases")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, names, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                bounds, ids = unpack(block.as_py())
                for at in range(0, len(names), 1024):
                    spans = [bounds.span(i) for i in range(at, min(at + 1024, len(names)))]
                    starts, sizes = pa.array([base + x for x, _ in spans], pa.int64()), pa.array([y - x for x, y in spans], pa.int64())
                    bodies = pa.array([ids[x:y].astype("<u4").tobytes() for x, y in spans], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 1024], pa.int64()), starts, sizes, bodies], ["doc_id", "start", "n_tokens", "ids"])

    rows = blocks.join(F.broadcast(bases) if small(bases) else bases, ["part", "row"]).select("base", "doc_ids", "bytes")
    return rows.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


END_ID = 2


def tokenized(spark: SparkSession, docs: DataFrame, in_order: bool = False, most_pieces: int = 400_000, keep_pieces: bool = True) -> DataFrame:
    """Write ``docs`` with the 50k byte-level tokenizer and read the files back: doc_id, start, n_tokens, ids_crc32.

    In the order of doc_id, or with ``in_order`` in the order of the files that ``docs`` is read from.
    """
    import public_tokenizers

    path = shared_path(spark, "tokens")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), END_ID, in_order=in_order, most_pieces=most_pieces, keep_pieces=keep_pieces)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: where every document's ids are in the files, and their checksum."""
    return tokenized(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
