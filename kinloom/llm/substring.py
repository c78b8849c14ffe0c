"""Substring deduplication by relative Lempel-Ziv parsing (operator 2).

Documents are parsed relative to the documents before them (by doc_id). The reference is cut into blocks: a block is
the stretch of a document whose windows of ``window`` words share their anchor, the least word of the window by an order
that puts rare words first. The blocks, as words with their document and position, are the index, dealt out by anchor.
A document's own blocks meet every reference block with the same anchor; a run of windows that stands in one earlier
document at consecutive positions is a factor (start, words, ref, ref_start). Windows across a block's edge belong to the
neighbouring block's anchor and are looked up there. At the end the factors of a document are joined where they go on
along the same reference, and the parse takes at each place the one that reaches furthest.

Windows are equal if their words are: words are numbered exactly (dictionary ranks, and numbers of the other words in a
batch), pairs of numbers are numbered again, and so on up to a window, so no hash decides. Hashes only deal rows out.
A dictionary of frequent words, drawn from a bounded sample, shortens what is shuffled; it changes no result.

An anchor that is common to very many blocks is hot: its windows are dealt out by bits of their own hash as well, to as
many places as an estimate on a sample of documents asks for; that too decides only where windows meet, never which.
Before anything is shuffled, each chunk of documents drops the windows that repeat a smaller document of the same chunk,
so a passage that many documents share sends one row from each chunk, not one from each document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _grown, _R, attach, keep_ids, materialise, mix64, numbered, running, small, span_hash

WINDOW = 13
#: Most words of the dictionary, the longest that it takes, and the number that stands for all others.
MOST_WORDS, LONGEST, OTHER = 65_000, 40, 65_535
#: About so many documents are drawn for the dictionary, and for the dictionary of the text packer.
DRAWN, PACK_DRAWN = 20_000, 1_000
#: An anchor with so many blocks among one of ``SAMPLE`` documents is hot; each of its places gets about ``PLACE`` blocks.
HOT, SAMPLE, PLACE = 256, 64, 1 << 14
#: The driver takes so many hot anchors at most, the hottest; others stay whole.
MOST_HOT = 100_000
#: Bytes of text that are looked at together, and rows of blocks.
CHUNK_BYTES, BATCH_ROWS = 4 << 20, 1 << 15
_LAST = (1 << 63) - 1
#: Bits of a position in a document; above them is the row's number among those that share its id.
_POS = 30
ROWS = "key int, id long, pos long, n int, body binary"
_NAMES = ["key", "id", "pos", "n", "body"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


@dataclass
class Layout:
    """How rows are laid out: frequent words, most frequent first; hot anchors (sorted) with their places."""

    words: list[bytes] = field(default_factory=list)
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def __post_init__(self) -> None:
        self.rank = {w: k for k, w in enumerate(self.words)}

    def known(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(dictionary rank or OTHER, 64-bit hash) of each of ``words``."""
        rank = np.fromiter((self.rank.get(w, OTHER) for w in words), np.int64, len(words))
        return rank, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _key(hashes: np.ndarray) -> np.ndarray:
    """What rows are dealt out and sorted by: 32 bits. Anchors that share them meet, too, which changes nothing."""
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _exact(symbols: np.ndarray, window: int) -> np.ndarray:
    """A number for each run of ``window`` symbols (below 2**31); runs have the same number exactly if they are equal."""
    now, span = symbols.astype(np.int64), 1
    while span < window:
        step = min(span, window - span)
        if len(now) <= step:
            return np.zeros(0, np.int64)
        now, span = pd.factorize(now[:-step] << 31 | now[step:])[0].astype(np.int64), span + step
    return now


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        values, span = np.minimum(values[:-step], values[step:]), span + step
    return values


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[from, to) of the runs that start where ``breaks`` is true."""
    begin = np.nonzero(breaks)[0]
    return begin, np.append(begin[1:], len(breaks))


def _first_of(codes: np.ndarray) -> np.ndarray:
    """For each element the place of the first that has its code."""
    first = np.zeros(codes.max(initial=-1) + 1, dtype=np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first[codes]


def _batch(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def _factor_rows(key, ids, at, words, refs, ref_at) -> pa.RecordBatch:
    """Factors travel with n < 0: minus their words; the body holds the reference and the position in it."""
    bodies = [struct.pack("<qq", r, p) for r, p in zip(refs.tolist(), ref_at.tolist(), strict=True)]
    return _batch(key, ids, at, -words.astype(np.int32), bodies)


@dataclass
class _Chunk:
    """The words of some texts and their windows: of which text, at which word, under which anchor, and who is equal."""

    words: list[bytes]
    code: np.ndarray
    rank: np.ndarray
    of: np.ndarray
    pos: np.ndarray
    at: np.ndarray
    key: np.ndarray
    same: np.ndarray


def _windows(texts: list[bytes], window: int, layout: Layout, deal: bool = True) -> _Chunk:
    split = [t.split() for t in texts]
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    words = [w for s in split for w in s]
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < window:
        return _Chunk(words, none, none, none, none, none, none.astype(np.uint64), none)
    objects = np.empty(n, dtype=object)
    objects[:] = words
    code, distinct = pd.factorize(objects)
    rank, digest = layout.known(list(distinct))
    # Words that aren't in the dictionary come first, then its words from the rarest; among alike ones a hash decides.
    common = np.where(rank == OTHER, 0, 1 + np.log2(MOST_WORDS / (rank + 1.0)).clip(0)).astype(np.uint64)
    order = (common << np.uint64(56)) | (digest >> np.uint64(8))
    of_word = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(n - window + 1)
    at = at[of_word[at] == of_word[at + window - 1]]
    anchor = _least(order[code], window)[at]
    if deal and len(layout.hot):
        place = np.minimum(np.searchsorted(layout.hot, anchor), len(layout.hot) - 1)
        hot = np.nonzero(layout.hot[place] == anchor)[0]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(digest[code] * _grown("r", _R, n), out=sums[1:])
        piece = span_hash(sums, at[hot], at[hot] + window) % layout.places[place[hot]]
        anchor[hot] = mix64(anchor[hot] + np.uint64(1) + piece)
    starts = np.cumsum(sizes) - sizes
    of = of_word[at]
    return _Chunk(words, code, rank[code], of, at - starts[of], at, anchor, _exact(code, window)[at])


def _bodies(words: list[bytes], rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[bytes]:
    """The words [low, high) of each block: how many, a rank of two bytes each, and the words that the dictionary lacks."""
    ranks = rank.astype("<u2").tobytes()
    rare = np.nonzero(rank == OTHER)[0]
    others = b"".join(words[i] + b" " for i in rare.tolist())
    length = np.zeros(len(rank) + 1, dtype=np.int64)
    length[rare + 1] = [len(words[i]) + 1 for i in rare.tolist()]
    at = np.cumsum(length)
    counts = (high - low).astype("<u2").tobytes()
    spans = zip(low.tolist(), high.tolist(), at[low].tolist(), at[high].tolist(), strict=True)
    return [counts[2 * k : 2 * k + 2] + ranks[2 * i : 2 * j] + others[x:y] for k, (i, j, x, y) in enumerate(spans)]


def _blocks(ids: np.ndarray, tags: np.ndarray, texts: list[bytes], window: int, layout: Layout) -> Iterator[pa.RecordBatch]:
    """Of a chunk: the factors found within it, and blocks of the other windows."""
    order = np.argsort(ids, kind="stable")
    ids, tags, texts = ids[order], tags[order], [texts[i] for i in order]
    c = _windows(texts, window, layout)
    if not len(c.of):
        return
    tag = tags << _POS
    first = _first_of(c.same)
    ref, ref_pos = ids[c.of[first]], c.pos[first]
    seen = ids[c.of] > ref
    apart = np.ones(len(c.of), dtype=bool)
    apart[1:] = (c.of[1:] != c.of[:-1]) | (seen[1:] != seen[:-1])
    along = apart.copy()
    along[1:] |= seen[1:] & ((c.of[first[1:]] != c.of[first[:-1]]) | (ref_pos[1:] != ref_pos[:-1] + 1))
    a, b = _runs(along)
    a, b = a[seen[a]], b[seen[a]]
    if len(a):
        own = ids[c.of[a]]
        dealt = _key(mix64(own.view(np.uint64) + mix64(tags[c.of[a]].view(np.uint64))))
        yield _factor_rows(dealt, own, c.pos[a] + tag[c.of[a]], b - a + window - 1, ref[a], ref_pos[a])
    apart[1:] |= c.key[1:] != c.key[:-1]
    a, b = _runs(apart)
    a, b = a[~seen[a]], b[~seen[a]]
    if not len(a):
        return
    # A block's count of words goes in two bytes, so a longer one is cut.
    cuts = [(i, min(i + (1 << 15), j)) for i, j in zip(a.tolist(), b.tolist(), strict=True) for i in range(i, j, 1 << 15)]
    a, b = (np.array(v, dtype=np.int64) for v in zip(*cuts, strict=True))
    bodies = _bodies(c.words, c.rank, c.at[a], c.at[b - 1] + window)
    yield _batch(_key(c.key[a]), ids[c.of[a]], c.pos[a] + tag[c.of[a]], np.zeros(len(a), np.int32), bodies)


def _symbols(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words of the blocks, words of each block): dictionary ranks, and OTHER or more for other words."""
    sizes = [x[0] | x[1] << 8 for x in bodies]
    symbols = np.frombuffer(b"".join(x[2 : 2 + 2 * n] for x, n in zip(bodies, sizes, strict=True)), "<u2").astype(np.int64)
    rare = np.empty(int((symbols == OTHER).sum()), dtype=object)
    rare[:] = b"".join(x[2 + 2 * n :] for x, n in zip(bodies, sizes, strict=True)).split()
    symbols[symbols == OTHER] = OTHER + pd.factorize(rare)[0]
    return symbols, np.array(sizes, dtype=np.int64)


def _factors(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by key and id meet: runs of windows that an earlier document has at consecutive places are factors.

    Only blocks of the key that a batch ends in, and of them those that hold a first window, are carried to the next.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []  # key, id, pos and bodies that go on
    for b in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
        done = b.column(3).to_numpy() < 0
        if done.any():
            yield b.filter(pa.array(done))
            b = b.filter(pa.array(~done))
        if not b.num_rows:
            continue
        key, ids, pos = (b.column(i).to_numpy() for i in range(3))
        bodies = b.column(4).to_pylist()
        old = 0
        if held and held[0][0][0] == key[0]:
            k, i, p, x = held[0]
            old = len(x)
            key, ids, pos, bodies = np.concatenate([k, key]), np.concatenate([i, ids]), np.concatenate([p, pos]), x + bodies
        symbols, sizes = _symbols(bodies)
        starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(len(sizes)), sizes - window + 1)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes - window + 1) - (sizes - window + 1), sizes - window + 1)
        same = _exact(symbols, window)[starts[row] + inside]
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        first = _first_of(pd.factorize(same << 31 | group[row])[0])
        at, tagless = pos[row] + inside, (pos[row] & ((1 << _POS) - 1)) + inside
        seen = ids[row] > ids[row[first]]
        along = np.ones(len(row), dtype=bool)
        along[1:] = (row[1:] != row[:-1]) | (seen[1:] != seen[:-1]) | (row[first[1:]] != row[first[:-1]]) | (tagless[first[1:]] != tagless[first[:-1]] + 1)
        x, y = _runs(along)
        fresh = seen[x] & (row[x] >= old)
        x, y = x[fresh], y[fresh]
        if len(x):
            yield _factor_rows(key[row[x]], ids[row[x]], at[x], y - x + window - 1, ids[row[first[x]]], tagless[first[x]])
        keep = np.unique(row[(first == np.arange(len(first))) & (group[row] == group[-1])])
        held = [(key[keep], ids[keep], pos[keep], [bodies[k] for k in keep.tolist()])]


def _parse(found: list[dict]) -> list[dict]:
    """The factors of one text: joined where they go on along their reference, then at each place the furthest-reaching."""
    joined: list[list[int]] = []  # start, end, ref, ref_start
    last: dict[tuple[int, int], list[int]] = {}
    for f in sorted(found, key=lambda f: f["start"]):
        along = last.get((f["ref"], f["ref_start"] - f["start"]))
        if along and f["start"] <= along[1]:
            along[1] = max(along[1], f["start"] + f["words"])
        else:
            along = last[f["ref"], f["ref_start"] - f["start"]] = [f["start"], f["start"] + f["words"], f["ref"], f["ref_start"]]
            joined.append(along)
    out: list[dict] = []
    at, k, best = 0, 0, None
    while k < len(joined) or (best and best[1] > at):
        if not (best and best[1] > at):
            at, best = max(at, joined[k][0]), joined[k]
        while k < len(joined) and joined[k][0] <= at:
            best = joined[k] if joined[k][1] > best[1] else best
            k += 1
        if best[1] > at:
            out.append({"start": at, "words": best[1] - at, "ref": best[2], "ref_start": best[3] + at - best[0]})
            at = best[1]
    return out


def _cut(text: bytes, found: list[dict]) -> tuple[bytes, int, int, list[dict]]:
    """Kept words, counts, and the parse."""
    words = text.split()
    factors = _parse([{"start": f["pos"] & ((1 << _POS) - 1), **f} for f in found]) if found else []
    kept, at = [], 0
    for f in factors:
        kept += words[at : f["start"]]
        at = f["start"] + f["words"]
    kept += words[at:]
    return b" ".join(kept), len(words), len(words) - len(kept), factors


def _drawn(rows: DataFrame, total: int, about: int) -> DataFrame:
    """About ``about`` of ``total`` rows (all if fewer), by hash of id and length of text."""
    many = 1 << 30
    return rows.where(F.pmod(F.xxhash64("id", F.length("text"), F.lit("drawn")), F.lit(many)) < min(many, many * about // max(total, 1)))


def frequent_words(rows: DataFrame, total: int) -> list[bytes]:
    """The most frequent words, most frequent first, of about DRAWN rows (id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pd.Series([w for t in b.column(0) for w in (t.as_py() or "").encode().split() if len(w) <= LONGEST], dtype=object)
            n = words.value_counts()
            yield pa.RecordBatch.from_arrays([pa.array(list(n.index), pa.binary()), pa.array(n.to_numpy(), pa.int64())], ["word", "n"])

    found = _drawn(rows, total, DRAWN).select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in found.where("n > 1").orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()]


def hot_anchors(rows: DataFrame, window: int, layout: Layout) -> Layout:
    """``layout`` with the anchors that have HOT blocks or more among one of SAMPLE rows (id, text), drawn by hash."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = _windows([(t.as_py() or "").encode() for t in b.column(0).slice(at, 256)], window, layout, deal=False)
                apart = np.ones(len(c.of), dtype=bool)
                apart[1:] = (c.of[1:] != c.of[:-1]) | (c.key[1:] != c.key[:-1])
                found, n = np.unique(c.key[apart].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["anchor", "n"])

    drawn = rows.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(SAMPLE)) == 0).select("text")
    found = drawn.mapInArrow(anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    found = found.orderBy(F.desc("n"), "anchor").limit(MOST_HOT).collect()
    anchor = np.array([r["anchor"] for r in found], dtype=np.int64).view(np.uint64)
    places = np.array([1 + r["n"] * SAMPLE // PLACE for r in found], dtype=np.uint64)
    order = np.argsort(anchor)
    return Layout(layout.words, anchor[order], places[order])


def pack_dictionary(rows: DataFrame, total: int) -> bytes:
    """A Zstandard dictionary of about PACK_DRAWN rows' texts, by which texts are packed for the way to their finds."""
    short = _drawn(rows, total, PACK_DRAWN).where(F.length("text").between(1, 4000)).select("text")
    return b"\n".join(sorted(t.encode() for (t,) in short.collect()))[: 1 << 17]


RESULT = "doc_id long, kept_text string, n_words long, n_removed long, factors array<struct<start:long,words:long,ref:long,ref_start:long>>"


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: kept_text, n_words, n_removed and the factors that went.

    A word goes if a window over it also starts in a document with a smaller id, judged on the input. Words are runs of
    non-whitespace (U+0020, U+0009 to U+000D); kept ones are joined by a space. Null text has no words. Null ids come
    after all others. Rows that repeat an id are told apart by numbers and judged each, and none repeats the other, their
    ids being equal; up to 2**33 rows may share one.
    Texts shorter than a window stay whole. An empty table gives no rows; extra columns are ignored.
    A factor is a copy of ``words`` words of document ``ref`` from its word ``ref_start`` on; factors don't overlap.
    """
    rows = _told_apart(docs, F.col(id_col).cast("long"), F.col(text_col))
    total = docs.count()
    layout = hot_anchors(rows, window, Layout(frequent_words(rows, total)))
    held = docs.sparkSession.sparkContext.broadcast((layout, pack_dictionary(rows, total)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = held.value[0]
        ids: list[tuple[int, int]] = []
        texts: list[bytes] = []
        size = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            own, tags = np.array(ids, dtype=np.int64).T
            yield from _blocks(own, tags, texts, window, layout)

        for b in batches:
            for i, tag, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                raw = (t.as_py() or "").encode()
                if size + len(raw) > CHUNK_BYTES and texts:
                    yield from blocks()
                    ids, texts, size = [], [], 0
                ids.append((i, tag))
                texts.append(raw)
                size += len(raw)
        if texts:
            yield from blocks()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "pos", "words", "ref", "ref_start"]
        for b in _factors(batches, window):
            refs = np.frombuffer(b"".join(b.column(4).to_pylist()), "<i8").reshape(-1, 2)
            cols = [b.column(1), b.column(2), pa.array(-b.column(3).to_numpy()), pa.array(refs[:, 0]), pa.array(refs[:, 1])]
            yield pa.RecordBatch.from_arrays(cols, names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = zstandard.ZstdCompressionDict(held.value[1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=6, dict_data=words)
        for b in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            packed = pa.array([packer.compress((t.as_py() or "").encode()) for t in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], ["id", "tag", "doc_id", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = zstandard.ZstdCompressionDict(held.value[1], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        unpacker = zstandard.ZstdDecompressor(dict_data=words)
        numbers = [("start", pa.int64()), ("words", pa.int64()), ("ref", pa.int64()), ("ref_start", pa.int64())]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct(numbers))]
        for part in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            finds = part.column(2)
            ends, names = finds.offsets.to_numpy().tolist(), ("pos", "words", "ref", "ref_start")
            flat = [dict(zip(names, x, strict=True)) for x in zip(*(finds.values.field(n).to_pylist() for n in names), strict=True)]
            of_row = [flat[x:y] for x, y in zip(ends, ends[1:], strict=False)]
            out = [_cut(unpacker.decompress(t), f) for t, f in zip(part.column(1).to_pylist(), of_row, strict=True)]
            cols = list(zip(*((k.decode(), *x) for k, *x in out), strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "kept_text", "n_words", "n_removed", "factors"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = rows.select("id", "tag", "text").mapInArrow(parse, ROWS).repartition(n, "key").sortWithinPartitions("key", "id")
    finds = blocks.mapInArrow(meet, "id long, pos long, words int, ref long, ref_start long")
    finds = finds.groupBy("id", F.shiftright("pos", _POS).alias("tag")).agg(F.collect_list(F.struct("pos", "words", "ref", "ref_start")).alias("found"))
    whole = rows.select("id", "tag", "doc_id", "text").mapInArrow(pack, "id long, tag long, doc_id long, packed binary")
    return whole.join(finds, ["id", "tag"], "left").select("doc_id", "packed", "found").mapInArrow(cut, RESULT)


def _told_apart(docs: DataFrame, own: Column, text: Column) -> DataFrame:
    """(id, tag, doc_id, text) of each row: null ids come last, and rows that share an id are numbered by ``tag``.

    Where no id repeats, all tags are 0 and nothing is joined. Else the rows that share one are sorted, without their
    texts, over all tasks (an id may have a third of all rows).
    """
    rows = docs.select(own.alias("doc_id"), text.alias("text"))
    ids = F.coalesce(F.col("doc_id"), F.lit(_LAST)).alias("id")
    repeated = materialise(rows.select(ids).groupBy("id").count().where("count > 1"), "repeated-ids")
    if repeated.isEmpty():
        return rows.select(ids, F.lit(0).cast("long").alias("tag"), "doc_id", "text")
    rows, row = numbered(rows, "_row")
    shared = materialise(running(keep_ids(rows.select(ids, row), repeated, "id"), ["id", row], "no", "shared-ids"), "shared-ids")
    start = materialise(shared.groupBy("id").agg(F.min("no").alias("start")), "id-starts")
    tags = materialise(attach(shared, start, "id").select(row, (F.col("no") - F.col("start")).alias("tag")), "tags")
    if (tags.agg(F.max("tag")).first()[0] or 0) >> (63 - _POS):
        raise ValueError(f"more than {1 << (63 - _POS)} rows share an id")
    rows = rows.join(F.broadcast(tags) if small(tags) else tags, row, "left")
    return rows.select(ids, F.coalesce("tag", F.lit(0)).alias("tag"), "doc_id", "text")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: what is left of every document, by its hash."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws[i:i + 12] AS win, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t WHERE len(ws) >= 13)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS dup FROM w),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM f WHERE dup)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM t WHERE len(ws) > 0),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS body, count(*) AS n FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.body, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
