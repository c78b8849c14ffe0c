"""Cross-tokenizer alignment by whitespace anchors (operator 13).

A document is encoded whole by two tokenizers. Where both have a token that starts with a space, and the tokens before
end at the same byte, is an anchor; anchors part the document into windows of a few ids of each. How the tokens of a
window meet depends on its ids alone, so each distinct window (a tuple of ids of both) is aligned once in a worker and its
groups, links and text are remembered; documents are then put together from their windows with array operations. A
document without anchors is one window. What is remembered is bounded: beyond that a worker forgets all and starts again.

The number of documents that link a pair of ids is summed before it is shuffled. The pairs' counts meet the documents'
pairs by broadcast if they are measured to be small, or else heavy pairs do and the others are shuffled (spread_join).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import BROADCAST_BYTES, materialise, small, spread_join
from .tokens import chunks, usual_characters

#: Windows that a worker remembers.
MOST_WINDOWS = 200_000
#: Characters of texts that are aligned together; a longer text is by itself.
CHARS = 1 << 19
_MARK = "▁"
#: How a byte-level BPE of this kind splits texts (fixed).
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Stands between the ids of the two sides of a window; no id is as large.
_BETWEEN = 0xFFFFFFFF


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


@lru_cache(1)
def _unusual() -> re.Pattern[str]:
    """Finds a character whose class isn't beyond doubt."""
    return re.compile("[^" + re.escape("".join(chr(c) for c in np.nonzero(usual_characters())[0].tolist())) + "]")


class Side:
    """A tokenizer's token bytes: their lengths, and which start with a space."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.marked = np.array([t[:1] == b" " for t in tokens], dtype=bool)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class ByteLevel(Side):
    """The byte-level BPE: encodes a space and the text.

    Texts of ordinary letters, digits, punctuation and ASCII white space go through the faster of two libraries, if the file's
    merges are numbered in their order, as its ranks then say the same; all other texts through the file's own tokenizer.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        table, vocab = byte_level(), self.tok.get_vocab()
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        raw = {token: token.encode() if token in special else bytes(table[c] for c in token) for token in vocab}
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            tokens[i] = raw[token]
        super().__init__(tokens)
        model = json.loads(self.tok.to_str())
        merges = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        config = model["pre_tokenizer"] or {}
        alike = config.get("type") == "ByteLevel" and config.get("use_regex") and not config.get("add_prefix_space") and not model["normalizer"]
        self.fast = None
        if alike and merges == sorted(set(merges)) and len(merges) + 256 + len(special) == len(vocab):
            self.fast = tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks={raw[t]: i for t, i in vocab.items() if t not in special}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            ids = self.fast.encode_ordinary(" " + t) if self.fast and not _unusual().search(t) else self.tok.encode(" " + t, add_special_tokens=False).ids
            out.append(np.array(ids, dtype=np.uint32))
        return out


class Pieces(Side):
    """The piece BPE, which puts a space before the text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and self.model.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype=np.uint32) for x in self.model.encode(texts, num_threads=1)]


def _repeated(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``values`` in order and the sums of ``times`` of each."""
    key, inverse = np.unique(values, return_inverse=True)
    out = np.zeros(len(key), dtype=np.int64)
    np.add.at(out, inverse, times)
    return key, out


class Windows:
    """What is remembered of aligned windows: their groups' text, how many groups and links, and the linked pairs.

    A pair is one number, the first id times 2**32 and the second; ``pairs`` numbers the distinct ones. The pairs of all
    windows stand side by side, with how often each is linked.
    """

    def __init__(self, a: Side, b: Side, most: int = MOST_WINDOWS):
        self.a, self.b, self.most = a, b, most
        self.decimal = [b"%d" % i for i in range(max(len(a.tokens), len(b.tokens)))]
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pairs: dict[int, int] = {}
        self.text: list[bytes] = []
        self.groups, self.links, self.offset, self.length, self.pair, self.times, self.codes = (np.zeros(0, np.int64) for _ in range(7))

    def of(self, a: np.ndarray, b: np.ndarray, edge_a: np.ndarray, edge_b: np.ndarray) -> np.ndarray:
        """The number of each window, of ids of ``a`` and ``b`` between edges; new ones are aligned."""
        # The ids of each window side by side: those of a, the mark, those of b.
        n = np.arange(1, len(edge_a))
        both = np.full(len(a) + len(b) + len(n), _BETWEEN, dtype="<u4")
        both[np.arange(len(a)) + np.repeat(edge_b[:-1] + n - 1, np.diff(edge_a))] = a
        both[np.arange(len(b)) + np.repeat(edge_a[1:] + n, np.diff(edge_b))] = b
        raw, ends = both.tobytes(), (4 * np.concatenate([[0], edge_a[1:] + edge_b[1:] + n])).tolist()
        keys = [raw[x:y] for x, y in pairwise(ends)]
        number = self.number
        found = list(map(number.get, keys))
        if None in found:
            new = []
            for at, key in enumerate(keys):
                if found[at] is None:
                    if (k := number.setdefault(key, len(number))) == len(self.text) + len(new):
                        new.append(at)
                    found[at] = k
            at = np.array(new)
            self._learn(*(_slices(ids, edge[at], edge[at + 1]) for ids, edge in ((a, edge_a), (b, edge_b))))
        return np.array(found, dtype=np.int64)

    def _learn(self, side_a: tuple[np.ndarray, np.ndarray], side_b: tuple[np.ndarray, np.ndarray]) -> None:
        """Align windows, given as the ids of all of them and the number of ids of each: groups end where both sides do."""
        (a, many_a), (b, many_b) = side_a, side_b
        ends_a, ends_b = np.cumsum(self.a.size[a]), np.cumsum(self.b.size[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        window = np.searchsorted(np.cumsum(many_a), np.cumsum(n_a))  # of each group, by the last id of its first side
        n = len(many_a)
        groups = np.bincount(window, minlength=n)
        links = np.zeros(n, dtype=np.int64)
        np.add.at(links, window, n_a * n_b)
        # Each distinct id of a side of a group with how often it stands there, so a long group of one id is one pair.
        (ka, ta), (kb, tb) = (_repeated(g << 32 | ids.astype(np.int64), np.ones(len(ids), np.int64)) for g, ids in ((group_a, a), (group_b, b)))
        start, stop = (np.searchsorted(kb >> 32, ka >> 32, side) for side in ("left", "right"))
        other, many = _slices(np.arange(len(kb)), start, stop)
        of = np.repeat(np.arange(len(ka)), many)
        codes, code = np.unique((ka[of] & 0xFFFFFFFF) << 32 | kb[other] & 0xFFFFFFFF, return_inverse=True)
        number = np.array([self.pairs.setdefault(c, len(self.pairs)) for c in codes.tolist()], dtype=np.int64)
        self.codes = np.concatenate([self.codes, codes[number >= len(self.codes)]])
        key, times = _repeated(window[ka[of] >> 32] * len(self.pairs) + number[code], ta[of] * tb[other])
        length = np.bincount(key // len(self.pairs), minlength=n)
        self.text += self._texts(a, b, group_a, group_b, n_a, n_b, window, groups)
        self.offset = np.concatenate([self.offset, len(self.pair) + np.cumsum(length) - length])
        for name, more in (("groups", groups), ("links", links), ("length", length), ("pair", key % len(self.pairs)), ("times", times)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))

    def _texts(self, a, b, group_a, group_b, n_a, n_b, window, groups) -> list[bytes]:
        """a1,a2|b1;a3|b2 of each window: every id with what follows it, in the order of the text."""
        before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        at = np.concatenate([np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + (before_a + n_a)[group_b]])
        follows = np.zeros(len(at), dtype=np.int64)
        follows[before_a + n_a - 1] = 1
        follows[len(a) + before_b + n_b - 1] = np.where(np.append(window[1:] != window[:-1], True), 3, 2)
        order = np.argsort(at)
        ids, follows = np.concatenate([a, b]).astype(np.int64)[order], follows[order]
        marks, decimal = (b",", b"|", b";", b""), self.decimal
        parts = [decimal[i] + marks[k] for i, k in zip(ids.tolist(), follows.tolist(), strict=True)]
        last = np.cumsum(groups) - 1
        ends = [0, *(np.cumsum(n_a + n_b)[last]).tolist()]
        return [b"".join(parts[x:y]) for x, y in zip(ends, ends[1:], strict=False)]

    def pairs_of(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of windows, one after another: the windows' places in ``of``, the pairs' numbers, times linked."""
        at, many = _slices(np.arange(len(self.pair)), self.offset[of], self.offset[of] + self.length[of])
        return np.repeat(np.arange(len(of)), many), self.pair[at], self.times[at]


def _slices(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start:stop] of each, one after another, and their lengths."""
    many = stop - start
    return values[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())], many


class Aligner:
    """Aligns lists of texts as two tokenizers encode them."""

    def __init__(self, a: Side, b: Side, most_windows: int = MOST_WINDOWS):
        self.a, self.b, self.windows = a, b, Windows(a, b, most_windows)

    def forget(self) -> None:
        self.windows.forget()

    def align(self, texts: list[str]) -> list[tuple[int, int, int, int, bytes, np.ndarray, np.ndarray]]:
        """For each text: n_a, n_b, n_groups, n_links, the groups' text, and the distinct pairs with their times linked."""
        none = (0, 0, 0, 0, b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
        out, at, ids_a, ids_b = [none] * len(texts), [], [], []
        # A mark in a text is taken for a space by the second tokenizer, so its bytes can't be the text's.
        usable = [i for i, t in enumerate(texts) if t and _MARK not in t]
        for i, a, b in zip(usable, *(side.encode([texts[i] for i in usable]) if usable else [] for side in (self.a, self.b)), strict=True):
            raw = (" " + texts[i]).encode()
            if self.a.bytes_of(a) == raw and self.b.bytes_of(b) == raw:
                at.append(i)
                ids_a.append(a)
                ids_b.append(b)
        if not at:
            return out
        if len(self.windows.number) > self.windows.most or len(self.windows.pairs) > 4 * self.windows.most:
            self.windows.forget()
        (a, ends_a, cut_a), (b, ends_b, cut_b) = (self._cuts(ids, side) for ids, side in ((ids_a, self.a), (ids_b, self.b)))
        shared = np.intersect1d(cut_a, cut_b, assume_unique=True)
        edge_a, edge_b = (np.concatenate([[0], np.searchsorted(ends, shared) + 1]) for ends in (ends_a, ends_b))
        of = self.windows.of(a, b, edge_a, edge_b)
        doc = np.searchsorted(np.cumsum([len(v) for v in ids_a]), edge_a[:-1], "right")
        return self._documents(out, at, ids_a, ids_b, of, doc)

    @staticmethod
    def _cuts(ids: list[np.ndarray], side: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each token ends, and the ends before tokens that start with a space or a document, and the last end."""
        flat = np.concatenate(ids)
        ends = np.cumsum(side.size[flat])
        before = np.ones(len(flat), dtype=bool)  # the last token is before nothing
        before[:-1] = side.marked[flat[1:]]
        before[np.cumsum([len(v) for v in ids]) - 1] = True
        return flat, ends, ends[before]

    def _documents(self, out: list, at: list[int], ids_a: list, ids_b: list, of: np.ndarray, doc: np.ndarray) -> list:
        w = self.windows
        place, pair, times = w.pairs_of(of)
        key, times = _repeated(doc[place] * len(w.pairs) + pair, times)
        codes = w.codes[key % len(w.pairs)]
        ends = np.searchsorted(key, np.arange(len(at) + 1) * len(w.pairs)).tolist()
        groups, links = (np.bincount(doc, weights=x[of], minlength=len(at)).astype(np.int64).tolist() for x in (w.groups, w.links))
        text = [w.text[k] for k in of.tolist()]
        first = np.searchsorted(doc, np.arange(len(at) + 1)).tolist()
        for d, i in enumerate(at):
            body = b";".join(text[first[d] : first[d + 1]])
            out[i] = (len(ids_a[d]), len(ids_b[d]), groups[d], links[d], body, codes[ends[d] : ends[d + 1]], times[ends[d] : ends[d + 1]])
        return out


@lru_cache(1)
def _aligner(path_a: str, path_b: str, most_windows: int) -> Aligner:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Aligner(ByteLevel(path_a), Pieces(path_b), most_windows)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<long>, times array<long>"


def aligned(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = True,
    most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """Each row's text aligned: n_a, n_b, n_groups, n_links, the groups and their hash, and its distinct pairs of ids.

    ``path_a`` is a byte-level BPE, which is given a space and the text; ``path_b`` a piece BPE, which adds the space.
    A group ends where tokens of both end at the same byte; all tokens of its two sides are linked. ``groups`` is
    ``a1,a2|b1;a3|b2,b3`` in decimal ids (null without ``keep_groups``). A pair is the first id times 2**32 and the
    second, with how often the row links it. Texts that are null or empty, or whose tokens' bytes aren't the text's, have
    no tokens: zeros, an empty hash, no pairs. Rows that repeat a doc_id or have none are aligned each. An empty table
    gives no rows; extra columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b, most_windows)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string()]
        for b in batches:
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for at, to in chunks(texts, CHARS):
                found = aligner.align(texts[at:to])
                cols = [ids[at:to], *([f[k] for f in found] for k in range(4)), [hashlib.sha256(f[4]).hexdigest() if f[0] else "" for f in found]]
                cols.append([f[4].decode() if keep_groups else None for f in found])
                ends = pa.array(np.cumsum([0, *(len(f[5]) for f in found)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found]), pa.int64())) for k in (5, 6)]
                flat = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*flat, *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "pairs", "times"])
        aligner.forget()
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows of ``rows`` (pairs) hold each pair, and whether no pair of its first id has more."""
    counts = materialise(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    return counts.join(most, first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` (of aligned()) with n_best and count_sum, by the counts of their pairs over all of ``rows``.

    n_best: the links whose pair is counted highest among the pairs of its first id, ties included. count_sum: the sum of
    the counts over the links. ``rows`` are written first. ``limit``: bytes of counts that are broadcast.
    """
    rows = materialise(rows.withColumn("_key", F.monotonically_increasing_id()), "aligned")
    counts = materialise(pair_counts(rows), "best-pairs")
    each = rows.select("_key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_key", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    held = each.join(F.broadcast(counts), "pair") if small(counts, limit) else spread_join(each, counts, "pair", "n", rows.agg(F.sum(F.size("pairs"))).first()[0] or 0)
    sums = held.groupBy("_key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return rows.join(sums.hint("merge"), "_key", "left").select(*[c for c in rows.columns if c != "_key"], *zero)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: every document's alignment, and its links by the corpus' counts."""
    import public_tokenizers

    rows = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep_groups=False)
    return scored(rows).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
