"""Line deduplication, ranked search and alignment against brute force, and on the awkward inputs that they define."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinloom.llm import alignment, lexical, lines
from kinloom.session import shared_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("h", "n", "at", "key", "gone", "row", "kept_text", "item", "score", "rank", "terms", "pairs", "times", "pair", "groups", "_key", "n_a")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def messy(df):
    return df.withColumns({c: F.lit("clash") for c in EXTRA})


def stored(spark, df, files=3):
    path = shared_path(spark, "docs")
    df.repartition(files).write.parquet(path)
    return path


# 11: lines


def dropped_lines(rows, least_docs, least_chars=1):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(key(x)) >= least_chars and n[key(x)] >= least_docs)]
        out.append((i, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def line_rows():
    r = random.Random(3)
    common = ["Copyright ACME", "  copyright acme\t", "menu", "ÉLAN", "élan", "x ", "x   ", "\x0bmenu\r", " menu", ""]
    rows = [(i, "\n".join(r.choice(common) if r.random() < 0.5 else f"line {r.randint(0, 40)}" for _ in range(r.randint(0, 9)))) for i in range(80)]
    rows += [(None, None), (None, ""), (7, "menu\nmenu\nmenu"), (7, "menu\nmenu\nmenu"), (500, "\n".join(f"own {k % 3000}" for k in range(6000)) + "\nmenu"), (501, "\n\n\n"), (502, " \t\x0c\n menu"), (503, "y" * 40_000)]
    return rows


@pytest.mark.parametrize(("least_docs", "least_chars", "files"), [(10, 1, 7), (2, 5, 1), (1, 1, 2)])
def test_lines(spark, line_rows, least_docs, least_chars, files):
    path = stored(spark, messy(docs(spark, line_rows)), files)
    got = lines.line_dedup(spark, path, least_docs, least_chars)
    assert [c for c in got.columns if c in EXTRA and c != "kept_text"] == [c for c in EXTRA if c != "kept_text"]
    rows = sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)
    assert rows == dropped_lines(line_rows, least_docs, least_chars)


def test_frequent_lines_beyond_a_broadcast(spark, line_rows, monkeypatch):
    monkeypatch.setattr(lines, "small", lambda df: False)
    got = lines.line_dedup(spark, stored(spark, docs(spark, line_rows)), 3)
    assert sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == dropped_lines(line_rows, 3)


def test_runs_go_on_and_are_merged_in_levels(spark):
    source, store = shared_path(spark, "arriving"), shared_path(spark, "store")
    seen: Counter = Counter()
    for batch in range(5):
        rows = [(batch * 100 + k, f"everywhere\nbatch {batch}\nshared {k % 4}\nsome {batch % 2}") for k in range(3)]
        docs(spark, rows).coalesce(1).write.mode("append").parquet(source)
        seen.update(x for _, t in rows for x in set(t.split("\n")))
        runs = lines.ingest(spark, source, store, settled=4)
        # Each level but the last holds at most one run: batches 1 to 5 in binary.
        assert [len(level) for level in runs.levels] == [int(b) for b in reversed(f"{batch + 1:b}")]
        for name in runs.runs():
            assert runs.run(name).groupBy("h").count().where("count > 1").isEmpty()
    hashes = spark.createDataFrame([(k, min(n, 4)) for k, n in seen.items()], "key string, want long").select(lines.line_hash(F.col("key")).alias("h"), "want")
    # What is settled isn't counted again, so 'everywhere' is in no later batch's own run.
    every = hashes.join(runs.run(runs.levels[0][0]), "h").where("want = 4")
    assert every.isEmpty()
    new = lines.unseen_lines(runs, docs(spark, [(1, "everywhere\nnever seen")]))
    assert new.count() == 1
    # A batch that is delivered again changes nothing, and a new driver finds the same runs.
    again = lines.LineRuns(spark, f"{store}/runs", 4)
    assert again.levels == runs.levels and again.last_batch == runs.last_batch
    again.add(lines.document_counts(docs(spark, [(1, "late")])), again.last_batch)
    total = {bytes(r.h): r.n for r in again.counted().collect()}
    assert total == {bytes(r.h): r.want for r in hashes.collect()}
    with pytest.raises(ValueError):
        lines.LineRuns(spark, f"{store}/runs", 5)
    again.close()
    runs.close()


def test_runs_are_joined_as_they_lie(spark):
    """Merges neither shuffle nor sort runs; a batch is shuffled once and joined to all runs."""
    runs = lines.LineRuns(spark, shared_path(spark, "runs"), 2, buckets=4)
    plans = []
    runs.add(lines.document_counts(docs(spark, [(1, "a\nb"), (2, "a")])), 0)

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())

    runs._sorted(lambda: plan(runs.fresh(spark.range(3).select(F.expr("cast(cast(id as string) as binary)").alias("h"), F.col("id").alias("n")).repartition(4, "h"))))
    assert plans[0].count("Exchange") == 1 and plans[0].count("Sort [h") <= 1 and "LeftAnti" in plans[0]
    runs.close()


def test_no_documents_no_lines(spark):
    assert lines.line_dedup(spark, stored(spark, docs(spark, []), 1)).isEmpty()


# 12: search


def best(rows, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    tfs = [Counter(cut(t)) for _, t in rows]
    n_docs, length = sum(1 for c in tfs if c), sum(c.total() for c in tfs)
    df = Counter(t for c in tfs for t in c)
    out = []
    for item, text in items:
        found = []
        for (i, _), c in zip(rows, tfs, strict=True):
            m = 10 + 90 * c.total() * n_docs // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(cut(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def search_rows():
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(60)] + ["Straße", "naïve", "x_y", "日本", "a1", "\u0085z"]
    rows = [(i, r.choice(" \n.,-/").join(r.choice(vocab) for _ in range(r.randint(1, 60)))) for i in range(150)]
    same = "w1 w2 w3 unique"
    rows += [(1000 + k, same) for k in range(40)] + [(None, same), (None, None), (2000, ""), (2001, "-- !"), (5, same), (5, same), (2002, "w9 " * 30_000), (2003, "q" * 50_000)]
    items = [(1, "w1 w2 unique"), (2, None), (3, ""), (4, "nowhere else"), (5, "W3, w3; STRASSE Straße"), (5, "w7"), (None, "日本 naïve"), (6, " ".join(vocab)), (7, "x-y\u0085Z")]
    return rows, items


@pytest.mark.parametrize("item_bytes", [1 << 20, 150])
def test_search(spark, search_rows, item_bytes, monkeypatch):
    rows, items = search_rows
    monkeypatch.setattr(lexical, "POSTINGS", 64)
    table = messy(docs(spark, rows)).repartition(5)
    asked = messy(spark.createDataFrame(items, "item_id long, text string")).drop("item")
    got = lexical.search(table, asked, item_bytes=item_bytes)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == best(rows, items)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(docs(spark, [(1, "a")]), none).isEmpty()
    assert lexical.search(docs(spark, []), spark.createDataFrame([(1, "a")], none.schema)).isEmpty()


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Ab cd-ef " * 500 + "gh"
    want = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.term_counts(text) == want and want == {b"ab": 500, b"cd": 500, b"ef": 500, b"gh": 1}


# 13: alignment


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def table_of(character):
    """GPT-style byte-level characters, written out the long way."""
    own = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    names, extra = {}, 0
    for b in range(256):
        names[chr(b) if b in own else chr(256 + extra)] = b
        extra += b not in own
    return names[character]


def align_plainly(text, tokenizers):
    """(n_a, n_b, groups, links as a Counter of pairs) by definition."""
    a, b = tokenizers
    none = (0, 0, [], Counter())
    if not text:
        return none
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(table_of(c) for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return none
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
    groups, links, last = [], Counter(), 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ([i for i, e in zip(ids, at, strict=True) if last < e <= end] for ids, at in zip((ids_a, ids_b), ends, strict=True))
        groups.append((x, y))
        links.update((i, j) for i in x for j in y)
        last = end
    return len(ids_a), len(ids_b), groups, links


ODD = [None, "", "a", " ", "  a  b ", "\n\n x\ty", "a▁b", "x\x00y", "<|endoftext|> <s> hi", "é ﬁ 漢字 テスト 🎉🎉 x🎉", "x" * 700, " " * 300 + "a" + " " * 77, "don't I'll we've 'S", "﻿a 　b c", "tab\t\tq  \r\n\r\n  z", "1234567 89", "🎉" * 30, "ab " * 50, "c\u0085d   e", "the cat sat", "the cat sat", "the dog"]


def test_alignment(spark, tokenizers):
    rows = [*enumerate(ODD), (None, "the cat"), (3, "the cat"), (3, "another")]
    plain = [align_plainly(t, tokenizers) for _, t in rows]
    holds = Counter(p for *_, links in plain for p in links)
    most: dict[int, int] = {}
    for (a, _), n in holds.items():
        most[a] = max(most.get(a, 0), n)
    want = []
    for (i, _), (n_a, n_b, groups, links) in zip(rows, plain, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(n for p, n in links.items() if holds[p] == most[p[0]])
        want.append((i, n_a, n_b, len(groups), links.total(), n_best, sum(n * holds[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    found = alignment.aligned(messy(docs(spark, rows)).repartition(3), A, B)
    for limit in (alignment.BROADCAST_BYTES, 0):
        got = alignment.scored(found, limit).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert alignment.scored(alignment.aligned(docs(spark, []), A, B)).isEmpty()


def test_windows_are_remembered_and_forgotten(tokenizers):
    a, b = alignment.ByteLevel(A), alignment.Pieces(B)
    assert a.fast is not None
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 8))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 80))) for _ in range(60)]
    one, small = alignment.Aligner(a, b), alignment.Aligner(a, b, most_windows=20)
    want = one.align(texts)
    got = [x for at in range(0, 60, 7) for x in small.align(texts[at : at + 7])]
    learned = len(one.windows.text)
    again = one.align(texts)
    assert len(one.windows.text) == learned and learned < sum(len(t.split()) for t in texts)
    for t, x, y, z in zip(texts, want, got, again, strict=True):
        n_a, n_b, groups, links = align_plainly(t, tokenizers)
        for found in (x, y, z):
            assert found[:4] == (n_a, n_b, len(groups), links.total())
            assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(found[5].tolist(), found[6].tolist(), strict=True)} == links


def test_both_ways_of_encoding_agree():
    a = alignment.ByteLevel(A)
    r = random.Random(9)
    usual = [chr(c) for c in np.nonzero(alignment.usual_characters())[0].tolist()]
    texts = ["".join(r.choice(usual + [" "] * 400 + list("'stre\n\n")) for _ in range(200)) for _ in range(60)]
    fast = a.encode(texts)
    a.fast = None
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(fast, a.encode(texts), strict=True))
