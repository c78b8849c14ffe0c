"""Each operator against a brute-force version or planted cases, and on the awkward inputs that its docstring defines."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kinloom.llm import common, decontaminate, exact, language, license, mixing, quality, simhash, substring, tokens, toxicity
from kinloom.llm.common import bounded_sample
from kinloom.session import shared_path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("fp", "id", "h", "ws", "digest", "place", "size", "component", "score", "lang_pred", "take", "pos", "votes", "label", "norm")
rng = random.Random(5)
VOCAB = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def docs(spark, rows):
    """rows of (doc_id, text[, source])."""
    full = [(i, t, "en", (s or [None])[0] if s else "s", len(t or "")) for i, t, *s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Nulls, empties, a very long text, exact copies, repeated rows, ties."""
    long = prose(30_000, 1)
    base = prose(120, 2)
    return [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, base), (6, base), (6, base), (7, base.replace(" ", "\n", 3)), (8, "one"), (9, "two words"), (10, "ünï çödé   x"), (11, long + " end"), (None, base), (None, None), (12, "x" * 50_000), (13, base + " " + prose(60, 3))]


def messy(df):
    return df.withColumns({c: F.lit("clash") for c in EXTRA})


# 10: SimHash


def reference_fp(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def closure(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark, odd):
    near = prose(300, 9)
    rows = [*odd, *((100 + k, near[: -(k % 4)] if k % 4 else near + f" w{k // 4}") for k in range(24))]
    got = simhash.near_duplicates(messy(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    fps = {i: reference_fp(t) for i, t in rows if i is not None}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = closure(pairs, fps)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["fp"] % (1 << 64) == fps[r["doc_id"]] for r in got if r["doc_id"] is not None)


@pytest.mark.parametrize("crowded", [4096, 4])
def test_links_find_every_pair(spark, monkeypatch, crowded):
    """With the long chain too: keys that hold many fingerprints."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    r = random.Random(1)
    seeds = [r.getrandbits(64) for _ in range(12)]
    fps = {s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for s in seeds for _ in range(25)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert got == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 300)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure(edges, {x for e in edges for x in e})
    assert got == {n: c for n, c in want.items() if n != c}


# 9: exact


def test_exact(spark, odd, tmp_path):
    messy(docs(spark, odd)).repartition(3).write.parquet(str(tmp_path / "d"))
    norm = lambda t: __import__("re").sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in odd:
        groups.setdefault(norm(t), []).append(i)
    for digest, batch in ((exact.sha256, None), (exact.sha256, 1), (lambda c: F.length(c).cast("string"), None)):  # the last collides
        got = exact.exact_duplicates(spark, str(tmp_path / "d"), digest=digest, files_per_batch=batch).collect()
        assert len(got) == len(odd)
        assert sum(r["kept"] for r in got) == len(groups)
        want = sorted((i, min((x for x in g if x is not None), default=None), len(g)) for i, t in odd if i is not None for g in [groups[norm(t)]])
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got if r["doc_id"] is not None) == want


# 2: substring


def cut(rows, n=13):
    """Brute force: (n_words, n_removed, hash) of each row."""
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, 1 << 62), (1 << 61) if i is None else i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < ((1 << 61) if i is None else i) for j in range(n)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [4 << 20, 2000])
def test_substring(spark, odd, monkeypatch, chunk):
    monkeypatch.setattr(substring, "CHUNK_BYTES", chunk)
    shared = prose(80, 77)
    rows = [*odd, *((200 + k, prose(k * 3, k) + " " + shared[: 50 + k * 10] + " " + prose(20, k + 50)) for k in range(20)), (300, ("ha " * 100).strip()), (301, ("ha " * 40).strip())]
    got = substring.substring_dedup(messy(docs(spark, rows)))
    got = got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=str) == cut(rows)


@pytest.mark.parametrize("hot", [1, 3])
def test_substring_of_hot_anchors(spark, odd, monkeypatch, hot):
    """A phrase in ever other surroundings; its anchor is split, and nothing else changes."""
    for name, value in (("HOT", hot), ("SAMPLE", 1), ("PLACE", 4), ("CHUNK_BYTES", 2000)):
        monkeypatch.setattr(substring, name, value)
    phrase = prose(9, 78)
    rows = [*odd, *((400 + k, prose(20, k % 17) + " " + phrase + " " + prose(25, k % 11)) for k in range(60))]
    plain = docs(spark, rows)
    layout = substring.hot_anchors(plain.select(F.col("doc_id").alias("id"), "text"), 13, substring.Layout([b"abc"]))
    assert len(layout.hot) and (np.diff(layout.hot.astype(object)) > 0).all() and layout.places.max() > 1
    got = substring.substring_dedup(plain).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=str) == cut(rows)


def local_dedup(rows, layout, chunk=7, window=13):
    """The operator's parts without Spark: {id: (n_words, n_removed, factors)} of rows with distinct ids."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    blocks = [b for at in range(0, len(rows), chunk) for b in substring._blocks(np.array([i for i, _ in rows[at : at + chunk]]), np.zeros(len(rows[at : at + chunk]), np.int64), [t for _, t in rows[at : at + chunk]], window, layout)]
    table = pa.Table.from_batches(blocks).sort_by([("key", "ascending"), ("id", "ascending")])
    found = {}
    for b in substring._factors(iter(table.combine_chunks().to_batches()), window):
        for x in b.to_pylist():
            ref, start = np.frombuffer(x["body"], "<i8").tolist()
            found.setdefault(x["id"], []).append({"pos": x["pos"], "words": -x["n"], "ref": ref, "ref_start": start})
    return {i: substring._cut(t, found.get(i, []))[1:] for i, t in rows}


@pytest.mark.parametrize(("bits", "rows_at_once", "words"), [(64, 1 << 15, 0), (2, 1 << 15, 0), (1, 50, 0), (2, 50, 300)])
def test_no_hash_decides(monkeypatch, bits, rows_at_once, words):
    """With hashes of a bit or two all windows meet under a few anchors; only those that are equal go."""
    monkeypatch.setattr(substring.xxhash, "xxh64_intdigest", lambda w, h=xxhash.xxh64_intdigest: h(w) >> (64 - bits))
    monkeypatch.setattr(substring, "BATCH_ROWS", rows_at_once)
    r = random.Random(6)
    phrase = [prose(n, n) for n in (5, 20, 40)]
    rows = [(k, " ".join([prose(r.randint(0, 40), 1000 + k), r.choice(phrase), prose(r.randint(0, 12), 2000 + k % 9), phrase[k % 3], f"own{k}"])) for k in range(80)]
    got = local_dedup(rows, substring.Layout([w.encode() for w in VOCAB[:words]]))
    assert sorted((i, n, gone) for i, (n, gone, _) in got.items()) == sorted(x[:3] for x in cut(rows))
    text = {i: t.split() for i, t in rows}
    for i, (_, gone, factors) in got.items():
        assert sum(f["words"] for f in factors) == gone
        for f in factors:  # each factor is a copy of what it refers to, and an earlier document's
            assert f["ref"] < i and text[i][f["start"] : f["start"] + f["words"]] == text[f["ref"]][f["ref_start"] : f["ref_start"] + f["words"]]


def test_factors_span_what_went(spark):
    shared = prose(40, 8)
    rows = [(1, prose(30, 1) + " " + shared), (2, shared + " " + prose(30, 2))]
    r = substring.substring_dedup(docs(spark, rows)).where("doc_id = 2").first()
    assert [tuple(f) for f in r["factors"]] == [(0, 40, 1, 30)] and r["n_removed"] == 40
    assert substring.substring_dedup(docs(spark, [])).isEmpty()


# 3: tokens


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_are_the_tokenizers(odd):
    e = tokens.Encoder(tokenizer())
    r = random.Random(3)
    texts = [t or "" for _, t in odd] + ["it's we'll don't 'tis ''s x 's\n's", "a  b \n\n c\t", "x<|endoftext|>y", "日本 語", "a\0b", " 'll be", "12ab 3 ½ ..."]
    texts += ["".join(r.choice("ab'stlverd \n\t12!?é ") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    want = [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.encode(texts)] == want
    for c in range(tokens._KNOWN):
        kind = int(tokens._classes()[c])
        if kind in (1, 2, 4):
            n = len(e.tok.pre_tokenizer.pre_tokenize_str("a" + chr(c) + "1" + chr(c) + "!"))
            assert n == {1: 4, 2: 3, 4: 4}[kind]


def test_long_texts_in_parts(monkeypatch):
    e, r = tokens.Encoder(tokenizer()), random.Random(4)
    bits = ["a", "Zb", "'s", "'re", " ", "  ", "\n", "\n\n", " \n", "\t", "9", "é", "日本", "🙂", "…", "\x1f", "\x85", "!", " the", " word", "<|endoftext|>"]
    texts = ["".join(r.choice(bits[: -1 if k % 9 else None]) for _ in range(r.randint(0, 200))) for k in range(1000)]
    whole = [language.features(t) for t in texts]
    for module, chars in ((tokens, 40), (language, 7)):
        monkeypatch.setattr(module, "CHUNK_CHARS", chars)
    for t, x, f in zip(texts, e.tok.encode_batch(texts, add_special_tokens=False), whole, strict=True):
        assert e.encode_parts(t).tolist() == x.ids and np.array_equal(language.features(t), f)


@pytest.mark.parametrize("values", [[0], [0, 0, 0, 5], [0, 1, 2, 3], list(range(0, 90_000, 7)), np.cumsum(np.random.default_rng(1).integers(0, 3000, 1000)).tolist()])
def test_elias_fano(values):
    low, lows, highs, samples = tokens.ef_encode(np.array(values, np.uint64))
    b = tokens.Boundaries(len(values), low, 64, memoryview(lows), memoryview(highs), samples)
    assert b.all().tolist() == values and [b.select(i) for i in range(len(values))] == values


def test_token_files(spark, odd, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 500)
    path = shared_path(spark, "t")
    tokens.write_tokens(messy(docs(spark, odd)), path, tokenizer(), 2)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    tok = tokens.Encoder(tokenizer()).tok
    at = 0
    for (i, t), r in zip(sorted(odd, key=lambda x: (x[0] is not None, x[0] or 0, np.uint64(xxhash.xxh64_intdigest(x[1] or "", 42)).astype(np.int64))), got, strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# 1: decontamination


def test_decontamination(spark, odd):
    items = {1: prose(40, 31), 2: prose(25, 32), 3: "just three words", 4: None, 5: ""}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    words = items[1].split()
    edited = " ".join([*words[:38], "changed", words[39]])
    rows = [*odd, (50, prose(90, 3) + " " + items[1].upper().replace(" ", ", ") + "! " + prose(90, 4)), (51, items[2]), (52, prose(10, 5) + " " + edited), (53, " ".join(words[:20])), (54, "so just three words here"), (55, prose(300, 6)), (55, items[2])]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(messy(docs(spark, rows)), messy(bench)).collect()}
    assert set(got) == {(50, 1), (51, 2), (52, 1), (54, 3), (55, 2)}
    assert got[50, 1]["start"] == 90 and got[50, 1]["similarity"] == 1 and 0.8 <= got[52, 1]["similarity"] < 1
    empty = bench.where("false")
    assert decontaminate.contaminated(docs(spark, rows), empty).isEmpty() and decontaminate.contaminated(docs(spark, []), bench).isEmpty()


def brute(text, item):
    """The greatest similarity of an item-sized window, and its first start."""
    ws, it = (re.findall(r"[a-z0-9]+", x.lower()) for x in (text, item))
    k, n = min(len(it), 5), min(len(it), len(ws))
    bags = [Counter(zip(*(x[i:] for i in range(k)), strict=False)) for x in [it, *(ws[s : s + n] for s in range(len(ws) - n + 1))]]
    return max((((bags[0] & b).total() / (bags[0] | b).total(), -s) for s, b in enumerate(bags[1:])), default=(0, 0))


def test_decontamination_of_every_window(spark):
    """Parts that stand elsewhere than in the item, and texts shorter than it, against all windows."""
    items = {1: prose(60, 31), 2: prose(36, 32), 3: " ".join(["ha", "hu", "ho"] * 14), 4: "just three words"}
    w, v, h = (items[i].split() for i in (1, 2, 3))
    pre, post = prose(100, 33).split(), prose(80, 34).split()
    texts = [[*pre, *w[30:], *w[:30], *post], [*pre, *w[15:], *w[:15], *post], [*pre, *w[20:], *w[:20]], v[:-1], v[1:], v[:-4], v[:20], [*pre[:3], *v[2:]], [*v[18:], *v[:18], *post], h * 3, h[:-1], [*h[:20], "x", *h[20:]], "three words".split(), [*w[:25], "y", *w[25:], *post], [*pre, *w[:40]]]
    want = {}
    for i, t in enumerate(texts):
        for j, item in items.items():
            if (found := brute(" ".join(t), item))[0] >= 0.8:
                want[i, j] = (pytest.approx(found[0]), -found[1])
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontaminate.contaminated(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), bench).collect()}
    assert got == want and {(0, 1), (3, 2), (4, 2), (9, 3)} <= set(want)


def test_index_holds_its_guarantee_and_prunes(spark):
    """Every item within RADIUS is found; of unrelated fingerprints the index meets under one pair in a hundred."""
    r = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seeds = [r.getrandbits(64) for _ in range(300)]
    near = [signed(s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, decontaminate.RADIUS)))) for s in seeds]
    kinds = spark.createDataFrame([(str(k), 36, f) for k, f in enumerate(near)], "wid string, n int, fp long")
    items = spark.createDataFrame([(k, 36, signed(s)) for k, s in enumerate(seeds)], "item_id long, n int, fp long")
    found = {(int(x["wid"]), x["item_id"]) for x in decontaminate.near(kinds, items).collect()}
    assert {(k, k) for k in range(300)} <= found
    meets = 4 * len(decontaminate.flips()) / (1 << 16)
    assert meets < 0.01
    same = spark.createDataFrame([(1, [3, 3, 5]), (2, [-1])], "i int, h array<long>").select("i", decontaminate.simhash(F.col("h"))).collect()
    assert [x[1] for x in same] == [3, -1]


def test_the_way_beside_the_index(spark):
    """Bags of a similarity of 0.8 share one of their rarest shingles; a shingle of all items brings no pairs of others."""
    r = random.Random(3)
    items, kinds, want = [], [], set()
    for k in range(60):
        own = [f"s{r.randint(0, 400)}" for _ in range(30)] + ["everywhere", "everywhere"]
        items.append((k, 36, own))
        for j, gone in enumerate((0, 3, 7)):
            kinds.append((f"{k}-{j}", 36, own[gone:] + [f"t{r.randint(0, 99)}" for _ in range(gone)]))
    bag = lambda a, b: (Counter(a) & Counter(b)).total() / (Counter(a) | Counter(b)).total()
    want = {(w, i) for w, _, a in kinds for i, _, b in items if bag(a, b) >= 0.8}
    found = decontaminate.beside(spark.createDataFrame(kinds, "wid string, n int, sh array<string>"), spark.createDataFrame(items, "item_id long, n int, sh array<string>"), 0.8)
    found = {(x["wid"], x["item_id"]) for x in found.collect()}
    assert want <= found and len(want) >= 120 and len(found) < 0.2 * len(kinds) * len(items)


# 4: licenses


@pytest.mark.parametrize(("text", "want"), [
    ("Released under the MIT License.", ["MIT"]), ("x y z.\nLicensed under the Apache License, Version 2.0. More.", ["Apache-2.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]), ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("This work is now licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("my driving license is lost", []), ("", []), ("nothing", []),
])
def test_licenses(text, want):
    assert [x["license"] for x in license.scan(text)] == want


GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */"""


@pytest.mark.parametrize(("text", "want"), [
    (GPL, [("GPL-3.0-or-later", 1)]), ("code\n\n# All rights\n# reserved.", [("proprietary", 2)]), ("REM All rights\nREM reserved.", [("proprietary", 0)]),
    ("MIT\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights", [("MIT", 2)]),
    ("// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are\n// met:", [("BSD-3-Clause", 0)]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy", [("MPL-2.0", 0)]),
    ("Licensed under the MIT License or the Apache License, Version 2.0.", [("MIT", 0), ("Apache-2.0", 0)]), ("Licensed under the MIT License. Licensed under CC BY 4.0.\nAll rights reserved.", [("MIT", 0), ("CC-BY-4.0", 0), ("proprietary", 1)]),
    ("Licensed under the Apache License, Version 2.0. Die Katze lief mit.", [("Apache-2.0", 0)]), ("Licensed under the Foo License. Die Katze lief mit.", []),
    ("Licensed under the MIT License.\n" * 2 + prose(30, 1), [("MIT", 0), ("MIT", 1)]),
    ("// SPDX-License-Identifier: MIT\ncode", [("MIT", 0)]), ("# SPDX-License-Identifier: MIT OR Apache-2.0", [("MIT", 0), ("Apache-2.0", 0)]), ("Foo is distributed under the MIT license.", [("MIT", 0)]),
    ("All rights reserved under the MIT License.", [("MIT", 0)]), ("This is free and unencumbered software released into the public domain.", [("Unlicense", 0)]),
])
def test_wrapped_and_several_licenses(text, want):
    assert sorted((x["line"], x["license"]) for x in license.scan(text)) == sorted((n, x) for x, n in want)


def perturbed(text, r):
    """A notice as files have it: wrapped behind comment marks, a word put in or another case, between other lines."""
    words = text.split()
    if len(words) > 12:
        words.insert(r.randint(3, len(words) - 3), r.choice(["hereby", "also", "fully"]))
    mark, width = r.choice(["# ", " * ", "// ", ""]), r.randint(40, 90)
    lines, line = [], ""
    for w in words:
        if len(line) + len(w) > width:
            lines, line = [*lines, line], ""
        line += (" " if line else "") + (w.upper() if r.random() < 0.03 and w.isalpha() else w)
    return "\n".join([prose(12, r.randint(0, 99)) + ".", "", *(mark + x for x in [*lines, line]), "", prose(9, r.randint(0, 99)) + "."])


def test_planted_licenses_are_found():
    """Recall of planted, perturbed notices, and none found in prose that speaks of licenses, rights or copyright."""
    r = random.Random(7)
    found = n = 0
    for name, text in license.TEMPLATES:
        for _ in range(8):
            n += 1
            found += name in {x["license"] for x in license.scan(perturbed(text, r))}
    assert found / n >= 0.95, found / n
    clean = [" ".join(r.sample([*prose(30, k).split(), "license", "copyright", "free", "software", "rights"], 30)) + "." for k in range(200)]
    assert sum(bool(license.scan(t)) for t in clean) <= 1


def test_license_rows_wrapped(spark):
    assert {r["license"] for r in license.license_blocks(docs(spark, [(1, GPL), (2, "# All rights\n# reserved.")])).collect()} == {"GPL-3.0-or-later", "proprietary"}


def test_license_rows(spark, odd):
    rows = [*odd, (60, "a\nReleased under the MIT License."), (60, "a\nReleased under the MIT License."), (None, "All rights reserved.")]
    got = license.license_blocks(messy(docs(spark, rows))).collect()
    assert sorted((str(r["doc_id"]), r["line"], r["license"]) for r in got) == [("60", 1, "MIT"), ("60", 1, "MIT"), ("None", 0, "proprietary")]
    assert license.license_blocks(docs(spark, [])).isEmpty()


# 6: mixing


def fill(sizes, weights, share):
    """Targets by raising the level little by little."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while left > 1e-9 and open_:
        total = sum(weights[i] for i in open_)
        step = min(left / total, min((2 * sizes[i] - out[i]) / weights[i] for i in open_))
        for i in open_:
            out[i] += step * weights[i]
        left -= step * total
        open_ = {i for i in open_ if 2 * sizes[i] - out[i] > 1e-9}
    return out


def test_targets_fill_up(spark):
    r = random.Random(4)
    for n in (1, 2, 7, 20):
        sizes = [r.randint(1, 1000) for _ in range(n)]
        df = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "source string, source_size long")
        got = [x["target"] for x in mixing.targets(df, mixing.WEIGHTS, 1.5, 2).orderBy("source").collect()]
        want = fill(sizes, [mixing.WEIGHTS[i % 3] for i in range(n)], 1.5)
        assert got == pytest.approx(want) and min(got) > 0 and sum(got) == pytest.approx(1.5 * sum(sizes))


def test_mixing(spark, odd):
    rows = [(i, t, s) for (i, t), s in zip(odd, ["a", "b", None, "a"] * 4, strict=True)] + [(100 + k, prose(20 + k, k), "abc"[k % 3]) for k in range(90)]
    queue = mixing.schedule(messy(docs(spark, rows)), mixing.WEIGHTS).cache()
    assert queue.count() == len(rows)
    turns = mixing.turns(queue).collect()
    assert [t["finish"] for t in turns] == sorted(t["finish"] for t in turns)
    by = Counter()
    for t in turns:
        by[t["source"]] += t["take"]
    aims = queue.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.max("size").alias("longest")).collect()
    assert sum(by.values()) == int(sum(r["target"] for r in aims) + 1e-6)
    for r in aims:  # a source is at its target but for the document in service, and what others left is shared alike
        assert r["target"] - r["longest"] <= by[r["source"]] <= turns[-1]["finish"] * r["target"] + 1e-6 and r["target"] <= 2 * r["source_size"] + 1e-6
        assert by[r["source"]] <= 2 * r["source_size"]
    # Only the truncation ends the mix: every document waits for each of its passes until then.
    assert 2 * sum(t["size"] for t in queue.collect()) > sum(by.values()) and sum(t["take"] < t["size"] for t in turns) <= 1
    assert all(t["take"] <= t["size"] for t in turns)
    again = mixing.turns(mixing.schedule(docs(spark, rows[::-1]).repartition(5), mixing.WEIGHTS)).collect()
    assert [(t["doc_id"], t["take"]) for t in again] == [(t["doc_id"], t["take"]) for t in turns]
    twins = docs(spark, [(1, "a b c", "x"), (1, "d e f", "x"), (1, "g h i", "x")] * 2 + [(2, "k", "y")])
    orders = [[r["text"] for r in mixing.mixed(twins.repartition(n), mixing.WEIGHTS).collect()] for n in (1, 3, 4)]
    assert orders[0] == orders[1] == orders[2]
    mix = mixing.mixed(docs(spark, rows[16:]), mixing.WEIGHTS)
    assert mix.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    total = sum(len((t or "").split()) for _, t, _ in rows[16:])
    assert abs(sum(len(r["text"].split()) for r in mix.collect()) - 1.5 * total) <= 3
    assert mixing.schedule(docs(spark, []), mixing.WEIGHTS).isEmpty()


def test_turns_interleave_sources(spark):
    """A reader that stops early has read the sources in proportion; the query goes the same way."""
    rows = [(k, prose(20 + k % 7, k), "abc"[k % 3]) for k in range(300)]
    queue = mixing.schedule(docs(spark, rows), mixing.WEIGHTS).cache()
    want = {(t["doc_id"], t["pass"]): t["turn"] for t in mixing.turns(queue).collect()}
    assert sorted(want.values()) == list(range(len(want)))
    mix = mixing.mixed(docs(spark, rows), mixing.WEIGHTS, turn_col="turn").collect()
    assert [r["turn"] for r in mix] == list(range(len(want)))
    aims = {r["source"]: r["target"] for r in queue.select("source", "target").distinct().collect()}
    for share in (0.25, 0.5, 0.75):
        read, left = dict.fromkeys("abc", 0), share * sum(aims.values())
        for r in mix:
            if left > 0:
                read[r["source"]] += len(r["text"].split())
                left -= len(r["text"].split())
        assert all(abs(read[s] / aims[s] - share) < 0.05 for s in "abc")


# 5, 7, 8: classifiers


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet").cache(), spark.read.parquet(f"{d}/labels.parquet").cache()


def test_language(spark, odd, tables):
    found = language.identify(messy(tables[0].drop(*EXTRA))).join(tables[0].select("doc_id", "lang"), "doc_id")
    r = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.min("score"), F.max("score")).first()
    assert r["right"] > 0.97 and r[1] >= 0 and r[2] <= 1
    got = language.predict(docs(spark, odd), language.fit(tables[0])).collect()
    assert len(got) == len(odd)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, None}
    assert language.identify(docs(spark, [])).isEmpty()
    assert {r["lang_pred"] for r in language.predict(docs(spark, odd), language.fit(docs(spark, []))).collect()} == {"und"}


def measures(found, labels, name):
    r = {(x["label"], x["predicted"]): x["n"] for x in found.where("held_out").join(labels.select("doc_id", F.col(name).alias("label")), "doc_id").groupBy("label", "predicted").agg(F.count("*").alias("n")).collect()}
    return r.get((1, 1), 0) / max(1, r.get((1, 1), 0) + r.get((1, 0), 0)), r.get((0, 0), 0) / max(1, r.get((0, 0), 0) + r.get((0, 1), 0))


def test_toxicity(spark, odd, tables):
    caught, left = measures(toxicity.rate(messy(tables[0]), messy(tables[1])), tables[1], "toxic")
    assert caught >= 0.6 and left >= 0.99
    got = toxicity.rate(docs(spark, [*odd, (70, "You idiot, you pathetic moron, what worthless trash.")]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(odd) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.rate(docs(spark, []), tables[1]).isEmpty()


def test_quality(spark, odd, tables):
    caught, left = measures(quality.rate(messy(tables[0]), messy(tables[1])), tables[1], "quality")
    assert caught >= 0.95 and left >= 0.9
    got = quality.rate(docs(spark, odd), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(odd) and {r["score"] for r in got} == {0.5}
    assert quality.rate(docs(spark, []), tables[1]).isEmpty()


def test_sample_is_bounded_and_the_same_again(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("label"))
    a, b = (sorted(r["id"] for r in bounded_sample(x, "id", "label", 300).collect()) for x in (df, df.repartition(7)))
    assert a == b and 400 < len(a) < 620


# Inputs without rows, and what two operators make of awkward names and paths


def test_empty_tables_of_the_rest(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "none"))
    assert exact.exact_duplicates(spark, str(tmp_path / "none")).isEmpty()
    assert simhash.near_duplicates(docs(spark, [])).isEmpty()
    path = shared_path(spark, "none")
    tokens.write_tokens(docs(spark, []), path, tokenizer(), 2)
    assert tokens.read_tokens(spark, path).isEmpty()


def test_exact_with_a_heavy_digest_and_a_slash(spark, tmp_path, monkeypatch):
    """Copies far above the bound of a heavy key, compared in several places; new files carry on from the same store."""
    monkeypatch.setattr(exact, "TOGETHER", 50)
    rows = [(k, "copies all over" if k % 3 else f"text {k}") for k in range(900)]
    store = shared_path(spark, "store")
    docs(spark, rows[:600]).repartition(4).write.parquet(str(tmp_path / "d"))
    exact.exact_duplicates(spark, str(tmp_path / "d") + "/", store=store)
    docs(spark, rows[600:]).repartition(2).write.mode("append").parquet(str(tmp_path / "d"))
    got = exact.exact_duplicates(spark, str(tmp_path / "d") + "/", store=store).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(k, 1 if k % 3 else k, 600 if k % 3 else 1, k == 1 or k % 3 == 0) for k in range(900)]


def test_simhash_of_many_copies_and_a_hub(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    base = prose(300, 12)
    rows = [(k, base if k % 2 else base + f" w{k}") for k in range(80)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fps = {i: reference_fp(t) for i, t in rows}
    want = closure([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], fps)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == 80
    star = [(0, k) for k in range(1, 60)] + [(100 + k, 200) for k in range(60)]
    found = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 60)}, **{100 + k: 100 for k in range(1, 60)}, 200: 100}


def test_mix_of_rows_without_or_with_the_same_id(spark):
    rows = [(None, prose(30, 1), "a"), (None, prose(40, 2), "a"), (5, prose(50, 3), "b"), (5, prose(50, 3), "b"), (5, prose(20, 4), "b"), (6, None, None), (7, prose(60, 5), None)]
    mix = mixing.mixed(docs(spark, rows).withColumn("_turn", F.lit(1)), mixing.WEIGHTS).collect()
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(sum(len(r["text"].split()) for r in mix) - 1.5 * total) <= 3
    served = Counter(r["text"] for r in mix)
    assert all(served[t] <= 2 * n for t, n in Counter(t for _, t, _ in rows).items())


def test_predicted_columns_do_not_replace_given_ones(spark, tables):
    df = docs(spark, [(1, "x² ½ ²"), (2, "²½"), (3, prose(20, 1))])
    model = language.fit(tables[0])
    assert [r["lang_pred"] == "und" for r in language.predict(df, model).orderBy("doc_id").collect()] == [False, True, False]
    with pytest.raises(ValueError):
        language.predict(df.withColumn("score", F.lit(1)), model)
    out = language.predict(df.withColumn("score", F.lit(1)), model, score_col="s").where("doc_id = 2").first()
    assert out["score"] == 1 and out["s"] == 0


def test_label_model_learns_from_votes_alone():
    """Two groups of voters that agree within themselves: posteriors follow them, with no label given."""
    r = np.random.default_rng(3)
    y = r.random(3000) < 0.15
    votes = (r.random((3000, 20)) < np.where(y[:, None], 0.35, 0.0005)).astype(np.uint8)
    votes = np.hstack([votes, np.zeros((3000, toxicity.N_PATTERNS), np.uint8)])
    post = toxicity.label_model(votes, 0.1)
    assert ((post > 0.5) == y).mean() > 0.97
