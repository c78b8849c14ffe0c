"""Operators against plain versions where earlier ones could be wrong: equal hashes, shared ids, compression, class shares."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_corpus import docs, perturbed, prose, tokenizer

from kinloom.llm import license, substring, tokens, toxicity
from kinloom.session import shared_path


# 2: rows that share an id, or have none


def kept_plainly(rows, window=13):
    """(doc_id, n_words, n_removed) by definition: a window goes if a smaller id has it; null ids are the largest."""
    rank = lambda i: (i is None, i or 0)
    first = {}
    words = [(t or "").split() for _, t in rows]
    for (i, _), ws in zip(rows, words, strict=True):
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for (i, _), ws in zip(rows, words, strict=True):
        gone = {p for k in range(len(ws) - window + 1) if first[tuple(ws[k : k + window])] < rank(i) for p in range(k, k + window)}
        out.append((i, len(ws), len(gone)))
    return sorted(out, key=str)


def test_substring_of_rows_that_share_an_id(spark):
    a, b = prose(21, 1), prose(21, 2)
    rows = [(1, a), (9, a), (9, b), (9, a + " " + b), (9, b), (None, a), (None, b), (None, prose(21, 3)), (None, prose(21, 3)), (4, b[:40])]
    rows += [(None, prose(14, 50 + k % 90)) for k in range(300)] + [(7, prose(14, 50 + k)) for k in range(80)]
    got = substring.substring_dedup(docs(spark, rows).repartition(4)).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == kept_plainly(rows)


def test_rows_without_an_id_are_spread(spark):
    rows = docs(spark, [(None, f"text {k}") for k in range(4000)])
    found = substring._told_apart(rows, F.col("doc_id"), F.col("text"))
    assert found.select("tag").distinct().count() == 4000
    sizes = [r["count"] for r in found.repartition(8, "id", "tag").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


# 3: pieces whose hashes are equal


def test_pieces_with_equal_hashes():
    """Thue-Morse words and their complements collide under every polynomial hash modulo 2**64."""
    e = tokens.Encoder(tokenizer())
    for k in range(10, 14):
        word = "a"
        for _ in range(k):
            word += word.translate({97: 98, 98: 97})
        texts = [word, word.translate({97: 98, 98: 97}), "x " + word, word]
        assert [x.tolist() for x in e.encode(texts)] == [e.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_any_hash_will_do(monkeypatch):
    monkeypatch.setattr(tokens, "span_hash", lambda prefix, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    e, r = tokens.Encoder(tokenizer()), random.Random(2)
    texts = ["".join(r.choice("ab'st \n12!é") for _ in range(r.randint(0, 60))) for _ in range(300)]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]


def test_token_files_of_rows_without_an_id(spark):
    rows = [(None, prose(5, k)) for k in range(300)] + [(None, "same")] * 200 + [(3, prose(4, 1))]
    path = shared_path(spark, "t")
    tokens.write_tokens(docs(spark, rows).repartition(3), path, tokenizer(), 2, partitions=6)
    parts = Counter(r["part"] for r in spark.read.parquet(path).select("part", F.explode("doc_ids")).collect())
    assert len(parts) == 6 and max(parts.values()) < 250
    got = tokens.read_tokens(spark, path).orderBy("start").collect()
    assert len(got) == 501 and got[-1]["doc_id"] == 3 and [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()


# 4: licenses by compression


def all_windows(text):
    """The licenses of a text by every template over every window of every sentence, best saving first."""
    found = []
    for block, _, _ in license._paragraphs(text):
        spots = [m.span() for m in license._WORD.finditer(block)]
        words = [block[a:b].lower() for a, b in spots]
        cuts = [0, *(sum(a < m.end() for a, _ in spots) for m in license._SENTENCE.finditer(block)), len(words)]
        for first, last in zip(cuts, cuts[1:], strict=False):
            for k, template in enumerate(license._template_words()):
                for a in range(first, last):
                    part = words[a:last][: 2 * len(template)]
                    if part and part[0] in template and license._telling()[k] <= set(part):
                        have, lacks, puts, at = license.differences(part, template)
                        if have >= license.LEAST_WORDS and not any(map(license._TELLING.search, lacks)) and len(puts) <= len(template) // 3:
                            found.append((-license._saved(block[spots[a + at[0]][0] : spots[a + at[-1]][1]], k)[0], license.TEMPLATES[k][0], {(block, a + i) for i in at}))
    names, taken = set(), set()
    for _, name, at in sorted(found, key=lambda x: x[:2]):
        if not at & taken:
            names.add(name)
            taken |= at
    return names


def test_all_templates_over_all_windows_agree():
    r = random.Random(12)
    for name, text in license.TEMPLATES:
        if name == "proprietary" or "SPDX" in text:
            continue
        planted = perturbed(text, r)
        assert {x["license"] for x in license.scan(planted)} == all_windows(planted), planted


def test_compression_ranks(monkeypatch):
    text = "Distributed under the Boost Software License, Version 1.0."
    ranked = license.winners(text)
    assert license.TEMPLATES[ranked[0]] == ("BSL-1.0", text)
    gpl = "This work is licensed under the GNU General Public License, version 2."
    first = [license.TEMPLATES[k][0] for k in license.winners(gpl)]
    assert first[0] == "GPL-2.0" and "GPL-3.0" in first
    license._remembered.cache_clear()
    plain = license._compressors()[0]
    monkeypatch.setattr(license, "_compressors", lambda: [plain] * (len(license.TEMPLATES) + 1))
    assert not license.winners(text) and not license.scan(text)  # with nothing saved there is no winner
    license._remembered.cache_clear()


def test_tags_and_names():
    tag = "# SPDX-License-Identifier: "
    for name in (*license.VERSIONED, "EUPL-1.2", "BSL-1.0", "GPL-2.0"):
        assert [x["license"] for x in license.scan(tag + name)] == [name]
    for text, name in (("License: GPLv3", "GPL-3.0"), ("Licensed under the EUPL, version 1.2", "EUPL-1.2"), ("Use, modification and distribution are subject to the\nBoost Software License, Version 1.0. (See", "BSL-1.0")):
        assert {x["license"] for x in license.scan(text)} == {name}


# 7: the share of toxic rows


def test_toxicity_does_not_depend_on_how_many_are_drawn(spark):
    d = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    known = labels.where(F.col("toxic").isNotNull() & ~toxicity.held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    held = table.join(labels.where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "toxic"), "doc_id").cache()
    rates = []
    for per_label in (4000, 200):  # all there are, and as many of each label
        got = toxicity.score(held, toxicity.fit(table, known, per_label=per_label)).join(held.select("doc_id", "toxic"), "doc_id")
        n = {(r["toxic"], r["hit"]): r["count"] for r in got.groupBy("toxic", (F.col("score") >= 0.7).alias("hit")).count().collect()}
        rates.append((n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0)), n.get((0, False), 0) / (n.get((0, False), 0) + n.get((0, True), 0))))
    assert rates[0][0] >= 0.65 and rates[0][1] >= 0.99 and rates[1][1] >= 0.98 and abs(rates[0][0] - rates[1][0]) <= 0.15, rates


def test_weights_stand_for_rows():
    """Rows that stand for two are as good as the rows twice."""
    r = np.random.default_rng(4)
    label = r.random(600) < 0.2
    votes = np.zeros((600, 12 + toxicity.N_PATTERNS), np.uint8)
    votes[:, :12] = r.random((600, 12)) < np.where(label[:, None], 0.4, 0.02)
    share = r.integers(1, 4, 600).astype(float)
    twice = np.repeat(votes, share.astype(int), axis=0)
    a, b = toxicity.label_model(votes, 0.2, share), toxicity.label_model(twice, 0.2)
    assert np.abs(np.repeat(a, share.astype(int)) - b).max() < 0.05
    assert ((a > 0.5) == label).mean() > 0.95
