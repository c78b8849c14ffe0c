"""Every stage of the pipeline against a plain version of it, over planted and awkward rows, and run() as a whole."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_corpus import brute, closure, fill, prose, reference_fp, tokenizer

import corpus_pipeline as P
from kinloom.llm import language, mixing, tokens

SMALL = "/root/testdata/sf0.001"
#: More columns, with names that the stages use themselves.
CLASH = ["score", "lang_pred", "_turn", "_row", "_mix_row", "row", "take", "fp", "component", "text_hash"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A folder of tables and its rows: part of the given documents, planted copies and passages, nulls, repeated ids."""
    given = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").select("doc_id", "text", "lang", "source").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    en = next(t for _, t, lang, _ in given if lang == "en" and t and 80 < len(t.split()) < 400 and "\n" not in t)
    other = next(t for _, t, lang, _ in given if lang == "de" and t and 80 < len(t.split()) < 400)
    long = " ".join([en, *(t for _, t, lang, _ in given if lang == "en" and t)] * 3)
    odd = [(None, None), (9001, None), (9002, ""), (9003, "1234 ... ½"), (9004, en), (9004, en), (9004, other + " and more of it"), (None, en + " without an id"), (None, other), (9005, en + " " + items[0][1]), (9005, long), (9006, items[1][1])]
    rows = [*given, *((i, t, "en", s) for (i, t), s in zip(odd, ["a", None, "zz"] * 4, strict=True))]
    path = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})
    df.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


@pytest.fixture(scope="module")
def stages(spark, table):
    """The rows (doc_id, text, lang, source) after each stage but the last, and the last one's rows in their order."""
    folder = table[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, out = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        docs = P.materialise(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == columns and {r[0] for r in docs.select("score").distinct().collect()} == {"clash"}
        out.append([tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()])
    last = [tuple(r) for r in P.STAGES[-1][1](spark, docs, folder).orderBy("start").collect()]
    return out, last


def plain_near(rows):
    """One row of each component: the least by id, null ids last, then by the hash of the text."""
    fps = [reference_fp(t) for _, t, *_ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rank = lambda k: (rows[k][0] is None, rows[k][0] or 0, signed(xxhash.xxh64_intdigest((rows[k][1] or "").encode(), 42)), rows[k][1] or "")
    best = {}
    for k, c in closure(pairs, range(len(rows))).items():
        best[c] = min(best.get(c, k), k, key=rank)
    return [rows[k] for k in best.values()]


def plain_mix(rows):
    """(doc_id, text, lang, source) of each turn, in order."""
    size = [len((t or "").split()) for _, t, *_ in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    of = {s: [k for k, r in enumerate(rows) if r[3] == s] for s in sources}
    total = {s: sum(size[k] for k in of[s]) for s in sources}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sources)}
    order = sorted(sources, key=lambda s: 2 * total[s] / weight[s])
    level = [(1.5 * sum(total.values()) - sum(2.0 * total[s] for s in order[:k])) / sum(weight[s] for s in order[k:]) for k in range(len(order))]
    level = max(x for x, s in zip(level, order, strict=True) if x <= 2 * total[s] / weight[s])
    target = {s: min(2.0 * total[s], weight[s] * level) for s in sources}
    assert [target[s] for s in sources] == pytest.approx(fill([total[s] for s in sources], [weight[s] for s in sources], 1.5))
    place = [hashlib.md5(f"{'text ' + format(xxhash.xxh64_intdigest(t.encode(), 42), 'X') if i is None else i}:7".encode()).hexdigest() for i, t, *_ in rows]
    signed = lambda k: int(np.uint64(xxhash.xxh64_intdigest((rows[k][1] or "").encode(), 42)).astype(np.int64))
    served = []
    for s in sources:
        for p in range(2):
            before = total[s] * p
            for k in sorted(of[s], key=lambda k: (place[k], rows[k][0] or 0, size[k], signed(k))):
                before += size[k]
                if size[k]:
                    served.append((before / target[s], place[k], p, signed(k), k))
    left = math.floor(sum(target.values()) + 1e-6)
    out = []
    for *_, k in sorted(served):
        take = min(size[k], left)
        left -= take
        if take:
            out.append((rows[k][0], rows[k][1] if take == size[k] else " ".join(rows[k][1].split()[:take]), *rows[k][2:]))
    return out


def test_stages_against_plain_versions(spark, table, stages):
    _, rows, items = table
    (after_language, after_near, after_clean, after_mix), last = stages
    bag = lambda x: Counter(x)

    model = language.fit(spark.createDataFrame([r for r in rows if not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)], "doc_id long, text string, lang string, source string"))
    real = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    names, scores = model.predict(np.array([language.features(r[1]) for r in real]))
    want = [(i, t, n, s) for (i, t, _, s), n, x in zip(real, names, scores, strict=True) if x >= P.LEAST_LANGUAGE_SCORE]
    assert bag(after_language) == bag(want) and len(want) > 0.9 * len(rows)

    assert bag(after_near) == bag(plain_near(after_language)) and len(after_near) < len(after_language)

    want = [r for r in after_near if all(brute(r[1], x)[0] < 0.8 for _, x in items)]
    assert bag(after_clean) == bag(want) and len(want) < len(after_near)

    mix = plain_mix(after_clean)
    assert bag(after_mix) == bag(mix)

    tok, at = tokens.Encoder(tokenizer()).tok, 0
    assert len(last) == len(mix)
    for (i, t, *_), (doc_id, start, n, crc) in zip(mix, last, strict=True):  # the files keep the order of the turns
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (doc_id, start, n, crc) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run_is_its_stages(spark, table, stages):
    assert [tuple(r) for r in P.run(spark, table[0]).orderBy("start").collect()] == stages[1]


def test_empty_tables(spark, table, tmp_path):
    docs = spark.read.parquet(f"{table[0]}/documents.parquet").where("false")
    for name, stage in P.STAGES:
        assert P.materialise(stage(spark, docs, table[0]), f"empty-{name}").isEmpty()
    some = spark.read.parquet(f"{table[0]}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.drop_contaminated(spark, some, str(tmp_path)).count() == some.count()
    without = prose(5, 5)
    assert P.write_token_ids(spark, spark.createDataFrame([(2, without, None, None, 0), (1, None, None, None, 0)], SCHEMA), "").orderBy("start").first()["doc_id"] == 1
