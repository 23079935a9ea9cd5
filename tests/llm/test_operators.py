"""The training-data operators against brute force on small tables, and their edge cases."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagewright.llm import brown, language, queries, toxicity
from pagewright.llm.components import connected_components
from pagewright.llm.licenses import NOTICES, PHRASES, scan_licenses
from pagewright.llm.minhash import MinHashParams, near_duplicates
from pagewright.llm.mixing import MixParams, mix, mixed_documents
from pagewright.llm.packing import combine, pack
from pagewright.llm.quality import judge
from pagewright.llm.spans import remove_repeats
from pagewright.llm.vectors import similar_vectors

TINY = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, rows):
    """Rows (doc_id, text, source?), with columns whose names clash with results."""
    full = [(i, t, *(more or ["en", "s"]), 0) for i, t, *more in rows]
    return spark.createDataFrame(full, SCHEMA).withColumn("score", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("size", F.lit("y"))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, letterless, repeated and very long texts."""
    long = " ".join(random.Random(3).choices(WORDS, k=30_000))
    return docs_of(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "12 34 !"), (5, "one"), (5, "one"), (6, long, None, None), (None, "no id here")])


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, width=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def test_components_are_those_of_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, i) for i in range(400, 480)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: r for n, r in roots(nodes, links).items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    base = rng.choices(WORDS, k=120)
    texts = [" ".join(base)] * 3
    for n in (1, 1, 2, 2, 3, 3, 4, 5, 8, 12) * 4:
        copy = list(base)
        for at in rng.sample(range(120), n):
            copy[at] = rng.choice(WORDS).upper()
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(WORDS, k=50)) for _ in range(30)] + ["a b", "A b", "a b c", None, "", "  "]
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    expected = roots(range(len(texts)), links)
    docs = docs_of(spark, list(enumerate(texts))).repartition(3)
    for params in (MinHashParams(), MinHashParams(block=8)):
        got = {r.doc_id: r for r in near_duplicates(docs, params).collect()}
        assert {i: r.component_id for i, r in got.items()} == expected
        assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_from_80_percent(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words[:88], *(f"x{i}" for i in range(4))]), " ".join([*words[:80], *(f"y{i}" for i in range(30))])]
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(3) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert near == [(1, 0)] and 100 * len(sets[0] & sets[1]) < 85 * len(sets[0] | sets[1])
    docs = docs_of(spark, list(enumerate(texts)))
    for percent, expected in ((80, {0: 0, 1: 0, 2: 2}), (85, {0: 0, 1: 1, 2: 2})):
        got = near_duplicates(docs, MinHashParams(percent=percent)).collect()
        assert {r.doc_id: r.component_id for r in got} == expected


def test_vectors_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 32))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.standard_normal(32) * (0.1 + 0.3 * (i % 5))
        rows.append((i, v.tolist(), i % 2))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [0.0] * 32, 0), (304, [float("nan")] * 32, 0),
             (305, [None] * 32, 0), (306, rows[0][1], None), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0), (309, [], 0)]
    ok = [(i, np.array(v), k) for i, v, k in rows if k is not None and i not in (302, 303, 304, 305, 309)]
    links = [(a, b) for a, v, k in ok for b, w, m in ok if b < a and k == m and len(v) == len(w)
             and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.93]
    count = Counter(n for link in links for n in link)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))
    got = {r.vec_id: r for r in similar_vectors(frame).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: count[i] for i, _, _ in rows}
    assert {i: r.component_id for i, r in got.items()} == roots([r[0] for r in rows], links)


def test_mix_comes_near_its_targets(spark, odd):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 300))), "en", ["a", "b", "c", None, "small"][min(i % 7, 4) if i % 50 else 4]) for i in range(900)]
    docs = docs_of(spark, rows)
    got = mix(docs).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken").collect()
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    total = sum(size.values())
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 0.02 * target[s] + 200
    again = mix(docs.repartition(7)).select("doc.doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}
    parts = mixed_documents(docs)
    assert parts.columns == docs.columns
    words = Counter()
    for r in parts.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == +Counter({r.doc_id: r.taken for r in got})
    assert mix(odd).count() == 8 and mix(odd, MixParams(block=64)).where("taken > 3 * size").count() == 0


def test_every_length_is_packed_once():
    rng = random.Random(8)
    for _ in range(30):
        capacity = rng.choice([10, 50, 200])
        counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(300)))
        bins = combine(counts, capacity)
        used = Counter()
        for parts, n in bins:
            assert sum(parts) <= capacity and n > 0
            for p in parts:
                used[p] += n
        assert used == counts
    assert combine({7: 5, 3: 5, 4: 2, 2: 3}, 10) == [((7, 3), 5), ((4, 4, 2), 1), ((2, 2), 1)]


def test_packing_keeps_all_tokens(spark, odd):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").unionByName(
        odd.where("doc_id in (1, 2, 3, 4, 6)").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).unionByName(
        spark.createDataFrame([(20_000, "x <|endoftext|> Y\x1cz  É q"), (20_001, "don't It's ÉA ΟΔΟΣ")], "doc_id long, text string"))
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in pack(docs, with_ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 2048
        pieces[r.doc_id].append((r.piece, r.start, r.ids))
        places[r.sequence_id].append((r.offset, r.length))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.collect():
        found = sorted(pieces[r.doc_id], key=lambda p: p[0])
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert [i for p in found for i in p[2]] == ids
        assert [p[1] for p in found] == list(range(0, len(ids), 2048))
    total = 0
    for items in places.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert len(places) <= math.ceil(total / 2048) * 1.05 + 1


def test_repeated_passages_go_once(spark, odd):
    rng = random.Random(6)
    prose = lambda n: " ".join(" ".join(rng.choices(WORDS, k=9)).capitalize() + "." for _ in range(n))
    passage = prose(8)
    texts = [f"{prose(5)} {passage} {prose(5)}" for _ in range(5)] + [prose(12) for _ in range(5)] + [f"{prose(3)}\n\n{prose(3)}  {passage}"]
    docs = docs_of(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert got[0].text == texts[0] and all(got[i].text == texts[i] for i in range(5, 10))
    for i in (1, 2, 3, 4, 10):
        assert passage not in got[i].text and got[i].words_removed == 72
        assert len(got[i].text.split()) == len(texts[i].split()) - 72
    same = remove_repeats(odd)
    assert same.columns[:-3] == [c for c in odd.columns if c != "text"][:1] + ["text"] + odd.columns[2:]
    assert sorted((str(r.doc_id), str(r.text)) for r in same.collect()) == sorted((str(r.doc_id), str(r.text)) for r in odd.collect())


@pytest.fixture(scope="module")
def rude(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = ["".join(rng.choices(["lo", "ma", "sten", "ir", "va", "kun", "de", "pol"], k=rng.randrange(1, 4))) for _ in range(60)]
        if i % 4 == 0:
            for insult in rng.sample(["nitwit", "blockhead", "scoundrel", "numbskull"], 3):
                words.insert(rng.randrange(60), insult)
        rows.append((i, " ".join(words) + ".", int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxic_words_are_found_through_gaps(spark, rude, odd):
    model = toxicity.fit(rude.where("doc_id < 300"))
    score = {r.doc_id: r.score for r in toxicity.score(rude.where("doc_id >= 300"), model).collect()}
    assert all((s >= 0.3) == (i % 4 == 0) for i, s in score.items())
    values = toxicity.decisions(["nitwit", "nitxwit", "blockhhead", "lokunma"], model)
    assert values[0] > 0 and values[1] > values[3] and values[2] > 0 and values[3] < 0
    assert toxicity.segments("N I T W I T, no") == ["n", "i", "t", "w", "i", "t", "no", "nitwit"]
    assert toxicity.score(odd, model).where("score >= 0.3").count() == 0 and toxicity.score(odd, model).count() == 8
    assert toxicity.clean_documents(odd, model).count() == 8
    kept = toxicity.clean_documents(rude.where("doc_id >= 300"), model)
    assert kept.columns == rude.columns and {r.doc_id % 4 for r in kept.collect()} == {1, 2, 3}
    blank = toxicity.fit(rude.where("toxic = 0"))
    assert toxicity.score(rude, blank).where("score >= 0.3").count() == 0


def test_toxic_words_are_learned_from_all_windows():
    rng = random.Random(4)
    stems = ["lokunmade", "irstenpol", "vamadekun"]
    clean = {f"{s}{''.join(rng.choices(['pol', 'va', 'ir', 'sten'], k=2))}": 20 for s in stems for _ in range(20)}
    params = toxicity.ToxicityParams()
    good = dict.fromkeys(toxicity._parts(list(clean), params.window, params.step)[0], 20) if hasattr(toxicity, "_parts") else clean
    weights, bias = toxicity._fit(good, {f"{s}schnurf": 20 for s in stems}, params)
    model = toxicity.ToxicityModel(weights, bias, (1.0, 0.0), 0.0, params)
    assert (toxicity.decisions([f"{s}schnurf" for s in stems], model) > 0).all()
    assert (toxicity.decisions(list(clean), model) < 0).all()


def test_a_worker_keeps_the_values_of_one_model():
    models = [toxicity.ToxicityModel(np.full(1 << 18, k, np.float32), k, (1.0, 0.0), 0.0, toxicity.ToxicityParams()) for k in (1.0, 2.0)]
    values = [dict(toxicity._known({"word", "other"}, m)) for m in (*models, models[0])]
    assert values[0] == values[2] != values[1]
    assert list(toxicity._cache) == [models[0].key()]


def test_languages(spark, odd):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = language.fit(docs.where("doc_id % 3 != 0"))
    held = language.identify(docs.where("doc_id % 3 = 0"), model).join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang_pred != lang").count() <= 0.02 * held.count()
    got = {r.doc_id: r.lang_pred for r in language.identify(odd.where("doc_id < 5"), model).collect()}
    assert set(got.values()) == {"und"} and len(got) == 4
    none = language.fit(docs.where("false"))
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}


def test_code_lengths_are_those_of_the_tree():
    text = b"abracadabra abra"
    rows = [("x", k, n) for k, n in Counter(int.from_bytes((b"\n\n\n" + text)[i:i + 4], "big") for i in range(len(text))).items()]
    model = language.build(rows)
    counts = defaultdict(Counter)
    padded = b"\n\n\n" + text
    for i in range(3, len(padded)):
        for k in range(4):
            counts[padded[i - k:i]][padded[i]] += 1

    def p(context, byte):
        lower = 1 / 256 if not context else p(context[1:], byte)
        seen = counts[context]
        if not seen:
            return lower
        n, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return seen[byte] / (n + kinds)
        low = lambda b: 1 / 256 if not context else p(context[1:], b)
        rest = sum(low(b) for b in set(padded[3:]) if b not in seen) + (128 - len(set(padded[3:]))) * low(0)
        return kinds / (n + kinds) * lower / rest

    probe = b"abba cad"
    bits = -sum(math.log2(p((b"\n\n\n" + probe)[i:i + 3], probe[i])) for i in range(len(probe)))
    assert abs(language.lengths([probe], model)[0, 0] - bits) < 0.1


def test_unigram_scores_are_exact(spark, odd):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").unionByName(odd.where("doc_id < 4").select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    docs = docs.withColumn("held_out", F.col("doc_id") % 5 == 0)
    rows = docs.collect()
    tokens = {r.doc_id: brown.tokens((r.text or "").encode()) for r in rows}
    counts = Counter(t for r in rows if not r.held_out for t in tokens[r.doc_id])
    n, v = sum(counts.values()), len(counts)
    for params in (brown.BrownParams(), brown.BrownParams(head=50, words=20, classes=4)):
        model, rest = brown.fit(docs.where("not held_out"), params)
        for r in brown.score(docs, model, rest).collect():
            words = tokens[r.doc_id]
            base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(w in counts for w in words), n)
            assert abs(r.base_score - base) < 1e-6 and r.score < 0


def test_tokens_of_many_texts_are_coded_at_once(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice(np.frombuffer(b"aAB \t\n\x0b\x0c\r\x1c\x85\xa0\xff\xc3z", np.uint8), n)) for n in rng.integers(0, 12, 2000)]
    monkeypatch.setattr(brown, "_BYTES", 300)
    got = []
    for words, at, sizes in brown.coded(pa.array(texts, pa.binary()).slice(3)):
        assert len(set(words)) == len(words)
        got += [[words[i] for i in part] for part in np.split(at, np.cumsum(sizes)[:-1])]
    assert got == [brown.tokens(t) for t in texts[3:]]


def test_exchange_finds_classes():
    rng = random.Random(2)
    groups = [range(0, 10), range(10, 20), range(20, 30)]
    pairs = np.zeros((31, 31))
    for _ in range(4000):
        k = rng.randrange(3)
        pairs[rng.choice(groups[k]), rng.choice(groups[(k + 1) % 3])] += 1
    of = brown.exchange(pairs, 30, 3, 20)
    assert [len(set(of[list(g)])) for g in groups] == [1, 1, 1] and len(set(of[:30])) == 3


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(1)
    words, classes, total = 30, 5, 10
    pairs = (rng.integers(0, 6, (35, 35)) * (rng.random((35, 35)) < 0.5)).astype(float)
    of = np.concatenate([rng.integers(0, classes, words), np.arange(classes, total)])
    of[3] = 6

    def table(of):
        out = np.zeros((total, total))
        np.add.at(out, (of[:, None], of[None, :]), pairs)
        return out

    own = np.diag(pairs)[:words]
    right, left = (np.array([np.bincount(of, side[w] * (np.arange(35) != w), total) for w in range(words)]) for side in (pairs, pairs.T))
    got = brown.gains(right, left, own, of[:words], table(of), classes)
    for w in range(words):
        values = [brown.likelihood(table(np.where(np.arange(35) == w, k, of))) for k in range(classes)]
        assert np.allclose(got[w] - got[w][0], np.array(values) - values[0])


def test_every_frequent_word_gets_an_exchange_class(spark):
    rng = random.Random(12)
    groups = [[f"{a}{i}x{i % 7}" for i in range(500)] for a in "abc"]
    texts = [" ".join(rng.choice(groups[(start + i) % 3]) for i in range(300)) for start in range(3) for _ in range(100)]
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)] + [(900, "a1x1 rare", False)], "doc_id long, text string, held_out boolean").repartition(5)
    model, rest = brown.fit(docs, brown.BrownParams(words=60, classes=3))
    counts = Counter(w for t in texts for w in t.split())
    often = [w for g in groups for w in g if counts[w] >= 20]
    assert len(often) > 1400 and len(model.known.hashes) == len(often)
    classes = [{int(k) for k in model.of[model.known.numbers([w.encode() for w in g if counts[w] >= 20])]} for g in groups]
    assert sorted(map(sorted, classes)) == [[0], [1], [2]]
    assert model.of[model.known.numbers([b"rare"])][0] >= 3 and brown.score(docs, model, rest).count() == 301


def test_license_phrases(spark, odd):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([
        (10_001, "CC-BY cc by, All Rights\nReserved. all rights reserved"), (10_002, "Licensed under the Apache Foundation"),
        (10_003, "x Licensed under the APACHE licence, Apache License, Version 2.0 y"), (10_004, "Released under the MIT-License")], "doc_id long, text string")).unionByName(
        odd.select(F.coalesce(F.col("doc_id"), F.lit(9)) + 20_000, "text").toDF("doc_id", "text").dropDuplicates())
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        places = {label: [i for i in range(len(words)) if words[i:i + len(p.split())] == p.split()] for p, label in PHRASES.items()}
        every = sorted(i for s in places.values() for i in s)
        o = got[r.doc_id]
        assert (o.n_words, o.n_base, o.first_word, o.last_word) == (len(words), len(every), min(every, default=None), max(every, default=None))
        assert o.base_labels == ",".join(sorted(k for k, s in places.items() if s)) and 0 <= o.score <= 1
        assert ("mit" in o.labels.split(",")) == ("released under the mit license" in " ".join(words))
    assert got[10_001].labels == "cc-by,reserved" and got[10_002].labels == "" and got[10_003].labels == "apache-2.0" and got[10_004].labels == "mit"


def test_every_notice_of_a_text_is_found(spark):
    prose = " binary forms permitted subject terms without source redistribution modification " * 5
    texts = [" x ".join(notice for _, _, notice in NOTICES), *(prose + notice + prose for _, _, notice in NOTICES)]
    docs = spark.createDataFrame(list(enumerate(texts + ["released under the mit license"] * 40)), "doc_id long, text string")
    got = {r.doc_id: {n.label for n in r.notices} for r in scan_licenses(docs).collect()}
    assert got[0] == {label for label, _, _ in NOTICES}
    assert all(label in got[i] for i, (label, _, _) in enumerate(NOTICES, 1))


def test_licenses_of_long_texts_take_linear_time(spark):
    notice = "Licensed under the Apache License, Version 2.0 x "
    docs = spark.createDataFrame([(1, notice * 8000), (1, notice), (None, "MIT License")], "doc_id long, text string")
    start = time.monotonic()
    got = sorted((r.doc_id or 0, r.n_words, len(r.notices), r.labels) for r in scan_licenses(docs).collect())
    assert got == [(0, 2, 0, ""), (1, 9, 1, "apache-2.0"), (1, 72_000, 8000, "apache-2.0")]
    assert time.monotonic() - start < 60
    assert scan_licenses(docs.where("false")).count() == 0


def test_quality_counts(spark, odd):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 5"))
    rows = {(r.doc_id, r.n_words): r for r in judge(docs).collect()}
    for r in docs.collect():
        words = (r.text or "").encode().split()
        o = rows[r.doc_id, len(words)]
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        twice = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if twice[w] > 1 for k in range(8)}
        lines = [x for x in (r.text or "").split("\n") if x.encode().split()]
        assert o.word_chars == sum(len(w.decode()) for w in words) and o.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
        assert o.n_dup_lines == len(lines) - len(set(lines)) and o.n_repeat_words == len(covered)
        assert o.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (o.base_failed and o.kept)


def test_common_words_do_not_depend_on_batches(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    one, many = (sorted((r.doc_id, r.word_distance) for r in judge(docs.repartition(n, "doc_id")).collect()) for n in (1, 40))
    assert one == many


def test_pipeline_and_queries_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{TINY}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.REGISTRY.items():
        # The chat query adds a conversation of its own.
        assert query(spark, str(tmp_path)).count() == (name == "op11_chat_format"), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").withColumn("size", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TINY)
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
