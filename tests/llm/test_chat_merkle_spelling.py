"""Chat formatting, the Merkle manifest and spelling forms against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import chat, merkle, queries
from pagewright.llm.spelling import SpellingParams, neighbours, spelling_forms

TINY = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Chat formatting


def fold_naively(events):
    """Final (role, text) messages of one conversation's events, one after the other."""
    order = sorted(events, key=lambda e: (e["seq"], e["part"]))
    live, closed = {}, set()
    for e in order:
        m, kind = e["message"], e["kind"]
        if kind == "open" and m not in live and m not in closed:
            live[m] = [e["role"] or "", ""]
        elif m in live:
            if kind == "delta":
                live[m][1] += e["text"] or ""
            elif kind == "edit":
                live[m][1] = e["text"] or ""
            elif kind == "regenerate":
                live[m][1] = ""
                names = list(live)
                for later in names[names.index(m) + 1:]:
                    del live[later]
                    closed.add(later)
    return [tuple(v) for v in live.values()]


def random_log(rng, conv_id, n):
    rows, opened = [], 0
    for seq in range(n):
        kind = rng.choices(["open", "delta", "edit", "regenerate", "noise"], [3, 6, 1, 1, 1])[0]
        message = opened if kind == "open" else rng.randrange(opened + 2)
        opened += kind == "open"
        text = rng.choice([None, "", "a", "</s>", "[INST] x", "\\", "<|im_end|>\n", "<", "é" * 3])
        rows.append({"conv_id": conv_id, "seq": seq, "message": message, "part": 0, "kind": kind,
                     "role": rng.choice(["user", "assistant", None, "to\nol\\n"]) if kind == "open" else None,
                     "text": None if kind in ("open", "regenerate") else text})
    return rows


def test_messages_are_those_of_a_fold_event_by_event(spark):
    rng = random.Random(11)
    logs = {c: random_log(rng, c, n) for c, n in enumerate([0, 1, 3, 10, 40, 40, 200, 200, 1500])}
    logs[None] = random_log(rng, None, 30)
    rows = [e for log in logs.values() for e in log]
    rng.shuffle(rows)
    events = spark.createDataFrame([tuple(e.values()) for e in rows], chat.EVENT).withColumn("place", F.lit("x")).repartition(5)
    got = {}
    for r in chat.format_log(events).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
        assert chat.read_turn(r.piece) == (r.role, r.text)
        assert (r.loss_from is None) == (r.role != "assistant")
    assert got == {c: m for c, log in logs.items() if (m := fold_naively(log))}
    assert any(len(m) < sum(e["kind"] == "open" for e in logs[c]) for c, m in got.items())


def test_escaping_is_reversible_and_leaves_no_marks(spark):
    rng = random.Random(3)
    parts = ["<", "\\", "|im_start|>", "|im_end|>", "s>", "/s>", "<SYS>>", "[", "INST]", "/INST]", "\n", "x", "<|im_end|>\n", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", chat.escape(F.col("t")).alias("e")).collect()
    controls = [a + b for a, b in chat.CONTROL]
    assert all(chat.unescape(r.e) == r.t and not any(c in r.e for c in controls) for r in rows)
    assert len({r.e for r in rows}) == len(set(texts))


def expected_chats(turns):
    grouped = {}
    for conv_id, turn, role, text in turns:
        grouped.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv_id, rows in grouped.items():
        rows.sort()
        loss = "".join(text for *_, role, text in rows if role == "assistant")
        out[conv_id] = (len(rows), sha(*(f"{role}\n{text}\n" for *_, role, text in rows)), len(loss), sha(loss))
    return out


def test_chat_query_reads_back_every_conversation(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{TINY}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    says = "</s>[INST] ok [/INST]"
    turns += [(-7, 0, "user", says), (-7, 1, "assistant", says)]
    rows = queries.op11_chat_format(spark, TINY).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == expected_chats(turns)
    assert len(rows) == len({r.conv_id for r in rows}) and all(r.formatted_chars > r.loss_chars for r in rows)


def test_odd_turns(spark):
    turns = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, None, "system", "s"), (1, None, None, "n"), (2, 5, "assistant", "<s>é\n" * 40_000),
             (2, 5, "assistant", "<s>é\n" * 40_000), (None, 0, "user", "x"), (None, 1, "assistant", "y\x00z"), (3, 7, "user", "b"), (3, 7, "user", "a")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("clash") for c in ("seq", "message", "part", "kind", "piece", "place")}).repartition(4)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_log(chat.events_of_turns(table))).collect()}
    assert got == expected_chats(turns)
    assert chat.read_back(chat.format_log(chat.events_of_turns(table.limit(0)))).count() == 0


# Merkle manifest


def root_and_paths(digests):
    """Root of a list of hex digests, and the (left, right) siblings of each."""
    paths, where = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, w in enumerate(where):
            start = w - w % 16
            paths[i].append(("".join(digests[start:w]), "".join(digests[w + 1:start + 16])))
            where[i] = w // 16
        digests = [sha(*digests[i:i + 16]) for i in range(0, len(digests), 16)]
    return digests[0], paths


def expected_audit(docs, tampers):
    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    groups = {}
    for r in docs:
        own = leaf(r, r.text)
        claim = own if r.text is None or not tampers(r.doc_id) else leaf(r, re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        groups.setdefault((r.source is not None, (r.source or "").encode()), []).append(((r.doc_id is not None, r.doc_id or 0, own), r.doc_id, own, claim))
    tops = [(key, rows, *root_and_paths([own for *_, own, _ in rows])) for key, rows in sorted((k, sorted(v)) for k, v in groups.items())]
    root, uppers = root_and_paths([subroot for *_, subroot, _ in tops])
    out = []
    for (_, rows, subroot, paths), upper in zip(tops, uppers):
        for (_, doc_id, own, claim), path in zip(rows, paths):
            node = claim
            for left, right in path + upper:
                node = sha(left, node, right)
            out.append((doc_id, own, subroot, root, sha(*(x for pair in path + upper for x in pair)), node, node == root))
    return sorted(out, key=str)


def tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_manifest_is_that_of_plain_lists(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").collect()
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, TINY).collect()), key=str)
    assert got == expected_audit(docs, tampered)
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257, 4096, 4097, 9000])
def test_large_and_odd_sources(spark, n):
    rows = [(i, f"T{i}" if i % 7 else None, "en", "big", i) for i in range(n)]
    rows += [(None, "No id", None, "big", None), (3, "T3", "en", "big", 3), (3, "T3", "en", "big", 3), (3, "Other", "en", "big", 3), (8, "", None, None, 0),
             (9, "Ünï <TEXT>" * 20_000, "de", "é", None), (10, "x", "en", "", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = table.withColumns({c: F.lit(1) for c in ("tree", "rank", "digest", "total", "claim", "id", "block")}).repartition(7)
    leaves = merkle.leaves(table, F.col("doc_id") % 5 == 0, merkle.lower_cased(F.col("text")))
    got = sorted((tuple(r) for r in merkle.audit(merkle.build_manifest(leaves)).collect()), key=str)
    assert got == expected_audit(table.collect(), lambda i: i is not None and i % 5 == 0)


def test_trees_of_several_tiers_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_LEVELS", 1)
    monkeypatch.setattr(merkle, "_BLOCK", 16)
    rows = [(i, f"Text {i}", "en", "big" if i % 3 else f"s{i % 600}", i) for i in range(5000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    leaves = merkle.leaves(table, F.col("doc_id") % 5 == 0, merkle.lower_cased(F.col("text")))
    sources, roots = (merkle.build_manifest(leaves).__dict__[k] for k in ("sources", "roots"))
    assert len(sources) > 2 and len(roots) > 1
    got = sorted((tuple(r) for r in merkle.audit(merkle.build_manifest(leaves)).collect()), key=str)
    assert got == expected_audit(table.collect(), lambda i: i % 5 == 0)


def test_van_emde_boas_places():
    """Places are a numbering without gaps, and each aligned half-height subtree lies in one piece."""
    for n in (1, 2, 16, 17, 255, 256, 257, 1000, 4095, 4096):
        for alone in (True, False):
            counts = merkle.level_counts(n, alone)
            places = [merkle.address(counts, k, np.arange(c)) for k, c in enumerate(counts)]
            assert sorted(np.concatenate(places).tolist()) == list(range(sum(counts))) and places[-1].tolist() == [0]
            if len(counts) == 4:  # levels 0 and 1 under each node of level 1
                for i in range(counts[1]):
                    tree = [places[1][i], *places[0][16 * i:16 * i + 16]]
                    assert sorted(tree) == list(range(min(tree), min(tree) + len(tree)))


# Spelling forms


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def expected_forms(docs, slips):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slips and h % slips == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near, form = {}, {}
    for w, n in words.items():
        near[w] = [x for x in words if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def forms_of(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_neighbours_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    words = {"".join(rng.choices("aab", k=rng.randrange(0, 8))) for _ in range(300)} | {"é", "éa", "xé" * 9, "xé" * 9 + "x", "xé" * 8 + "x", "q" * 5000, "z" + "q" * 5000}
    table = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long").repartition(3)
    got = [(r.a_word, r.b_word) for r in neighbours(table).collect()]
    expected = {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert {frozenset(p) for p in got} == expected and len(got) == len(expected)


def test_forms_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcdé", k=rng.randrange(5, 9))) for _ in range(30)]
    pool = stems + [s[:i] + rng.choice(["", "x", s[i:i + 1] * 2]) + s[i + 1:] for s in stems for i in (1, 3, 4)]
    docs = [(i, " ".join(rng.choices(pool, [1 + 200 * (k % 5 == 0) for k in range(len(pool))], k=300)).title()) for i in range(40)]
    docs += [(None, "straße STRASSE " * 9), (7, None), (8, ""), (9, "a" * 50_000 + " " + "Ā" * 9), (10, "noöne ×÷×÷×÷ " * 6)]
    docs += [(i, "qbcdef " + "qbcdeg " * 10 + "qbcdegh " * 100) for i in range(50, 80)] + [(50, "qbcdef")]
    expected = expected_forms(docs, 3)
    assert any(root != form for form, root, *_ in expected.values() if form)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    table = table.withColumns({c: F.lit("x") for c in ("word", "n", "root", "depth")}).repartition(6)
    assert forms_of(spelling_forms(table, SpellingParams(slips=3))) == expected
    assert spelling_forms(table.limit(0)).count() == 0


def test_spelling_query_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()]
    assert forms_of(queries.op13_spelling_forms(spark, TINY)) == expected_forms(docs, 199)
