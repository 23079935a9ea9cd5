"""Repeated passages against a plain version, and the passages the cuts must not lose."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagewright.llm.spans import SpanParams, cut, remove_repeats, spans

PARAMS = SpanParams()
SCHEMA = "doc_id long, text string"


def cut_text(text):
    return cut(np.frombuffer(text, np.uint8), np.array([0, len(text)]), PARAMS)


def sentences(text):
    """Sentences of a text, which they add up to."""
    pieces = cut_text(text)
    return [text[a:b] for a, b in zip(pieces.start, pieces.end)]


def spans_of(text):
    """Print, first and last sentence of each span of a text alone."""
    hashes, _, first, last = spans(cut_text(text), 1, PARAMS)
    return list(zip(hashes.tolist(), first.tolist(), last.tolist()))


def removed_naively(docs):
    """Text left of each row: every sentence in a span seen at an earlier place goes."""
    first_place, pieces_of = {}, {}
    for doc_id, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        raw = (text or "").encode()
        pieces_of[doc_id, text] = sentences(raw)
        for print_, first, _ in spans_of(raw):
            first_place[print_] = min(first_place.get(print_, (doc_id, first)), (doc_id, first))
    out = []
    for doc_id, text in docs:
        if doc_id is None or text is None:
            out.append((doc_id, text))
            continue
        drop = set()
        for print_, first, last in spans_of(text.encode()):
            if first_place[print_] < (doc_id, first):
                drop |= set(range(first, last + 1))
        kept = [p for i, p in enumerate(pieces_of[doc_id, text]) if i not in drop]
        out.append((doc_id, b"".join(kept).decode() if drop else text))
    return sorted(out, key=str)


def prose(rng, n, stops=True):
    return " ".join(f"{rng.choice('bcdfg')}{rng.randrange(900)}" + (rng.choice([".", "!", "", "", "", "", "", ""]) if stops else "") for _ in range(n))


def test_texts_left_are_those_of_a_plain_version(spark, monkeypatch):
    rng = random.Random(9)
    passages = [prose(rng, 60), prose(rng, 55, False), "the cat " * 40, prose(rng, 25)]
    docs = [(i, prose(rng, rng.randrange(0, 200)) + " " + " ".join(rng.choices(passages, k=rng.randrange(3))) + "\n\n " + prose(rng, 30)) for i in range(60)]
    docs += [(100 + i, docs[i % 3][1]) for i in range(30)] + [(5, docs[5][1]), (200, None), (201, ""), (None, passages[0]), (202, passages[0] * 300), (202, passages[0] * 300)]
    expected = removed_naively(docs)
    for parts in (1, 7, 40):
        got = remove_repeats(spark.createDataFrame(docs, SCHEMA).withColumn("later", F.lit(1)).repartition(parts)).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == expected
    monkeypatch.setattr("pagewright.llm.spans._BATCH", 5)
    got = remove_repeats(spark.createDataFrame(docs, SCHEMA).coalesce(1)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == expected


def test_every_passage_of_51_words_keeps_a_span():
    """Passages within other text, with stops or without, share a span with their copies."""
    rng = random.Random(4)
    for n in range(400):
        stops = n % 2 == 0
        passage = "the cat " * 26 if n % 20 == 0 else prose(rng, 51, stops)
        prints = []
        for _ in range(2):
            text = prose(rng, rng.randrange(0, 60), rng.random() < 0.5) + " " + passage + " " + prose(rng, rng.randrange(0, 60), rng.random() < 0.5)
            prints.append({print_ for print_, *_ in spans_of(text.encode())})
        assert prints[0] & prints[1], passage


def words_of_sentences(text):
    """Numbers of words of sentences that are not cut, and all cut ones as one, by plain rules."""
    out = []
    for line in text.split("\n"):
        n = 0
        for word in line.encode().split():
            n += 1
            if word.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?"):
                out.append(n)
                n = 0
        out += [n] if n else []
    return out


def test_pieces_add_up_and_end_with_sentences():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices([" ", "\n", ".", "a", "Bc ", "é ", "! ", "\t", "x y z ", "?) ", "\"."], k=rng.randrange(200)))
        raw = text.encode()
        pieces = sentences(raw)
        assert b"".join(pieces) == (raw if raw.split() else b"")
        ends = np.cumsum([len(p.split()) for p in pieces]).tolist()
        plain = words_of_sentences(text)
        assert set(np.cumsum(plain).tolist()) <= set(ends)
        if all(n <= PARAMS.longest for n in plain):
            assert np.cumsum(plain).tolist() == ends
    for text in ("w " * 500, "the cat " * 200, prose(rng, 3000, False)):
        assert max(len(p.split()) for p in sentences(text.encode())) <= 2 * PARAMS.window


def test_texts_cut_together_are_cut_as_alone():
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(0, 90), k % 2 == 0).encode() * (k % 4) for k in range(200)] + [b"", b" \n ", b"x"]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes, doc, first, last = spans(cut(data, offsets, PARAMS), len(texts), PARAMS)
    together = list(zip(doc.tolist(), hashes.tolist(), first.tolist(), last.tolist()))
    assert together == [(k, *span) for k, text in enumerate(texts) for span in spans_of(text)]
