"""Insults with signs, digits and underscores inside, on whole documents."""

import random

from pyspark.sql import functions as F

from pagewright.llm import toxicity


def test_tokens_are_read_without_what_stands_inside():
    found = toxicity.segments("You mor*on, i_d_i_o_t and st.upid! (m0ron) well-known 12a3b plain, d u m b")
    for word in ("moron", "idiot", "stupid", "mron", "wellknown", "plain", "dumb", "ab"):
        assert word in found
    assert toxicity.joined("plain words, only. ¡no! 12 ''") == []


def test_broken_insults_are_found_in_documents(spark):
    rng = random.Random(9)
    insults = ["nitwit", "blockhead", "scoundrel", "numbskull"]
    syllables = ["lo", "ma", "sten", "ir", "va", "kun", "de", "pol"]

    def text(words):
        out = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(60)]
        for word in words:
            out.insert(rng.randrange(60), word)
        return " ".join(out) + "."

    rows = [(i, text(rng.sample(insults, 3) if i % 4 == 0 else []), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))

    def broken(word, how):
        k = len(word) // 2
        return {"*": word[:k] + "*" + word[k:], "-": word[:k] + "-" + word[k:], "7": word[:k] + "7" + word[k:], "_": "_".join(word)}[how]

    tests = [(n, text([broken(w, how) for w in rng.sample(insults, 3)])) for n, how in enumerate("*-7_" * 10)]
    tests += [(100 + n, text([])) for n in range(40)] + [(200, text(["lo-ma", "sten_ir", "va7kun"]))]
    got = {r.doc_id: r.toxic for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).select(
        "doc_id", (F.col("score") >= 0.3).alias("toxic")).collect()}
    assert sum(got[n] for n in range(40)) >= 38
    assert sum(got[n] for n in got if n >= 100) <= 2
