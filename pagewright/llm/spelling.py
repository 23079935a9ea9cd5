"""Spelling variants: words one edit apart, found on a trie held as a table.

The frontier is a table of states: a word, the position reached in it, a node
of the trie that is one edit from the word up to there. Level by level it is
joined with the trie's edges; states that reach the end of a word on both sides
are neighbours. Words that share a prefix share its states: as long as several
words go on from a prefix, the state's word is the node of that prefix.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import raw_text, to_batch
from pagewright.session import materialize

_FLUSH = 200_000  # different words, and prefixes, that a task holds
_END = ""  # the letter behind a word's last


@dataclass(frozen=True)
class SpellingParams:
    """Words have ``length`` letters and occur ``least`` times. A near word ``ratio`` times as frequent is a word's form.
    One in ``slips`` of the runs of a document, picked by hash, loses a letter before words are counted; 0: none."""

    length: int = 6
    least: int = 5
    ratio: int = 5
    slips: int = 0


def _counted(params: SpellingParams):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    # Longer runs only: a slip shortens a run, never lengthens it.
    runs = regex.compile(r"[a-zÀ-ÿ]{%d,}+" % max(params.length, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return to_batch({"word": list(counts), "n": list(counts.values())}, schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                mine = Counter(runs.findall(text.as_py().lower().decode()))
                if params.slips:
                    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word in [w for w in mine if zlib.crc32(w.encode(), salt) % params.slips == 0]:
                        at = zlib.crc32(word.encode(), salt) % len(word)
                        n, slipped = mine.pop(word), word[:at] + word[at + 1:]
                        if len(slipped) >= params.length:
                            counts[slipped] += n
                counts.update(mine)
                if len(counts) > _FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    return run


def word_counts(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """``(word, n)`` of all words of ``docs(doc_id, text)``: runs of Latin-1 letters, A-Z lower-cased."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(F.col("text")).alias("text"))
    counted = rows.mapInArrow(_counted(params), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= params.least)


def _nodes(word: str) -> list[bytes]:
    """A 128-bit digest of each prefix, from the empty one to the word."""
    digest, out = blake2b(digest_size=16), []
    out.append(digest.digest())
    for letter in word:
        digest.update(letter.encode())
        out.append(digest.digest())
    return out


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("node", pa.binary()), ("word", pa.binary())])
    for batch in batches:
        nodes, words = [], []
        for word in batch.column("word").to_pylist():
            mine = _nodes(word)
            nodes += mine
            words += [mine[-1]] * len(mine)
            if len(nodes) > _FLUSH:
                yield to_batch({"node": nodes, "word": words}, schema)
                nodes, words = [], []
        yield to_batch({"node": nodes, "word": words}, schema)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges out of a word's shared prefixes, the first ``shared`` ones; one that only this word takes carries it."""
    schema = pa.schema([("depth", pa.int32()), ("node", pa.binary()), ("letter", pa.string()), ("child", pa.binary()),
                        ("word", pa.string()), ("n", pa.int64())])
    for batch in batches:
        rows = []
        for word, n, shared in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "shared"))):
            mine = _nodes(word)
            for depth in range(shared):
                ends = depth == len(word)
                alone = ends or depth + 1 >= shared
                rows.append((depth, mine[depth], _END if ends else word[depth], None if alone else mine[depth + 1],
                             word if alone else None, n if alone else None))
            if len(rows) > _FLUSH:
                yield to_batch(dict(zip(schema.names, zip(*rows))), schema)
                rows = []
        yield to_batch(dict(zip(schema.names, zip(*rows))) if rows else dict.fromkeys(schema.names, ()), schema)


def trie(words: DataFrame) -> DataFrame:
    """Edge table of ``words(word, n)``: depth, node and its ``children`` (letter, child or else word, n).

    It holds the nodes that several words pass; below them a word is its own
    path. A child's letter is empty where a word ends. Nodes are digests, as
    prefixes of long words would take quadratic room.
    """
    prefixes = words.select("word").mapInArrow(_prefixes, "node binary, word binary")
    alone = prefixes.groupBy("node").agg(F.count("*").alias("m"), F.min("word").alias("id")).where("m = 1")
    alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
    keyed = words.mapInArrow(_identified, "word string, n long, id binary")
    shared = keyed.join(alone, "id", "left").select(
        "word", "n", (F.char_length("word") + 1 - F.coalesce("alone", F.lit(0))).cast("int").alias("shared"))
    edges = shared.where("shared > 0").mapInArrow(_edges, "depth int, node binary, letter string, child binary, word string, n long")
    return edges.distinct().groupBy("depth", "node").agg(
        F.collect_list(F.struct("letter", "child", "word", "n")).alias("children"))


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("id", pa.binary())])
    for batch in batches:
        words = batch.column("word").to_pylist()
        yield to_batch({"word": words, "n": batch.column("n"), "id": [blake2b(w.encode(), digest_size=16).digest() for w in words]}, schema)


def _side(child: str, name: str) -> list[Column]:
    return [F.col(child).getField(f).alias(f"{name}_{f}") for f in ("child", "word", "n")]


def _steps(side: str, depth: Column) -> Column:
    """The ways on from a side of a state: the edges of its node, or the next letter of its word."""
    word = F.col(f"{side}_word")
    own = F.array(F.struct(F.substring(word, depth + 1, F.lit(1)).alias("letter"), F.lit(None).cast("binary").alias("child"),
                           word.alias("word"), F.col(f"{side}_n").alias("n")))
    return F.when(word.isNotNull(), own).otherwise(F.col(f"{side}_children"))


def _rest(side: str, depth: Column) -> Column:
    word = F.col(f"{side}_word")
    return F.substring(word, depth + 1, F.greatest(F.char_length(word), F.lit(1)))


def _advance(states: DataFrame, level: int, nodes: DataFrame) -> DataFrame:
    """States one letter on: both sides take edges of the same letter.

    ``lead`` is how much deeper side a is. A step onto the node that side a
    comes from is left out: the insertion there starts at the next level.
    """
    def ways(side: str, depth: int) -> DataFrame:
        return nodes.where(F.col("depth") == depth).select(F.col("node").alias(f"{side}_child"), F.col("children").alias(f"{side}_children"))

    out = []
    for lead in (0, 1):
        some = states.where(F.col("lead") == lead)
        some = some.join(ways("a", level + lead), "a_child", "left").join(ways("b", level), "b_child", "left")
        pairs = F.flatten(F.transform(_steps("a", F.lit(level + lead)), lambda x: F.transform(
            F.filter(_steps("b", F.lit(level)), lambda y: y["letter"] == x["letter"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        moved = some.select(F.col("a_child").alias("_from"), F.explode(pairs).alias("p")).select(
            "_from", *_side("p.x", "a"), *_side("p.y", "b"), F.lit(lead).alias("lead"))
        if lead:
            moved = moved.where(~F.coalesce(F.col("_from") == F.col("b_child"), F.lit(False)))
        out.append(moved.drop("_from"))
    return out[0].unionByName(out[1])


def _begin(nodes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """States with their edit at ``level``: (insertions, to go on from here; replacements, one letter on)."""
    here = nodes.where(F.col("depth") == level)
    letters = F.filter("children", lambda c: c["letter"] != _END)
    inserted = here.select("node", F.explode(letters).alias("c")).select(
        *_side("c", "a"), F.col("node").alias("b_child"), F.lit(None).cast("string").alias("b_word"),
        F.lit(None).cast("long").alias("b_n"), F.lit(1).alias("lead"))
    two = F.flatten(F.transform(letters, lambda x: F.transform(
        F.filter(letters, lambda y: x["letter"] < y["letter"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    replaced = here.select(F.explode(two).alias("p")).select(*_side("p.x", "a"), *_side("p.y", "b"), F.lit(0).alias("lead"))
    return inserted, replaced


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs ``(a_word, a_n, b_word, b_n)`` of ``words(word, n)`` that differ by one letter put in, left out or replaced.

    Each pair comes once. Rounds go as deep as the longest prefix that two words
    share. Once both sides are single words their rests are compared at once.
    """
    nodes = materialize(trie(words).sortWithinPartitions("depth"), "trie")
    deepest = nodes.agg(F.max("depth")).first()[0]
    states, found = None, []
    for level in range(0 if deepest is None else deepest + 1):
        inserted, replaced = _begin(nodes, level)
        states = inserted if states is None else states.unionByName(inserted)
        moved = _advance(states, level, nodes).unionByName(replaced)
        single = F.col("a_word").isNotNull() & F.col("b_word").isNotNull()
        same = _rest("a", F.col("lead") + level + 1) == _rest("b", F.lit(level + 1))
        moved = materialize(moved.withColumn("done", single).where(~F.col("done") | same), f"frontier-{level}")
        found.append(moved.where("done").select("a_word", "a_n", "b_word", "b_n"))
        states = moved.where("not done").drop("done")
    if not found:
        return words.sparkSession.createDataFrame([], "a_word string, a_n long, b_word string, b_n long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``, where forms lead from one to the next; each round doubles the way."""
    way = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = materialize(way.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "forms")
        way = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return way


def spelling_forms(docs: DataFrame, params: SpellingParams = SpellingParams()) -> DataFrame:
    """One row per word of ``docs(doc_id, text)``: word, form, root, n, n_near, form_n.

    ``n_near`` counts the words one edit away. The most frequent of them, of
    equally frequent ones the first, is the ``form`` if it is ``ratio`` times as
    frequent as the word; ``root`` is the last of the forms that follow from the
    word, or the word.

    Null and empty texts have no words. Very long texts and words are counted
    whole. Rows that repeat an id count each; a null id reads as an empty one
    where slips are picked. Other columns are ignored. An empty table gives no
    rows.
    """
    words = materialize(word_counts(docs, params), "words")
    pairs = materialize(neighbours(words), "neighbours")
    both = pairs.select(F.col("a_word").alias("word"), F.col("b_word").alias("near"), F.col("b_n").alias("m")).unionByName(
        pairs.select(F.col("b_word").alias("word"), F.col("a_word").alias("near"), F.col("a_n").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    follows = -F.col("best.m") >= params.ratio * F.col("n")
    found = materialize(words.join(best, "word", "left").select(
        "word", F.when(follows, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(follows, -F.col("best.m")).alias("form_n")), "near-words")
    roots = last_forms(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
