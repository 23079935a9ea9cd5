"""Term counts inside Arrow batches of pages.

A page's words come as one array. The different words of some pages are
numbered, words and word pairs become single numbers, and these are sorted and
counted; text is put together again only for what leaves the task. Pages never
meet outside their batch, and no step compares strings.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_WORDS = 1 << 19  # words counted at once; a page that has more is counted alone
_PRODUCTS = 1 << 20  # products of weights added up at once; a page that has more is scored alone


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Consecutive pages of about ``_WORDS`` words together, with the number of words of each."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("words")), 0).to_numpy()
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + _WORDS, "right")))
            yield batch.slice(start, stop - start), sizes[start:stop]
            start = stop


def _numbered(rows: pa.RecordBatch, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, the number of each word, and the row it is in."""
    coded = rows.column("words").flatten().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _terms(code: np.ndarray, row: np.ndarray, n: int, singles: bool, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """(term, row) of words and neighbouring pairs without words numbered -1.

    A word a is the term a * (n + 1), the pair of a and b is b + 1 more.
    """
    found = []
    if singles:
        known = code >= 0
        found.append((code[known].astype(np.int64) * (n + 1), row[known]))
    if pairs:
        both = (row[1:] == row[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0)
        found.append((code[:-1][both].astype(np.int64) * (n + 1) + code[1:][both] + 1, row[1:][both]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _counted(term: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, how often), by row; terms are below ``n``."""
    key, tf = np.unique(row * n + term, return_counts=True)
    return key // n, key % n, tf


def _spelled(words: pa.Array, term: np.ndarray) -> pa.Array:
    first, second = np.divmod(term, len(words) + 1)
    then = words.take(pa.array(second - 1, mask=second == 0))
    return pc.binary_join_element_wise(words.take(pa.array(first)), then, " ", null_handling="skip")


def _output(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def term_rows(words: DataFrame, *keep: str, pairs: bool = True) -> DataFrame:
    """``keep``, term, tf: the words of each row's array ``words``, and neighbouring pairs, with their counts."""
    schema = T.StructType([words.schema[k] for k in keep]).add("term", "string").add("tf", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes in _parts(batches):
            known, code, row = _numbered(rows, sizes)
            n = len(known)
            row, term, tf = _counted(*_terms(code, row, n, True, pairs), n * (n + 1) or 1)
            yield _output([*(rows.column(k).take(pa.array(row)) for k in keep), _spelled(known, term), pa.array(tf)], schema.names)

    return words.select(*keep, "words").mapInArrow(count, schema)


def term_arrays(words: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``counts``: the words and neighbouring pairs of each row with their tf, empty where there are none."""
    counted = T.ArrayType(T.StructType().add("term", "string").add("tf", "long"))
    schema = T.StructType([words.schema[k] for k in keep]).add("counts", counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes in _parts(batches):
            known, code, row = _numbered(rows, sizes)
            n = len(known)
            row, term, tf = _counted(*_terms(code, row, n, True, True), n * (n + 1) or 1)
            counts = pa.StructArray.from_arrays([_spelled(known, term), pa.array(tf)], names=["term", "tf"])
            ends = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            yield _output([*(rows.column(k) for k in keep), pa.ListArray.from_arrays(pa.array(ends), counts)], schema.names)

    return words.select(*keep, "words").mapInArrow(count, schema)


def document_counts(words: DataFrame, singles: bool = True, pairs: bool = True, holds: Callable[[str], bool] | None = None) -> DataFrame:
    """term, df, cf: in how many rows a word or neighbouring pair is, and how often in all.

    Counts of some pages are added up before they leave the task, and again
    after. Words are those for which ``holds``.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes in _parts(batches):
            known, code, row = _numbered(rows, sizes)
            n = len(known)
            if holds:
                code = np.where(np.fromiter(map(holds, known.to_pylist()), bool, n), np.arange(n), -1)[code]
            _, term, tf = _counted(*_terms(code, row, n, singles, pairs), n * (n + 1) or 1)
            term, place, df = np.unique(term, return_inverse=True, return_counts=True)
            cf = np.bincount(place, tf, len(term)).astype(np.int64)
            yield _output([_spelled(known, term), pa.array(df), pa.array(cf)], ["term", "df", "cf"])

    return words.select("words").mapInArrow(count, "term string, df long, cf long").groupBy("term").agg(
        {"df": "sum", "cf": "sum"}).toDF("term", "df", "cf")


def bit_filter(cells: list[int]) -> Callable[[str], bool]:
    """Whether the bit of a word's ``crc32`` is set in ``cells`` of 64 bits, a power of two of them."""
    table = np.array(cells, np.int64).astype("<i8").tobytes()
    last = 8 * len(table) - 1

    def holds(word: str) -> bool:
        at = zlib.crc32(word.encode()) & last
        return table[at >> 3] >> (at & 7) & 1 == 1

    return holds


class _Weigher:
    """L2-normalised TF-IDF weights of some rows' terms that ``idf`` has; terms are numbered as in ``terms``."""

    def __init__(self, idf: dict[str, float]):
        split = {term: term.split(" ") for term in idf}
        parts = sorted({word for both in split.values() for word in both})
        number = {word: i for i, word in enumerate(parts)}
        self.n = n = len(parts)
        key = {term: number[both[0]] * (n + 1) + (number[both[1]] + 1 if len(both) > 1 else 0) for term, both in split.items()}
        self.terms = sorted(idf, key=key.get)
        self.keys, self.factors = np.array([key[t] for t in self.terms], np.int64), np.array([idf[t] for t in self.terms], float)
        self.values = pa.array(parts, pa.string())

    def weigh(self, rows: pa.RecordBatch, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf, weight), by row."""
        known, code, row = _numbered(rows, sizes)
        ids = pc.fill_null(pc.index_in(known, value_set=self.values), -1).to_numpy()
        term, row = _terms(ids[code], row, self.n, True, True)
        at = np.minimum(np.searchsorted(self.keys, term), len(self.keys) - 1)
        hit = self.keys[at] == term
        row, term, tf = _counted(at[hit], row[hit], len(self.keys))
        raw = tf * self.factors[term]
        return row, term, tf, raw / np.sqrt(np.bincount(row, raw * raw, len(sizes)))[row]


def weighed_rows(words: DataFrame, idf: dict[str, float], *keep: str) -> DataFrame:
    """``keep``, term, tf, weight: each row's terms that ``idf`` has, in L2-normalised TF-IDF weights."""
    schema = T.StructType([words.schema[k] for k in keep]).add("term", "string").add("tf", "long").add("weight", "double")
    weigher = _Weigher(idf)
    named = pa.array(weigher.terms, pa.string())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes in _parts(batches) if weigher.terms else ():
            row, term, tf, weight = weigher.weigh(rows, sizes)
            taken = pa.array(row)
            yield _output([*(rows.column(k).take(taken) for k in keep), named.take(pa.array(term)), pa.array(tf), pa.array(weight)], schema.names)

    return words.select(*keep, "words").mapInArrow(weigh, schema)


class _Asked:
    """Query vectors, by term: ``vectors`` has query_id, key (a domain or ``all``), term and weight."""

    def __init__(self, vectors: pa.Table, terms: list[str]):
        place = pc.index_in(vectors["term"].combine_chunks(), value_set=pa.array(terms, pa.string()))
        vectors, place = vectors.filter(pc.is_valid(place)), place.drop_null().to_numpy()
        order = np.argsort(place, kind="stable")
        vectors = vectors.take(pa.array(order))
        self.bounds = np.searchsorted(place[order], np.arange(len(terms) + 1))
        ids = vectors["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        self.ids, self.query = ids.dictionary, ids.indices.to_numpy()
        keys = vectors["key"].combine_chunks().dictionary_encode()
        self.keys, self.key = keys.dictionary, keys.indices.to_numpy()
        self.everywhere = np.array([k == "all" for k in self.keys.to_pylist()], bool)
        self.weight = vectors["weight"].to_numpy()

    def scores(self, domain: pa.Array, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, query, score) of the pairs that share a term, some rows at once; postings are sorted by row."""
        at = pc.fill_null(pc.index_in(domain, value_set=self.keys), -1).to_numpy()
        times, n = self.bounds[term + 1] - self.bounds[term], len(self.ids)
        first = np.searchsorted(row, np.arange(len(domain) + 1))
        # Rows are taken together while they have few products, and few scores.
        products = np.concatenate([[0], np.cumsum(times)])[first]
        start = 0
        while start < len(domain):
            stop = min(int(np.searchsorted(products, products[start] + _PRODUCTS, "right")) - 1, start + _PRODUCTS // max(n, 1))
            stop = min(max(stop, start + 1), len(domain))
            some = slice(first[start], first[stop])
            posting = np.repeat(np.arange(some.start, some.stop), times[some])
            entry = np.arange(len(posting)) + np.repeat(self.bounds[term[some]] - (np.cumsum(times[some]) - times[some]), times[some])
            inside = self.everywhere[self.key[entry]] | (at[row[posting]] == self.key[entry])
            posting, entry = posting[inside], entry[inside]
            found = np.bincount((row[posting] - start) * n + self.query[entry], weight[posting] * self.weight[entry], (stop - start) * n)
            pair = np.flatnonzero(found)
            yield pair // max(n, 1) + start, pair % max(n, 1), found[pair]
            start = stop


def scored_rows(words: DataFrame, idf: dict[str, float], vectors: pa.Table, least: float | None = None, best: int | None = None) -> DataFrame:
    """query_id, page_id, score of the rows ``words(page_id, domain, words)`` and the queries that share a term with them.

    A row's postings are weighed and multiplied where its words are. Only scores
    above ``least`` are returned; with ``best`` only those that are among so many
    best ones of their query in some rows, and those that equal the last of them
    to nine digits.
    """
    schema = T.StructType([T.StructField("query_id", T.LongType()), words.schema["page_id"], T.StructField("score", T.DoubleType())])
    weigher = _Weigher(idf)
    asked = _Asked(vectors, weigher.terms)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sizes in _parts(batches) if len(asked.weight) else ():
            row, term, _, weight = weigher.weigh(rows, sizes)
            for row, query, value in _together(asked.scores(rows.column("domain"), row, term, weight), best):
                if least is not None:
                    row, query, value = (x[value > least] for x in (row, query, value))
                if best is not None:
                    row, query, value = (x[_leading(query, value, best)] for x in (row, query, value))
                yield _output([asked.ids.take(pa.array(query)), rows.column("page_id").take(pa.array(row)), pa.array(value)], schema.names)

    return words.select("page_id", "domain", "words").mapInArrow(score, schema)


def _together(parts: Iterator[tuple[np.ndarray, ...]], best: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """The parts, or with ``best`` what leads in each of them, as one."""
    if best is None:
        yield from parts
    else:
        kept = [tuple(x[_leading(p[1], p[2], best)] for x in p) for p in parts]
        if kept:
            yield tuple(map(np.concatenate, zip(*kept)))


def _leading(query: np.ndarray, score: np.ndarray, best: int) -> np.ndarray:
    """Places of the ``best`` scores of each query, and of those that may round to the same nine digits as the last of them."""
    order = np.lexsort((-score, query))
    first = np.flatnonzero(np.concatenate([[True], query[order][1:] != query[order][:-1]])) if len(order) else order
    size = np.diff(first, append=len(order))
    last = score[order][first + np.minimum(size, best) - 1]
    return order[score[order] >= np.repeat(last, size) - 2e-9]
