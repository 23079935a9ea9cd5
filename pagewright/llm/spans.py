"""Substring deduplication over sliding sentence spans.

Every run of several consecutive sentences is hashed and counted over all
documents; the sentences of any run that is not its first occurrence go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.llm.common import raw_text, to_batch
from pagewright.session import materialize

_SPAN = pa.schema([("print", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("later", pa.bool_())])
_COVERED = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_BATCH = 400_000  # spans compared inside a task at once
_BYTES = 1_500_000  # text read at once, unless one document has more
_ODD, _FACTOR, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9  # odd multipliers of hashes
_MOD = 1 << 64


@dataclass(frozen=True)
class SpanParams:
    """A span is the shortest run of at least ``sentences`` sentences with ``words`` words.

    A sentence ends with a line, or behind a word that ends with a stop. One
    longer than ``longest`` words is cut behind each word whose hash is the
    smallest of some ``window`` neighbouring words, of equal ones the last. So
    at most ``window`` words lie between cuts, whatever the words, and equal
    passages are cut alike up to a window's width from their ends. A passage of
    50 words loses at most ``longest`` or twice ``window`` words at each end,
    and keeps a whole span.
    """

    sentences: int = 2
    words: int = 16
    longest: int = 12
    window: int = 6


@dataclass(frozen=True)
class Pieces:
    """The sentences of some texts that lie one behind the other in ``data``.

    ``start`` and ``end`` are the bytes of a sentence with the white space after
    it; ``doc`` is its text's number. ``word`` counts the words before each
    sentence, and all at last. ``sums`` adds up the hashes of words from the left.
    """

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    sums: np.ndarray

    def bounds(self, texts: int) -> np.ndarray:
        """The first sentence of each text, and the number of sentences."""
        return np.searchsorted(self.doc, np.arange(texts + 1))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _among(data: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table[data]


def _word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Hashes of words, capital letters of ASCII as small ones."""
    small = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64) + np.uint64(1)
    small[blank] = 0
    place = np.arange(len(data))
    place[begin[0]:] -= np.repeat(begin, np.diff(np.append(begin, len(data))))
    place[blank] = 0
    hashes = np.add.reduceat(small * _powers(_ODD, int(place.max()) + 1)[place], begin)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(_MIX)
    return hashes ^ (hashes >> np.uint64(32))


def cut(data: np.ndarray, offsets: np.ndarray, params: SpanParams) -> Pieces:
    """Sentences of the texts ``data[offsets[i]:offsets[i + 1]]``; blank texts have none."""
    n, none = len(data), np.zeros(0, np.int64)
    blank = _among(data, b" \t\n\v\f\r")
    inside = ~blank
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside & (edge[:n] | np.concatenate([[True], blank[:-1]]))) if n else none
    if not len(begin):
        return Pieces(none, none, none, np.zeros(1, np.int64), np.zeros(1, np.uint64))
    stop = np.flatnonzero(inside & (edge[1:] | np.concatenate([blank[1:], [True]])))  # last bytes of words
    doc = np.searchsorted(offsets, begin, "right") - 1
    hashes = _word_hashes(data, begin, stop + 1, blank)
    # A word ends its sentence if its text or line ends, or if it ends with a stop, maybe in brackets or quotes.
    lines = np.cumsum(np.concatenate([[0], data == 10]))
    following = np.append(begin[1:], n)
    plain = np.where(_among(data, b"\"')]"), 0, np.arange(n))
    core = np.maximum.accumulate(plain)[stop]
    ends = (core >= begin) & _among(data[core], b".!?")
    ends |= lines[following] > lines[stop + 1]
    ends |= np.append(doc[1:] != doc[:-1], True)
    sentence = np.cumsum(ends) - ends
    long = np.bincount(sentence)[sentence] > params.longest
    w = params.window
    if long.any() and len(hashes) >= w:
        first = np.flatnonzero(long[:len(long) - w + 1] & (sentence[:len(sentence) - w + 1] == sentence[w - 1:]))
        windows = np.lib.stride_tricks.sliding_window_view(hashes, w)[first]
        ends[first + w - 1 - windows[:, ::-1].argmin(axis=1)] = True
    last = np.flatnonzero(ends)
    opening = np.concatenate([[0], last[:-1] + 1])
    # White space belongs to the sentence before it, at the head of a text to the first one.
    doc_of = doc[opening]
    new = np.concatenate([[True], doc_of[1:] != doc_of[:-1]])
    start = np.where(new, offsets[doc_of], begin[opening])
    end = np.append(start[1:], n)
    end[np.append(new[1:], True)] = offsets[doc_of[np.append(new[1:], True)] + 1]
    weighted = hashes * _powers(_FACTOR, len(hashes))
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(weighted, out=sums[1:])
    return Pieces(start, end, doc_of, np.append(opening, len(begin)), sums)


def spans(pieces: Pieces, texts: int, params: SpanParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text, first and last sentence of every span; sentences count from the text's first."""
    n = len(pieces.doc)
    first, bounds = np.arange(n), pieces.bounds(texts)
    last = np.maximum(np.searchsorted(pieces.word, pieces.word[:-1] + params.words, "left") - 1, first + params.sentences - 1)
    fits = last < bounds[pieces.doc + 1] if n else np.zeros(0, bool)
    first, last = first[fits], last[fits]
    a, b = pieces.word[first], pieces.word[last + 1]
    back = _powers(pow(_FACTOR, -1, _MOD), int(pieces.word[-1]) + 1)
    hashes = (pieces.sums[b] - pieces.sums[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(_MIX)
    hashes ^= hashes >> np.uint64(31)
    doc = pieces.doc[first]
    return (hashes * np.uint64(_ODD)).view(np.int64), doc, first - bounds[doc], last - bounds[doc]


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Texts of a binary column, some at once: the first one's number, their bytes, and where each begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and len(buffer) else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BYTES, "right")) - 1)
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def _earliest(parts: list[tuple], salt: np.int64) -> pa.RecordBatch:
    """Spans of some documents: of each print the earliest one, and those that lie behind it as ``later``.

    Later ones are covered whatever other tasks hold, and need not meet their
    print again: they go by their document.
    """
    prints, ids, first, last = map(np.concatenate, zip(*parts))
    order = np.lexsort((first, ids, prints))
    prints, ids, first, last = prints[order], ids[order], first[order], last[order]
    new = np.concatenate([[True], prints[1:] != prints[:-1]])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (ids != ids[lead]) | (first != first[lead])
    lead = np.flatnonzero(new)
    gone_id, gone_first, gone_last = _joined_runs(ids[later], first[later], last[later])
    kinds = np.repeat([False, True], [len(lead), len(gone_id)])
    columns = zip((prints[lead], ids[lead], first[lead], last[lead]), (gone_id * salt, gone_id, gone_first, gone_last))
    return to_batch(dict(zip(_SPAN.names, (*map(np.concatenate, columns), kinds))), _SPAN)


def _joined_runs(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of sentences that touch, as one; the later a document's run starts, the later it ends."""
    order = np.lexsort((first, ids))
    ids, first, last = ids[order], first[order], last[order]
    starts = np.ones(len(ids), bool)
    starts[1:] = (ids[1:] != ids[:-1]) | (first[1:] > last[:-1] + 1)
    at = np.flatnonzero(starts)
    return ids[at], first[at], last[np.append(at[1:], len(ids)) - 1] if len(at) else last


def _spans(params: SpanParams):
    salt = np.int64(-7046029254386353131)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for start, data, offsets in _chunks(batch.column("text")):
                hashes, doc, first, last = spans(cut(data, offsets, params), len(offsets) - 1, params)
                if len(hashes):
                    parts.append((hashes, ids[start + doc], first, last))
                    held += len(hashes)
                if held > _BATCH:
                    yield _earliest(parts, salt)
                    parts, held = [], 0
        if parts:
            yield _earliest(parts, salt)

    return run


def _behind_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans behind the first of their print, from spans sorted by print and place, and those known to be."""
    last_print = last_place = None
    for batch in batches:
        if not batch.num_rows:
            continue
        prints, ids, first, last, known = (batch.column(c).to_numpy(zero_copy_only=False) for c in _SPAN.names)
        new = np.concatenate([[True], prints[1:] != prints[:-1]])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        lead_id, lead_first = ids[lead], first[lead]
        if prints[0] == last_print:
            run = lead == 0
            lead_id, lead_first = np.where(run, last_place[0], lead_id), np.where(run, last_place[1], lead_first)
        covered = known | (ids != lead_id) | (first != lead_first)
        last_print, last_place = prints[-1], (lead_id[-1], lead_first[-1])
        yield to_batch({"doc_id": ids[covered], "first": first[covered], "last": last[covered]}, _COVERED)


def _cut(params: SpanParams):
    counts = ("n_sentences", "n_removed", "words_removed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            texts, numbers = [], []
            firsts, lasts = batch.column("firsts"), batch.column("lasts")
            for start, data, offsets in _chunks(column):
                pieces = cut(data, offsets, params)
                bounds = pieces.bounds(len(offsets) - 1)
                for k in range(len(offsets) - 1):
                    row, a, b = start + k, bounds[k], bounds[k + 1]
                    text = column[row]
                    gone = words = 0
                    left = data[offsets[k]:offsets[k + 1]]
                    if firsts[row].is_valid and b > a:
                        drop = np.zeros(b - a + 1, np.int64)
                        np.add.at(drop, firsts[row].values.to_numpy(), 1)
                        np.add.at(drop, lasts[row].values.to_numpy() + 1, -1)
                        drop = np.cumsum(drop)[:-1] > 0
                        gone, words = int(drop.sum()), int(np.diff(pieces.word[a:b + 1])[drop].sum())
                        left = left[np.repeat(~drop, pieces.end[a:b] - pieces.start[a:b])]
                    texts.append(left.tobytes().decode() if text.is_valid else None)
                    numbers.append((b - a, gone, words))
            fields = [batch.schema.field("row"), pa.field("text", pa.string()), *(pa.field(c, pa.int64()) for c in counts)]
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers)] if numbers else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), *columns], schema=pa.schema(fields))

    return run


def remove_repeats(docs: DataFrame, params: SpanParams = SpanParams()) -> DataFrame:
    """``docs`` with repeated passages removed from ``text``, all columns and rows kept.

    The order of occurrences is that of doc_id, then place; the first stays.
    Adds n_sentences, n_removed and words_removed in place of columns of these
    names. Texts that lose nothing stay byte for byte; a null text stays null,
    and a text may become empty. Rows that repeat an id are one document: equal
    places of theirs are one occurrence. Rows without an id are left as they are.
    An empty table gives no rows.

    A task sends one span of each print, its earliest, so a passage that every
    document repeats meets as one row per task.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(F.col("text")).alias("text")).where("doc_id is not null")
    every = raw.mapInArrow(_spans(params), "print long, doc_id long, first int, last int, later boolean")
    # Spans known to be later are no prints: they only share the exchange.
    met = every.repartition("later", "print").sortWithinPartitions("later", "print", "doc_id", "first")
    later = met.mapInArrow(_behind_first, "doc_id long, first int, last int")
    covered = materialize(
        later.groupBy("doc_id").agg(F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")), "covered")
    added = ["n_sentences", "n_removed", "words_removed"]
    others = [c for c in docs.columns if c not in ("text", *added)]
    rows = docs.select(
        F.struct(*others).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")
    ).join(covered, "doc_id", "left")
    out = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), *(T.StructField(c, T.LongType()) for c in added)])
    cut_rows = rows.select("row", "text", "firsts", "lasts").mapInArrow(_cut(params), out)
    return cut_rows.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in added), *added)
