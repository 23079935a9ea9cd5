"""Language-model scores from Brown classes.

Exchange clustering assigns every word seen often enough to a class so that
class bigrams predict best; only rarer words belong to classes by their ending.
A text's probability is the product of smoothed class transitions and word
emissions. Word counts and bigrams cover all training documents.

The most frequent words are clustered among themselves first. Then tasks hold
slices of the clustered words with the counts of their neighbours, and score
each word's moves against the small class-by-class table, until they settle.
So the driver and the tasks need a hash and a class of each clustered word, and
no bigrams of words. Counts of the ``head`` most frequent words travel with the
tasks; those of all other words are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pagewright.llm.common import raw_text, small_batches, sorted_runs, to_batch
from pagewright.session import materialize

_END = b"\n"  # no word: words hold no white space
_FLUSH = 150_000
_TOKENS = 250_000  # tokens of a slice of words
_HELD = 40_000  # bigrams of a slice that are added up at once, at least
_PAIRS = 500_000  # bigrams a task holds
_BYTES = 1 << 20  # text cut into words at once, unless one text has more
_GAIN = 1e-3  # log-likelihood below which sums of a whole corpus are rounding
_SETTLED = 1e-3  # log-likelihood a bigram: a thousandth of the perplexity


@dataclass(frozen=True)
class BrownParams:
    """Words seen ``least`` times are clustered into ``classes``; others fall into ``endings`` classes.
    The first ``words`` of them start the classes, in at most ``rounds`` rounds; all move until the likelihood settles."""

    classes: int = 48
    words: int = 1000
    endings: int = 32
    head: int = 100_000
    rounds: int = 6
    smoothing: float = 5.0
    least: int = 20


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words and the end."""
    return [*text.lower().split(), _END]


def coded(texts: pa.Array) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """``tokens`` of some texts at once: the different ones, the number of each token, and how many each text has."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        stop = max(int(np.searchsorted(size, (size[start - 1] if start else 0) + _BYTES, "right")), start + 1)
        part = texts.slice(start, stop - start)
        # Only ASCII is looked at, so the bytes need not be valid.
        plain = pa.Array.from_buffers(pa.string(), len(part), part.buffers(), 0, part.offset)
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        code = split.flatten().dictionary_encode()
        words, at = code.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), code.indices.to_numpy()
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        if b"" in words:  # before and behind white space at the ends
            none = words.index(b"")
            keep = at != none
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            at = at[keep] - (at[keep] > none)
            del words[none]
        yield [*words, _END], np.insert(at, bounds[1:], len(words)), np.diff(bounds) + 1
        start = stop


def ending(word: bytes, endings: int) -> int:
    return zlib.crc32(word[-2:]) % endings


class _Kinds(dict):
    """Numbers of the endings by a word's last two bytes, each worked out once; the end comes after them."""

    def __init__(self, endings: int):
        super().__init__({_END: endings})
        self.endings = endings

    def __missing__(self, tail: bytes) -> int:
        self[tail] = kind = ending(tail, self.endings)
        return kind


@lru_cache(maxsize=8)
def _kinds(endings: int) -> _Kinds:
    return _Kinds(endings)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    counts: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        return to_batch({"word": list(counts), "n": list(counts.values())}, schema)

    for batch in batches:
        for words, at, _ in coded(batch.column("text")):
            for word, n in zip(words, np.bincount(at, minlength=len(words)).tolist()):
                counts[word] = counts.get(word, 0) + n
            if len(counts) > _FLUSH:
                yield out()
                counts.clear()
                _release()
    yield out()
    _release()


@dataclass(frozen=True)
class Vocabulary:
    """Numbers of the clustered words, the most frequent first; then come the endings and the end, which also starts.

    ``hashes`` are sorted, ``order`` has their words' numbers.
    """

    hashes: np.ndarray
    order: np.ndarray
    endings: int

    @property
    def size(self) -> int:
        return len(self.hashes) + self.endings + 1

    def numbers(self, words: list[bytes]) -> np.ndarray:
        n, out = len(self.hashes), np.full(len(words), -1, np.int64)
        if n and words:
            mine = np.fromiter(map(xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).view(np.int64)
            at = np.minimum(np.searchsorted(self.hashes, mine), n - 1)
            out = np.where(self.hashes[at] == mine, self.order[at], out)
        kinds = _kinds(self.endings)
        rest = np.flatnonzero(out < 0)
        out[rest] = [n + kinds[words[i][-2:]] for i in rest.tolist()]
        return out


def _release() -> None:
    """Give back memory of finished Arrow batches, which the pool would keep beside the next task's."""
    pa.default_memory_pool().release_unused()


def _ends(pairs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Both numbers of bigrams. NumPy divides by a single number far quicker than it finds remainders."""
    own = pairs // size
    return own, pairs - own * size


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


_SLICE = pa.schema([("slice", pa.int32()), ("right", pa.bool_()), ("pairs", pa.binary()), ("n", pa.binary())])


def _bigrams(known: Vocabulary, slices: int):
    """Bigrams of a task: for each slice of the clustered words those they begin and those they end; in slice -1 the others."""
    size, words = known.size, len(known.hashes)

    def out(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rows = []
        for right in (True, False):
            own, other = _ends(pairs, size) if right else _ends(pairs, size)[::-1]
            part = np.where(own < words, own % slices, slices)
            if right:
                part = np.where((own >= words) & (other >= words), -1, part)
            part = part.astype(np.min_scalar_type(-slices - 1))  # small integers sort faster
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(-1, slices + 1))
            for k in range(slices + 1):
                mine = order[bounds[k]:bounds[k + 1]]
                if len(mine):
                    rows.append((k - 1, right, (own[mine] * size + other[mine]).tobytes(), n[mine].tobytes()))
        return to_batch(dict(zip(_SLICE.names, zip(*rows))) if rows else dict.fromkeys(_SLICE.names, ()), _SLICE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = []

        def summed() -> pa.RecordBatch:
            nonlocal pairs
            keys = np.sort(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            pairs = []
            return out(keys[first], np.diff(first, append=len(keys)))

        for batch in batches:
            for different, at, _ in coded(batch.column("text")):
                ids = known.numbers(different)[at]
                pairs.append(np.concatenate([[size - 1], ids[:-1]]) * size + ids)
                if sum(map(len, pairs)) > _PAIRS:
                    yield summed()
                    _release()
        yield summed()
        _release()

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice and side. Rows are added up once they are as many as what they are added to."""
    def out() -> pa.RecordBatch:
        add()
        return to_batch({"slice": [last[0]], "right": [last[1]], "pairs": [parts[0].tobytes()], "n": [times[0].tobytes()]}, _SLICE)

    def add() -> None:
        nonlocal parts, times
        pairs, n = _summed(np.concatenate(parts), np.concatenate(times))
        parts, times = [pairs], [n]

    last, parts, times = None, [], []
    for batch in batches:
        for k in range(batch.num_rows):
            key, right, pairs, n = (batch.column(c)[k].as_py() for c in _SLICE.names)
            if (key, right) != last:
                if last:
                    yield out()
                last, parts, times = (key, right), [], []
            parts.append(np.frombuffer(pairs, np.int64))
            times.append(np.frombuffer(n, np.int64))
            if sum(map(len, parts[1:])) > max(len(parts[0]), _HELD):
                add()
        _release()
    if last:
        yield out()
    _release()


def _table(of: np.ndarray, total: int, words: int):
    """Counts of neighbouring classes. Of the bigrams a clustered word ends, only those that no clustered word begins."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(total * total, np.int64)  # sums of the task, small as classes are few
        for batch in batches:
            for k in range(batch.num_rows):
                own, other = _ends(np.frombuffer(batch.column("pairs")[k].as_buffer(), np.int64), len(of))
                n = np.frombuffer(batch.column("n")[k].as_buffer(), np.int64)
                if not batch.column("right")[k].as_py():
                    keep = other >= words
                    own, other, n = other[keep], own[keep], n[keep]
                found += np.bincount(of[own].astype(np.int64) * total + of[other], n, total * total).astype(np.int64)
        pair = np.flatnonzero(found)
        yield to_batch({"pair": pair, "n": found[pair]}, schema)

    return run


def _class_table(pairs: DataFrame, of: np.ndarray, total: int, words: int) -> np.ndarray:
    found = pairs.mapInArrow(_table(of, total, words), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(total * total)
    table[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy()
    return table.reshape(total, total)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of class bigrams, up to a constant."""
    return float(_f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum())


def gains(right: np.ndarray, left: np.ndarray, own: np.ndarray, old: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """Log-likelihood each word gains in each class, over that without the word.

    ``right`` and ``left`` count a word's bigrams with classes but for the ``own``
    ones with itself. ``table`` has the words in their ``old`` classes.
    """
    out = np.zeros((len(right), classes))
    k = np.arange(classes)
    # The other class's part of the table, once with rows and once with columns as the word's classes.
    for here, there, cells in ((right, left, table[:classes]), (left, right, table[:, :classes].T)):
        w, d = np.nonzero(here)
        for start in range(0, len(w), 20_000):
            wi, di = w[start:start + 20_000], d[start:start + 20_000]
            n, was = here[wi, di], old[wi]
            # Words with as many bigrams with a class gain alike, which is worked out once for all of them.
            most = int(n.max()) + 1
            kinds, of_kind = np.unique(di * most + n.astype(np.int64), return_inverse=True)
            kind_d, kind_n = _ends(kinds, most)
            base = cells[:, kind_d].T
            value = (_f(base + kind_n[:, None]) - _f(base))[of_kind]
            # But not where the table has bigrams of the word itself.
            mine = np.flatnonzero((was < classes) & (di != was))
            base = cells[was[mine], di[mine]] - n[mine]
            value[mine, was[mine]] = _f(base + n[mine]) - _f(base)
            back = np.flatnonzero(di == was)
            base = cells[:, di[back]].T - there[wi[back]][:, :classes]
            inside = np.flatnonzero(was[back] < classes)
            at = back[inside]
            base[inside, was[at]] -= n[at] + own[wi[at]]
            value[back] = _f(base + n[back][:, None]) - _f(base)
            _add_runs(out, wi, value)
    # Cells of a class with itself get all three at once.
    diagonal = np.tile(table[k, k], (len(right), 1))
    inside = np.flatnonzero(old < classes)
    at = old[inside]
    diagonal[inside, at] -= right[inside, at] + left[inside, at] + own[inside]
    r, l_ = right[:, :classes], left[:, :classes]
    out += _f(diagonal + r + l_ + own[:, None]) - _f(diagonal + r) - _f(diagonal + l_) + _f(diagonal)
    for n, sums in ((right.sum(axis=1) + own, table.sum(axis=1)), (left.sum(axis=1) + own, table.sum(axis=0))):
        rest = np.tile(sums[:classes], (len(right), 1))
        rest[inside, at] -= n[inside]
        out -= _f(rest + n[:, None]) - _f(rest)
    return out


def _add_runs(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds ``values`` to the sorted ``rows``."""
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    out[rows[first]] += np.add.reduceat(values, first, axis=0)


def _moves(of: np.ndarray, table: np.ndarray, classes: int, words: int):
    """Words of the slices that gain in another class, and that class."""
    schema = pa.schema([("word", pa.int32()), ("to", pa.int32())])
    total = len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in sorted_runs(batches, ["slice"]):
            sides = {True: (np.zeros(0, np.int64),) * 2, False: (np.zeros(0, np.int64),) * 2}
            for right, pairs, n in zip(columns["right"], columns["pairs"], columns["n"]):
                sides[bool(right)] = np.frombuffer(pairs, np.int64), np.frombuffer(n, np.int64)
            if columns["slice"][0] < 0:
                continue
            word = np.unique(np.concatenate([pairs // len(of) for pairs, _ in sides.values()]))
            for start in range(0, len(word), 1000):
                part = word[start:start + 1000]
                own, tables = np.zeros(len(part)), {}
                for right, (pairs, n) in sides.items():
                    a, b = np.searchsorted(pairs, [part[0] * len(of), (part[-1] + 1) * len(of)])
                    w, other = _ends(pairs[a:b], len(of))
                    at, n = np.searchsorted(part, w), n[a:b]
                    self_ = w == other
                    own[at[self_]] = n[self_]
                    tables[right] = np.bincount((at * total + of[other])[~self_], n[~self_], len(part) * total).reshape(-1, total)
                old = of[part].astype(np.int64)
                value = gains(tables[True], tables[False], own, old, table, classes)
                best = value.argmax(axis=1)
                row = np.arange(len(part))
                gain = value[row, best] - value[row, np.minimum(old, classes - 1)]
                move = (old >= classes) | (gain > _GAIN)
                yield to_batch({"word": part[move], "to": best[move]}, schema)

    return run


def cluster(pairs: DataFrame, of: np.ndarray, classes: int, total: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words and their table, from ``of``, in which clustered words may still have their ending's class.

    Each round scores all words, and moves those that gain. Where these moves
    together do not raise the likelihood, every second one of them is tried, and
    so on: a single move always does. Rounds go on until nothing moves, or until
    a round gains less than ``_SETTLED`` a bigram.
    """
    table = _class_table(pairs, of, total, words)
    step = 1
    while True:
        found = pairs.mapInArrow(_moves(of, table, classes, words), "word int, to int").toPandas().sort_values("word")
        at, to = found["word"].to_numpy(np.int64), found["to"].to_numpy(np.int64)
        unplaced = bool((of[at] >= classes).any())
        if not len(at):
            return of, table
        step = 1 if unplaced else max(1, step // 2)
        while True:
            new = of.copy()
            new[at[::step]] = to[::step]
            moved = _class_table(pairs, new, total, words)
            gain = likelihood(moved) - likelihood(table)
            if unplaced or gain > 0:
                of, table = new, moved
                if not unplaced and gain < _SETTLED * table.sum():
                    return of, table
                break
            if step >= len(at):
                return of, table
            step *= 2


def exchange(pairs: np.ndarray, free: int, classes: int, rounds: int) -> np.ndarray:
    """Class of each row of the bigram counts ``pairs``; rows from ``free`` on keep a class of their own.

    A word moves to the class that gains most log-likelihood of class bigrams,
    ``sum f(n(c, d)) - sum f(n(c, .)) - sum f(n(., c))`` with ``f(x) = x log x``;
    rounds go on until nothing moves.
    """
    f = _f
    n = len(pairs)
    pairs = pairs.astype(np.float64)
    often = np.argsort(-pairs[:free].sum(axis=1), kind="stable")
    of = np.empty(n, np.int64)
    of[often] = np.arange(free) % classes
    of[free:] = classes + np.arange(n - free)
    total = classes + n - free

    def fold(matrix: np.ndarray) -> np.ndarray:
        out = np.zeros((total, matrix.shape[1]))
        np.add.at(out, of, matrix)
        return out

    table = fold(fold(pairs).T).T
    for _ in range(rounds):
        moved = 0
        for w in often:
            old = of[w]
            right = np.bincount(of, pairs[w], total)
            left = np.bincount(of, pairs[:, w], total)
            self_ = pairs[w, w]
            right[old] -= self_
            left[old] -= self_
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= self_
            k = np.arange(classes)
            rows, columns = table[:classes], table[:, :classes].T
            gain = (f(rows + right) - f(rows)).sum(axis=1) + (f(columns + left) - f(columns)).sum(axis=1)
            diagonal = table[k, k]
            gain += f(diagonal + right[k] + left[k] + self_) - f(diagonal + right[k]) - f(diagonal + left[k]) + f(diagonal)
            sums, others = (table.sum(axis=1) + left)[:classes], (table.sum(axis=0) + right)[:classes]
            gain -= f(sums + right.sum() + self_) - f(sums) + f(others + left.sum() + self_) - f(others)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += right
            table[:, new] += left
            table[new, new] += self_
            of[w] = new
            moved += new != old
        if not moved:
            break
    return of


@dataclass(frozen=True)
class BrownModel:
    """``head``: frequent words and their places in ``logs`` (log10 of the count and 1) and ``kinds`` (classes). ``step[c, d]``: log10 of the transition from
    class c to d less that of the emissions' denominator of d. ``of``: class of each number of ``known``."""

    head: dict[bytes, int]
    logs: np.ndarray
    kinds: np.ndarray
    step: np.ndarray
    known: Vocabulary
    of: np.ndarray
    end: int
    train_tokens: int
    distinct: int
    params: BrownParams


def fit(docs: DataFrame, params: BrownParams = BrownParams()) -> tuple[BrownModel, DataFrame]:
    """The model of ``docs(text)`` and the counts ``(word, n)`` of its other words.

    The driver holds the ``head`` counts, bigrams of at most ``words`` words, a
    hash, count and class of each clustered word, and one count per class.
    """
    with small_batches(docs.sparkSession):
        return _fit(docs, params)


def _fit(docs: DataFrame, params: BrownParams) -> tuple[BrownModel, DataFrame]:
    rows = docs.select(raw_text(F.col("text")).alias("text"))
    counts = materialize(rows.mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(params.head).toPandas()
    head = [bytes(w) for w in top["word"]]
    kind = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(params.endings)).cast("int")
    clustered = (F.col("n") >= params.least) & (F.col("word") != F.lit(bytearray(_END)))
    often = counts.where(clustered).orderBy(F.desc("n"), "word").select(F.xxhash64("word").alias("hash"), "n", kind.alias("k")).toPandas()
    hashes, words = often["hash"].to_numpy(np.int64), len(often)
    order = np.argsort(hashes, kind="stable")
    known = Vocabulary(hashes[order], order, params.endings)
    slices = max(1, -(-int(total["n"]) // _TOKENS))
    pairs = materialize(
        rows.mapInArrow(_bigrams(known, slices), "slice int, right boolean, pairs binary, n binary")
        .repartition("slice").sortWithinPartitions("slice", "right").mapInArrow(_merged, "slice int, right boolean, pairs binary, n binary"), "bigrams")
    # The most frequent words among themselves, then all.
    starts = min(words, params.words)
    fallback = np.concatenate([often["k"].to_numpy(np.int64), np.arange(params.endings + 1)]).astype(np.int32)
    first = fallback + starts
    first[:starts] = np.arange(starts)
    seeds = _class_table(pairs, first, starts + params.endings + 1, words)
    of = fallback + params.classes
    of[:starts] = exchange(seeds, starts, params.classes, params.rounds)[:starts]
    total_classes = params.classes + params.endings + 1
    first_ending, end = params.classes, total_classes - 1
    of, table = cluster(pairs, of, params.classes, total_classes, words)
    # Tokens and different words of each class.
    n = often["n"].to_numpy(np.float64)
    tokens_of, words_of = np.bincount(of[:words], n, total_classes), np.bincount(of[:words], minlength=total_classes).astype(float)
    for r in counts.where(~clustered).groupBy((F.col("word") == F.lit(bytearray(_END))).alias("ends"), kind.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        k = end if r["ends"] else first_ending + r["k"]
        tokens_of[k] += r["n"]
        words_of[k] += r["v"]
    places = {w: i for i, w in enumerate(head)}
    to = table.sum(axis=0) + 0.5
    step = (table + params.smoothing * to / to.sum()) / (table.sum(axis=1, keepdims=True) + params.smoothing)
    step = np.log10(step) - np.log10(tokens_of + words_of + 1)[None, :]
    model = BrownModel(places, np.log10(top["n"].to_numpy(float) + 1), of[known.numbers(head)].astype(np.int32), step, known, of, end, int(total["n"]), int(total["v"]), params)
    rest = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in map(bytearray, head)], "word binary")), "word", "left_anti")
    return model, rest


def _score(model: BrownModel):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()),
                        ("emitted", pa.float64()), ("walked", pa.float64()), ("rare", pa.list_(pa.binary())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = pa.array(list(model.head), pa.binary())
        for batch in batches:
            out = {f.name: [] for f in schema}
            out["doc_id"], out["held_out"] = batch.column("doc_id"), batch.column("held_out")
            for different, at, sizes in coded(batch.column("text")):
                place = pc.fill_null(pc.index_in(pa.array(different, pa.binary()), value_set=head), -1).to_numpy()
                kinds = np.empty(len(different), np.int32)
                kinds[place >= 0] = model.kinds[place[place >= 0]]
                kinds[place < 0] = model.of[model.known.numbers([different[i] for i in np.flatnonzero(place < 0).tolist()])]
                kinds[-1] = model.end
                for stop, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
                    mine = at[stop - size:stop]
                    places = place[mine]
                    often = places >= 0
                    times = Counter([different[i] for i in mine[~often].tolist()])
                    ids = np.concatenate([[model.end], kinds[mine]])
                    out["n_tokens"].append(size)
                    out["known"].append(int(often.sum()))
                    out["emitted"].append(float(model.logs[places[often]].sum()))
                    out["walked"].append(float(model.step[ids[:-1], ids[1:]].sum()))
                    out["rare"].append(list(times))
                    out["times"].append(list(times.values()))
            yield to_batch(out, schema)

    return run


def score(docs: DataFrame, model: BrownModel, rest: DataFrame) -> DataFrame:
    """Scores of every row of ``docs(doc_id, text, held_out)``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (unigrams with one added), score (log10 probability under the classes) and
    perplexity. Null and empty texts are the end alone. Rows that repeat an id
    are scored each. Without training documents every count is 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", raw_text(F.col("text")).alias("text"))
    shape = "doc_id long, held_out boolean, n_tokens long, known long, emitted double, walked double, rare array<binary>, times array<long>"
    with small_batches(docs.sparkSession):
        scored = materialize(rows.mapInArrow(_score(model), shape).withColumn("row", F.monotonically_increasing_id()), "walks")
    rare = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
        .join(rest, "word")
        .groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rest"))
    )
    emitted = F.col("emitted") + F.coalesce("rest", F.lit(0.0))
    floor = float(np.log10(model.train_tokens + model.distinct + 1))
    value = emitted + F.col("walked")
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (emitted - F.col("n_tokens") * floor).alias("base_score"), value.alias("score"),
        F.pow(F.lit(10.0), -value / F.col("n_tokens")).alias("perplexity"))
