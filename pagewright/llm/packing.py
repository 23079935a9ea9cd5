"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. How pieces are combined
depends on their lengths alone, so it is decided on the table of counts per
length, which has at most ``capacity`` rows: for each length, from the longest
down, single lengths, pairs and triples that exactly fill the gap are consumed
while they last; what remains is packed best-fit. Pieces of a length are then
numbered in distributed slices and dealt to the places made for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from pagewright.llm.common import raw_text, to_batch
from pagewright.session import materialize

_CACHED_WORDS = 200_000
_JOINED_WORDS = 200
_MARK = "~"
_SLICE_BYTES = 4 << 20
_SLICES = 1024
_encoders: dict[str, "_Encoder"] = {}


class _Encoder:
    """Ids of white-space separated words as little-endian bytes, kept between batches.

    The tokenizer splits at white space and lower-cases, so the ids of a text
    are those of its words. New words are encoded many at a time, with a mark
    between them. Words are kept in two generations: when the young one is full
    it becomes the old one, and what is not met again is forgotten with it.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for lower-case ASCII, which needs no normalizing
        self.bare.normalizer = normalizers.Sequence([])
        self.mark = np.frombuffer(self.ids(_MARK), "<u4")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of the different ``words``."""
        if len(self.young) > _CACHED_WORDS:
            self.old, self.young = self.young, {}
        plain, other = [], []
        for word in words:
            if word in self.young:
                continue
            found = self.old.get(word)
            if found is not None:
                self.young[word] = found
            elif word.isascii():
                plain.append(word)
            else:
                other.append(word)
        self._learn(self.bare, plain)
        self._learn(self.tokenizer, other)
        return list(map(self.young.__getitem__, words))

    def texts(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """Ids of all ``texts`` in a row, and the bytes at which those of each begin and end."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
        coded = split.flatten().dictionary_encode()
        found = pa.array(self.words(coded.dictionary.cast(pa.binary()).to_pylist()), pa.binary()).take(coded.indices)
        if not len(found):
            return memoryview(b""), [0] * len(split.offsets)
        bounds = np.frombuffer(found.buffers()[1], np.int32)
        return memoryview(found.buffers()[2]), bounds[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()

    def _learn(self, tokenizer: Tokenizer, words: list[bytes]) -> None:
        for start in range(0, len(words), _JOINED_WORDS):
            chunk = words[start:start + _JOINED_WORDS]
            text = f" {_MARK} ".encode().join(chunk).decode()
            encoding, = tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(encoding.ids, "<u4")
            marks = np.flatnonzero(ids == self.mark[0]) * 4
            if len(self.mark) == 1 and len(marks) == len(chunk) - 1 == text.count(_MARK):
                flat = ids.tobytes()
                ends = [*marks.tolist(), len(flat)]
                starts = [0, *(marks + 4).tolist()]
                self.young.update(zip(chunk, [flat[a:b] for a, b in zip(starts, ends)]))
            else:
                self.young.update((word, self.ids(word.decode())) for word in chunk)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = _Encoder(path)
        encoder = _encoders[path]
        for batch in _slices(batches):
            out: dict[str, list] = {f.name: [] for f in schema}
            texts = batch.column("text")
            # Characters that the tokenizer may take for white space, and its special tokens.
            odd = pc.match_substring_regex(texts, r"[\x1c-\x1f]|<\|").to_numpy(zero_copy_only=False)
            flat, bounds = encoder.texts(pc.if_else(pa.array(odd), b"", texts))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = (encoder.ids(texts[k].as_py().decode()) if odd[k] else bytes(flat[bounds[k]:bounds[k + 1]])) + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start:start + 4 * capacity]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(start // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<i4"))
            yield to_batch(out, schema)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``_SLICE_BYTES`` of text, or of one longer text."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            stop = max(int(np.searchsorted(size, before + _SLICE_BYTES, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def combine(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how often each is used; every piece is used once.

    ``counts`` holds pieces per length. Bulk steps: each uses up a length or a
    kind of bin, so their number depends on the lengths, not on the pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins: list[tuple[tuple[int, ...], int]] = []

    def use(parts: tuple[int, ...]) -> None:
        times = min(int(left[p]) // parts.count(p) for p in set(parts))
        if times:
            for p in parts:
                left[p] -= times
            bins.append((parts, times))

    def pairs(total: int, top: int) -> np.ndarray:
        """Larger parts, at most ``top``, of the available pairs with the sum ``total``."""
        larger = np.arange((total + 1) // 2, min(top, total - 1) + 1)
        return larger[(left[larger] > 0) & (left[total - larger] > 0)][::-1]

    for length in range(capacity, 0, -1):
        gap = capacity - length
        if left[length] and gap == 0:
            use((length,))
        if left[length] and 0 < gap:
            use((length, gap))
        if left[length]:
            for a in pairs(gap, gap).tolist():
                use((length, a, gap - a))
                if not left[length]:
                    break
        for a in np.flatnonzero(left[:max(gap - 1, 1)])[::-1].tolist() if left[length] else ():
            for b in pairs(gap - a, a).tolist():
                use((length, a, b, gap - a - b))
                if not left[length]:
                    break
            if not left[length]:
                break
    # Best fit: the fullest kind of bin with room first takes the longest piece that fits.
    rest: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in rest if g >= length), default=None)
            if gap is None:
                for each, times in ((capacity // length, n // (capacity // length)), (n % (capacity // length), 1)):
                    if each and times:
                        rest.setdefault(capacity - each * length, []).append(((length,) * each, times))
                break
            parts, times = rest[gap].pop()
            if not rest[gap]:
                del rest[gap]
            each = max(1, min(gap // length, n // times))
            filled = min(times, n // each)
            n -= filled * each
            rest.setdefault(gap - each * length, []).append((parts + (length,) * each, filled))
            if times > filled:
                rest.setdefault(gap, []).append((parts, times - filled))
    return bins + [kind for kinds in rest.values() for kind in kinds]


def _places(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first number of that length, first sequence, offset), sorted."""
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for parts, times in combine(counts, capacity):
        offset = 0
        for length in parts:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _deal(places: np.ndarray):
    schema = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])
    shift = 1 << 44
    keys = places[:, 0] * shift + places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            row = np.searchsorted(keys, length * shift + number, "right") - 1
            keep = [i for i, n in enumerate(batch.schema.names) if n != "number"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in keep] + [pa.array(places[row, 2] + number - places[row, 1]), pa.array(places[row, 3])],
                schema=pa.schema([batch.schema.field(i) for i in keep] + list(schema)))

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` and their place in sequences of at most ``capacity`` tokens.

    A document's tokens are its text's ids and ``end_id``; null and empty texts
    are that one token. Only longer documents are cut. Rows that repeat an id
    are packed each. Returns doc_id, piece, start, length, ids_crc32
    (and ``ids``), sequence_id, offset. An empty table gives none.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text(F.col("text")).alias("text"))
        .mapInArrow(_pieces(path, capacity, end_id, with_ids), shape), "pieces")
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(_SLICES)))
    sizes = materialize(sliced.groupBy("length", "slice").agg(F.count("*").alias("n")), "lengths")
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        sliced.withColumn("inner", F.row_number().over(inside)).join(bases, ["length", "slice"])
        .select(*pieces.columns, (F.col("base") + F.col("inner") - 1).alias("number"))
    )
    return numbered.mapInArrow(_deal(_places(counts, capacity)), shape + ", sequence_id long, offset long")
