"""Best-fit packing of documents into token sequences, by large-item matching."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WordCodes, coded_words, materialize, only

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
#: Id that ends every document.
END = 0
#: Distinct words whose ids a worker keeps; it starts anew beyond that.
CACHED_WORDS = 400_000
#: Bytes of text that a worker tokenizes at a time, unless a single text is longer, as its arrays take many times as much.
PORTION = 1 << 22


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Words that are tokenized as one text, with spaces between them, which takes half the time of so many texts; and how
#: many such texts are tokenized at once, as what the tokenizer returns is large.
JOINED, AT_ONCE = 128, 64


def word_ids(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of single words, one after the other, and how many each has: those that start in its characters."""
    ids, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    chunks = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
    for k in range(0, len(chunks), AT_ONCE):
        some = chunks[k : k + AT_ONCE]
        for chunk, e in zip(some, _tokenizer(path).encode_batch([" ".join(c) for c in some], add_special_tokens=False), strict=True):
            ends = np.cumsum(np.fromiter(map(len, chunk), np.int64, len(chunk)) + 1)
            at = np.fromiter((x for x, _ in e.offsets), np.int64, len(e.ids))
            ids.append(np.array(e.ids, np.uint32))
            size.append(np.bincount(np.searchsorted(ends, at, "right"), minlength=len(chunk)))
    return np.concatenate(ids), np.concatenate(size)


class WordTokens:
    """Token ids of texts, put together from the ids of their white-space separated words.

    Exact for tokenizers whose pre-tokens and added tokens never span ASCII white space (such as ``VOCABULARY``, which
    drops white space): normalisation and BPE then work on each word alone. Each distinct word is tokenized once, and a
    batch's words are told apart in Arrow.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.clear()

    def clear(self) -> None:
        self.codes, self.flat, self.start, self.size = WordCodes(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        if len(self.codes) > CACHED_WORDS:
            self.clear()
        own, words, distinct = coded_words(texts)
        known = np.fromiter(map(self.codes.__getitem__, distinct), np.int64, len(distinct))
        if new := self.codes.new:
            ids, size = word_ids(self.path, [w.decode() for w in new])
            start = np.cumsum(size) - size + len(self.flat)
            self.flat = np.concatenate([self.flat, ids])
            self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
            self.codes.new = []
        start, size = self.start[known][own], self.size[known][own]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.cumsum(words)
        return ids, np.diff(np.concatenate([[0], np.append(0, ends)[last]]))


def _ranks(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each value's number among its equals, counted on from ``seen``, which moves on."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(values) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(values)))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, many) + seen[ordered]
    seen[ordered[first]] += many
    return out


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch (id, text) in runs of rows of at most PORTION bytes of text; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    done = 0
    while done < len(ends):
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PORTION, "right")))
        yield batch.slice(done, stop - done)
        done = stop


def _pieces(path: str, capacity: int, end: int, keep_ids: bool):
    schema = _piece_schema(keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tokens, seen = TaskContext.get().partitionId(), WordTokens(path), np.zeros(capacity + 1, np.int64)
        for batch in (part for whole in batches for part in portions(whole)):
            ids, sizes = tokens.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(sizes), np.uint32(end)).astype("<u4", copy=False)
            sizes = sizes + 1
            many = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            at = (np.cumsum(sizes) - sizes)[doc] + start
            data = memoryview(ids).cast("B")
            crcs = [zlib.crc32(data[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), piece, start, length, crcs, np.full(len(doc), part), _ranks(length, seen)]
            if keep_ids:
                columns.append([ids[x : x + n] for x, n in zip(at, length, strict=True)])
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _piece_schema(keep_ids: bool) -> pa.Schema:
    fields = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("pos", pa.int64())]
    return pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if keep_ids else []))


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Bins for so many items of each length. Large items (over a third of the capacity) come first, at most two a bin,
    longest with the longest that fits beside it; smaller ones then go, longest first, to the fullest bin that takes
    them. Bins of one kind are one row with a count, so the work depends on the capacity and not on the items.

    Rows: length, first (number among the items of that length), count, each (items of this length in a bin), sequence
    (number of the first bin) and offset (place of the first item in its bin).
    """
    left = {n: c for n, c in counts.items() if c}
    kinds: list[list] = []  # gap, bins, [(length, each), ...]
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            fits = [m for m in large if m <= capacity - n and left[m] and (m != n or left[m] > 1)]
            if not fits:
                kinds.append([capacity - n, left[n], [(n, 1)]])
                left[n] = 0
            elif (m := fits[0]) == n:
                kinds.append([capacity - 2 * n, left[n] // 2, [(n, 2)]])
                left[n] %= 2
            else:
                k = min(left[n], left[m])
                kinds.append([capacity - n - m, k, [(n, 1), (m, 1)]])
                left[n] -= k
                left[m] -= k
    by_gap: dict[int, list[list]] = {}
    for kind in kinds:
        by_gap.setdefault(kind[0], []).append(kind)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        gaps = iter(sorted(g for g in by_gap if g >= n))
        gap = next(gaps, None)
        while todo:
            while gap is not None and not by_gap.get(gap):
                gap = next(gaps, None)
            if gap is None:
                kind = [capacity, -(-todo // (capacity // n)), []]
                kinds.append(kind)
            else:
                kind = by_gap[gap].pop()
            fit = kind[0] // n
            bins = min(kind[1], todo // fit)
            if bins < kind[1] and bins:  # some bins of the kind stay as they are
                rest = [kind[0], kind[1] - bins, list(kind[2])]
                kinds.append(rest)
                by_gap.setdefault(rest[0], []).append(rest)
                kind[1] = bins
            elif not bins:  # fewer items than one bin takes
                if kind[1] > 1:
                    rest = [kind[0], kind[1] - 1, list(kind[2])]
                    kinds.append(rest)
                    by_gap.setdefault(rest[0], []).append(rest)
                kind[1], fit = 1, todo
            kind[2].append((n, fit))
            todo -= fit * kind[1]
            kind[0] -= fit * n
            by_gap.setdefault(kind[0], []).append(kind)
    rows, first, sequence = [], dict.fromkeys(counts, 0), 0
    for _, bins, items in kinds:
        offset = 0
        for n, each in items:
            rows.append((n, first[n], bins * each, each, sequence, offset))
            first[n] += bins * each
            offset += n * each
        sequence += bins
    return pd.DataFrame(rows, columns=["length", "first", "count", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens, cutting only those that are longer.

    One scan tokenizes every whole text and writes its pieces without the text. Pieces of one length can stand for each
    other, so the driver plans over how many there are of each length (at most ``capacity`` numbers), and each piece
    finds its place from its rank among those of its length: a rank in its task plus the counts of earlier tasks. No
    group of pieces meets in a task.

    Returns id, piece, start, length, ids_crc32, sequence_id and offset, and ids if asked for. A null or empty text is
    the end id alone. Rows that repeat a document are packed as often as they come. An empty input gives no rows.
    """
    spark = docs.sparkSession
    spark_schema = "id long, piece int, start long, length long, ids_crc32 long, part int, pos long" + (", ids array<long>" if keep_ids else "")
    rows = only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    pieces = materialize(rows.mapInArrow(_pieces(path, capacity, end, keep_ids), spark_schema), "pieces")
    counts = materialize(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    by_length = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    table = plan(by_length, capacity)
    before = np.zeros(capacity + 2, np.int64)
    before[1:] = np.cumsum([by_length.get(n, 0) for n in range(capacity + 1)])
    places = spark.sparkContext.broadcast((before, before[table["length"].to_numpy(np.int64)] + table["first"].to_numpy(np.int64), *(table[c].to_numpy(np.int64) for c in ("first", "each", "sequence", "offset"))))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        before, at, first, each, sequence, offset = places.value
        k = np.searchsorted(at, before[length.to_numpy()] + rank.to_numpy(), "right") - 1
        j = rank.to_numpy() - first[k]
        return pd.DataFrame({"sequence_id": sequence[k] + j // each[k], "offset": offset[k] + j % each[k] * length.to_numpy()})

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    out = pieces.join(base, ["length", "part"]).withColumn("at", place("length", F.col("base") + F.col("pos")))
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if keep_ids else []))


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens; null texts count as empty, rows that repeat an id
    are documents each."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
