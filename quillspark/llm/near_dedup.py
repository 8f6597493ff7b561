"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER_ASCII, materialize, only, restrict, scratch_scope
from .linking import link_components, shared_buckets

#: 32 bands of 4 hashes miss a pair of similarity 0.8 with a chance of (1 - 0.8 ** 4) ** 32, about 5 in 10**8.
BANDS, ROWS = 32, 4
#: Hashes compared at a time, and the posterior chance of a link below which a pair is given up.
BATCH, MISS = 16, 1e-6
CACHED_WORDS = 400_000
#: Sketches and sets of a block in the last step of linking.
CELL_BYTES = 8 << 20
_SEED = 7_001


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingles:
    """Sorted distinct 64-bit hashes of the word shingles of texts."""

    def __init__(self, words: int) -> None:
        self.words, self.cache = words, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        words = (text or "").encode("utf-8", "replace").translate(LOWER_ASCII).split()
        h = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        n = len(h)
        if not n:
            return h
        k = min(self.words, n)
        x = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            x = (x ^ h[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        if n < self.words:
            x += np.uint64(n)
        return np.unique(x)


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(_SEED)
    return r.randint(0, 2**31, count).astype(np.uint32) * np.uint32(2) + np.uint32(1), r.randint(0, 2**31, count).astype(np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Low 16 bits of the smallest value of each hash function."""
    x = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 4096):
        v = x[None, at : at + 4096] * a[:, None]
        v += b[:, None]
        np.minimum(least, v.min(axis=1), out=least)
    return least.astype(np.uint16)


def _sketch(words: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, (a, b) = Shingles(words), _multipliers(hashes)
        for batch in batches:
            sizes, digests, sketches = [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketches.append(signature(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "n", "digest", "sketch"])

    return run


def _buckets(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, bands, -1)
            key = np.zeros(s.shape[:2], np.uint64)
            for k in range(s.shape[2]):
                key = (key + s[:, :, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            key = (key ^ mark) * np.uint64(0xBF58476D1CE4E5B9)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands))], names=["bucket", "id"])

    return run


def least_matches(n: int, percent: int, miss: float) -> int:
    """The fewest of n equal hashes with which a link is likelier than ``miss``.

    With a uniform prior the similarity's posterior is Beta(m + 1, n - m + 1); that it reaches t has the chance that a
    binomial of n + 1 trials at t comes to m or less.
    """
    t, below = percent / 100, 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below > miss:
            return m
    return n


def _prune(percent: int, hashes: int, batch_size: int, miss: float):
    steps = [(at, min(at + batch_size, hashes)) for at in range(0, hashes, batch_size)]
    need = [least_matches(end, percent, miss) for _, end in steps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            alive, got = np.arange(len(x)), np.zeros(len(x), np.int64)
            for (at, end), least in zip(steps, need, strict=True):
                got[alive] += (x[alive, at:end] == y[alive, at:end]).sum(axis=1)
                alive = alive[got[alive] >= least]
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(alive)) for k in (0, 1)], names=["a", "b"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "s"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(np.flatnonzero(np.array(ok, bool)))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in (0, 1)], names=["a", "b"])

    return run


def _cell(percent: int, hashes: int, batch_size: int, miss: float):
    """Links of a block of outside documents with a block of inside ones, of different components: signatures are
    compared batch by batch and pruned, and what is left is counted on the full sets. One link joins two components."""
    steps = [(at, min(at + batch_size, hashes)) for at in range(0, hashes, batch_size)]
    need = [least_matches(end, percent, miss) for _, end in steps]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            sig = np.frombuffer(b"".join(right["sketch"]), np.uint16).reshape(len(right), -1)
            sets = [np.frombuffer(s, np.uint64) for s in right["s"]]
            size = np.array([len(s) for s in sets])
            every, ids, comps = np.concatenate(sets), right["id"].to_numpy(), right["comp"].to_numpy()
            order = np.argsort(every, kind="stable")
            values, owner = every[order], np.repeat(np.arange(len(sets)), size)[order]
            joined: set[tuple[int, int]] = set()
            for i, comp, sketch, s in zip(left["id"], left["comp"], left["sketch"], left["s"], strict=True):
                own, s = np.frombuffer(sketch, np.uint16), np.frombuffer(s, np.uint64)
                alive = np.flatnonzero((comps != comp) & (100 * np.minimum(size, len(s)) >= percent * np.maximum(size, len(s))))
                got = np.zeros(len(alive), np.int64)
                for (at, end), least in zip(steps, need, strict=True):
                    got += (sig[alive, at:end] == own[at:end]).sum(axis=1)
                    stay = got >= least
                    alive, got = alive[stay], got[stay]
                if not len(alive):
                    continue
                first, last = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
                both = np.zeros(len(sets), np.int64)
                for at in range(0, len(s), 512):
                    n = last[at : at + 512] - first[at : at + 512]
                    ends = np.cumsum(n)
                    both += np.bincount(owner[np.repeat(first[at : at + 512] - (ends - n), n) + np.arange(ends[-1])], minlength=len(sets))
                for k in alive[100 * both[alive] >= percent * (size[alive] + len(s) - both[alive])]:
                    if (key := (min(comp, comps[k]), max(comp, comps[k]))) not in joined:
                        joined.add(key)
                        out.append((int(i), int(ids[k])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, batch: int = BATCH, miss: float = MISS) -> DataFrame:
    """Groups of documents whose sets of ``words``-word shingles reach a Jaccard similarity of ``percent`` / 100.

    Words are runs of other than ASCII white space, A-Z lower-cased. A document with fewer words has their whole sequence
    as its one shingle; without words (null or empty texts too) its set is empty and it is linked with nothing.

    One scan takes from every whole text the size and a 128-bit digest of its set and a MinHash signature. Documents with
    equal sets are one class from there on; only class representatives are banded. Candidates go through
    :func:`link_components`; pairs are compared batch by batch of their signatures and given up once the posterior chance
    of a link is below ``miss``; the rest is confirmed on the full shingle sets, which a second scan takes from documents
    in shared buckets only.

    Returns id, n_shingles, component_id (smallest id reachable, its own included) and kept; one row for each input row.
    Rows that share an id are one document and their links are joined. A row with a null id takes no part and is kept,
    with a null component. An empty input gives no rows.
    """
    source = only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    with scratch_scope() as keep:
        sketches = keep(materialize(source.mapInArrow(_sketch(words, bands * rows), "id long, n long, digest binary, sketch binary"), "sketches"))
        usable = sketches.filter("digest is not null and id is not null")
        classes = materialize(usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
        reps = usable.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").select("id", "sketch")
        members = reps.mapInArrow(_buckets(bands), "bucket long, id long").distinct()
        live = shared_buckets(members)
        ids = materialize(live.select("id").distinct(), "ids")
        kept_sketches = materialize(restrict(reps, ids, "id"), "live_sketches")
        sets = materialize(restrict(source, ids, "id").mapInArrow(_sets(words), "id long, s binary"), "sets")

        def joined(pairs: DataFrame, values: DataFrame, col: str) -> DataFrame:
            v = values.select(F.col("id").alias("a"), F.col(col).alias("x"))
            w = values.select(F.col("id").alias("b"), F.col(col).alias("y"))
            return pairs.join(v, "a").join(w, "b").select("a", "b", "x", "y")

        def verify(pairs: DataFrame) -> DataFrame:
            likely = joined(pairs, kept_sketches, "sketch").mapInArrow(_prune(percent, bands * rows, batch, miss), "a long, b long")
            likely = materialize(likely, "likely")
            return joined(likely, sets, "s").mapInArrow(_confirm(percent), "a long, b long").distinct()

        def cross(outside: DataFrame, inside: DataFrame) -> DataFrame:
            data = sets.join(kept_sketches, "id")
            left, right = (materialize(df.join(data, "id"), "side") for df in (outside, inside))
            blocks = lambda df, name: df.groupBy("grp").agg(F.ceil(F.sum(F.length("s") + F.length("sketch")) / CELL_BYTES).cast("int").alias(name))
            grid = materialize(blocks(left, "rows").join(blocks(right, "cols"), "grp"), "grid")
            mix = F.xxhash64("id", F.lit(_SEED))
            cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
            left = left.join(grid, "grp").withColumn("row", F.pmod(mix, F.col("rows")).cast("int")).withColumn("col", cells("cols"))
            right = right.join(grid, "grp").withColumn("col", F.pmod(mix, F.col("cols")).cast("int")).withColumn("row", cells("rows"))
            one, other = (df.select("grp", "row", "col", "id", "comp", "sketch", "s").groupBy("grp", "row", "col") for df in (left, right))
            return one.cogroup(other).applyInPandas(_cell(percent, bands * rows, batch, miss), "a long, b long")

        comps = link_components(live, verify, cross)
        least = classes.join(comps.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"), (F.col("comp").isNotNull() | (F.col("size") > 1)).alias("shared")).filter("shared")
        least = keep(materialize(least.drop("shared"), "membership"))
    own = sketches.select("id", "n", "digest").join(least, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents by two-word shingles at 80 percent; see :func:`near_dedup` for nulls, empty
    texts and repeated ids."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
  FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON c.a = n.doc_id
"""
