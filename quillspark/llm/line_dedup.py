"""Fuzzy deduplication of lines across documents: SimHash, pigeonhole blocks, edit similarity, one line of each group."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from struct import unpack

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import among, coded_words, free_shuffles, materialize, only, parted, scratch_scope
from .linking import link_components, shared_buckets

#: Bits in which the SimHash of two linked lines may differ. Blocks of the 64 bits: all but two of them are equal in
#: hashes within two bits, so no such pair is missed; other candidates share a run of words or all words but one.
DISTANCE, BLOCKS, BLOCK_BITS = 12, 4, 2
#: The bound with ``finer``, of the 128 bits of two SimHashes; two more for each word under SHORT. It keeps lines that only
#: share a passage from being compared one by one.
FAR = 26
#: Least edit similarity of two lines, in percent: 100 * (longer - distance) >= percent * longer.
PERCENT = 90
#: Lines whose normal form is shorter have no near lines; without ``short`` they are always kept.
MIN_CHARS = 24
CACHED_WORDS = 400_000
#: Lines over this length are compared one by one, by bits of whole numbers; others in bands, of FEW edits at first.
LONG, FEW = 2048, 10
#: Runs of GRAM words are dealt over BINS by their hash; a line's least hash in each bin is a key. Lines of up to SHORT
#: words are also joined on what is left of them without any one word.
GRAM, BINS, SHORT = 4, 8, 12
#: Buckets over this size are cut by length classes, and then linked through leaders.
SMALL = 24
#: Counters of a line's characters, and characters of a side of a cell: large buckets are compared cell by cell, so many
#: pairs at a time.
LETTERS, CELL_CHARS, AT_ONCE = 32, 1 << 19, 4096
_NONE, _MIX = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_DIGITS = bytes(range(48, 58))
_UPPER = bytes(range(65, 91))
#: Letters A-Z in lower case, every digit a 0, other ASCII signs a space.
NORMAL = bytes.maketrans(_UPPER + _DIGITS + _PUNCTUATION, _UPPER.lower() + b"0" * 10 + b" " * len(_PUNCTUATION))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def normal_lines(text: str | None) -> list[list[bytes]]:
    """Words of the normal form of each line."""
    return [line.split() for line in (text or "").encode("utf-8", "replace").translate(NORMAL).split(b"\n")]


def _marks(text: str | None) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Normal form of each line, and 128 bits of its hash as two numbers."""
    forms = [b" ".join(words) for words in normal_lines(text)]
    return forms, [unpack(">qq", xxhash.xxh3_128_digest(f)) for f in forms]


def run_keys(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each line and bin the least hash of its runs of GRAM words there, _NONE where there is none."""
    out = np.full((len(ends), BINS), _NONE)
    n = len(words) - GRAM + 1
    if n < 1:
        return out
    runs = words[:n].copy()
    for k in range(1, GRAM):
        runs = (runs ^ (runs >> np.uint64(29))) * _MIX + words[k : n + k]
    runs = (runs ^ (runs >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    runs = np.concatenate([runs ^ (runs >> np.uint64(29)), np.full(GRAM - 1, _NONE)])
    for k in range(1, GRAM):  # runs that would reach into the next line
        at = ends - k
        runs[at[at >= 0]] = _NONE
    starts, which = np.concatenate([[0], ends[:-1]]), runs >> np.uint64(61)
    for b in range(BINS):
        out[:, b] = np.minimum.reduceat(np.where(which == b, runs, _NONE), starts)
    return out


def all_but_one(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines of up to SHORT words: of all words, and of those without any one of them. Keys, and their lines."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    size, keys, owner = ends - starts, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n in range(1, SHORT + 1):
        mine = np.flatnonzero(size == n)
        if not len(mine):
            continue
        own = words[starts[mine][:, None] + np.arange(n)]
        for gone in range(-1 if n > 0 else 0, n if n > 1 else 0):
            key = np.full(len(mine), np.uint64(7))
            for k in range(n):
                if k != gone:
                    key = (key ^ (key >> np.uint64(29))) * _MIX + own[:, k]
            keys.append((key ^ (key >> np.uint64(32))) * _MIX)
            owner.append(mine)
    return np.concatenate(keys), np.concatenate(owner)


def line_keys(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines without the blocks of their SimHash, and the lines they belong to, in order of the lines."""
    runs = run_keys(words, ends)
    line, b = np.nonzero(runs != _NONE)
    few, owner = all_but_one(words, ends)
    keys, owner = np.concatenate([runs[line, b], few]), np.concatenate([line, owner])
    order = np.argsort(owner, kind="stable")
    return keys[order], owner[order]


_LINES = pa.schema([("id", pa.int64()), ("m1", pa.int64()), ("m2", pa.int64()), ("k", pa.int32()), ("size", pa.int32()), ("words", pa.int32()), ("sim", pa.int64()), ("sim2", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _scan(min_chars: int, short: bool):
    """A row for each distinct line of a document, with the number of its places; hashes and keys with the first row of a
    form in a task only, which is enough to find its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = _Hashes(), set()
        for batch in batches:
            if len(cache) > CACHED_WORDS:
                cache.clear()
            if len(seen) > CACHED_WORDS:
                seen.clear()
            ids, digests, counts, new, at = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for form, k in Counter(b" ".join(words) for words in normal_lines(text)).items():
                    if len(form) >= (1 if short else min_chars):
                        digest = xxhash.xxh3_128_digest(form)
                        if len(form) >= min_chars and digest not in seen:
                            seen.add(digest)
                            new.append(form)
                            at.append(len(ids))
                        ids.append(i)
                        digests.append(digest)
                        counts.append(k)
            m = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            forms = pa.array(new, pa.large_binary()).cast(pa.large_string())
            codes, words, distinct = coded_words(forms)
            hashes = np.fromiter(map(cache.__getitem__, distinct), np.uint64, len(distinct))[codes]
            ends = np.cumsum(words)
            keys, owner = line_keys(hashes, ends)
            place = np.full(len(ids) + 1, len(new))
            place[at] = np.arange(len(new))
            where = pa.array(place[:-1], mask=place[:-1] == len(new))
            bounds = np.zeros(len(ids) + 1, np.int32)
            bounds[1:][place[:-1] < len(new)] = np.bincount(owner, minlength=len(new))
            bounds = np.cumsum(bounds)
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32(), mask=np.append(place[:-1] == len(new), False)), pa.array(keys.view(np.int64)))
            columns = [pa.array(ids, pa.int64()), pa.array(m[:, 0]), pa.array(m[:, 1]), pa.array(counts, pa.int32())]
            other = (hashes ^ (hashes >> np.uint64(31))) * _MIX
            sims = (simhash(hashes, ends), simhash(other ^ (other >> np.uint64(29)), ends))
            columns += [pc.take(pa.array(x), where).cast(t) for x, t in ((pc.utf8_length(forms), pa.int32()), (words, pa.int32()), *((x, pa.int64()) for x in sims))]
            yield pa.RecordBatch.from_arrays([*columns, listed], schema=_LINES)

    return run


def simhash(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each run of word hashes; ``ends`` are the runs' ends, no run is empty."""
    out = np.zeros(len(ends), np.int64)
    done = 0
    while done < len(ends):
        first = ends[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(ends, first + 100_000, "right")))
        part = np.ascontiguousarray(hashes[first : ends[stop - 1]])
        starts = np.concatenate([[0], ends[done : stop - 1] - first])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        more = 2 * ones > np.diff(np.append(starts, len(part)))[:, None]
        out[done:stop] = np.packbits(more, axis=1).view(np.int64).ravel()
        done = stop
    return out


def _keys(blocks: int):
    """For each choice of all but BLOCK_BITS blocks, which are equal in some choice: a key of their bits."""
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    for n, chosen in enumerate(combinations(range(blocks), blocks - BLOCK_BITS)):
        mask = sum(((1 << (bounds[k + 1] - bounds[k])) - 1) << bounds[k] for k in chosen)
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        yield F.xxhash64(F.col("sim").bitwiseAND(F.lit(mask)), F.lit(n))


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of ``wanted`` of each text, in normal form."""
    for batch in batches:
        ids, forms = [], []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {mark: form for form, mark in zip(*_marks(text), strict=True)}
            for w in wanted:
                if (form := own.get((w["m1"], w["m2"]))) is not None:
                    ids.append(w["m1"])
                    forms.append(form.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(forms, pa.string())], names=["id", "form"])


def _shared_start(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _cores(a: str, b: str) -> tuple[str, str]:
    """Two strings without the start and the end that they share, which changes no edit distance."""
    at = _shared_start(a, b)
    a, b = a[at:], b[at:]
    at = _shared_start(a[::-1], b[::-1])
    return a[: len(a) - at], b[: len(b) - at]


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time as the bits of whole numbers; shared ends are cut first."""
    a, b = _cores(a, b)
    if not a or not b:
        return len(a) + len(b)
    full, top, where = (1 << len(a)) - 1, 1 << (len(a) - 1), dict.fromkeys(b, 0)
    for k, c in enumerate(a):
        if c in where:
            where[c] |= 1 << k
    up, down, distance = full, 0, len(a)
    for c in b:
        eq = where[c]
        same = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | (full & ~(same | up)), up & same
        distance += bool(rise & top) - bool(fall & top)
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        eq |= down
        up, down = fall | (full & ~(eq | rise)), rise & eq
    return distance


def _banded(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Whether each pair's edit distance is at most its ``most``: the diagonals of the table that a path of so many edits
    can reach and come back from (those of the largest ``most``, one more than edits), all pairs a row at a time; pairs
    that have no small enough value left in a row drop out."""
    k, n, m = int(most.max()), *(np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    codes = lambda s: np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)
    a, b = np.zeros((len(pairs), int(n.max())), np.uint32), np.zeros((len(pairs), int(max(n.max(), m.max())) + k + 1), np.uint32)
    zero = (k - (m - n)) // 2  # where the main diagonal lies in the band
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = codes(x)
        b[i, zero[i] : zero[i] + len(y)] = codes(y)
    steps, far = np.arange(k + 1, dtype=np.int16), np.int16(20_000)
    row = np.where(steps >= zero[:, None], steps - zero[:, None], far).astype(np.int16)
    out, alive = np.zeros(len(pairs), bool), np.arange(len(pairs))
    for i in range(a.shape[1] + 1):
        if i:
            new = row + (b[:, i - 1 : i + k] != a[:, i - 1 : i])
            np.minimum(new[:, :-1], row[:, 1:] + np.int16(1), out=new[:, :-1])
            new -= steps
            np.minimum.accumulate(new, axis=1, out=new)
            new += steps
            row = new
        done = n[alive] == i
        if done.any():
            at = np.flatnonzero(done)
            out[alive[at]] = row[at, (m - n + zero)[alive[at]]] <= most[alive[at]]
        if done.any() or i % 16 == 15:
            stay = ~done & (row.min(axis=1) <= most[alive])
            alive, row, a, b = alive[stay], row[stay], a[stay], b[stay]
            if not len(alive):
                break
    return out


def letters(forms: list[str]) -> np.ndarray:
    """How often the characters of each of LETTERS kinds are in each line."""
    out = np.zeros((len(forms), LETTERS), np.int32)
    for i, form in enumerate(forms):
        out[i] = np.bincount(np.frombuffer(form.encode("utf-32-le", "replace"), np.uint32) % LETTERS, minlength=LETTERS)
    return out


def fewest_edits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number of edits that no two lines of these letters can do without: one takes out and puts in one character at most."""
    more = x - y
    return np.maximum(np.maximum(more, 0).sum(axis=-1), np.maximum(-more, 0).sum(axis=-1))


def within(pairs: list[tuple[str, str]], most: list[int]) -> np.ndarray:
    """Whether each pair's edit distance is at most its ``most``. Very long ones are worked on one by one."""
    out, cores = np.zeros(len(pairs), bool), []
    forms = {form: i for i, form in enumerate(dict.fromkeys(form for pair in pairs for form in pair))}
    counts = letters(list(forms))
    least = fewest_edits(*(counts[[forms[p[side]] for p in pairs]] for side in (0, 1)))
    for i in np.flatnonzero(least <= np.array(most, np.int64)):
        k, (a, b) = most[i], _cores(*pairs[i])
        if max(len(a), len(b)) <= k:
            out[i] = True
        elif abs(len(a) - len(b)) > k:
            continue
        elif max(len(a), len(b)) > LONG:
            out[i] = edit_distance(a, b) <= k
        else:
            cores.append((k, len(a), i, (a, b)))
    for bound in (FEW, LONG):  # most links have few edits, which a narrow band shows
        todo = [(min(k, bound), n, i, p) for k, n, i, p in cores if not out[i] and least[i] <= bound]
        todo.sort(key=lambda c: c[:3])
        at = 0
        while at < len(todo):
            end = at + 1
            while end < len(todo) and end - at < 512 and todo[end][0] <= 1.25 * todo[at][0] + 2:
                end += 1
            some = todo[at:end]
            out[[c[2] for c in some]] = _banded([c[3] for c in some], np.array([c[0] for c in some]))
            at = end
        cores = [c for c in cores if c[0] > bound]
    return out


def _close(percent: int):
    """Pairs of lines (ids, forms) of enough edit similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            keep = pa.array(np.flatnonzero(within(pairs, [max(len(x), len(y)) * (100 - percent) // 100 for x, y in pairs])))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in (0, 1)], names=["a", "b"])

    return run


def _cell(percent: int, distance: int, finer: bool):
    """Links of a block of a bucket's outside lines (``left``) with a block of all its lines, of different components. Two
    lines that share several buckets meet in the least of them only."""

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        left, right = cell[cell["left"]], cell[~cell["left"]]
        out: list[tuple[int, int]] = []
        ends: list[tuple[int, int]] = []
        pairs: list[tuple[str, str]] = []

        def compare() -> None:
            out.extend(ends[k] for k in np.flatnonzero(within(pairs, [max(len(x), len(y)) * (100 - percent) // 100 for x, y in pairs])))
            ends.clear()
            pairs.clear()

        if len(left) and len(right):
            grp, forms, groups = left["grp"].iloc[0], right["form"].tolist(), [frozenset(g) for g in right["grps"]]
            ids, comps, size, words, sim, sim2, outer = (right[c].to_numpy() for c in ("id", "comp", "size", "words", "sim", "sim2", "out"))
            own, counts = letters(left["form"].tolist()), letters(forms)
            named = zip(*(left[c].tolist() for c in ("id", "comp", "size", "words", "sim", "sim2", "form")), left["grps"], own, strict=True)
            for i, comp, n, w, s, s2, form, g, count in named:
                longer = np.maximum(size, n).astype(np.int64)
                most = longer * (100 - percent) // 100
                bits = np.bitwise_count((sim ^ s).view(np.uint64)).astype(np.int64)
                bound = distance
                if finer:
                    bits += np.bitwise_count((sim2 ^ s2).view(np.uint64))
                    bound = FAR + 2 * np.maximum(0, SHORT - np.minimum(words, w))
                alive = np.flatnonzero((comps != comp) & (~outer | (ids > i)) & (longer - np.minimum(size, n) <= most) & (bits <= bound))
                g = frozenset(g)
                for k in alive[fewest_edits(count, counts[alive]) <= most[alive]]:
                    if min(g & groups[k]) == grp:
                        ends.append((i, int(ids[k])))
                        pairs.append((form, forms[k]))
                if len(pairs) >= AT_ONCE:
                    compare()
            compare()
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def without_lines(text: str, gone: list[dict] | None) -> tuple[str, int, int]:
    """A text without the lines that ``gone`` names, its number of lines and how many went."""
    lines = text.split("\n")
    if gone is None:
        return text, len(lines), 0
    named, met, stay = {(g["m1"], g["m2"]): g for g in gone}, set(), []
    for line, mark in zip(lines, _marks(text)[1], strict=True):
        if (g := named.get(mark)) is None:
            stay.append(line)
        elif g["here"] and (group := (g["g1"], g["g2"])) not in met:
            met.add(group)
            stay.append(line)
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def _near(x: str, y: str, percent: int, distance: int, finer: bool) -> Column:
    """What two lines (columns ``<x>size`` and so on) must meet to be worth comparing."""
    size, words, sim, sim2 = ((F.col(f"{x}{c}"), F.col(f"{y}{c}")) for c in ("size", "words", "sim", "sim2"))
    longer, shorter = F.greatest(*size), F.least(*size)
    bits = F.bit_count(sim[0].bitwiseXOR(sim[1]))
    both = bits + F.bit_count(sim2[0].bitwiseXOR(sim2[1]))
    alike = both <= FAR + 2 * F.greatest(F.lit(0), SHORT - F.least(*words)) if finer else bits <= distance
    return (longer - shorter <= F.floor(longer * (100 - percent) / 100)) & alike


def _size_class(size: str | Column, percent: int) -> Column:
    """A class of lengths: those of linked lines lie in the same or in neighbouring classes."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-np.log((100 - min(99, 100 - percent)) / 100 - 1e-6)))


def _here(x: str, y: str, percent: int) -> Column:
    """Whether two lines of a bucket are to meet in it: in buckets cut by classes, where each is in its own and in the next,
    in the larger of their own classes only."""
    return F.col(f"{x}class").isNull() | (F.col(f"{x}class") == F.greatest(_size_class(f"{x}size", percent), _size_class(f"{y}size", percent)))


def _linked(lines: DataFrame, exact: DataFrame, source: DataFrame, percent: int, distance: int, blocks: int, finer: bool) -> DataFrame:
    """Components (id, comp) of the forms with near ones; forms go by the first half of their mark."""
    twice = materialize(exact.groupBy("m1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "halves")
    keyed = lines.filter("keys is not null").withColumnRenamed("m1", "id_")
    if not twice.isEmpty():  # forms that share a half of their marks, as good as never
        keyed = keyed.join(twice.select(F.col("m1").alias("id_")), "id_", "left_anti")
    members = keyed.select("id_", F.explode(F.concat(F.array(*_keys(blocks)), "keys")).alias("bucket")).withColumnRenamed("id_", "id")
    several = members.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high")
    shared = materialize(several.select("bucket"), "shared")
    found = materialize(among(members, shared, "bucket").distinct(), "found")
    free_shuffles(source.sparkSession)
    ids = materialize(found.select("id").distinct(), "ids")
    attrs = among(keyed.select(F.col("id_").alias("id"), "size", "words", "sim", "sim2"), ids, "id").groupBy("id").agg(*[F.min(c).alias(c) for c in ("size", "words", "sim", "sim2")])
    attrs = materialize(attrs, "attrs")
    live = materialize(shared_buckets(found).join(attrs, "id"), "live")

    few = live.filter(F.col("n") <= SMALL)
    other = few.select("bucket", *[F.col(c).alias(f"o_{c}") for c in ("id", "size", "words", "sim", "sim2")])
    pairs = few.join(other, "bucket").filter(F.col("id") < F.col("o_id")).filter(_near("", "o_", percent, distance, finer))
    pairs = materialize(pairs.select(F.col("id").alias("a"), F.col("o_id").alias("b")).distinct(), "pairs")
    # each line is in its own class and in the next, so linked ones share the larger of their two, and meet there only
    size_class = _size_class("size", percent)
    many = live.filter(F.col("n") > SMALL).drop("n").withColumn("class", F.explode(F.array(size_class, size_class + 1)))
    many = shared_buckets(many.withColumn("bucket", F.xxhash64("bucket", "class")))

    compared = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(many.select("id")).distinct(), "compared")
    places = among(exact.select(F.col("m1").alias("lid"), "m1", "m2", "at"), compared.withColumnRenamed("id", "lid"), "lid")
    wanted = materialize(places.groupBy(F.col("at").alias("id")).agg(F.collect_list(F.struct("m1", "m2")).alias("wanted")), "wanted")
    read = parted(source, wanted, "id")[0].join(wanted, "id")
    texts = materialize(read.select("text", "wanted").mapInArrow(_forms, "id long, form string").dropDuplicates(["id"]), "texts")
    free_shuffles(source.sparkSession)

    def verify(some: DataFrame) -> DataFrame:
        side = lambda name, out: texts.select(F.col("id").alias(name), F.col("form").alias(out))
        return some.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_close(percent), "a long, b long")

    def cross(outside: DataFrame, inside: DataFrame) -> DataFrame:
        groups = inside.groupBy("id").agg(F.collect_list("grp").alias("grps"))
        data = materialize(groups.join(attrs, "id").join(texts, "id"), "members")
        blocks = lambda df, name: df.join(data.select("id", "size"), "id").groupBy("grp").agg(F.ceil(F.sum("size") / CELL_CHARS).cast("int").alias(name))
        grid = materialize(blocks(outside, "rows").join(blocks(inside, "cols"), "grp"), "grid")
        mix = F.xxhash64("id", F.lit(1))
        cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = outside.join(grid, "grp").withColumns({"row": F.pmod(mix, F.col("rows")).cast("int"), "col": cells("cols"), "out": F.lit(True), "left": F.lit(True)})
        right = inside.join(grid, "grp").withColumns({"row": cells("rows"), "col": F.pmod(mix, F.col("cols")).cast("int"), "left": F.lit(False)})
        members = left.unionByName(right).drop("rows", "cols").join(data, "id")
        return members.groupBy("grp", "row", "col").applyInPandas(_cell(percent, distance, finer), "a long, b long")

    near = materialize(few.withColumn("class", F.lit(None).cast("long")).unionByName(many).join(compared, "id", "left_semi"), "near")
    return link_components(near, verify, cross, near=lambda x, y: _here(x, y, percent) & _near(x, y, percent, distance, finer))


def repeated_lines(source: DataFrame, percent: int = PERCENT, distance: int = DISTANCE, blocks: int = BLOCKS, min_chars: int = MIN_CHARS, finer: bool = False, short: bool = False) -> DataFrame:
    """Of each document of ``source`` (id, text) the lines that stand in a group of several: marks m1 and m2, group g1
    and g2, and ``here``, whether the group's first line is in this document."""
    with scratch_scope() as keep:
        lines = materialize(source.filter("id is not null").mapInArrow(_scan(min_chars, short), "id long, m1 long, m2 long, k int, size int, words int, sim long, sim2 long, keys array<long>"), "lines")
        exact = materialize(lines.groupBy("m1", "m2").agg(F.min("id").alias("at"), F.sum("k").alias("n")), "exact")
        comps = _linked(lines, exact, source, percent, distance, blocks, finer)
        grouped = exact.join(comps.select(F.col("id").alias("m1"), "comp"), "m1", "left").filter("comp is not null or n > 1")
        grouped = materialize(grouped.select("m1", "m2", "at", F.coalesce("comp", "m1").alias("g1"), F.when(F.col("comp").isNull(), F.col("m2")).alias("g2")), "groups")
        first = grouped.groupBy("g1", "g2").agg(F.min("at").alias("first"))
        grouped = materialize(grouped.withColumn("n2", F.coalesce("g2", F.lit(0))).join(first.withColumn("n2", F.coalesce("g2", F.lit(0))).drop("g2"), ["g1", "n2"]).drop("n2", "at"), "groups")
        named = lines.select("id", "m1", "m2").join(grouped, ["m1", "m2"]).distinct()
        drops = keep(materialize(named.groupBy("id").agg(F.collect_list(F.struct("m1", "m2", "g1", "g2", (F.col("id") == F.col("first")).alias("here"))).alias("gone")), "drops"))
    free_shuffles(source.sparkSession)
    return drops


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, distance: int = DISTANCE, blocks: int = BLOCKS, min_chars: int = MIN_CHARS, finer: bool = False, short: bool = False) -> DataFrame:
    """The documents without lines that repeat, exactly or nearly, a line elsewhere; further columns stay as they are.

    A line's normal form has letters A-Z in lower case, digits as 0 and runs of other ASCII signs as one space. Lines
    with shorter forms than ``min_chars`` bytes always stay; with ``short``, of equal ones that are not empty only the
    first stays, and only near lines are not looked for. Two lines are linked if their forms are equal, or if their
    64-bit SimHashes over words differ in at most ``distance`` bits and their edit similarity is at least ``percent``;
    with ``finer`` edit similarity alone counts (lines are within ``FAR`` of 128 bits all the same).
    Of each connected group the first line stays (smallest id, then place in the text).

    Candidates are joined on pigeonhole blocks: hashes within two bits agree wholly in all but two of ``blocks`` blocks,
    so no such pair is missed. As pairs of edit similarity 0.9 mostly differ in more bits, lines that share the least
    hash of their word runs in one of ``BINS`` bins or, up to ``SHORT`` words, all words but one are candidates too; of
    these a small share is missed (see the README). Buckets of up to ``SMALL`` lines are whole, larger
    ones by length classes; all go through :func:`link_components`, which loses no link between lines of a bucket. Its last
    step compares large buckets in cells of two blocks of lines, without a row for each pair.

    One scan writes a narrow row for each line; equal forms are one from there on. Texts are read again only for lines
    with candidates and to take the lines out.

    Returns the input's columns with the new text, then lines_total and lines_dropped (both int). A text that loses
    nothing stays byte for byte; a text may become empty; a null text stays null and has no lines. Documents that repeat
    an id are one document: what stays in one stays in the other. Rows with a null id stay as they are. An empty input
    gives no rows.
    """
    source = only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    drops = repeated_lines(source, percent, distance, blocks, min_chars, finer, short)
    key, gone = "__quill_id", "__quill_gone"
    taken = [c for c in docs.columns if c not in ("lines_total", "lines_dropped")]
    found = drops.select(F.col("id").alias(key), F.col("gone").alias(gone))
    rows = docs.select(*[F.col(f"`{c}`") for c in taken]).withColumn(key, F.col(f"`{id_col}`").cast("long"))
    some, others = parted(rows, found, key)  # only documents that may lose lines are shuffled
    joined = some.join(found, key, "left").unionByName(others.withColumn(gone, F.lit(None).cast(found.schema[gone].dataType)))

    @F.pandas_udf("text string, lines_total int, lines_dropped int")
    def cut(text, gone):
        out = [(None, 0, 0) if t is None else without_lines(t, g) for t, g in zip(text, gone, strict=True)]
        return pd.DataFrame(out, columns=["text", "lines_total", "lines_dropped"])

    cutted = joined.withColumn("__quill_cut", cut(F.col(f"`{text_col}`"), F.col(gone)))
    return cutted.select(*[(F.col("__quill_cut.text").alias(c) if c == text_col else F.col(f"`{c}`")) for c in taken], "__quill_cut.lines_total", "__quill_cut.lines_dropped")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that repeat others, short ones by equal forms; see :func:`line_dedup` for nulls
    and repeated ids."""
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), finer=True, short=True)
