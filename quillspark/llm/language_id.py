"""Language identification by unigram piece models, summed over all segmentations of a word."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WordCodes, only
from .packing import vocabulary
from .toxicity import held_out

VOCABULARY = "piece_bpe_32k.model"
#: The vocabulary's longest piece of letters, in characters, the mark of a word's start included.
LONGEST = 16
#: Most documents to fit on for each language, in order of a hash of the id, and most characters of all.
SAMPLE, SAMPLE_CHARS = 300, 8_000_000
ROUNDS, SMOOTH, SEED = 3, 0.1, 11
CACHED_WORDS = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall((text or "").lower())


def pieces_of(path: str, longest: int = LONGEST) -> dict[str, int]:
    """Pieces of letters, lower-cased, with a number each; number 0 stands for any single character of none."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i).lower()
        if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i) and len(p) <= longest and (p.lstrip("▁").isalpha() or p == "▁"):
            out.setdefault(p, len(out) + 1)
    return out


def lattice(words: list[str], pieces: dict[str, int], longest: int = LONGEST) -> np.ndarray:
    """Piece numbers of the substrings of words of one length: [word, end, piece length - 1], -1 for none."""
    n = len(words[0]) + 1
    out = np.full((len(words), n, min(longest, n)), -1, np.int32)
    get = pieces.get
    for k, w in enumerate(words):
        s = "▁" + w
        row = out[k]
        for j in range(n):
            for i in range(j, min(n, j + longest)):
                if (p := get(s[j : i + 1])) is not None:
                    row[i, i - j] = p
    single = out[:, :, 0]
    single[single < 0] = 0
    return out


def forward(ids: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of each word in each language, all segmentations summed; scaled alphas and the logs of scales.

    ``p`` is [piece, language]; its last row is 0, for substrings that are no piece.
    """
    count, n, width = ids.shape
    alpha = np.zeros((n + 1, count, p.shape[1]))
    logs = np.zeros((n + 1, count, p.shape[1]))
    alpha[0] = 1
    for i in range(n):
        total = np.zeros(alpha.shape[1:])
        for k in range(min(width, i + 1)):
            at = np.flatnonzero(ids[:, i, k] >= 0)
            # alphas are scaled each; bring the earlier one to the scale of the latest
            if len(at):
                total[at] += alpha[i - k, at] * np.exp(logs[i - k, at] - logs[i, at]) * p[ids[at, i, k]]
        alpha[i + 1], logs[i + 1] = 1.0, logs[i] + np.log(np.maximum(total, 1e-300))
    return logs[n], alpha, logs


def expected(ids: np.ndarray, p: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Expected count of each piece over words with these weights, in one language."""
    count, n, width = ids.shape
    last, _, fwd = forward(ids, p)
    back = np.full((n + 1, count), -np.inf)
    back[n] = 0
    out = np.zeros(size + 1)
    logp = np.log(np.maximum(p[:, 0], 1e-300))
    for i in range(n, 0, -1):
        for k in range(min(width, i)):
            j, t = i - 1 - k, ids[:, i - 1, k]
            term = np.where(t >= 0, logp[t] + back[i], -np.inf)
            back[j] = np.logaddexp(back[j], term)
            post = np.exp(fwd[j, :, 0] + term - last[:, 0]) * weight
            np.add.at(out, np.where(t >= 0, t, size), post)
    return out[:size]


class Model:
    """Piece probabilities [piece + 1, language] (last row 0), languages and their log shares."""

    def __init__(self, pieces: dict[str, int], langs: list[str]) -> None:
        self.pieces, self.langs = pieces, langs
        self.p = np.zeros((len(pieces) + 2, len(langs)))
        self.prior = np.zeros(len(langs))

    def word_logs(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        by = defaultdict(list)
        for k, w in enumerate(words):
            by[len(w)].append(k)
        for n, at in by.items():
            step = max(1, 400_000 // ((n + 2) * LONGEST * max(1, len(self.langs))))
            for i in range(0, len(at), step):
                part = at[i : i + step]
                out[part] = forward(lattice([words[k] for k in part], self.pieces), self.p)[0]
        return out


def fit(texts: list[tuple[str, str | None]], pieces: dict[str, int], rounds: int = ROUNDS) -> Model:
    """EM on the words of (language, text) rows, each language alone."""
    counts: dict[str, Counter] = defaultdict(Counter)
    docs = Counter(lang for lang, _ in texts)
    for lang, text in texts:
        counts[lang].update(words_of(text))
    model = Model(pieces, sorted(docs))
    size = len(pieces) + 1
    for k, lang in enumerate(model.langs):
        by = defaultdict(list)
        for w in sorted(counts[lang]):
            by[len(w)].append(w)
        groups = []
        for n, ws in by.items():
            step = max(1, 2_000_000 // ((n + 1) * LONGEST))
            for i in range(0, len(ws), step):
                part = ws[i : i + step]
                groups.append((lattice(part, pieces), np.array([counts[lang][w] for w in part], float)))
        p = np.append(np.full(size, 1 / size), 0)[:, None]
        for _ in range(rounds):
            got = np.full(size, SMOOTH)
            for ids, weight in groups:
                got += expected(ids, p, weight, size)
            p = np.append(got / got.sum(), 0)[:, None]
        model.p[:, k] = p[:, 0]
        model.prior[k] = np.log(docs[lang] / len(texts))
    return model


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        codes, logs, real = WordCodes(), np.zeros((0, len(model.langs))), np.zeros(0, bool)
        for batch in batches:
            if len(codes) > CACHED_WORDS:
                codes, logs, real = WordCodes(), np.zeros((0, len(model.langs))), np.zeros(0, bool)
            coded = []
            for t in batch.column(1).to_pylist():
                w = words_of(t)
                coded.append(np.fromiter(map(codes.__getitem__, w), np.int64, len(w)))
            if model.langs:
                logs = np.vstack([logs, model.word_logs(codes.new)])
            # fractions and the like are word signs to re, but no letters
            real = np.concatenate([real, np.fromiter((any(map(str.isalpha, w)) for w in codes.new), bool, len(codes.new))])
            codes.new = []
            best, score = [], []
            for c in coded:
                c = c[real[c]]
                if not len(c) or not model.langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                total = logs[c].sum(axis=0) + model.prior
                k = int(total.argmax())
                best.append(model.langs[k])
                score.append(float(1 / np.exp(total - total[k]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def train(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on the learning folds: for each language at most ``sample`` documents in order of a hash of the id, whole
    texts, at most ``chars`` characters in all. Rows with a null id, text or language are left out; of several rows with
    an id and a language one counts."""
    rows = only(docs, id=id_col, text=text_col, lang=lang_col).filter("id is not null and text is not null and lang is not null").filter(~held_out("id"))
    narrow = rows.groupBy("id", "lang").agg(F.max(F.length("text")).alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(SEED)), "id"))
    ranked = [(r["place"] - 1, r) for r in narrow.withColumn("place", place).filter(F.col("place") <= sample).collect()]
    # the first document of each language comes before all others, so that the bound on characters shuts out no language
    ranked.sort(key=lambda x: (x[0] > 0, xxhash.xxh64_intdigest(str(x[1]["id"]))))
    picked = [r for _, r in ranked]
    ids, total = [], 0
    for r in picked:
        if total + r["n"] <= chars:
            total += r["n"]
            ids.append((r["id"], r["lang"]))
    few = docs.sparkSession.createDataFrame(ids, f"id {dict(rows.dtypes)['id']}, lang string")
    got = rows.join(F.broadcast(few), ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("id", "lang").collect() if ids else []
    return fit([(r["lang"], r["text"]) for r in got], pieces_of(path))


def language_id(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The likeliest language of every whole text.

    A text is its runs of letters, lower-cased. A word's chance in a language is the sum over all ways to cut it (with a
    mark at its start) into pieces of a fixed public vocabulary, of the product of their chances; a forward pass sums
    them. A character of no piece counts as one common unknown piece. Each distinct word is scored once in a task.

    Returns id, held_out, lang_pred and score (posterior of the predicted language); one row for each input row. Texts
    that are null or have no letter get ``und`` and 0; so does every text if no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = only(docs, id=id_col, text=text_col).withColumn("held_out", F.coalesce(held_out("id"), F.lit(False)))
    out = rows.mapInArrow(_predict(shared), f"id {dict(rows.dtypes)['id']}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents, learned outside the held-out fold; null texts and texts without letters
    are ``und``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return language_id(docs, train(docs, vocabulary(VOCABULARY)))
