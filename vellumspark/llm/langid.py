"""Language identification by interpolated Kneser-Ney character models.

One model a language over letters of words, order 4, boundaries included. All counts
come from all learning documents: workers count words, Spark adds them up, and n-grams
are counted from distinct words; discounts, continuation counts and probabilities are
joins and sums of those tables. A model is sorted arrays of 64-bit n-gram hashes with
a row of log probabilities per language; many languages are several models. A text goes to the language of least
cross-entropy per letter. Rejection and the score are calibrated on the learning
documents' own cross-entropies.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

ORDER = 4
#: Distinct words that a counting or scoring worker holds, and bytes of new ones that it
#: gathers; longer words are scored each time.
HELD, HELD_BYTES, LONGEST = 200_000, 16 << 20, 64
#: n-grams times languages of a model that is sent to all tasks (8 bytes each, about).
CELLS = 16_000_000
#: Of learning documents, the share whose best cross-entropy is above the rejection bound.
REJECTED = 0.001
SHARPNESS = (4.0, 8.0, 16.0, 32.0, 64.0, 128.0)

LETTERS = re.compile(r"[^\W\d_]+")
REST = re.compile(rb"\S*")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def pieces(chunk: str) -> list[str]:
    """Lower-case runs of letters."""
    runs = LETTERS.findall(chunk.lower())
    if not all(map(str.isalpha, runs)):  # signs like ½ count as word characters
        runs = "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()
    return runs


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text mod 4 is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, word, n) over whole texts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows: Counter = Counter()
            for lang, chunks in seen.items():
                for chunk, n in chunks.items():
                    for word in pieces(chunk.decode("utf-8", "replace")):
                        rows[lang, word] += n
            seen.clear()
            return pa.record_batch([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], names=["lang", "word", "n"])

        held = 0
        for b in it:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), strict=True):
                data = text.as_py()
                for at in range(0, len(data), 8 << 20):
                    seen[lang].update(_cut(data, at, 8 << 20) if len(data) > 8 << 20 else data.split())
                    held += min(len(data), 8 << 20)
                    if held > HELD_BYTES and sum(len(w) for by in seen.values() for w in by) > HELD_BYTES // 4 or sum(map(len, seen.values())) > HELD:
                        yield out()
                        held = 0
        yield out()

    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).where("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _cut(data: bytes, at: int, size: int) -> list[bytes]:
    """Words that start in data[at:at + size]."""
    start = at if at == 0 or data[at - 1 : at].isspace() else REST.match(data, at).end()
    end = min(len(data), at + size)
    end = end if data[end - 1 : end].isspace() else REST.match(data, end).end()
    return data[start:end].split()


def gram_counts(words: DataFrame) -> DataFrame:
    """(lang, word, n) -> (lang, gram, n), ORDER characters, from padded words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                padded = " " * (ORDER - 1) + word + " "
                for i in range(len(word) + 1):
                    rows[lang, padded[i : i + ORDER]] += n
            yield pa.record_batch([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), pa.array(list(rows.values()), pa.int64())], names=["lang", "gram", "n"])

    return words.select("lang", "word", "n").mapInArrow(batches, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` codes, by their last position."""
    n = len(codes) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(size):
        out = (out + codes[k : k + n].astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


@dataclass
class Model:
    """``grams[k]``: sorted hashes of (k + 1)-grams and bits per language; ``backoff[k]``:
    of contexts of k + 1 characters, bits of the back-off weight; ``unknown``: bits of a
    character that no language has."""

    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    backoff: list[tuple[np.ndarray, np.ndarray]]
    unknown: np.ndarray

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Bits per language of each code from position ORDER - 1 on."""
        n, order = len(codes) - ORDER + 1, ORDER
        out = np.zeros((n, len(self.langs)))
        todo = np.arange(n)
        for size in range(order, 0, -1):
            keys = hashes(codes[order - size :], size)[todo]
            table, rows = self.grams[size - 1]
            at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
            found = table[at] == keys if len(table) else np.zeros(len(keys), bool)
            out[todo[found]] += rows[at[found]]
            todo = todo[~found]
            if not len(todo):
                return out
            if size > 1:
                keys = hashes(codes[order - size : len(codes) - 1], size - 1)[todo]
                table, rows = self.backoff[size - 2]
                at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
                found = table[at] == keys if len(table) else np.zeros(len(keys), bool)
                out[todo[found]] += rows[at[found]]
        out[todo] += self.unknown
        return out

    def words(self, chunks: list[bytes]) -> np.ndarray:
        """A row for each chunk: bits per language, then characters."""
        texts, counts = [], []
        for chunk in chunks:
            own = pieces(chunk.decode("utf-8", "replace"))
            texts += own
            counts.append(len(own))
        result = np.zeros((len(chunks), len(self.langs) + 1))
        if not texts:
            return result
        pad = " " * (ORDER - 1)
        codes = _codes("".join(pad + t + " " for t in texts))
        lengths = np.array([len(t) for t in texts])
        ends = np.cumsum(lengths + ORDER)
        inside = np.ones(len(codes) - ORDER + 1, bool)
        starts = np.concatenate([[0], ends[:-1]])
        every = self.bits(codes)
        for k in range(1, ORDER):  # windows that reach into the next word
            inside[ends[:-1] - k] = False
        every[~inside] = 0
        by_word = np.add.reduceat(every, starts, axis=0)
        owner = np.repeat(np.arange(len(chunks)), counts)
        np.add.at(result[:, :-1], owner, by_word)
        np.add.at(result[:, -1], owner, lengths + 1)
        return result


def probabilities(grams: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """(lang, gram, n) of the highest order -> (lang, size, gram, p), every n-gram's
    interpolated Kneser-Ney probability; (lang, size, context, w), weights of backing off
    from contexts of ``size`` characters (0: from none); and that of a character of none.

    Discounts, totals and continuation counts are those of the whole tables.
    """
    counts = {ORDER: grams.select("lang", "gram", "n")}
    for size in range(ORDER - 1, 0, -1):
        counts[size] = kept(counts[size + 1].groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n")), "counts")
    uniform = 1 / (counts[1].select("gram").distinct().count() + 1)
    lower, found, weights = None, [], []
    for size in range(1, ORDER + 1):
        now = counts[size].withColumn("context", F.substring("gram", 1, size - 1))
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        discount = now.groupBy("lang").agg(F.when(ones + twos > 0, F.least(F.lit(0.9), F.greatest(F.lit(0.1), ones / (ones + 2 * twos)))).otherwise(0.5).alias("d"))
        same = now.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
        weight = kept(same.join(discount, "lang").select("lang", "context", "total", "d", (F.col("d") * F.col("types") / F.col("total")).alias("w")), "weights")
        weights.append(weight.select("lang", F.lit(size - 1).alias("size"), "context", "w"))
        rows = now.join(weight, ["lang", "context"])
        own = (F.col("n") - F.col("d")) / F.col("total")
        if lower is None:
            rows = rows.select("lang", "gram", (own + F.col("w") * uniform).alias("p"))
        else:
            below = lower.select("lang", F.col("gram").alias("_rest"), F.col("p").alias("_p"))
            rows = rows.withColumn("_rest", F.substring("gram", 2, size)).join(below, ["lang", "_rest"]).select("lang", "gram", (own + F.col("w") * F.col("_p")).alias("p"))
        lower = kept(rows, "probabilities")
        found.append(lower.select("lang", F.lit(size).alias("size"), "gram", "p"))
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return union(found), union(weights), uniform


def _runs(texts: list[str], size: int) -> np.ndarray:
    """Codes of texts of ``size`` characters, a row each."""
    return _codes("".join(texts)).reshape(len(texts), size)


def _hashed(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        out = (out + codes[:, k].astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def _rows(texts: list[str], langs: np.ndarray, values: np.ndarray, size: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct texts, their codes, and values by language, NaN
    where a language has none."""
    codes = _runs(texts, size)
    keys, first, at = np.unique(_hashed(codes), return_index=True, return_inverse=True)
    out = np.full((len(keys), width), np.nan)
    out[at, langs] = values
    return keys, codes[first], out


def assembled(langs: list[str], grams: DataFrame, weights: DataFrame, uniform: float) -> Model:
    """The model of some languages from probabilities(); n-grams that a language lacks
    but another has get what backing off gives them."""
    number, width = {x: i for i, x in enumerate(langs)}, len(langs)

    def read(df: DataFrame, size: int, text: str, value: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        got = df.where((F.col("size") == size) & F.col("lang").isin(langs)).select("lang", text, value).toArrow()
        return got.column(1).to_pylist(), np.array([number[x] for x in got.column(0).to_pylist()], np.int64), -np.log2(got.column(2).to_numpy())

    _, which, empty = read(weights, 0, "context", "w")
    unknown = np.zeros(width)
    unknown[which] = empty
    unknown -= np.log2(uniform)
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    backoff: list[tuple[np.ndarray, np.ndarray]] = []
    for size in range(1, ORDER + 1):
        keys, codes, bits = _rows(*read(grams, size, "gram", "p"), size, width)
        if size == 1:
            rest = np.broadcast_to(unknown, bits.shape)
        else:
            at, _, own = _rows(*read(weights, size - 1, "context", "w"), size - 1, width)
            backoff.append((at, np.nan_to_num(own)))
            below, rows = tables[-1]
            rest = backoff[-1][1][np.searchsorted(at, _hashed(codes[:, :-1]))] + rows[np.searchsorted(below, _hashed(codes[:, 1:]))]
        tables.append((keys, np.where(np.isnan(bits), rest, bits)))
    return Model(langs, tables, backoff, unknown)


def slices(sizes: dict[str, int], most: int) -> list[list[str]]:
    """Languages by name, dealt so that a slice's n-grams times languages are at most
    ``most``; a language over it is a slice of its own."""
    out: list[list[str]] = []
    held = 0
    for lang in sorted(sizes):
        if out and (held + sizes[lang]) * (len(out[-1]) + 1) <= most:
            out[-1].append(lang)
            held += sizes[lang]
        else:
            out.append([lang])
            held = sizes[lang]
    return out


class Scorer(dict):
    """Word -> row of sums; a worker's memory of scored words, bounded by HELD."""

    def __init__(self, model: Model):
        self.model, self.rows, self.used = model, np.zeros((1024, len(model.langs) + 1)), 0

    def learn(self, chunks: set[bytes]) -> None:
        fresh = [c for c in chunks if c not in self]  # of LONGEST bytes at most
        if len(self) + len(fresh) > HELD and len(self):
            self.clear()
            self.used, fresh = 0, list(chunks)
        for at in range(0, len(fresh), 20_000):
            part = fresh[at : at + 20_000]
            new = self.model.words(part)
            while self.used + len(part) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(part)] = new
            self.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def score(self, text: bytes | None) -> np.ndarray:
        """Bits per language and characters of a whole text."""
        total = np.zeros(len(self.model.langs) + 1)
        for at in range(0, len(text or b""), 8 << 20):
            words = _cut(text, at, 8 << 20) if len(text) > 8 << 20 else text.split()
            kinds = set(words)
            if max(map(len, kinds), default=0) > LONGEST:
                for word in words:
                    if len(word) > LONGEST:
                        total += self.model.words([word])[0]
                words = [w for w in words if len(w) <= LONGEST]
                kinds = set(words)
            self.learn(kinds)
            if words:
                total += self.rows[np.fromiter(map(self.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return total


def train(docs: DataFrame, most: int = CELLS) -> list[Model]:
    """Models of every non-null lang of ``docs``, from all its rows and n-grams; several
    languages a model, a model of ``most`` n-grams times languages at most."""
    grams = kept(gram_counts(word_counts(docs)), "grams")
    sizes = {r.lang: r.n for r in grams.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return []
    found, weights, uniform = probabilities(grams)
    return [assembled(langs, found, weights, uniform) for langs in slices(sizes, most)]


def entropies(docs: DataFrame, models: list[Model]) -> DataFrame:
    """(doc_id, held_out, lang, pred, best, second, chars): cross-entropies in bits per
    character of the best two languages; pred is null without letters. Texts pass every
    model once, and are stored between two models."""
    ask = "doc_id long, held_out boolean, lang string, pred string, best double, second double, chars long"
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("lang").cast("string"), F.lit(None).cast("string").alias("pred"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("second"), F.lit(0).cast("long").alias("chars"), F.col("text").cast("string"))
    for k, model in enumerate(models):
        last = k == len(models) - 1
        rows = rows.mapInArrow(_passing(docs.sparkSession.sparkContext.broadcast(model), last), ask + ("" if last else ", text string"))
        rows = rows if last else kept(rows, "texts")
    return rows


def _passing(shared: Broadcast, last: bool):
    names = ["doc_id", "held_out", "lang", "pred", "best", "second", "chars", "text"][: 7 if last else 8]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in it:
            rows = []
            earlier = zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
            for text, (pred, best, second) in zip(b.column(7).cast(pa.large_binary()), earlier, strict=True):
                sums = scorer.score(text.as_py())
                n = int(sums[-1])
                if n:
                    h = sums[:-1] / n
                    k = int(np.argmin(h))
                    values = sorted([*h.tolist(), *(x for x in (best, second) if x is not None)])
                    if best is None or h[k] < best:
                        pred, best = scorer.model.langs[k], float(h[k])
                    second = values[1] if len(values) > 1 else None
                rows.append((pred, best, second, n))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.record_batch([*b.columns[:3], *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), *([] if last else [b.column(7)])], names=names)

    return batches


def _confidence(sharpness: float) -> Column:
    """How surely the best of two languages is right, from their gap and the length."""
    gap = (F.coalesce("second", F.col("best") + 1) - F.col("best")) * F.sqrt(F.least("chars", F.lit(400)) / F.lit(400.0))
    return 1 / (1 + F.exp(-F.lit(sharpness) * gap))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of ``docs``.

    Learns from rows that are not held out and have a lang; predicts from text alone.
    lang_pred is 'und' with score 0 if the text is null or has no letter, or nothing
    could be learned; ties go to the first language by name. ``rejected`` marks texts
    less like their best language than all but REJECTED of the learning texts; their score
    is halved. Rows with a null doc_id are not held out; repeated rows count each; other
    columns are not read.
    """
    models = train(docs.where(~held_out(F.col("doc_id"))))
    if not models:
        return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"))
    found = kept(entropies(docs, models), "entropies")
    learned = found.where("NOT held_out AND lang IS NOT NULL AND pred IS NOT NULL")
    right = F.col("lang") == F.col("pred")
    loss = [F.sum(-F.log(F.greatest(F.when(right, _confidence(s)).otherwise(1 - _confidence(s)), F.lit(1e-9)))).alias(f"l{i}") for i, s in enumerate(SHARPNESS)]
    row = learned.agg(*loss, F.percentile_approx(F.when(right, F.col("best")), 1 - REJECTED, 10_000).alias("bound")).first()
    losses = [row[i] if row[i] is not None else 0.0 for i in range(len(SHARPNESS))]
    sharp, bound = SHARPNESS[losses.index(min(losses))], row["bound"]
    over = F.coalesce(F.col("best") > F.lit(bound), F.lit(False)) if bound is not None else F.lit(False)
    score = F.when(F.col("pred").isNull(), 0.0).otherwise(_confidence(sharp) * F.when(over, 0.5).otherwise(1.0))
    return found.select("doc_id", "held_out", F.coalesce("pred", F.lit("und")).alias("lang_pred"), score.alias("score"), over.alias("rejected"))
