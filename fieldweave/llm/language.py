"""Language identification by interpolated Kneser-Ney character models, one a language.

Texts are lower-cased, everything but letters becomes a blank and runs of blanks one blank. Counts of all 4-grams of
code points of all documents with a known language are made in the tasks and summed by Spark; lower orders follow from
the distinct 4-grams, as Kneser-Ney's continuation counts do. A language's model is kept as sorted arrays of hashed
n-grams with their interpolated probabilities; the arrays of all languages are merged, so one binary search a position
finds the log-probabilities under every language. A text gets the language of the lowest cross-entropy a character.

Rejection is calibrated on rows kept out of the counts: one in `KEPT_OUT` learnable rows, by hash, of languages with
`ENOUGH_ROWS` or more; all rows of the others. A row's excess is its cross-entropy over the median of its language's
calibration rows, over 1 + 20 / size, as short texts scatter more. A text is rejected if its excess is above the
1 - `REJECT_SHARE` quantile of its language's and above `NEVER_DEVIATIONS` robust deviations. So at most about
`REJECT_SHARE` of a language's texts like the known ones are rejected. A language with a single calibration row rejects
nothing. A temperature fitted on a bounded sample of calibration rows (at most `calibration_docs`, each of at most
`CALIBRATION_BYTES` bytes) turns cross-entropies into the score.

Every 4-gram of every language is in the model, which tasks get with the plan: it must fit the driver and each worker.

Edge cases: text that is null or has no letter is `und` with score 0 and rejected; null lang is no training row; without
any training row everything is `und`; repeated rows are labelled alike; an empty table gives an empty result. Other
columns play no part. Letters beyond the basic plane share one code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import Scratch
from fieldweave.llm.textblocks import blocks

ORDER, CALIBRATION_DOCS, CALIBRATION_BYTES = 4, 2000, 1 << 16
#: One in so many learnable rows of a language with enough rows is kept out of its counts for calibration.
KEPT_OUT, ENOUGH_ROWS = 8, 256
#: The share of a language's own rows that may be rejected, and the deviations above the median that never are.
REJECT_SHARE, NEVER_DEVIATIONS = 1e-3, 8.0
#: The code that stands for letters beyond the basic plane (one for private use, so no letter's own).
BEYOND = 0xE000
UNKNOWN = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters; built once in a worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(c).isalpha() for c in range(65536)])
    return _LETTER


def letters_of(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint16; 32 a blank) of a block's texts, each led by one blank, and the offsets of the texts.

    Every text ends in a blank too if a letter comes before; a text without letters has its leading blank alone.
    """
    # A line feed after each text keeps texts apart while the block is lower-cased as one string.
    spread = np.full(len(body) + len(offsets) - 1, 10, np.uint8)
    spread[np.arange(len(body)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))] = body
    ends = offsets[1:] + np.arange(len(offsets) - 1)
    starters = (spread & 0xC0) != 0x80
    place = np.cumsum(starters)
    points = np.frombuffer(spread.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    cut = place[ends]  # code points up to and with each text's closing line feed
    if cut[-1] != len(points):
        raise ValueError("text is not UTF-8")
    beyond = points >= 65536
    table = np.where(_letters(), _lower(), 32).astype(np.uint16)
    shown = table[np.where(beyond, 0, points).astype(np.uint16)]
    if beyond.any():
        found, back = np.unique(points[beyond], return_inverse=True)
        shown[beyond] = np.where([chr(c).isalpha() for c in found.tolist()], BEYOND, 32)[back]
    text_of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], cut])))
    keep = (shown != 32) | np.concatenate([[True], shown[:-1] != 32])  # a run's first blank stays
    keep[np.concatenate([[0], cut[:-1]])] = True
    shown, text_of = shown[keep], text_of[keep]
    # Each text gets a blank in front, as a mark of its start.
    sizes = np.bincount(text_of, minlength=len(ends))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(starts[-1], 32, np.uint16)
    out[np.arange(len(shown)) + text_of + 1] = shown
    return out, starts


_LOWER: np.ndarray | None = None


def _lower() -> np.ndarray:
    global _LOWER
    if _LOWER is None:
        _LOWER = np.array([ord(x) if len(x := chr(c).lower()) == 1 and ord(x) < 65536 else c for c in range(65536)], np.uint16)
    return _LOWER


def packed(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each position, its four code points in 64 bits; before a text's start stand blanks."""
    wide = points.astype(np.uint64)
    code = wide.copy()
    begins = starts[:-1]
    for back in range(1, ORDER):
        older = np.concatenate([np.full(back, 32, np.uint64), wide[:-back]]) if len(wide) > back else np.full(len(wide), 32, np.uint64)
        for k in range(back):
            at = begins + k
            older[at[at < starts[1:]]] = 32
        code |= older << np.uint64(16 * back)
    return code


def hashed(codes: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit n-grams."""
    x = codes * _ODD
    return x ^ (x >> np.uint64(32))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """lang, code (a 4-gram), n over all rows of text and lang: counted per batch and block, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            ids, names = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            for lo, hi, body, offsets in blocks(batch.column(0)):
                points, starts = letters_of(body, offsets)
                codes = packed(points, starts)
                codes[starts[:-1]] = 0  # the blank put in front is no observation
                owner = np.repeat(ids[lo:hi], np.diff(starts))
                for k in np.unique(ids[lo:hi]):
                    found, n = np.unique(codes[owner == k], return_counts=True)
                    found, n = found[found > 0], n[found > 0]
                    yield pa.RecordBatch.from_arrays([pa.array([names[k]] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from 1: (n-grams, their discounted share, contexts, the context's weight of the lower order).

    Codes hold the newest character in the low bits. The highest order uses counts; lower orders use the number of
    distinct characters seen to the left. Order 1 has the empty context.
    """
    levels: list = []
    grams, n = codes, counts.astype(np.float64)
    for order in range(ORDER, 0, -1):
        singles, pairs = float((n == 1).sum()), float((n == 2).sum())
        discount = min(max(singles / (singles + 2 * pairs) if singles + pairs else 0.5, 0.1), 0.95)
        contexts, inverse = np.unique(grams >> np.uint64(16), return_inverse=True)
        total, kinds = np.bincount(inverse, n), np.bincount(inverse)
        levels.append((grams, np.maximum(n - discount, 0) / total[inverse], contexts, discount * kinds / total))
        if order > 1:
            mask = np.uint64((1 << (16 * (order - 1))) - 1)
            grams, left = np.unique(grams & mask, return_counts=True)
            n = left.astype(np.float64)
    return levels[::-1]


def probabilities(levels: list, codes: np.ndarray) -> np.ndarray:
    """Interpolated log-probability of the newest character of each 4-gram. Below order 1 all 65,536 codes are alike."""
    p = np.full(len(codes), 1.0 / 65536)
    for order, (grams, share, contexts, weight) in enumerate(levels, 1):
        gram = codes & np.uint64((1 << (16 * order)) - 1) if order < 4 else codes
        context = gram >> np.uint64(16)
        at, found = _find(grams, gram)
        c_at, c_found = _find(contexts, context)
        p = np.where(c_found, np.where(found, share[at], 0.0) + np.where(c_found, weight[c_at], 1.0) * p, p)
    return np.log(p)


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


@dataclass
class LanguageModel:
    names: list[str]
    levels: list[list]
    keys: np.ndarray  # sorted hashes of all languages' 4-grams
    values: np.ndarray  # log-probabilities, a column a language
    mean: np.ndarray
    bound: np.ndarray
    temperature: float = 20.0

    @classmethod
    def build(cls, names: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
        levels = []
        for codes, counts in tables:
            order = np.argsort(codes)
            levels.append(kneser_ney(codes[order], counts[order]))
        codes = np.unique(np.concatenate([c for c, _ in tables]))
        keys = hashed(codes)
        order = np.argsort(keys)
        values = np.stack([probabilities(x, codes) for x in levels], axis=1).astype(np.float32)[order]
        return cls(names, levels, keys[order], values, np.zeros(len(names)), np.full(len(names), np.inf))

    def cross_entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character of each text under each language, and each text's number of characters (0: no letter)."""
        entropy, size = np.zeros((len(column), len(self.names))), np.zeros(len(column), np.int64)
        for lo, hi, body, offsets in blocks(column):
            points, starts = letters_of(body, offsets)
            codes = packed(points, starts)
            real = np.ones(len(codes), bool)
            real[starts[:-1]] = False
            owner = np.repeat(np.arange(hi - lo), np.diff(starts))[real]
            codes, letters = codes[real], (points != 32)[real]
            at, found = _find(self.keys, hashed(codes))
            logs = self.values[at]
            if not found.all():
                rest, back = np.unique(codes[~found], return_inverse=True)
                logs[~found] = np.stack([probabilities(x, rest) for x in self.levels], axis=1)[back]
            n = np.bincount(owner, minlength=hi - lo)
            for k in range(len(self.names)):
                entropy[lo:hi, k] = -np.bincount(owner, logs[:, k], hi - lo) / np.maximum(n, 1)
            size[lo:hi] = np.where(np.bincount(owner[letters], minlength=hi - lo) > 0, n, 0)
        return entropy, size

    def scores(self, entropy: np.ndarray) -> np.ndarray:
        z = -(entropy - entropy.min(axis=1, keepdims=True)) * self.temperature
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def learnable(parts: int = 3, part: int = 1) -> Column:
    """Rows to learn from: those not held out, that is whose crc32 of doc_id as text doesn't leave `part`."""
    return ~held_out(parts, part) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()


def held_out(parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def kept_out(rows: DataFrame) -> tuple[Column, Column]:
    """Which rows are kept out of the counts, and which calibrate: those, and all of languages without enough rows.

    Collects one name a language.
    """
    large = [r["lang"] for r in rows.where("lang is not null").groupBy("lang").count().where(F.col("count") >= ENOUGH_ROWS).collect()]
    enough = F.coalesce(F.col("lang").isin(large), F.lit(False)) if large else F.lit(False)
    picked = F.pmod(F.xxhash64("doc_id", "text"), F.lit(KEPT_OUT)) == 0
    return enough & picked, ~enough | picked


def train(docs: DataFrame, calibration_docs: int = CALIBRATION_DOCS, chosen: Column | None = None) -> LanguageModel | None:
    """Counts over all learnable rows but those kept out; bounds from the latter; the temperature from a bounded sample of them."""
    rows = docs.where(learnable() if chosen is None else chosen)
    apart, calibrating = kept_out(rows)
    table = count_ngrams(rows.where(~apart)).toArrow()
    if not table.num_rows:
        return None
    langs = table.column("lang").dictionary_encode().combine_chunks()
    owner, found = langs.indices.to_numpy(), langs.dictionary.to_pylist()
    codes, counts = table.column("code").to_numpy().view(np.uint64), table.column("n").to_numpy()
    names = sorted(found)
    model = LanguageModel.build(names, [(codes[owner == k], counts[owner == k]) for k in map(found.index, names)])
    some = rows.where(calibrating & F.col("lang").isNotNull() & F.col("text").isNotNull())
    calibrate(some, model)
    short = some.where(F.octet_length("text") <= CALIBRATION_BYTES).select("doc_id", "text", "lang")
    sample = short.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text", "lang").limit(calibration_docs).toArrow()
    text = pa.concat_arrays(sample.column("text").chunks) if sample.num_rows else pa.array([], pa.string())
    entropy, size = model.cross_entropies(text)
    truth = np.array([names.index(x) if x in names else -1 for x in sample.column("lang").to_pylist()], int)
    entropy, truth = entropy[(size > 0) & (truth >= 0)], truth[(size > 0) & (truth >= 0)]
    if not len(truth):
        return model
    loss = []
    grid = np.array([0.5, 1, 2, 5, 10, 20, 50, 100])
    for t in grid:
        model.temperature = float(t)
        loss.append(-np.log(model.scores(entropy)[np.arange(len(truth)), truth] + 1e-9).mean())
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def own_entropies(rows: DataFrame, model: LanguageModel) -> DataFrame:
    """lang, entropy and size: nats a character under its own language's model, and characters, of every row with a letter."""
    place = {x: k for k, x in enumerate(model.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropy, size = model.cross_entropies(batch.column(0))
            own = np.array([place.get(x, -1) for x in batch.column(1).to_pylist()], int)
            some = np.flatnonzero((size > 0) & (own >= 0))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(some)), pa.array(entropy[some, own[some]]), pa.array(size[some])], ["lang", "entropy", "size"])

    return rows.where("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, entropy double, size long")


def calibrate(rows: DataFrame, model: LanguageModel) -> None:
    """Sets each language's median and its bound on the excess, from all the given rows of it."""
    quantile = lambda c, at: F.percentile_approx(c, at, 10_000)
    own = Scratch(rows.sparkSession).write(own_entropies(rows, model), "entropies")
    medians = own.groupBy(F.col("lang").alias("m_lang")).agg(quantile("entropy", 0.5).alias("median"), F.count("*").alias("n")).where("n > 1")
    apart = own.join(F.broadcast(medians), F.col("lang") == F.col("m_lang")).select("lang", "median", (F.col("entropy") - F.col("median")).alias("over"), "size")
    # Robust: half of the rows set the deviation, so mislabelled or odd rows don't widen it.
    bounds = apart.groupBy("lang").agg(F.first("median").alias("median"), quantile(F.abs("over"), 0.5).alias("apart"), quantile(F.col("over") / (1 + F.lit(20) / F.col("size")), 1 - REJECT_SHARE).alias("most"))
    for row in bounds.collect():
        k = model.names.index(row["lang"])
        model.mean[k], model.bound[k] = row["median"], max(row["most"], NEVER_DEVIATIONS * max(1.4826 * row["apart"], 0.05))


def identify(docs: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, then held_out, lang_pred, score, cross_entropy (nats a character) and rejected of every document."""
    names = list(keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields] + ["held_out boolean", "lang_pred string", "score double", "cross_entropy double", "rejected boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            label, score, best, rejected = np.full(rows, UNKNOWN, object), np.zeros(rows), np.zeros(rows), np.ones(rows, bool)
            if model is not None and rows:
                entropy, size = model.cross_entropies(batch.column(len(names)))
                some = np.flatnonzero(size > 0)
                k = entropy[some].argmin(axis=1)
                label[some] = np.array(model.names, object)[k]
                score[some] = model.scores(entropy[some])[np.arange(len(some)), k]
                best[some] = entropy[some, k]
                rejected[some] = best[some] > model.mean[k] + model.bound[k] * (1 + 20 / size[some])
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(len(names) + 1), pa.array(label, pa.string()), pa.array(score), pa.array(best), pa.array(rejected)], [*names, "held_out", "lang_pred", "score", "cross_entropy", "rejected"])

    return docs.select(*names, F.col("text").alias("_text"), held_out().alias("_held")).mapInArrow(run, schema)
