"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad from features of its bytes and of the lines before and after it. Two states and a
transition table make the chain; forward-backward gives each line's marginal of being good, and their mean, weighted by
line length, passes a fitted logistic curve to become the document's score.

Labels are of documents. Training starts with each line bearing its document's label; then, in documents labelled bad,
lines that the model takes for good keep that label (the worst line of each stays bad) and the chain is fitted again.
The labelled sample is bounded: at most `train_docs` documents, picked by hash, each of at most `TRAIN_BYTES` bytes, and
of these, from the one of fewest lines on, as many as have `TRAIN_LINES` lines together.

Texts over `BLOCK_BYTES` are read in pieces; beside the text they take some tens of bytes a line, not the features of all lines.

Edge cases: null and empty texts are one empty line and get a score; repeated rows are scored alike; without labelled
rows of both kinds every score is 1; an empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.textblocks import BLOCK_BYTES, blocks, segment_sums

TRAIN_DOCS, TRAIN_BYTES, TRAIN_LINES, ROUNDS, PENALTY = 4000, 1 << 16, 500_000, 120, 1e-3
THRESHOLD = 0.7
#: Chains of more lines are scanned in runs.
LONG_CHAIN = 512


def _classes() -> np.ndarray:
    """Bit sets of byte classes."""
    table = np.zeros(256, np.uint16)
    for bit, members in enumerate(
        (
            [*range(65, 91), *range(97, 123), *range(128, 256)],  # letters, and all of UTF-8 beyond ASCII
            range(65, 91),
            range(48, 58),
            b"#*$%&|<>",
            b"!?",
            b" \t\x0b\x0c\r",
            b".,;:",
            b"\"'()[]{}/\\_=+-~^`@",
            b"aeiouAEIOU",
        )
    ):
        table[list(members)] |= 1 << bit
    return table


CLASSES, N_CLASSES = _classes(), 9
BLANK, LOUD = 1 << 5, (1 << 3) | (1 << 4)
FEED = 10
#: A line's own features, and which of them says that it equals an earlier one.
OWN, AGAIN = N_CLASSES + 8, N_CLASSES + 6
HASH_STEP = 0x9E3779B97F4A7C15


def _line_counts(body: np.ndarray, before: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Per line: bytes of each class, words, bytes equal to the one before, loud bytes. They add up over the parts of a line.

    `before` holds the byte before each one, a line feed where a document starts.
    """
    kinds = CLASSES[body]
    inked = (kinds & BLANK) == 0
    begins = inked & (((CLASSES[before] & BLANK) != 0) | (before == FEED))
    columns = [*((kinds >> bit) & 1 for bit in range(N_CLASSES)), begins, inked & (body == before), (kinds & LOUD) != 0]
    return np.stack([segment_sums(c, starts, stops) for c in columns], axis=1)


def _tails(body: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The last byte of each line; 0 for empty ones."""
    return np.where(stops > starts, body[np.maximum(stops - 1, 0)], 0) if len(body) else np.zeros(len(starts), np.uint8)


def _own_features(counts: np.ndarray, size: np.ndarray, tail: np.ndarray, again: np.ndarray) -> np.ndarray:
    n, words = size.astype(np.float64), counts[:, N_CLASSES]
    safe, spoken = np.maximum(n, 1.0), np.maximum(words, 1)
    return np.column_stack(
        [
            counts[:, :N_CLASSES] / safe[:, None],
            np.log1p(n) / 5.0,
            np.log1p(words) / 4.0,
            np.minimum(n / spoken, 30) / 10.0,
            counts[:, N_CLASSES + 1] / safe,
            np.isin(tail, list(b".!?:\"")),
            n == 0,
            again,
            counts[:, N_CLASSES + 2] / spoken,
        ]
    ).astype(np.float64)


def _repeats(rolled: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Lines, not empty, that equal an earlier one of their document, by hash."""
    by = np.lexsort((np.arange(len(rolled)), rolled, owner))
    again = np.zeros(len(rolled), bool)
    again[by[1:]] = (owner[by][1:] == owner[by][:-1]) & (rolled[by][1:] == rolled[by][:-1]) & (size[by][1:] > 0)
    return again


def line_features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of a block of documents, the lines' lengths, and the first line of each document (and the end).

    A document has one line more than line feeds. A line's own features are followed by those of its neighbours.
    Nothing depends on the other documents of the block.
    """
    feeds = np.flatnonzero(body == FEED)
    docs = len(offsets) - 1
    cuts = np.concatenate([feeds + 1, offsets[:-1]])
    owner = np.concatenate([np.searchsorted(offsets, feeds, "right") - 1, np.arange(docs)])
    order = np.lexsort((cuts, owner))
    starts, owner = cuts[order], owner[order]
    last = np.concatenate([owner[1:] != owner[:-1], [True]])
    stops = np.empty_like(starts)
    stops[~last] = starts[1:][~last[:-1]] - 1
    stops[last] = offsets[1:]
    first = np.searchsorted(owner, np.arange(docs + 1))
    before = np.concatenate([[FEED], body[:-1]]).astype(np.uint8)[: len(body)]
    before[offsets[:-1][offsets[:-1] < len(body)]] = FEED
    size = stops - starts
    again = _repeats(_line_hashes(body, starts, stops), size, owner)
    own = _own_features(_line_counts(body, before, starts, stops), size, _tails(body, starts, stops), again)
    ahead, behind = np.zeros_like(own), np.zeros_like(own)
    inside = np.concatenate([[False], owner[1:] == owner[:-1]])[: len(owner)]
    ahead[inside] = own[np.flatnonzero(inside) - 1]
    follows = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    behind[follows] = own[np.flatnonzero(follows) + 1]
    edges = np.column_stack([~inside, ~follows]).astype(np.float64)
    return np.column_stack([own, ahead, behind, edges]), size + 1.0, first


def _line_hashes(body: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each line, from one running sum: byte k of a line weighs HASH_STEP to the power k."""
    powers = lambda step: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(body), step, np.uint64))])
    with np.errstate(over="ignore"):
        mixed = (body.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers(HASH_STEP)[:-1], dtype=np.uint64)])
        return (run[stops] - run[starts]) * powers(pow(HASH_STEP, -1, 1 << 64))[starts]


@dataclass
class Chain:
    """Weights of a two-state chain. State 1 is good; its score over state 0 is `weights` times the features."""

    weights: np.ndarray
    moves: np.ndarray  # 2 x 2, log potentials of successive states
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 8.0
    offset: float = -4.0

    def odds(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


def long_odds(body: np.ndarray, chain: Chain, most: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Odds and lengths of the lines of one document of any length, read in pieces of `most` bytes.

    A line may run over many pieces: its counts and hash are carried on. The odds are linear in the features, so a line
    leaves three numbers (what it adds to itself and to either neighbour), its length and its hash, never its features.
    """
    w = chain.weights[:-1] / chain.scale
    sides = w[: 3 * OWN].reshape(3, OWN).T
    added, sizes, hashes = [], [], []

    def close(counts: np.ndarray, size: np.ndarray, tail: np.ndarray, rolled: np.ndarray) -> None:
        added.append(_own_features(counts, size, tail, np.zeros(len(size))) @ sides)
        sizes.append(size)
        hashes.append(rolled)

    held, previous = (np.zeros((1, N_CLASSES + 3), np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint8), np.zeros(1, np.uint64)), FEED
    for lo in range(0, len(body), most):
        piece = body[lo : lo + most]
        stops = np.append(np.flatnonzero(piece == FEED), len(piece))
        starts = np.append(0, stops[:-1] + 1)
        counts = _line_counts(piece, np.append(np.uint8(previous), piece[:-1]), starts, stops)
        size, tail, rolled = stops - starts, _tails(piece, starts, stops), _line_hashes(piece, starts, stops)
        tail[0] = tail[0] if size[0] else held[2][0]
        rolled[0] = (int(held[3][0]) + pow(HASH_STEP, int(held[1][0]), 1 << 64) * int(rolled[0])) % (1 << 64)
        counts[0] += held[0][0]
        size[0] += held[1][0]
        close(counts[:-1], size[:-1], tail[:-1], rolled[:-1])
        held, previous = (counts[-1:], size[-1:], tail[-1:], rolled[-1:]), piece[-1]
    close(*held)
    parts, size, rolled = np.concatenate(added), np.concatenate(sizes), np.concatenate(hashes)
    parts[_repeats(rolled, size, np.zeros(len(size), np.int8))] += sides[AGAIN]
    odds = parts[:, 0] + (chain.weights[-1] - chain.mean @ w)
    odds[1:] += parts[:-1, 1]
    odds[:-1] += parts[1:, 2]
    odds[0] += w[-2]
    odds[-1] += w[-1]
    return odds, size + 1.0


def _scan(odds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward messages of one long chain, as log odds of state 1, in about the square root of its length steps.

    The chain is cut into equal runs. All runs at once find where each state before them leads, the runs are passed one after
    the other, and all runs at once fill in their lines.
    """
    steps = int(np.ceil(np.sqrt(len(odds))))
    runs = -(-len(odds) // steps)
    grid = np.concatenate([odds, np.zeros(runs * steps - len(odds))]).reshape(runs, steps).T
    emit = np.stack([np.zeros_like(grid), grid], axis=-1)[:, :, None, :]  # step, run, state before the run, state
    leads = moves[None] + emit[0]
    leads[0] = emit[0, 0]  # nothing moves into the first line
    for t in range(1, steps):
        leads = emit[t] + np.logaddexp(leads[..., :1] + moves[0], leads[..., 1:] + moves[1])
    entry, at = np.zeros((runs, 2)), np.zeros(2)
    for k in range(runs):
        entry[k] = at
        at = leads[k, 0] if k == 0 else np.logaddexp(at[0] + leads[k, 0], at[1] + leads[k, 1])
        at = at - at.max()
    out = np.empty_like(grid)
    x = grid[0] + np.logaddexp(entry[:, 0] + moves[0, 1], entry[:, 1] + moves[1, 1]) - np.logaddexp(entry[:, 0] + moves[0, 0], entry[:, 1] + moves[1, 0])
    x[0] = grid[0, 0]
    for t in range(steps):
        x = x if t == 0 else _step(x, grid[t], moves)
        out[t] = x
    return out.T.ravel()[: len(odds)]


def _step(x: np.ndarray, odds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    return odds + np.logaddexp(moves[0, 1], x + moves[1, 1]) - np.logaddexp(moves[0, 0], x + moves[1, 0])


def messages(odds: np.ndarray, first: np.ndarray, moves: np.ndarray, long_chain: int = LONG_CHAIN) -> np.ndarray:
    """Forward messages, as log odds of state 1, of every line of every chain.

    Chains of up to `long_chain` lines go side by side, longest first, so the ones that still go on at a step are a prefix;
    longer ones are scanned each by itself.
    """
    out, length = np.empty_like(odds), np.diff(first)
    for k in np.flatnonzero(length > long_chain):
        out[first[k] : first[k + 1]] = _scan(odds[first[k] : first[k + 1]], moves)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] <= long_chain]
    begin, size = first[:-1][order], length[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    for t in range(steps):
        at = begin[: live[t]] + t
        out[at] = odds[at] if t == 0 else _step(out[at - 1], odds[at], moves)
    return out


def marginals(odds: np.ndarray, first: np.ndarray, moves: np.ndarray, long_chain: int = LONG_CHAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1 of every line, with the messages that reach it from the front and from the back, its own odds in both."""
    ahead = messages(odds, first, moves, long_chain)
    back = messages(odds[::-1], len(odds) - first[::-1], moves.T, long_chain)[::-1]
    return 1.0 / (1.0 + np.exp(-np.clip(ahead + back - odds, -60, 60))), ahead, back


def forward_backward(odds: np.ndarray, first: np.ndarray, moves: np.ndarray, long_chain: int = LONG_CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 of every line, and the expected number of moves of each kind, over all chains."""
    marginal, ahead, back = marginals(odds, first, moves, long_chain)
    inner = np.ones(len(odds), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    left = np.flatnonzero(inner)
    ways = [moves[a, b] + a * ahead[left] + b * back[left + 1] for a in range(2) for b in range(2)]
    total = np.logaddexp.reduce(ways, axis=0)
    return marginal, np.array([np.exp(x - total).sum() for x in ways]).reshape(2, 2)


def fit_chain(features: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> Chain:
    """Maximum likelihood by Adam over all lines of the bounded sample; `labels` has one 0 or 1 a line."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = np.column_stack([(features - mean) / scale, np.ones(len(features))])
    theta, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    inner = np.ones(len(labels), bool)
    inner[first[1:] - 1] = False
    left = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[left], labels[left + 1]), 1.0)
    for k in range(1, rounds + 1):
        moves = theta[-4:].reshape(2, 2)
        marginal, expected = forward_backward(x @ theta[:-4], first, moves)
        slope = np.concatenate([x.T @ (labels - marginal), (seen - expected).ravel()]) / len(labels) - penalty * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Chain(theta[:-4].copy(), theta[-4:].reshape(2, 2).copy(), mean, scale)


def document_means(marginal: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    return segment_sums(marginal * length, first[:-1], first[1:]) / segment_sums(length, first[:-1], first[1:])


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic curve, by Newton steps with a small ridge; classes weigh the same."""
    w = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    design, beta = np.column_stack([x, np.ones_like(x)]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (w * (y - p)) - 1e-3 * beta
        bend = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(max(beta[0], 1e-3)), float(beta[1])


def train(sample: pa.Table) -> Chain | None:
    """The chain of a bounded table of text and quality; None without both kinds."""
    text = sample.column("text").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    y = sample.column("quality").to_numpy().astype(np.int64)
    lines = pc.count_substring(text, "\n").to_numpy() + 1
    if lines.sum() > TRAIN_LINES:
        order = np.argsort(lines, kind="stable")
        few = np.sort(order[np.cumsum(lines[order]) <= TRAIN_LINES])
        text, y = text.take(pa.array(few)), y[few]
    if len(np.unique(y)) < 2:
        return None
    parts, lengths, firsts, total = [], [], [np.zeros(1, np.int64)], 0
    for _, _, body, offsets in blocks(text):
        f, n, first = line_features(body, offsets)
        parts.append(f)
        lengths.append(n)
        firsts.append(first[1:] + total)
        total += len(n)
    x, n, first = np.concatenate(parts), np.concatenate(lengths), np.concatenate(firsts)
    line_doc = np.repeat(np.arange(len(y)), np.diff(first))
    labels = y[line_doc]
    chain = fit_chain(x, first, labels, ROUNDS // 2)
    marginal = marginals(chain.odds(x), first, chain.moves)[0]
    worst = np.minimum.reduceat(marginal, first[:-1])[line_doc]
    relabelled = np.where((labels == 0) & (marginal > 0.5) & (marginal > worst), 1, labels)
    chain = fit_chain(x, first, relabelled)
    marginal = marginals(chain.odds(x), first, chain.moves)[0]
    chain.slope, chain.offset = fit_logistic(document_means(marginal, n, first) * 10 - 5, y)
    return chain


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Rows whose crc32 of the key as text leaves the remainder `part`; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> pa.Table:
    """Text and label of about `train_docs` labelled documents that aren't held out, each label with half where there are enough."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = None
    for value in (0, 1):
        rows = known.where(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs // 2)
        picked = rows if picked is None else picked.unionByName(rows)
    picked = F.broadcast(picked.select(F.col("doc_id").alias("label_id"), "quality"))
    # Of several texts under one doc_id the least one stands for it, so the sample doesn't depend on the order of rows.
    short = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return short.join(picked, F.col("doc_id") == F.col("label_id")).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "quality").toArrow()


def score_documents(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, then held_out, score and predicted of every document. `text` may be among `keep`."""
    chain = train(training_sample(docs, labels, train_docs))
    names = list(keep)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields] + ["held_out boolean", "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 2)
            score = np.ones(batch.num_rows)
            if chain is not None:
                for lo, hi, body, offsets in blocks(text):
                    if len(body) > BLOCK_BYTES:  # one text alone
                        odds, n = long_odds(body, chain)
                        first = np.array([0, len(n)])
                    else:
                        x, n, first = line_features(body, offsets)
                        odds = chain.odds(x)
                    marginal = marginals(odds, first, chain.moves)[0]
                    mean = document_means(marginal, n, first) * 10 - 5
                    score[lo:hi] = 1 / (1 + np.exp(-np.clip(chain.slope * mean + chain.offset, -30, 30)))
            columns = [batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(batch.num_columns - 1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "held_out", "score", "predicted"])

    return docs.select(*names, F.col("text").alias("_text"), held_out(F.col("doc_id")).alias("_held")).mapInArrow(run, schema)
