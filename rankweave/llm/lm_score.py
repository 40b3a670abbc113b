"""Operator 6: language-model scores by deleted interpolation of bigram and unigram estimates.

P(w | v) = l2 * c(v w) / c(v) + l1 * c(w) / N + l0 / (V + 1), the weights l depending on the octave of c(v), from 1 up;
contexts that training doesn't hold have l2 = 0. The weights are learned by expectation-maximisation on counts with each
occurrence held out in turn (its own count taken off numerator and denominator).

Counting works on blocks, parts of the input's partitions. A block sends its distinct words and bigrams, as hashes in order
with its own counts, to the parts of the range of hashes. A part adds up what all blocks sent and replies to each with the totals
alone, in the order in which they came: the block knows its hashes. Documents and replies then meet by block, where c(v), c(w) and c(v w)
of every token are known; these are written per document, and summed into the bounded histogram that EM needs.

Defined results: a null or empty text is the end token alone; a null key makes its row a training row; repeated rows
count each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.hashing import as_bytes, chunks, mix, word_hashes
from rankweave.llm.shared import give_back, small_batches, tidy, written

FOLDS, HELD_OUT = 5, 1
#: Buckets of contexts: 0 for unseen ones, then one for each octave of c(v).
BUCKETS = 64
EM_STEPS = 60
#: Steps of the histogram of probabilities in an octave.
PER_OCTAVE = 4
#: Blocks of an input partition.
SPLIT = 3
#: Tokens that a task scores at once.
FLUSH = 1 << 18
#: Bytes of rows that a Python worker gets at once, and of hashes that it sends at once.
BATCH, SENT = 8 << 20, 2 << 20

START, END = (np.uint64(x) for x in (0x5EED0001, 0x5EED0002))
WORDS, PAIRS = 0, 1
MOVED = "the documents came in other partitions the second time; write them to a table first"
REQUESTS = "part int, kind int, block int, keys binary, n binary"
REPLIES = "block int, kind int, part int, check long, n binary, vocabulary long, total long"
COUNTS = "doc_id long, held_out boolean, n_tokens long, c1 binary, c2 binary, cell long, weight long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, context, and number of tokens of each text."""
    toks, ctxs, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, part in chunks(texts):
        words, n = word_hashes(part)
        ends = np.cumsum(n + 1) - 1
        tok = np.full(len(words) + len(n), END, np.uint64)
        is_word = np.ones(len(tok), bool)
        is_word[ends] = False
        tok[is_word] = words
        ctx = np.empty_like(tok)
        ctx[1:] = tok[:-1]
        ctx[ends - n] = START
        toks.append(tok), ctxs.append(ctx), sizes.append(n + 1)
    return np.concatenate(toks), np.concatenate(ctxs), np.concatenate(sizes)


def pair(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(w + mix(v))


def distinct(tok: np.ndarray, sizes: np.ndarray, ctx: np.ndarray):
    """Distinct words (START among them) and bigrams in order; the places of each token's context and word, and of its bigram."""
    words, at = np.unique(np.append(tok, START), return_inverse=True)
    of_word, of_ctx = at[:-1], np.roll(at[:-1], 1)
    of_ctx[np.cumsum(sizes) - sizes] = at[-1]
    pairs, of_pair = np.unique(pair(tok, ctx), return_inverse=True)
    return words, pairs, of_ctx, of_word, of_pair


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the range of hashes begins in hashes in order, and their end."""
    return np.append(np.searchsorted(keys, np.array([(k << 64) // parts for k in range(parts)], np.uint64)), len(keys))


def packed(n: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return n.astype(np.min_scalar_type(int(n.max()))).tobytes()


def unpacked(n: bytes, size: int) -> np.ndarray:
    return np.frombuffer(n, f"u{len(n) // size}").astype(np.int64)


def in_blocks(docs: DataFrame) -> DataFrame:
    """Adds block: a part of an input partition, small enough for a task's memory."""
    own = F.spark_partition_id() * SPLIT + F.pmod(F.xxhash64("doc_id", "text"), F.lit(SPLIT))
    return docs.withColumn("block", own.cast("int"))


def requests(docs: DataFrame, parts: int) -> DataFrame:
    """One row per block, part of the hashes and kind: the block's distinct words or bigrams and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[int, list[bytes]] = {}
        held: dict[int, list[bool]] = {}
        for batch in batches:
            for block, text, off in zip(batch.column("block").to_pylist(), as_bytes(batch.column("text")), batch.column("held_out").to_pylist(), strict=True):
                texts.setdefault(block, []).append(text)
                held.setdefault(block, []).append(off)
        for block in sorted(texts):
            yield from of_block(block, texts.pop(block), np.array(held[block], bool))
            give_back()

    def of_block(block: int, texts: list[bytes], held_out: np.ndarray) -> Iterator[pa.RecordBatch]:
        tok, ctx, sizes = tokens(texts)
        train = np.repeat(~held_out, sizes)
        words, pairs, _, of_word, of_pair = distinct(tok, sizes, ctx)
        n_words = np.bincount(of_word, train, len(words)).astype(np.int64)
        n_words[np.searchsorted(words, START)] = (~held_out).sum()
        for kind, keys, n in ((WORDS, words, n_words), (PAIRS, pairs, np.bincount(of_pair, train, len(pairs)).astype(np.int64))):
            at = cuts(keys, parts)
            full = np.flatnonzero(np.diff(at))
            for some in np.array_split(full, max(1, len(full) // 1000, min(len(full), keys.nbytes // SENT))):
                slices = [slice(at[k], at[k + 1]) for k in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()),
                        pa.array(np.full(len(some), kind), pa.int32()),
                        pa.array(np.full(len(some), block), pa.int32()),
                        pa.array([keys[x].tobytes() for x in slices], pa.binary()),
                        pa.array([packed(n[x]) for x in slices], pa.binary()),
                    ],
                    ["part", "kind", "block", "keys", "n"],
                )

    return in_blocks(docs).select("block", "text", "held_out").mapInArrow(tidy(run), REQUESTS)


def level(p: np.ndarray) -> np.ndarray:
    """Logarithm of a probability in steps, a large negative number for 0."""
    return np.where(p > 0, np.round(PER_OCTAVE * np.log2(np.maximum(p, 1e-300))), -99_999).astype(np.int64)


def replies(asked: DataFrame, parts: int) -> DataFrame:
    """The totals of each row of requests, in its order; under block -1 the numbers of distinct words and of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            part, kind, block, keys, n = (batch.column(c).to_pylist() for c in ("part", "kind", "block", "keys", "n"))
            for p, a, b, k, c in zip(part, kind, block, keys, n, strict=True):
                found.setdefault((p, a), []).append((b, np.frombuffer(k, np.uint64), np.frombuffer(c, f"u{8 * len(c) // len(k)}")))
        while found:
            (part, kind), rows = found.popitem()
            keys, at = np.unique(np.concatenate([k for _, k, _ in rows]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([c for _, _, c in rows]), len(keys)).astype(np.int64)
            totals = np.split(sums[at], np.cumsum([len(k) for _, k, _ in rows])[:-1])
            out = [(b, kind, part, zlib.crc32(k), packed(t), None, None) for (b, k, _), t in zip(rows, totals, strict=True)]
            if kind == WORDS:
                own = sums[keys != START]
                out.append((-1, kind, part, None, None, int((own > 0).sum()), int(own.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = [x.split()[0] for x in REPLIES.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    return asked.repartitionById(parts, "part").mapInArrow(tidy(run), REPLIES)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a count of 0, then 1 for 1, 2 for 2 and 3, and so on."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def histogram(context: np.ndarray, word: np.ndarray, both: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (bucket and levels of both probabilities) of training tokens, each held out in turn, and how many each has."""
    p2 = level((both - 1) / np.maximum(1, context - 1))
    p1 = level((word - 1) / max(1, total - 1))
    return np.unique((bucket_of(context) << 40) + ((p2 + 100_000) << 20) + (p1 + 100_000), return_counts=True)


def counted(docs: DataFrame, answers: DataFrame, parts: int, total: int) -> DataFrame:
    """Per document c(START) and c(w) of each token, and c(v w) of each; rows with a cell are parts of the histogram."""

    def run(texts: pa.Table, totals: pa.Table) -> pa.Table:
        tok, ctx, sizes = tokens(as_bytes(texts.column("text")))
        words, pairs, of_ctx, of_word, of_pair = distinct(tok, sizes, ctx)
        sums = {}
        rows = list(zip(*(totals.column(c).to_pylist() for c in ("kind", "part", "check", "n")), strict=True))
        for kind, keys in ((WORDS, words), (PAIRS, pairs)):
            at, known = cuts(keys, parts), np.full(len(keys), -1)
            for _, part, check, n in (r for r in rows if r[0] == kind):
                own = slice(at[part], at[part + 1])
                if zlib.crc32(keys[own].tobytes()) != check:
                    raise RuntimeError(MOVED)
                known[own] = unpacked(n, own.stop - own.start)
            if len(texts) and known.min(initial=0) < 0:
                raise RuntimeError(MOVED)
            sums[kind] = known
        context, word, both = sums[WORDS][of_ctx], sums[WORDS][of_word], sums[PAIRS][of_pair]
        off = texts.column("held_out").to_numpy().astype(bool)
        train = np.repeat(~off, sizes)
        cells, weight = histogram(context[train], word[train], both[train], total)
        ends = np.cumsum(sizes)
        docs, none = [slice(e - n, e) for e, n in zip(ends, sizes, strict=True)], [None] * len(cells)
        c1 = [packed(np.append(context[x.start], word[x])) for x in docs]
        columns = [
            pa.array(texts.column("doc_id").to_pylist() + none, pa.int64()),
            pa.array(off.tolist() + none, pa.bool_()),
            pa.array(sizes.tolist() + none, pa.int64()),
            pa.array(c1 + none, pa.binary()),
            pa.array([packed(both[x]) for x in docs] + none, pa.binary()),
            pa.array([None] * len(docs) + cells.tolist(), pa.int64()),
            pa.array([None] * len(docs) + weight.tolist(), pa.int64()),
        ]
        return pa.table(columns, names=[x.split()[0] for x in COUNTS.split(", ")])

    def whole(texts: pa.Table, totals: pa.Table) -> pa.Table:
        out = run(texts, totals)
        give_back()
        return out

    texts = in_blocks(docs).select("block", "text", "held_out", "doc_id")
    return texts.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(whole, COUNTS)


def learn(histogram: list[tuple[int, int]], vocabulary: int, buckets: int, steps: int = EM_STEPS) -> np.ndarray:
    """Weights (l2, l1, l0) of each bucket, by EM over the held-out probabilities."""
    out = np.tile([0.3, 0.5, 0.2], (buckets, 1))
    cell = np.array([c for c, _ in histogram], np.int64)
    weight = np.array([n for _, n in histogram], np.float64)
    q2, q1 = ((cell >> 20) & 0xFFFFF) - 100_000, (cell & 0xFFFFF) - 100_000
    p = np.stack([np.where(q > -99_999, 2.0 ** (q / PER_OCTAVE), 0) for q in (q2, q1)] + [np.full(len(cell), 1 / (vocabulary + 1))], axis=1)
    for b in range(buckets):
        own = (cell >> 40) == b
        if b == 0:
            out[b] = [0, 0.7, 0.3]
        if weight[own].sum() <= 0:
            continue
        for _ in range(steps):
            share = p[own] * out[b]
            share /= share.sum(1, keepdims=True)
            out[b] = (share * weight[own, None]).sum(0) / weight[own].sum()
    out = np.maximum(out, [0, 1e-9, 1e-9])
    out[0, 0] = 0
    return out / out.sum(1, keepdims=True)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with small_batches(spark, BATCH):
        answers = written(replies(requests(docs, parts), parts))
    found = answers.where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("vocabulary", "total"))).first()
    vocabulary, total = found.vocabulary, found.total
    with small_batches(spark, BATCH):
        counts = written(counted(docs, answers, parts, total))
    cells = counts.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("weight").alias("n")).collect()
    weights = learn([(r.cell, r.n) for r in cells], vocabulary, BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(batch.column("n_tokens").to_numpy())
            edges = np.unique(np.r_[0, np.searchsorted(ends, np.arange(FLUSH, ends[-1] if len(ends) else 0, FLUSH)), len(ends)])
            for a, b in zip(edges, edges[1:], strict=False):
                yield of_some(batch.slice(a, b - a))

    def of_some(some: pa.RecordBatch) -> pa.RecordBatch:
        sizes = some.column("n_tokens").to_numpy()
        c1 = [unpacked(x, n + 1) for x, n in zip(some.column("c1").to_pylist(), sizes, strict=True)]
        context, word = np.concatenate([x[:-1] for x in c1]), np.concatenate([x[1:] for x in c1])
        both = np.concatenate([unpacked(x, n) for x, n in zip(some.column("c2").to_pylist(), sizes, strict=True)])
        by = weights[bucket_of(context)]
        p = by[:, 0] * both / np.maximum(1, context) + by[:, 1] * word / max(1, total) + by[:, 2] / (vocabulary + 1)
        base = np.log10((word + 0.5) / (total + 0.5 * (vocabulary + 1)))
        first = np.cumsum(sizes) - sizes
        add = lambda x: pa.array(np.add.reduceat(x, first))
        columns = [some.column("doc_id"), some.column("held_out"), some.column("n_tokens"), add((word > 0).astype(np.int64)), pa.array(np.full(len(sizes), total, np.int64)), add(base), add(np.log10(p))]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCORES.split(", ")])

    return counts.where("cell IS NULL").select("doc_id", "held_out", "n_tokens", "c1", "c2").mapInArrow(tidy(run), SCORES)


def op6_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
