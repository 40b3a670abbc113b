"""Operator 2: removal of long repeated strings by run-length compressed suffix indexes.

The symbols of a text are its bytes or its words (A-Z lower-cased, apart by white space, as hashes). Every window of `length`
symbols belongs to one anchor, the leftmost smallest hash of its k-grams. Equal windows have equal
anchors, so repeats are looked for among the segments (an anchor's consecutive windows) of one anchor hash. Segments
that occur twice as a whole are repeats; equal segments one right after the other, as periodic text has them, are one row
with their number. The distinct segments of the other anchors are dealt out by anchor
hash, and each task indexes its share: the suffix order gives the Burrows-Wheeler transform, of which only the runs are
kept, with the text positions at both ends of each run. Along the text the matching statistics (the longest match of each suffix
with its neighbour in suffix order) fall by one a symbol except at run ends, so the matches sampled there give all of
them; those of `length` symbols or more are marked. Anchors with too many distinct segments for one index have their windows
counted by hash instead.

Defined results: a null or empty text has 0 bytes; every row is a document of its own, so that repeated rows are repeats
of each other; ids may be null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.hashing import TABLE, as_bytes, chunks, mix, powers, substring_hashes, word_hashes, word_spans
from rankweave.llm.shared import dropped, small_batches, tidy, written

LENGTH, GRAM = 400, 100
#: Words of the shortest passage of over 50 words, and of its grams.
PASSAGE, PASSAGE_GRAM = 51, 13
#: Distinct segments of an anchor hash in one index. A segment is shorter than 2 * LENGTH - GRAM + 1 bytes, so an index has at most about 3.5 million.
MAX_VARIANTS = 5000
#: Symbols that one index takes if it can choose.
INDEX = 1 << 19
#: Windows of a text that are treated at once.
BLOCK = 1 << 19
#: Bytes of rows that a Python worker gets at once.
BATCH = 8 << 20
_SECOND = np.random.default_rng(20240301).integers(1, 2**64, 256, dtype=np.uint64)


def symbols_of(texts: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, bytes or hashes of words in 32 bits, and how many each text has."""
    if unit == "words":
        hashes, sizes = word_hashes(texts)
        return hashes.astype(np.uint32), sizes
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(x) for x in texts])


def sums_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums for two independent hashes of substrings."""
    up, _ = powers(len(symbols) + 1)
    kinds = (TABLE[symbols], _SECOND[symbols]) if symbols.dtype == np.uint8 else (mix(symbols.astype(np.uint64) + k) for k in (TABLE[0], _SECOND[0]))
    out = []
    for values in kinds:
        out.append(np.zeros(len(symbols) + 1, np.uint64))
        np.cumsum(values * up[: len(symbols)], dtype=np.uint64, out=out[-1][1:])
    return out[0], out[1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, from running minima of blocks of w in both directions."""
    n = len(x)
    padded = np.concatenate([x, np.full((-n) % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors_of(texts: list[bytes], length: int, gram: int, unit: str = "bytes") -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor hash, two segment hashes, first window, number of windows, times) of all segments, as arrays; equal ones in a row are given once."""
    low = np.uint64(2**23 - 1)
    w = length - gram + 1
    for first, part in chunks(texts, BLOCK):
        b, size = symbols_of(part, unit)
        begin = np.cumsum(size) - size
        for at in range(0, max(0, len(b) - length + 1), BLOCK):
            c = b[at : at + BLOCK + length - 1]
            sums, second = sums_of(c)
            start = np.arange(len(c) - gram + 1)
            h = substring_hashes(sums, start, start + gram)
            least = sliding_min((h & ~low) | start.astype(np.uint64), w)
            s = np.arange(len(least))
            of = np.searchsorted(begin, s + at, side="right") - 1
            # Empty texts share their start with the next one: the last of them is the one with symbols.
            inside = s + at + length <= begin[of] + size[of]
            s, of, pos = s[inside], of[inside], (least[inside] & low).astype(np.int64)
            if not len(s):
                continue
            new = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (s[1:] != s[:-1] + 1)])
            n = np.diff(np.r_[new, len(s)])
            lo = s[new]
            end = lo + n + length - 1
            rows = first + of[new], h[pos[new]], substring_hashes(sums, lo, end), substring_hashes(second, lo, end), lo + at - begin[of[new]], n
            text, *key, start, _ = rows
            again = (text[1:] == text[:-1]) & (start[1:] == start[:-1] + n[:-1])
            for x in key:
                again &= x[1:] == x[:-1]
            head = np.flatnonzero(np.r_[True, ~again])
            yield *(x[head] for x in rows), np.diff(np.r_[head, len(n)])


def suffix_ranks(t: np.ndarray, depth: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """Ranks of the strings of 1, f, f**2, ... symbols at each place, and the suffixes in order; any two differ within depth."""
    n = len(t)
    f = 3 if max(n, int(t.max())) + 1 < 1 << 21 else 2
    bits = 21 if f == 3 else 31
    levels, span, rank = [(1, t.astype(np.int32))], 1, t.astype(np.int64)
    while True:
        padded = np.concatenate([rank, np.zeros(span * (f - 1), np.int64)])
        key = padded[:n]
        for j in range(1, f):
            key = (key << bits) | padded[j * span : j * span + n]
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, k[1:] != k[:-1]])
        span *= f
        if span >= depth or rank[order[-1]] == n:
            return levels, order
        levels.append((span, rank.astype(np.int32)))


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n, f = len(levels[0][1]), 3 if len(levels) > 1 and levels[1][0] == 3 else 2
    out = np.zeros(len(a), np.int64)
    for span, rank in reversed(levels):
        for _ in range(f - 1):
            x, y = a + out, b + out
            ok = (x < n) & (y < n)
            same = ok & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
            out += span * same
    return out


def repeated_windows(segments: list[np.ndarray], length: int) -> list[list[tuple[int, int]]]:
    """Per segment the ranges of windows (first, one past the last) whose symbols also start elsewhere in these segments."""
    size = np.array([len(s) + 1 for s in segments])
    end = np.cumsum(size) - 1
    # Each segment ends with a symbol of its own, below all others: no match crosses it.
    t, own = np.zeros(int(size.sum()), np.int64), np.ones(int(size.sum()), bool)
    own[end] = False
    t[own] = np.unique(np.concatenate(segments), return_inverse=True)[1] + len(segments)
    t[end] = np.arange(len(segments))
    t += 1
    levels, order = suffix_ranks(t, int(size.max()))
    bwt = t[order - 1]
    # Run-length compression: a run's first and last rows. A segment's start always has a symbol of its own before it.
    head = np.flatnonzero(np.r_[True, bwt[1:] != bwt[:-1]])[1:]
    above, below = order[head - 1], order[head]
    match = common_prefix(levels, above, below)
    change = np.zeros(len(t) + 1, np.int64)
    for place in (above, below):
        long = match >= length
        np.add.at(change, place[long], 1)
        np.add.at(change, place[long] + match[long] - length + 1, -1)
    marked = np.cumsum(change[:-1]) > 0
    edge = np.flatnonzero(np.diff(marked.astype(np.int8), prepend=0, append=0))
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    begin = end - size + 1
    for a, z in zip(edge[::2], edge[1::2], strict=True):
        k = int(np.searchsorted(end, a))
        while a < z:
            out[k].append((int(a - begin[k]), int(min(z, end[k]) - begin[k])))
            a, k = end[k] + 1, k + 1
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


KEY = ["k1", "k2"]
SEGMENT = ["h", "g1", "g2"]


def anchor_table(texts: DataFrame, length: int, gram: int, unit: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in KEY)
            for of, h, g1, g2, lo, n, times in anchors_of(as_bytes(batch.column("text")), length, gram, unit):
                yield pa.RecordBatch.from_arrays([pa.array(k1[of]), pa.array(k2[of]), signed(h), signed(g1), signed(g2), *(pa.array(x.astype(np.int32)) for x in (lo, n, times))], [*KEY, *SEGMENT, "lo", "n", "times"])

    return texts.mapInArrow(tidy(run), "k1 long, k2 long, h long, g1 long, g2 long, lo int, n int, times int")


def cut_segments(texts: DataFrame, wanted: DataFrame, length: int, unit: str) -> DataFrame:
    """The symbols of the wanted segments (k1, k2, h, g1, g2, lo, n, occ, big)."""
    per_text = wanted.groupBy(KEY).agg(F.collect_list(F.struct(*SEGMENT, "lo", "n", "occ", "big")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k1, k2, text, asked in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text", "wanted")), strict=True):
                b = symbols_of([(text or "").encode()], unit)[0]
                rows += [{"k1": k1, "k2": k2, **x, "symbols": b[x["lo"] : x["lo"] + x["n"] + length - 1].tobytes()} for x in asked]
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    ints, longs = pa.int32(), pa.int64()
    schema = pa.schema([("k1", longs), ("k2", longs), ("h", longs), ("g1", longs), ("g2", longs), ("lo", ints), ("n", ints), ("occ", longs), ("big", pa.bool_()), ("symbols", pa.binary())])
    found = texts.join(per_text, KEY).select(*KEY, "text", "wanted")
    return found.mapInArrow(tidy(run), "k1 long, k2 long, h long, g1 long, g2 long, lo int, n int, occ long, big boolean, symbols binary")


MARKS = "k1 long, k2 long, start int, end int"


def indexed_marks(segments: DataFrame, parts: int, length: int, kind: type, index: int = INDEX) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        held = pd.concat(rows, ignore_index=True)
        held = held.drop_duplicates(SEGMENT).sort_values(SEGMENT, ignore_index=True)
        size = held["symbols"].map(len).to_numpy() // np.dtype(kind).itemsize + 1
        new = np.r_[True, held["h"].to_numpy()[1:] != held["h"].to_numpy()[:-1]]
        starts = np.flatnonzero(new)
        bounds, filled = [0], 0
        for a, z in zip(starts, np.r_[starts[1:], len(held)], strict=True):
            more = int(size[a:z].sum())
            if filled and filled + more > index:
                bounds.append(a)
                filled = 0
            filled += more
        for a, z in zip(bounds, [*bounds[1:], len(held)], strict=True):
            part = held.iloc[a:z]
            rows = [
                (k1, k2, lo + x, lo + y - 1 + length)
                for k1, k2, lo, occ, found in zip(part["k1"], part["k2"], part["lo"], part["occ"], repeated_windows([np.frombuffer(x, kind) for x in part["symbols"]], length), strict=True)
                if occ == 1
                for x, y in found
            ]
            if rows:
                yield pd.DataFrame(rows, columns=["k1", "k2", "start", "end"])

    return segments.repartition(parts, "h").mapInPandas(tidy(run), MARKS)


def counted_marks(segments: DataFrame, length: int, kind: type) -> DataFrame:
    """The same for anchors with too many segments: windows with an equal one, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k1, k2, lo, n, occ, b in zip(*(batch.column(c).to_pylist() for c in (*KEY, "lo", "n", "occ", "symbols")), strict=True):
                s = np.arange(n)
                w1, w2 = (substring_hashes(x, s, s + length) for x in sums_of(np.frombuffer(b, kind)))
                full = lambda v, kind: pa.array(np.full(n, v, kind))
                yield pa.RecordBatch.from_arrays([full(k1, np.int64), full(k2, np.int64), signed(w1), signed(w2), pa.array((lo + s).astype(np.int32)), full(occ, np.int64)], [*KEY, "w1", "w2", "start", "occ"])

    windows = segments.mapInArrow(tidy(run), "k1 long, k2 long, w1 long, w2 long, start int, occ long")
    often = windows.groupBy("w1", "w2").agg(F.sum("occ").alias("all")).where("all > 1")
    return windows.where("occ = 1").join(often, ["w1", "w2"]).select(*KEY, "start", (F.col("start") + length).alias("end"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, max_variants: int = MAX_VARIANTS, carry: tuple[str, ...] = (), as_text: bool = False, unit: str = "bytes") -> DataFrame:
    """One row per document: key, carried columns, n_bytes, spans (array of start, end; removed bytes), kept (binary).

    The unit of length and gram is bytes or words. As text, kept is a string without the characters that a removal cut in two.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("k1"), F.xxhash64(key, text).alias("k2"), F.col(key), F.col(text).alias("text"), *carry)
    with small_batches(spark, BATCH):
        anchors = written(anchor_table(texts.select(*KEY, "text"), length, gram, unit))
        segments = anchors.groupBy(SEGMENT).agg(F.sum("times").alias("occ"), F.min(F.struct(*KEY, "lo", "n")).alias("at"))
        segments = written(segments)
        groups = segments.groupBy("h").agg(F.count("*").alias("variants"), F.min("occ").alias("least")).where("variants > 1 AND least = 1")
        wanted = segments.join(groups, "h").select(*SEGMENT, "occ", "at.*", (F.col("variants") > max_variants).alias("big"))
        cut = written(cut_segments(texts.select(*KEY, "text"), wanted, length, unit))
        kind = np.uint32 if unit == "words" else np.uint8
        whole = anchors.join(segments.where("occ > 1").select(SEGMENT), SEGMENT).select(*KEY, F.col("lo").alias("start"), (F.col("lo") + F.col("times") * F.col("n") + length - 1).alias("end"))
        marks = whole.unionByName(indexed_marks(cut.where("NOT big"), parts, length, kind)).unionByName(counted_marks(cut.where("big"), length, kind))
        spans = written(marks.groupBy(KEY).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("marks")))
        dropped(anchors, segments, cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged, kept, sizes = [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                b, own = (text or "").encode(), []
                for m in marks or []:
                    if own and m["start"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], m["end"])
                    else:
                        own.append({"start": m["start"], "end": m["end"]})
                if unit == "words" and own:
                    starts, ends = word_spans(b)
                    own = [{"start": int(starts[m["start"]]), "end": int(ends[m["end"] - 1])} for m in own]
                sizes.append(len(b))
                merged.append(own)
                kept.append(b"".join(b[x:y] for x, y in zip([0, *(m["end"] for m in own)], [*(m["start"] for m in own), len(b)], strict=True)))
            left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            spans = pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *carry)), pa.array(sizes, pa.int64()), spans, left], [key, *carry, "n_bytes", "spans", "kept"])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *carry)) + f", n_bytes long, spans array<struct<start:int,end:int>>, kept {'string' if as_text else 'binary'}"
    return texts.join(spans, KEY, "left").select(key, *carry, "text", "marks").mapInArrow(tidy(run), schema)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) with what is left of their texts; those of which nothing is left go."""
    found = remove_repeats(docs, carry=("lang", "source"), as_text=True, **options)
    left = found.where((F.size("spans") == 0) | (F.length("kept") > 0))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passages: runs of over 50 words, of any length in bytes, that also occur elsewhere."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs.withColumn("text_hash", F.xxhash64("text")), carry=("text_hash",))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.select("doc_id", "text_hash", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    passages = remove_repeats(docs.withColumn("text_hash", F.xxhash64("text")), length=PASSAGE, gram=PASSAGE_GRAM, carry=("text_hash",), unit="words")
    passages = passages.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash")).agg(F.max(F.size("spans")).cast("long").alias("n_passages"))
    both = found.join(passages, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash")), "left")
    return both.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_passages", F.lit(0)).alias("n_passages"))
