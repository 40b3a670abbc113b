"""Operator 5: exact Jaccard join of word-shingle sets by PartEnum signatures.

A set that links with another holds few shingles of its own: of n, at most the fraction that the threshold leaves over.
Shingles of half the domain are counted over all documents, as packed keys per range of the domain; sets with more keys
of their own than that link with nothing and send no signatures.

Sizes of the others fall into tables, bands that overlap so that any two sets which may link share one. In a table the
Hamming distance of a linking pair is at most k. The domain of shingles is cut into groups by hash, more than (k + 1) / 2
of them, so that some groups differ in at most one shingle; each group is cut into three parts, and each two of the three
give a signature: the one difference lies outside one of these pairs, whose signature both sets share.

Shingles that many documents hold are left out of the signatures, which only lowers Hamming distances, so that a
signature's group is small. Signatures without any shingle aren't sent; a set that has so many of them that a link might
rest on them alone sends signatures of its whole set as well, for others of its kind.

Small groups give all their pairs, large ones each document with the first of them, the hub. Each set has a sketch, the
parities of its shingles in cells as many as it is large; the distance of two sketches bounds the Hamming distance from
below and spares most pairs the exact comparison. Each document is compared with its first hub, then with those of its
candidates that are still in another component.

Where a large group still holds several components, the sketches of its documents meet in blocks of bounded size within
tasks, which send only pairs of different components that may link: first each document's likeliest partner among a few
in a part of the groups, which joins nearly all that belongs together, then, exactly, every pair. Near copies share most of
their groups, which lie in different tasks: each document carries its smallest signatures, and a group leaves a pair out
if both carry one that is smaller than the group's own, since that group has the pair as well. Only the documents that send
signatures have their sets written, and tables go after their last use.

Defined results: a null or wordless text has the empty set and links with nothing; equal sets are one class; a null id
makes its row link with nothing; rows that share an id are one node of the links; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.components import components
from rankweave.llm.hashing import as_bytes, chunks, mix, word_hashes
from rankweave.llm.shared import dropped, small_batches, tidy, written

#: Words in a shingle, and the least similarity as a fraction of whole numbers.
SHINGLE, LEAST = 5, (80, 100)
#: Ratio of the bounds of consecutive size bands.
BAND = 1.6
#: Share of all documents that makes a shingle too common for signatures; in small tables, HOT_LEAST documents do. At most
#: (mean set size) / HOT_SHARE shingles are common: that bounds the broadcast.
HOT_SHARE, HOT_LEAST = 0.0005, 20
#: Documents of a group that gives all its pairs, and of a block of a large one.
SMALL, BLOCK = 16, 4096
#: The first look into large groups takes one group of so many, and as many partners of each document.
SHARE, PARTNERS = 8, 8
#: Bytes of a sketch that a document sends with each signature at most, and how many of its smallest signatures go with it.
SENT, LEADING = 256, 16
#: 64-bit words of sketches that are compared at once.
WORDS = 1 << 19
#: Shingles or rows that a task gathers before it sends them on, and documents.
FLUSH, MOST_DOCS = 1_000_000, 60_000
#: Bytes of a batch of rows with texts, sets or sketches, two of which an executor's tasks hold in and outside Python.
BATCH = 8 << 20
#: Bytes of a key whose holders are counted. Two shingles that share a key only spare a set too few.
KEY = 6
#: Rows of the bitmap that keeps most other texts out of the shuffle, 64 bits each.
BITMAP = 1 << 16


def shingle_sets(texts: list[bytes], words: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, part in chunks(texts):
        h, n = word_hashes(part)
        rolled = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for j in range(words):
            rolled = mix(rolled + h[j : j + len(rolled)] + np.uint64(j + 1))
        start = 0
        for k in n:
            if k >= words:
                yield np.unique(rolled[start : start + k - words + 1])
            elif k:
                one = np.full(1, 1000 + k, np.uint64)
                for w in h[start : start + k]:
                    one = mix(one * np.uint64(31) + w)
                yield one
            else:
                yield np.zeros(0, np.uint64)
            start += k


def band_start(b: int) -> int:
    return int(np.ceil(BAND**b))


def tables_of(size: int, least: tuple[int, int] = LEAST) -> list[int]:
    """The band of a size, and the next one if a set of that band may link with it."""
    b = max(0, int(np.log(size) / np.log(BAND)) - 1)
    while band_start(b + 1) <= size:
        b += 1
    return [b, b + 1] if size * least[1] >= band_start(b + 1) * least[0] else [b]


def groups_of(table: int, least: tuple[int, int] = LEAST) -> tuple[int, int]:
    """Groups of the domain in a table, and how many of them a link can't make differ in two shingles or more."""
    largest = band_start(table + 1) - 1
    k = (least[1] - least[0]) * 2 * largest // (least[0] + least[1])
    needed = (k + 2) // 2
    spare = 1 + needed // 8
    return needed + spare, 1 + spare


def signatures(s: np.ndarray, whole: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """Signatures of the set `whole`, whose uncommon shingles are s."""
    out = [np.zeros(0, np.uint64)]
    for table in tables_of(len(whole), least):
        agreeing = groups_of(table, least)[1]
        keys, there = keys_of(s, table, 0, least)
        out.append(keys[there])
        if (~there.all(1)).sum() >= agreeing:
            keys, there = keys_of(whole, table, 1, least)
            out.append((keys if (~there.all(1)).sum() >= agreeing else keys[there]).ravel())
    return np.concatenate(out)


def keys_of(s: np.ndarray, table: int, kind: int, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each group and pair of its parts, and whether the set has any shingle there."""
    n = groups_of(table, least)[0]
    place, value = mix(s ^ np.uint64(0xA5A5)), mix(s + np.uint64(0x77))
    part = (place % np.uint64(3 * n)).astype(np.int64)
    sums, filled = np.zeros(3 * n, np.uint64), np.zeros(3 * n, bool)
    if len(s):
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sums[part[first]] = np.add.reduceat(value[order], first)
        filled[part[first]] = True
    sums, filled = sums.reshape(n, 3), filled.reshape(n, 3)
    other = [1, 2, 0]
    pairs = mix(sums * np.uint64(3)) + mix(sums[:, other] + np.uint64(5))
    name = np.arange(3 * n, dtype=np.uint64).reshape(n, 3) + np.uint64((2 * table + kind) << 32)
    return mix(pairs + mix(name)), filled | filled[:, other]


def sketch(s: np.ndarray) -> bytes:
    """Parities in as many cells, a power of two, as the set has shingles, or up to twice as many."""
    cells = max(64, 1 << len(s).bit_length())
    odd = np.bincount((mix(s + np.uint64(5)) % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_distances(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many cells two sketches differ; the longer one is folded to the size of the other."""
    out, sizes = np.zeros(len(x), np.int64), np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)]).reshape(-1, 2)
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)
    for k, sizes_of in enumerate(kinds):
        at = np.flatnonzero(kind.ravel() == k)
        p, q = (np.frombuffer(b"".join(z[i] for i in at), np.uint64).reshape(len(at), n // 8) for z, n in zip((x, y), sizes_of, strict=True))
        while p.shape[1] != q.shape[1]:
            p, q = (z[:, : z.shape[1] // 2] ^ z[:, z.shape[1] // 2 :] if z.shape[1] > min(p.shape[1], q.shape[1]) else z for z in (p, q))
        out[at] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
    return out


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches: a batch of very long texts and their sets would be hard to hold at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


TABLE = "kind int, chunk long, slot int, doc_id long, n long, s1 long, s2 long, keys binary, slots binary"
SETS, COMMON, ASKED = 0, 1, 2


def rows_of(kind: int, size: int, **columns) -> pa.RecordBatch:
    """A batch of TABLE; what isn't given is null."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    given, names, arrays = columns | {"kind": pa.array(np.full(size, kind, np.int32))}, [], []
    for name, kind_of in (x.split() for x in TABLE.split(", ")):
        names.append(name)
        arrays.append(given.get(name, pa.nulls(size, types[kind_of])))
    return pa.RecordBatch.from_arrays(arrays, names)


def set_table(texts: DataFrame, parts: int) -> DataFrame:
    """SETS: a document's set size and two hashes of its set, with its place in a chunk. COMMON: locally common shingles (s1) with counts (n).

    ASKED: per chunk and part (slot) of the range of keys, its distinct keys of half the domain, in order, and who holds them;
    the last slot is for keys that several of the chunk hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        chunk, total = TaskContext.get().partitionId() << 24, 0

        def closed() -> Iterator[pa.RecordBatch]:
            every, size = np.concatenate(held), [len(s) for s in held]
            u, n = np.unique(every, return_counts=True)
            often = n >= max(2, HOT_SHARE / 2 * len(held))
            yield rows_of(COMMON, int(often.sum()), n=pa.array(n[often].astype(np.int64)), s1=signed(u[often]))
            owner = np.repeat(np.arange(len(held), dtype=np.uint16), size)
            half = (every & np.uint64(1)) == 0
            keys, first, times = np.unique(every[half] >> np.uint64(64 - 8 * KEY), return_index=True, return_counts=True)
            owner = np.where(times == 1, owner[half][first], 0xFFFF).astype("<u2")
            at = np.append(np.searchsorted(keys, np.array([(k << (8 * KEY)) // parts for k in range(parts)], np.uint64)), len(keys))
            packed = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY])
            full = np.flatnonzero(np.diff(at))
            for some in np.array_split(full, max(1, len(full) // 1000)):
                if len(some):
                    yield rows_of(
                        ASKED,
                        len(some),
                        chunk=pa.array(np.full(len(some), chunk)),
                        slot=pa.array(some, pa.int32()),
                        keys=pa.array([packed[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()),
                        slots=pa.array([owner[at[k] : at[k + 1]].tobytes() for k in some], pa.binary()),
                    )

        for batch in slices(batches, 1000):
            sets = list(shingle_sets(as_bytes(batch.column("text"))))
            if held and (total > FLUSH or len(held) + len(sets) > MOST_DOCS):
                yield from closed()
                held, total, chunk = [], 0, chunk + 1
            s1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
            s2 = np.array([mix(s + np.uint64(9)).sum(dtype=np.uint64) for s in sets], np.uint64)
            size = np.array([len(s) for s in sets], np.int64)
            slot = np.arange(len(held), len(held) + len(sets), dtype=np.int32)
            yield rows_of(SETS, len(sets), chunk=pa.array(np.full(len(sets), chunk)), slot=pa.array(slot), doc_id=batch.column("doc_id"), n=pa.array(size), s1=signed(s1), s2=signed(s2))
            held += sets
            total += int(size.sum())
        if held:
            yield from closed()

    return texts.mapInArrow(tidy(run), TABLE)


def own_keys(asked: DataFrame, parts: int) -> DataFrame:
    """(chunk, slot, own): how many keys no other document holds, for the documents that have such keys."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, *row in zip(*(batch.column(c).to_pylist() for c in ("slot", "chunk", "keys", "slots")), strict=True):
                rows.setdefault(part, []).append(row)
        while rows:
            _, own = rows.popitem()
            packed = np.frombuffer(b"".join(k for _, k, _ in own), np.uint8).reshape(-1, KEY)
            keys = np.zeros((len(packed), 8), np.uint8)
            keys[:, :KEY] = packed
            keys, holders = keys.view("<u8").ravel(), np.frombuffer(b"".join(s for _, _, s in own), "<u2")
            order = np.argsort(keys, kind="stable")
            k = keys[order]
            new = np.r_[True, k[1:] != k[:-1]]
            alone = np.zeros(len(keys), bool)
            alone[order] = new & np.r_[new[1:], True]
            alone &= holders != 0xFFFF
            ends = np.cumsum([len(s) // 2 for _, _, s in own])
            slots = [holders[a:z][alone[a:z]].tobytes() for a, z in zip(np.r_[0, ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in own], pa.int64()), pa.array(slots, pa.binary())], ["chunk", "slots"])

    def counted(table: pa.Table) -> pa.Table:
        slots = np.frombuffer(b"".join(table.column("slots").to_pylist()), "<u2")
        n = np.bincount(slots)
        slot = np.flatnonzero(n)
        return pa.table([pa.array(np.full(len(slot), table.column("chunk")[0].as_py(), np.int64)), pa.array(slot.astype(np.int32)), pa.array(n[slot].astype(np.int64))], ["chunk", "slot", "own"])

    found = asked.select("slot", "chunk", "keys", "slots").repartitionById(parts, "slot").mapInArrow(tidy(single), "chunk long, slots binary")
    return found.groupBy("chunk").applyInArrow(counted, "chunk long, slot int, own long")


def node_table(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, set, sketch) of the distinct texts that nodes (node) name; a set is its sorted hashes.

    A copy's row would meet all those of its partner's copies in each join of pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            sets = list(shingle_sets(as_bytes(batch.column("text"))))
            size = pa.array(np.array([len(s) for s in sets], np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())], ["node", "n", "set", "sketch"])

    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * BITMAP))
    bit = nodes.select(place("node").alias("at")).select(F.expr("shiftright(at, 6)").alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS INT))").alias("bit"))
    bitmap = F.broadcast(bit.groupBy("word").agg(F.bit_or("bit").alias("bits")))
    likely = texts.withColumn("at", place("doc_id")).withColumn("word", F.expr("shiftright(at, 6)")).join(bitmap, "word").where("(shiftrightunsigned(bits, CAST(at & 63 AS INT)) & 1) = 1")
    # Nodes are distinct; a semi-join would be pushed below the bitmap, so that all texts were shuffled.
    found = likely.select("doc_id", "text").dropDuplicates().join(nodes.select(F.col("node").alias("doc_id")), "doc_id")
    return found.mapInArrow(tidy(run), "node long, n int, set binary, sketch binary")


def signature_table(nodes: DataFrame, hot, least: tuple[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(keys: list[np.ndarray], rows: list[int], batch: pa.RecordBatch) -> pa.RecordBatch:
            of = np.repeat(rows, [len(k) for k in keys])
            return pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), batch.column("node").take(pa.array(of)), batch.column("n").take(pa.array(of))], ["sig", "node", "n"])

        for batch in slices(batches, 1000):
            keys, rows, total = [], [], 0
            for i, x in enumerate(batch.column("set").to_pylist()):
                s = np.frombuffer(x, np.uint64)
                if len(s):
                    keys.append(signatures(s[~np.isin(s, hot.value)] if len(hot.value) else s, s, least))
                    rows.append(i)
                    total += len(keys[-1])
                if total > 200_000:
                    yield sent(keys, rows, batch)
                    keys, rows, total = [], [], 0
            if keys:
                yield sent(keys, rows, batch)

    return nodes.select("node", "n", "set").mapInArrow(tidy(run), "sig long, node long, n int")


def grouped_pairs(sigs: DataFrame, parts: int, least: tuple[int, int]) -> DataFrame:
    """(a, b, star, near): pairs of small groups whose sizes are near, and of large ones (star) each document (b) with the first (a). Streams over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        kept_sig, kept = None, np.zeros((0, 2), np.int64)  # the last group so far; only its hub once it is large
        hub_only = False

        def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return (x * least[1] >= y * least[0]) & (y * least[1] >= x * least[0])

        def add(a: np.ndarray, b: np.ndarray) -> None:
            good = near(a[:, 1], b[:, 1])
            a, b = a[good], b[good]
            held.append(np.stack([a[:, 0], b[:, 0], np.ones(len(a), np.int64)], axis=1))

        def star(rows: np.ndarray) -> None:
            hub, others = rows[0], rows[1:]
            held.append(np.stack([np.full(len(others), hub[0]), others[:, 0], 2 + near(hub[1], others[:, 1])], axis=1))

        def close() -> None:
            if not hub_only and len(kept) > 1:
                i, j = np.triu_indices(len(kept), 1)
                add(kept[i], kept[j])

        def merged() -> pa.RecordBatch:
            u = np.unique(np.concatenate(held), axis=0)
            held[:] = []
            return pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1]), pa.array(u[:, 2] >= 2), pa.array(u[:, 2] % 2 == 1)], ["a", "b", "star", "near"])

        for batch in batches:
            sig, node, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(sig):
                continue
            rows = np.stack([node, n.astype(np.int64)], axis=1)
            start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
            size = np.diff(np.r_[start, len(sig)])
            # The first run may go on with the group that the batch before left open.
            first = rows[: size[0]]
            if sig[0] == kept_sig:
                kept = np.concatenate([kept, first])
            else:
                close()
                kept_sig, kept, hub_only = sig[0], first, False
            if hub_only or len(kept) > SMALL:
                star(kept)
                kept, hub_only = kept[:1], True
            if len(start) > 1:
                close()
                inner, inner_size = start[1:-1], size[1:-1]
                for g in np.unique(inner_size[(inner_size > 1) & (inner_size <= SMALL)]):
                    these = rows[inner[inner_size == g][:, None] + np.arange(g)]
                    i, j = np.triu_indices(g, 1)
                    add(these[:, i].reshape(-1, 2), these[:, j].reshape(-1, 2))
                for k in np.flatnonzero(inner_size > SMALL):
                    star(rows[inner[k] : inner[k] + inner_size[k]])
                kept_sig, kept, hub_only = sig[-1], rows[start[-1] :], False
                if len(kept) > SMALL:
                    star(kept)
                    kept, hub_only = kept[:1], True
            if sum(map(len, held)) > FLUSH // 4:
                yield merged()
        close()
        if held:
            yield merged()

    dealt = sigs.repartition(parts, "sig").sortWithinPartitions("sig", "node")
    return dealt.mapInArrow(tidy(run), "a long, b long, star boolean, near boolean")


def least_distance(n: np.ndarray, m: np.ndarray, apart: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The least Hamming distance of sets of n and m shingles whose sketches are so far apart, and whether it allows a link."""
    low, total = np.maximum(apart, np.abs(n - m)), n + m
    return low, (total - low) * least[1] >= (total + low) * least[0]


def bounded(pairs: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b) that sizes and sketches allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            may = least_distance(n, m, sketch_distances(*(batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b"))), least)[1]
            yield batch.select(["a", "b"]).filter(pa.array(may))

    one, two = (nodes.select(F.col("node").alias(c), F.col("n").alias("n_" + c), F.col("sketch").alias("sketch_" + c)) for c in ("a", "b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(tidy(run), "a long, b long")


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of any sizes as rows of the smallest one's size."""
    least, out = min(map(len, sketches)) // 8, []
    for x in sketches:
        row = np.frombuffer(x, np.uint64)
        while len(row) > least:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out.append(row)
    return np.stack(out)


def leading(keys: np.ndarray, most: int) -> bytes:
    """The smallest of a document's signatures; the largest number, which is smaller than none, fills up what is missing."""
    out = np.full(most, np.iinfo(np.uint64).max)
    least = np.sort(keys)[:most]
    out[: len(least)] = least
    return out.tobytes()


def met_before(x: np.ndarray, y: np.ndarray, group: np.uint64) -> np.ndarray:
    """Whether rows of leading signatures have one in common that is smaller than the group's."""
    out = np.zeros(len(x), bool)
    for k in range(x.shape[1]):
        at = np.flatnonzero(~out & (x[:, k] < group))
        out[at] = (x[at, k : k + 1] == y[at]).any(1)
    return out


def likely_pairs(x, y, least: tuple[int, int], first_only: bool, group: np.uint64) -> np.ndarray:
    """(a, b, low) of the pairs of rows of two blocks that may link and are in different components.

    A block is (node, n, component, sketches, leading signatures). With first_only, both are the same block and each row meets
    only those that follow it; else pairs that a group of a smaller signature surely has are left to that group.
    """
    out = [np.zeros((0, 3), np.int64)]
    width = min(x[3].shape[1], y[3].shape[1])
    sx, sy = (np.bitwise_xor.reduce(z[3].reshape(len(z[3]), -1, width), axis=1) for z in (x, y))

    def add(i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
        low, may = least_distance(x[1][i], y[1][j], apart, least)
        may &= x[2][i] != y[2][j]
        i, j, low = i[may], j[may], low[may]
        if not first_only:
            new = ~met_before(x[4][i], y[4][j], group)
            i, j, low = i[new], j[new], low[new]
        a, b = x[0][i], y[0][j]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b), low], axis=1))

    if first_only:
        for k in range(1, min(PARTNERS, len(sx) - 1) + 1):
            i = np.arange(len(sx) - k)
            add(i, i + k, np.bitwise_count(sx[:-k] ^ sx[k:]).sum(1, dtype=np.int64))
        return np.concatenate(out)
    # Rows of the commonest component needn't meet each other.
    names, n = np.unique(np.r_[x[2], y[2]], return_counts=True)
    usual = names[n.argmax()]
    for far, (p, q, u, v) in ((x[2] != usual, (sx, sy, x, y)), (y[2] != usual, (sy, sx, y, x))):
        at = np.flatnonzero(far)
        step = max(1, WORDS // q.size)
        for k in range(0, len(at), step):
            some = at[k : k + step]
            apart = np.bitwise_count(p[some, None] ^ q).sum(2, dtype=np.int64)
            i, j = np.nonzero(u[2][some, None] != v[2])
            add(*((some[i], j) if u is x else (j, some[i])), apart[i, j])
        if x is y:
            break
    return np.unique(np.concatenate(out), axis=0)


def likeliest(pairs: np.ndarray) -> np.ndarray:
    """Of (a, b, low) those that are the nearest, then the first, of one of their ends."""
    me, which = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.tile(np.arange(len(pairs)), 2)
    order = np.lexsort((pairs[which, 1], pairs[which, 0], pairs[which, 2], me))
    first = np.diff(me[order], prepend=me[order[:1]] - 1) != 0
    return pairs[np.unique(which[order[first]])]


LIKELY = "a long, b long, low long, group long, block int, nodes binary, sizes binary, components binary, sketches binary, leads binary"


def second_look(rows: DataFrame, hot, parts: int, least: tuple[int, int], first_only: bool) -> DataFrame:
    """(a, b, low): pairs of different components within large groups of rows (node, n, set, sketch, component) that may link."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(rows: list[int], keys: list[np.ndarray], leads: list[bytes], batch: pa.RecordBatch, sketches: pa.Array) -> pa.RecordBatch:
            times = [len(k) for k in keys]
            of, lead = pa.array(np.repeat(rows, times)), pa.array(leads, pa.binary()).take(pa.array(np.repeat(np.arange(len(leads)), times)))
            return pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), *(batch.column(c).take(of) for c in names[:3]), sketches.take(of), lead], ["sig", *names, "lead"])

        for batch in slices(batches, 1000):
            sketches = pa.array([folded([x, bytes(SENT)])[0].tobytes() if len(x) > SENT else x for x in batch.column("sketch").to_pylist()], pa.binary())
            keys, leads, rows, total = [], [], [], 0
            for i, x in enumerate(batch.column("set").to_pylist()):
                s = np.frombuffer(x, np.uint64)
                k = signatures(s[~np.isin(s, hot.value)] if len(hot.value) else s, s, least)
                keys.append(k[k % np.uint64(SHARE) == 0] if first_only else k)
                leads.append(b"" if first_only else leading(k, LEADING))
                rows.append(i)
                total += len(keys[-1])
                if total > 25_000:
                    yield some(rows, keys, leads, batch, sketches)
                    keys, leads, rows, total = [], [], [], 0
            if total:
                yield some(rows, keys, leads, batch, sketches)

    names = ["node", "n", "component", "sketch"]
    spread = rows.repartition(parts, "node").select("set", *names).mapInArrow(tidy(sent), "sig long, node long, n int, component long, sketch binary, lead binary")

    def block_of(table: pa.Table):
        leads = np.frombuffer(b"".join(table.column("lead").to_pylist()), np.uint64).reshape(len(table), -1)
        return *(table.column(c).to_numpy().astype(np.int64) for c in ("node", "n", "component")), folded(table.column("sketch").to_pylist()), leads

    def row(pairs: np.ndarray, group: int | None = None, block: int | None = None, x=None) -> pa.RecordBatch:
        n = len(pairs) if x is None else 1
        if x is None:
            values = [*(pa.array(pairs[:, i]) for i in range(3)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(5))]
        else:
            values = [*(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([group], pa.int64()), pa.array([block], pa.int32()), *(pa.array([y.tobytes()], pa.binary()) for y in x)]
        return pa.RecordBatch.from_arrays(values, [c.split()[0] for c in LIKELY.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, total, block = None, [], 0, 0
        found, n_found = [], 0

        def settled() -> np.ndarray:
            # A first look asks for each document's likeliest partner only.
            pairs = np.unique(np.concatenate(found), axis=0)
            return likeliest(pairs) if first_only else pairs

        def within() -> tuple[np.ndarray, ...]:
            nonlocal n_found
            x = block_of(pa.concat_tables(held))
            if len(np.unique(x[2])) > 1:
                found.append(likely_pairs(x, x, least, first_only, group.view(np.uint64)))
                n_found += len(found[-1])
            return x

        for batch in batches:
            sig = batch.column("sig").to_numpy()
            table, start = pa.Table.from_batches([batch]), np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else []
            for a, z in zip(start, np.r_[start[1:], len(sig)], strict=False):
                if group is not None and sig[a] != group:
                    # The last block of a group that has several must meet the others as well.
                    if total and (block or total > SMALL):
                        x = within()
                        if block and not first_only:
                            yield row(None, int(group), block, x)
                    held, total, block = [], 0, 0
                group = sig[a]
                while a < z:
                    some = table.slice(a, min(z - a, BLOCK - total))
                    held.append(some)
                    total, a = total + len(some), a + len(some)
                    if total == BLOCK:
                        x = within()
                        if not first_only:
                            yield row(None, int(group), block, x)
                        held, total, block = [], 0, block + 1
                if n_found > FLUSH // 4:
                    found = [settled()]
                    n_found = len(found[0])
                    if not first_only or n_found > FLUSH // 8:
                        yield row(found[0])
                        found, n_found = [], 0
        if total and (block or total > SMALL):
            x = within()
            if block and not first_only:
                yield row(None, int(group), block, x)
        if n_found:
            yield row(settled())

    dealt = spread.repartition(parts, "sig").sortWithinPartitions("sig", F.xxhash64("sig", "node")).mapInArrow(tidy(run), LIKELY)
    if first_only:
        return dealt.select("a", "b", "low")
    dealt = written(dealt)
    blocks = dealt.where("block IS NOT NULL").select("group", "block", "nodes", "sizes", "components", "sketches", "leads")
    one, two = (blocks.select("group", *(F.col(c).alias(c + side) for c in blocks.columns[1:])) for side in ("_a", "_b"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = []
                for side in ("_a", "_b"):
                    x = [np.frombuffer(batch.column(c + side)[i].as_py(), np.uint64 if c in ("sketches", "leads") else np.int64) for c in ("nodes", "sizes", "components", "sketches", "leads")]
                    sides.append((*x[:3], *(z.reshape(len(x[0]), -1) for z in x[3:])))
                group = np.int64(batch.column("group")[i].as_py()).view(np.uint64)
                yield row(likely_pairs(*sides, least, False, group)).select(["a", "b", "low"])

    met = one.join(two, "group").where("block_a < block_b").mapInArrow(tidy(across), "a long, b long, low long")
    return dealt.where("a IS NOT NULL").select("a", "b", "low").unionByName(met)


def verified(pairs: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """pairs (a, b) with the distance of their sets, and whether they link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 250):
            x, y = ([np.frombuffer(s, np.uint64) for s in batch.column(c).to_pylist()] for c in ("set_a", "set_b"))
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            union = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64) - both
            link = (both > 0) & (least[1] * both >= least[0] * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(1 - both / np.maximum(1, union)), pa.array(link)], ["a", "b", "d", "link"])

    one, two = (nodes.select(F.col("node").alias(c), F.col("set").alias("set_" + c)) for c in ("a", "b"))
    return written(pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(tidy(run), "a long, b long, d double, link boolean"))


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """pairs (a, b, ...) whose ends are in different components of joined (node, component)."""
    for column in ("a", "b"):
        own = joined.select(F.col("node").alias(column), F.col("component").alias("of_" + column))
        pairs = pairs.join(own, column, "left").withColumn("of_" + column, F.coalesce("of_" + column, column))
    return pairs.where("of_a <> of_b")


def links_of(nodes: DataFrame, hot, parts: int, least: tuple[int, int]) -> DataFrame:
    """(node, component) of the nodes (node, n, set, sketch) that link with any."""
    pairs = written(grouped_pairs(signature_table(nodes, hot, least), parts, least))
    may = written(bounded(pairs.where("near").select("a", "b").distinct(), nodes, least))
    # Each document with its first hub, then what is still apart.
    seen = verified(may.groupBy("b").agg(F.min("a").alias("a")), nodes, least)
    joined = components(seen.where("link").select("a", "b"))
    more = verified(apart(may, joined).select("a", "b").join(seen.select("a", "b"), ["a", "b"], "left_anti"), nodes, least)
    joined = joined_by(joined, more)
    dropped(may, seen, more)
    # Of a large group only the hub's pairs are known: a group that still holds several components is looked into.
    stars = written(pairs.where("star").select("a", "b").distinct())
    dropped(pairs)
    for first_only in (True, False):
        split = written(apart(stars, joined).select("a", "b", "of_a"))
        # The components of such hubs, and the documents apart from them, hold all of these groups.
        own = joined.select("node", "component")
        placed = nodes.select("node").distinct().join(own, "node", "left").withColumn("component", F.coalesce("component", "node"))
        there = placed.join(split.select(F.col("of_a").alias("component")).distinct(), "component", "left_semi").select("node").unionByName(split.select(F.col("b").alias("node"))).distinct()
        rows = written(nodes.join(there, "node", "left_semi").join(placed, "node"))
        dropped(split)
        found = second_look(rows, hot, parts, least, first_only)
        if first_only:
            # Each document's likeliest partner.
            found = found.select(F.explode(F.expr("array(struct(a AS me, a, b, low), struct(b AS me, a, b, low))")).alias("x")).select("x.*").groupBy("me").agg(F.min_by(F.struct("a", "b"), F.struct("low", "a", "b")).alias("x")).select("x.*")
        last = verified(bounded(found.select("a", "b").distinct(), rows, least), rows, least)
        joined = joined_by(joined, last)
        dropped(rows, last)
    joined = written(joined)
    dropped(stars)
    return joined


def joined_by(joined: DataFrame, seen: DataFrame) -> DataFrame:
    """Components (node, component) after the links among (a, b, link) have been added."""
    links = seen.where("link").select("a", "b")
    if not apart(links, joined).limit(1).count():
        return joined
    return components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key reachable by links)."""
    with small_batches(docs.sparkSession, BATCH):
        sets, classes, joined = linked(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), least)
    component = classes.join(joined.withColumnRenamed("node", "class"), "class", "left").select("s1", "s2", "n", F.coalesce("component", "class").alias("component"), F.lit(True).alias("named"))
    out = sets.withColumn("named", F.expr("doc_id IS NOT NULL")).join(component, ["s1", "s2", "n", "named"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def linked(texts: DataFrame, least: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: (doc_id, n, s1, s2) of each text, (s1, s2, n, class) of each set, and (node, component) of the classes that link with any."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = written(set_table(texts, parts))
    own = own_keys(table.where(F.col("kind") == ASKED), parts)
    sets = table.where(F.col("kind") == SETS).select("chunk", "slot", "doc_id", "n", "s1", "s2").join(own, ["chunk", "slot"], "left")
    fits = F.coalesce("own", F.lit(0)) * least[1] <= F.col("n") * (least[1] - least[0])
    sets = written(sets.select("doc_id", "n", "s1", "s2", fits.alias("fits")))
    common = table.where(F.col("kind") == COMMON).groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_LEAST, HOT_SHARE * sets.count()))
    hot = spark.sparkContext.broadcast(np.sort(common.select("s1").toArrow()["s1"].to_numpy().view(np.uint64)))
    dropped(table)

    named = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = written(named.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("class"), F.max("fits").alias("fits")))
    # One document of each class sends signatures.
    nodes = written(node_table(texts, classes.where("fits").select(F.col("class").alias("node")).distinct()))
    joined = links_of(nodes, hot, parts, least)
    dropped(nodes)
    return sets, classes, joined


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, of the smallest id, with all its columns; rows without any word stay.

    Texts are linked, not ids, so each row is judged by its own text: of rows that share an id only the one whose text comes
    first can stay, rows without an id come after all others, and of rows equal in id and text one stays.
    """
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("h"))
    linked = near_duplicates(docs.select(F.xxhash64("text").alias("h"), "text"), key="h", **options).where("n_shingles > 0")
    component = linked.select(F.col("doc_id").alias("h"), F.col("component_id").alias("component")).distinct()
    of_text = whole.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "h")).alias("row"))
    first = of_text.join(component, "h").groupBy("component").agg(F.min("row").alias("row")).select(F.col("row.id").alias("first_id"), F.col("row.h").alias("first_h"))
    # Equal rows meet within their tasks before they are shuffled.
    once = whole.dropDuplicates(["id", "h"])
    kept = once.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")), "left_semi")
    wordless = whole.where(~F.coalesce(F.col("doc.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.unionByName(wordless).select(*(F.col(f"doc.`{c}`") for c in docs.columns))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
