"""Operator 12: alignment of two tokenizers' tokens, made once per distinct segment.

A text, with a space before it, is cut before each space that follows a character other than white space. The first
tokenizer's splitting pattern starts a new piece there, and neither vocabulary holds a piece that goes on from such a
character into a space (read from both vocabularies; the characters for which one does are no place to cut), so no merge
crosses a cut and the segments' tokens, one after the other, are the text's. One pass cuts documents into blocks of bounded
size, each with its distinct segments and the documents as lists of numbers into them. Distinct segments of the whole corpus
are tokenised and aligned once; the alignments are joined to the blocks' segments, and each block composes its documents.

Defined results: texts that are null or empty, or that either tokenizer would change (U+2581, which stands for a space in
pieces), have no tokens, no groups and an empty digest, and add nothing to the counts; repeated rows count each; rows keep a
null id; texts of any length are cut as they are read; segments without any space are taken whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankweave.llm.shared import dropped, give_back, small_batches, tidy, written
from rankweave.llm.tokens import VOCABULARY, library, odd, vocabulary_path, word_encoder

PIECES = "piece_bpe_32k.model"
#: Characters of text in a block, of text cut at once, and segments aligned at once.
BLOCK_CHARS, CHUNK_CHARS, AT_ONCE = 32 << 20, 1 << 20, 20_000
#: Bytes of a batch of rows for Python, two of which an executor's tasks hold in and outside Python.
BATCH = 8 << 20
#: Parts in which blocks are composed, and bits of a block's number within its task.
WAVES, TASK_BITS = 3, 24
#: Fixed value: how pieces write a space.
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """letter -> byte of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


class Pair:
    """Both tokenizers with the bytes of their tokens, and where texts may be cut."""

    def __init__(self, vocabulary: str, pieces: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = library(vocabulary)
        self.library.encode_special_tokens = True
        self.words = word_encoder(vocabulary)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(pieces))
        letters, known = byte_letters(), self.library.get_vocab()
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.a_bytes[i] = bytes(letters[x] for x in token) if all(x in letters for x in token) else token.encode()
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.sp.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        # An id as it stands first in a segment, first in a group, first of the second side, and elsewhere.
        self.marked = [[f"{mark}{i}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))] for mark in ("", ";", "|", ",")]
        self.lone_space = self.sp.piece_to_id(SPACE)
        inside = [x.decode(errors="replace") for x in self.a_bytes] + [x.replace(SPACE, " ") for i, x in enumerate(names) if not self.sp.is_byte(i)]
        across = {x[i - 1] for x in inside for i in range(1, len(x)) if x[i] == " "}
        no_place = rf"\s{re.escape(''.join(sorted(x for x in across if not x.isspace())))}"
        self.cut = re.compile(f"(?<=[^{no_place}]) ")
        # A text without such a space, and without one at its start, is cut at all its spaces.
        self.uneven = re.compile(f"[{no_place}] ").search

    def unchanged(self, text: str) -> bool:
        """Whether the joined tokens are the text again."""
        if SPACE in text or self.sp.normalize(text) != SPACE + text.replace(" ", SPACE):
            return False
        return self.library.normalizer is None or self.library.normalizer.normalize_str(" " + text) == " " + text

    def segments(self, text: str) -> Iterator[list[str]]:
        """The segments of space + text, each without its first space, a chunk at a time."""
        start = 0
        while start <= len(text):
            end = self.cut.search(text, start + CHUNK_CHARS)
            part = text[start : end.start()] if end else text[start:]
            yield part.split(" ") if part[:1] != " " and self.uneven(part) is None else self.cut.split(part)
            start = end.end() if end else len(text) + 1

    def encoded(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [self.words(" " + x) if odd(x) is None else None for x in segments]
        late = [i for i, x in enumerate(a) if x is None]
        for i, x in zip(late, self.library.encode_batch([" " + segments[i] for i in late], add_special_tokens=False), strict=True):
            a[i] = x.ids
        return a, [x or [self.lone_space] for x in self.sp.encode(segments, num_threads=1)]


@cache
def pair(vocabulary: str, pieces: str) -> Pair:
    return Pair(vocabulary, pieces)


BLOCKS = "block long, ids array<string>, sizes array<int>, codes binary, code int, segment string, n long"


def cut_into_blocks(docs: DataFrame, both: Callable[[], Pair], block_chars: int) -> DataFrame:
    """Rows of two kinds. Without a code: a block, ids and sizes (segments) of its documents, codes (the segments' numbers, int32, deflated).

    With a code: one of the block's distinct segments and how often (n) it occurs there; no row grows with the block's vocabulary.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, task, made = both(), TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        codes: list[np.ndarray] = []
        chars = 0

        class Numbers(dict):
            def __missing__(self, segment: str) -> int:
                self[segment] = out = len(self)
                return out

        numbers = Numbers()
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("code", pa.int32()), ("segment", pa.string()), ("n", pa.int64())])

        def rows(size: int, **columns) -> pa.RecordBatch:
            given = columns | {"block": np.full(size, (task << TASK_BITS) + made)}
            return pa.RecordBatch.from_arrays([pa.array(given[x.name], x.type) if x.name in given else pa.nulls(size, x.type) for x in schema], schema=schema)

        def block() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            codes.clear()
            counts = np.bincount(flat, minlength=len(numbers))
            yield rows(1, ids=[ids], sizes=[sizes], codes=[zlib.compress(flat, 1)])
            del flat
            segments = iter(numbers)
            for i in range(0, len(numbers), AT_ONCE):
                some = list(islice(segments, AT_ONCE))
                yield rows(len(some), code=np.arange(i, i + len(some), dtype=np.int32), segment=some, n=counts[i : i + len(some)])

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids.append(doc_id.as_py())
                size, text = 0, text.as_py()
                if text and tokenizers.unchanged(text):
                    for part in tokenizers.segments(text):
                        codes.append(np.fromiter(map(numbers.__getitem__, part), np.int32, len(part)))
                        size += len(part)
                    chars += len(text)
                sizes.append(size)
                if chars >= block_chars or len(ids) >= block_chars:
                    yield from block()
                    made += 1
                    ids, sizes, codes, chars, numbers = [], [], [], 0, Numbers()
        if ids:
            yield from block()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return texts.mapInArrow(tidy(blocks), BLOCKS)


def groups_of(segments: list[str], tokenizers: Pair) -> dict[str, pa.Array]:
    """Of each segment: numbers of tokens and groups, the groups as text, and the last tokens of each group, which are linked."""
    sides = [(np.fromiter(chain.from_iterable(x), np.int64), np.fromiter(map(len, x), np.int64, len(x))) for x in tokenizers.encoded(segments)]
    (a, n_a), (b, n_b) = sides
    end_a, end_b = np.cumsum(tokenizers.a_sizes[a]), np.cumsum(tokenizers.b_sizes[b])
    ends = np.cumsum([1 + len(x.encode()) for x in segments])
    if not (np.array_equal(end_a[np.cumsum(n_a) - 1], ends) and np.array_equal(end_b[np.cumsum(n_b) - 1], ends)):
        raise ValueError("the tokens of a segment don't make it up")
    # Segments lie end to end, so each ends in a shared end, and no group spans two.
    shared, last_a, last_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
    n_groups = np.diff(np.searchsorted(shared, ends, "right"), prepend=0)
    group = np.concatenate([np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, group))
    ids, side, group = np.concatenate([a, b])[order], side[order], group[order]
    before = np.where(np.diff(group, prepend=-1) > 0, 1, np.where(np.diff(side, prepend=0) > 0, 2, 3))
    of_segment = n_a + n_b
    starts = np.cumsum(of_segment) - of_segment
    before[starts] = 0
    written_ids = [tokenizers.marked[k][i] for k, i in zip(before.tolist(), ids.tolist(), strict=True)]
    texts = ["".join(written_ids[i : i + n]) for i, n in zip(starts.tolist(), of_segment.tolist(), strict=True)]
    offsets = pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32())
    lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))
    return {**{k: pa.array(v, pa.int32()) for k, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups))}, "groups": pa.array(texts, pa.string()), "last_a": lists(a[last_a]), "last_b": lists(b[last_b])}


def align_segments(segments: DataFrame, both: Callable[[], Pair]) -> DataFrame:
    """segment, n (its occurrences) and what groups_of() gives."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                found = groups_of(part["segment"].to_pylist(), both())
                yield pa.RecordBatch.from_arrays([part["segment"], part["n"], *found.values()], ["segment", "n", *found])

    return segments.mapInArrow(tidy(aligned), "segment string, n long, n_a int, n_b int, n_groups int, groups string, last_a array<int>, last_b array<int>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, links (how many in the corpus link the two), best (whether no other a has more links with b)."""
    links = aligned.select("n", F.explode(F.arrays_zip("last_a", "last_b")).alias("x")).groupBy(F.col("x.last_a").alias("a"), F.col("x.last_b").alias("b")).agg(F.sum("n").alias("links"))
    return links.withColumn("best", (F.col("links") == F.max("links").over(Window.partitionBy("b"))).cast("int"))


def align_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pieces: str = PIECES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document, as a written table."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    both = lambda: pair(vocabulary, pieces)
    with small_batches(docs.sparkSession, BATCH):
        blocks = written(cut_into_blocks(docs, both, block_chars))
        in_block = blocks.where("code IS NOT NULL").select("block", "code", "segment", "n")
        aligned = written(align_segments(in_block.groupBy("segment").agg(F.sum("n").alias("n")), both).withColumn("number", F.monotonically_increasing_id()))
        linked = aligned.select("number", F.explode(F.arrays_zip("last_a", "last_b")).alias("x")).select("number", F.col("x.last_a").alias("a"), F.col("x.last_b").alias("b"))
        sums = linked.join(link_counts(aligned).hint("shuffle_hash"), ["a", "b"]).groupBy("number").agg(F.sum("best").alias("n_best"), F.sum("links").alias("count_sum"))
        # Written, so that the shuffles up to here go before the next ones come.
        known = written(aligned.join(sums.hint("shuffle_hash"), "number").select("segment", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups"))
        dropped(aligned)

        def compose(block: pa.Table, words: pa.Table) -> pa.Table:
            order = np.argsort(words["code"].to_numpy())
            per_segment = {k: words[k].to_numpy()[order].astype(np.int64) for k in ("n_a", "n_b", "n_groups", "n_best", "count_sum")}
            groups = words["groups"].take(pa.array(order)).to_pylist()
            out: dict[str, list] = {k: [] for k in ("doc_id", *per_segment, "groups_sha256")}
            for row in block.to_pylist():
                codes, end = np.frombuffer(zlib.decompress(row["codes"]), np.int32), 0
                for doc_id, size in zip(row["ids"], row["sizes"], strict=True):
                    own, end = codes[end : end + size], end + size
                    out["doc_id"].append(doc_id)
                    for k, v in per_segment.items():
                        out[k].append(int(v[own].sum()))
                    digest = hashlib.sha256()
                    for i in range(0, size, AT_ONCE):
                        digest.update(((";" if i else "") + ";".join(map(groups.__getitem__, own[i : i + AT_ONCE].tolist()))).encode())
                    out["groups_sha256"].append(digest.hexdigest() if size else "")
            return pa.table({k: pa.array(v, pa.string() if k in ("doc_id", "groups_sha256") else pa.int64()) for k, v in out.items()})

        def compose_alone(block: pa.Table, words: pa.Table) -> pa.Table:
            out = compose(block, words)
            give_back()
            return out

        def composed(wave: int) -> DataFrame:
            mine = F.shiftright("block", TASK_BITS) % WAVES == wave
            dictionary = in_block.where(mine).select(F.col("block").alias("of_block"), "code", "segment").join(known.hint("shuffle_hash"), "segment").drop("segment")
            both_sides = blocks.where("code IS NULL").where(mine).select("block", "ids", "sizes", "codes").groupBy("block").cogroup(dictionary.groupBy("of_block"))
            found = both_sides.applyInArrow(compose_alone, "doc_id string, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups_sha256 string")
            # Tokens have at least a byte, so that one of each side ends at a group's end: a group is a link.
            return found.select(F.col("doc_id").cast(id_type).alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")

        # Blocks in waves: the shuffles of one are gone before the next begins.
        out = reduce(DataFrame.unionByName, [written(composed(wave)) for wave in range(WAVES)])
        dropped(blocks, known)
    return out


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
