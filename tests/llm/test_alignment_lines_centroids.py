"""Operators 11 to 13 against brute force: hot keys, ties, nulls, repeated rows, long texts, empty tables, clashing columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankweave.llm import alignment, centroids, line_dedup, shared
from rankweave.llm.shared import BATCH_BYTES

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def clashing(df, *names):
    return df.withColumns({c: F.lit(7) for c in names})


# Operator 13


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_lines(rows):
    last = lambda k: (k is None, k or 0)  # noqa: E731  a missing id comes after all others
    owners = defaultdict(set)
    for k, t in rows:
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= 10:
                owners[line_key(x)].add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        out.append((k, t, [x for x in lines if len(line_key(x)) < 10 or min(owners[line_key(x)], key=last) == k]))
    return out


def line_rows():
    rng = random.Random(3)
    parts = ["A common LINE of the corpus", "  a common line of the corpus\t", "short", "", "\r", "Über den grünen Klee", "über den grünen Klee", "nine char", "ten chars!", " ten chars! ", "\x1cten chars!", "日本語の長い行です。はい"]
    rows = [(i, "\n".join(rng.choice([*parts, f"line number {rng.randint(0, 40)}"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    long = "\n".join(f"line number {i % 977}" for i in range(20_000))
    return [*rows, (70, None), (71, ""), (5, rows[5][1]), (5, "Another text of doc 5\nten chars!" + "\n" * 20), (None, "line number 3\nowned by none"), (None, "owned by none\nalone\nagain"), (72, long), (73, "A" * 100_000), (74, "a" * 100_000)]


@pytest.mark.parametrize("hot_parts", [1, 20, 1000])
def test_op13_bitmaps_against_brute_force(spark, hot_parts):
    docs = clashing(spark.createDataFrame(line_rows(), DOCS).repartition(5), "keep", "pos", "lines", "h", "g", "first_doc", "n_lines", "n")
    runs = {(r.doc_id, r.n_lines): [x for run in r.keep for x in range(run.first, run.first + run.n)] for r in line_dedup.keep_bitmaps(docs, hot_parts=hot_parts).collect()}
    for k, t, kept in brute_lines(line_rows()):
        lines = (t or "").split("\n")
        assert [lines[i] for i in runs.get((k, len(lines)), range(len(lines)))] == kept


def test_op13_texts_keep_other_columns(spark):
    docs = clashing(spark.createDataFrame(line_rows(), DOCS).repartition(3), "keep", "doc", "of_id")
    got = line_dedup.without_shared_lines(docs)
    assert got.columns == docs.columns
    want = Counter((k, t if len(kept) == len((t or "").split("\n")) else "\n".join(kept)) for k, t, kept in brute_lines(line_rows()))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    none = docs.limit(0)
    assert line_dedup.without_shared_lines(none).count() == line_dedup.keep_bitmaps(none).count() == 0


# Operator 11


def brute_centroids(rows, k=16, rounds=3, dim=64):
    fits = lambda v: v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) < centroids.LARGEST // 64 for x in v)
    own = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if fits(v)]
    order = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in own:
            groups[nearest(v)[1]].append(v)
        now = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if groups[j] else c for j, c in enumerate(now)]
    found = [(i, *nearest(v)[::-1]) for i, v in own]
    return found, now


def vectors(n, spread, seed=1):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.5) for _ in range(64)] for _ in range(12)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("rows", [vectors(700, 0.02), vectors(400, 0.4), vectors(9, 0.2)], ids=["tight", "loose", "few"])
def test_op11_against_brute_force(spark, rows):
    big = [2.0**20 * (1 if i % 2 else -1) for i in range(64)]
    odd = [(9_000, None), (9_001, []), (9_002, [0.1] * 63), (9_003, [0.1] * 63 + [None]), (9_004, [float("nan")] + [0.0] * 63), (9_005, [float("inf")] + [0.0] * 63), (9_006, [2.0**21] * 64)]
    same = [(3, rows[3][1]), (3, rows[3][1]), (None, rows[1][1]), (2**53 + 1, rows[2][1]), (8_000, [0.0] * 64), (8_001, [0.0] * 64), (8_002, big)]
    df = clashing(spark.createDataFrame([*rows, *odd, *same], "vec_id long, embedding array<double>").repartition(4), "cluster", "q", "ids", "distance")
    got, now = centroids.cluster(df)
    want, middles = brute_centroids([*rows, *odd, *same])
    assert now == middles
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_op11_trees_and_empty_table(spark):
    rows = vectors(centroids.TREE_SIZE + 300, 0.05, seed=4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    trees = centroids.plant(centroids.integer_vectors(df, 64, 64)).collect()
    assert sorted(len(t.ids) for t in trees) == [300, centroids.TREE_SIZE]
    for row in trees:
        tree = centroids.Tree(row, 64)
        for (a, b), left, radius, total in zip(tree.span, tree.left, tree.radius, tree.sum, strict=True):
            assert (tree.points[a:b].sum(axis=0) == total).all() and b > a
            off = tree.points[a:b] - total / (b - a)
            assert (off**2).sum(axis=1).max() <= radius**2 + 1e-6
            assert left < 0 or (tree.span[left][0], tree.span[left + 1][1]) == (a, b)
    # Tight balls go whole to a centroid; the rest is compared one by one.
    balls, owners, points, _ = tree.assigned(centroids.np.array([tree.points[0], tree.points[-1]]))
    assert tree.count[balls].sum() + len(points) == len(tree.points) and len(balls)
    got, now = centroids.cluster(df.limit(0))
    assert now == [] and got.count() == 0


# Operator 12


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute_alignment(rows, a_side, b_side):
    letters = alignment.byte_letters()
    names = {i: t for t, i in a_side.get_vocab().items()}
    of_a = lambda i: bytes(letters[c] for c in names[i])
    of_b = lambda i: bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for k, text in rows:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        if b"".join(map(of_a, a)) != (" " + text).encode() if text else True:
            a = b = []
        if b and b"".join(map(of_b, b)) != (" " + text).encode():
            a = b = []
        at = {}
        for side, ids, size in ((0, a, of_a), (1, b, of_b)):
            n = 0
            for place, i in enumerate(ids):
                n += len(size(i))
                at.setdefault(n, {})[side] = place
        groups, links, i, j = [], [], 0, 0
        for n in sorted(n for n, x in at.items() if len(x) == 2):
            p, q = at[n][0], at[n][1]
            groups.append(",".join(map(str, a[i : p + 1])) + "|" + ",".join(map(str, b[j : q + 1])))
            links.append((a[p], b[q]))
            i, j = p + 1, q + 1
        counts.update(links)
        docs.append((k, len(a), len(b), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    digest = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return Counter((k, na, nb, len(g), len(x), sum(counts[y] == best[y[1]] for y in x), sum(counts[y] for y in x), digest(g)) for k, na, nb, g, x in docs)


def test_op12_query_against_brute_force(spark, tokenizers):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, alignment.op12_alignment(spark, SF).collect())) == brute_alignment(rows, *tokenizers)


def test_op12_odd_texts_against_brute_force(spark, tokenizers):
    rng = random.Random(5)
    parts = ["a", "b", "the", "The", " ", "  ", "\n", "\t", "▁", "é", "日本", "\x85", "᠎", "​", "​", "'s", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "1", "23", "!", "\r\n", "\xa0", "　", "\0", "😀", "\x1c", "ab ab", "."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    rows += [(3000, None), (3001, ""), (3002, " "), (3003, "   "), (3004, "x  y " * 300_000), (3005, "no" * 3_000), (None, "no id"), (7, "again"), (7, "again")]
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(4), "block", "codes", "segment", "n", "number")
    assert Counter(map(tuple, alignment.align_documents(df, block_chars=3000).collect())) == brute_alignment(rows, *tokenizers)
    assert alignment.align_documents(df.limit(0)).count() == 0


def test_op12_rows_stay_small_beside_a_large_vocabulary(spark, monkeypatch):
    """A block's segments are a row each, not one row that grows with them, and what goes to Python is bounded."""
    words = [f"w{i}" for i in range(30_000)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "w7 w7 w8"), (3, None)], DOCS).coalesce(1)
    rows = alignment.cut_into_blocks(df, lambda: alignment.pair(alignment.VOCABULARY, alignment.PIECES), alignment.BLOCK_CHARS).collect()
    assert [(r.ids, r.sizes) for r in rows if r.code is None] == [(["1", "2", "3"], [30_000, 3, 0])]
    assert [(r.code, r.segment, r.n) for r in rows if r.code is not None] == [(i, x, 3 if i == 7 else 2 if i == 8 else 1) for i, x in enumerate(words)]
    real, seen, before = alignment.written, [], spark.conf.get(BATCH_BYTES)
    monkeypatch.setattr(alignment, "written", lambda df: seen.append(spark.conf.get(BATCH_BYTES)) or real(df))
    assert alignment.align_documents(df).count() == 3
    assert seen and set(seen) == {str(alignment.BATCH)} and spark.conf.get(BATCH_BYTES) == before


def test_workers_give_memory_back_at_the_end(monkeypatch):
    """Once, after the last batch, when what the function held is free."""
    done, kept = [], []
    monkeypatch.setattr(shared, "give_back", lambda: done.append(len(kept)))

    def run(batches):
        for x in batches:
            kept.append(x)
            yield x
        kept.clear()

    for i, x in enumerate(shared.tidy(run)(iter(range(3)))):
        assert x == i and not done
    assert done == [0]
    monkeypatch.undo()
    shared.give_back()


def test_op12_cuts_hold_for_every_character(tokenizers):
    a_side, b_side = tokenizers
    both = alignment.pair(alignment.VOCABULARY, alignment.PIECES)
    for code in range(1, 0x3100):
        c = chr(code)
        parts = both.cut.split(f"a{c} b")
        whole = a_side.encode(f" a{c} b", add_special_tokens=False).ids, b_side.encode(f"a{c} b")
        assert both.unchanged(f"a{c} b") == (c != "▁")
        if c != "▁":
            one, two = both.encoded(parts)
            assert (sum(one, []), sum(two, [])) == whole
