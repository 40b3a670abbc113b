"""The pipeline's near-duplicate stage, row by row, against brute force over all pairs of texts."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
from rankweave.llm import jaccard


def shingles(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    texts = sorted({t for _, t in rows if shingles(t)})
    leader = {t: t for t in texts}

    def top(t):
        while leader[t] != t:
            t = leader[t]
        return t

    sets = {t: shingles(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                leader[top(a)] = top(b)
    groups = defaultdict(set)
    for k, t in rows:
        if shingles(t):
            groups[top(t)].add(((k is None, k or 0), t))
    return groups, Counter((k, t) for k, t in rows if not shingles(t))


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(rng.randint(1, 4)):
            t = list(b)
            if rng.random() < 0.7:
                t[rng.randrange(60)] = rng.choice(words)
            rows.append((rng.choice([None, *range(40)]), " ".join(t)))
    t, other, z = (" ".join(x) for x in base[:3])
    rows += [(1, t), (5, t), (5, other), (7, z), (7, z), (None, t), (None, "only " + z[:20]), (9, None), (9, None), (10, ""), (11, " \n "), (12, "Two words"), (13, "two WORDS"), (None, "two words")]
    docs = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    groups, wordless = brute(rows)
    assert Counter((r.doc_id, r.text) for r in got if not shingles(r.text)) == wordless
    kept = [((r.doc_id is None, r.doc_id or 0), r.text) for r in got if shingles(r.text)]
    assert len(kept) == len(groups)
    for members in groups.values():
        own = [m for m in members if m in kept]
        assert len(own) == 1 and own[0][0] == min(members)[0]
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_copies_of_a_text_are_one_node(spark, monkeypatch):
    """Rows of nodes don't grow with copies, whose pairs would grow with the square; other texts stay out by the bitmap before any shuffle."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    t = [rng.choice(words) for _ in range(160)]
    near = [" ".join(t[:k] + ["edit"] + t[k + 1 :]) for k in (20, 40, 60)]
    rows = [(i, x) for i, x in enumerate([*near * 50, *(" ".join(rng.choice(words) + str(i) for _ in range(40)) for i in range(30))])]
    docs = spark.createDataFrame([(k, x, "en", "s", 1) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    real, seen = jaccard.links_of, []
    monkeypatch.setattr(jaccard, "links_of", lambda nodes, *rest: seen.append((nodes.count(), nodes.select("node").distinct().count())) or real(nodes, *rest))
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == [0, *range(150, 180)]
    assert seen[0][0] == seen[0][1] >= 3
    plan = jaccard.node_table(docs.select("doc_id", "text"), spark.createDataFrame([(3,), (4,)], "node long"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
