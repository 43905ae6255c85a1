"""The scale-oriented rewrites give the same answers as brute force.

Salted top-n, block-bucketed co-occurrence, degree-ordered wedge counting,
bucketed prefix sums and the histogram-refined sampler are checked on
random inputs with a hot key (a third of all rows in one group).
"""
import itertools
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from postlytics.operators import encode as en
from postlytics.operators import frames as fr
from postlytics.operators import graph as gr


def test_salted_top_n_equals_window(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randint(1, 20), i, rng.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, id long, v int")
    order = [F.col("v").desc(), F.col("id")]
    got = {(r.g, r.id, r["rank"]) for r in fr.top_n_per_group(df, ["g"], order, 7).collect()}
    w = Window.partitionBy("g").orderBy(*order)
    exp = {(r.g, r.id, r.rk) for r in df.withColumn("rk", F.row_number().over(w))
           .where("rk <= 7").collect()}
    assert got == exp


def test_cooccurrence_equals_brute_force(spark):
    rng = random.Random(5)
    posts = [(i, [f"#t{rng.randint(0, 9)}" for _ in range(rng.randint(0, 30 if i else 200))])
             for i in range(60)]
    df = spark.createDataFrame(posts, "post_id long, tags array<string>")
    for w in (1, 3, 5):
        exp = {}
        for pid, tags in posts:
            seen = set()
            for i, j in itertools.combinations(range(len(tags)), 2):
                if j - i <= w and tags[i] != tags[j]:
                    seen.add((min(tags[i], tags[j]), max(tags[i], tags[j])))
            for e in seen:
                exp[e] = exp.get(e, 0) + 1
        got = {(r.src, r.dst): r.weight for r in gr.cooccurrence_edges(df, window=w).collect()}
        assert got == exp


def test_common_neighbors_equals_brute_force(spark):
    rng = random.Random(7)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = {tuple(sorted(("n00", n))) for n in nodes[1:]}  # a hub adjacent to all
    edges |= {tuple(sorted(rng.sample(nodes[1:], 2))) for _ in range(120)}
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, dst string, weight long")
    adj = {n: set() for n in nodes}
    for a, b in edges:
        adj[a].add(b)
        adj[b].add(a)
    got = {(r.src, r.dst): r.common for r in gr.common_neighbors(df).collect()}
    assert got == {(a, b): len(adj[a] & adj[b]) for a, b in edges}


def test_prefix_sum_equals_cumsum(spark):
    rng = random.Random(9)
    rows = [(i * 3 + rng.randint(0, 2), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r.k: r.offset for r in en.prefix_sum(df, "k", "v", buckets=16).collect()}
    acc, exp = 0, {}
    for k, v in sorted(rows):
        exp[k] = acc
        acc += v
    assert got == exp


def executed_plan(df):
    """The plan of ``df`` as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_segmentation_broadcasts_nothing(spark):
    """Words, candidates and segmented tags grow with the corpus."""
    from postlytics.operators import embed as em
    from postlytics.operators import segment as sg
    counts = sg.unigram_counts(spark.createDataFrame([("machine learning learning",), ("deep",)], "text string"))
    tags = spark.createDataFrame([("#machinelearning",), ("#zz",), ("#",), (None,)], "tag string")
    seg = sg.segment(tags, "tag", counts)
    assert "Broadcast" not in executed_plan(seg)
    assert {tuple(r) for r in seg.collect()} == {
        ("#machinelearning", "machine learning"), ("#zz", "z z"), ("#", ""), (None, None)}
    posts = spark.createDataFrame([(1, ["#machinelearning", "#zz"]), (2, None)], "post_id long, tags array<string>")
    mean = em.mean_embedding(posts, "post_id", "tags", em.HashedNgramEmbedder(8), segmenter=sg.segmenter(counts))
    assert "BroadcastHashJoin [element" not in executed_plan(mean)
    rows = {r["post_id"]: r["embedding"] for r in mean.collect()}
    assert len(rows[1]) == 8 and rows[2] is None


def test_wedges_and_candidates_travel_as_lists(spark):
    """no row is sent for every wedge, nor for every pair of a candidate and a tag."""
    tags = [f"#t{i:02d}" for i in range(12)]
    pairs = [p for p in itertools.combinations(tags, 2) if hash_free(p)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, weight long")
    near = {t: {b if a == t else a for a, b in pairs if t in (a, b)} for t in tags}
    cn = gr.common_neighbors(edges)
    got = {(r["src"], r["dst"]): (r["ds"], r["dd"], r["common"]) for r in cn.collect()}
    assert got == {(a, b): (len(near[a]), len(near[b]), len(near[a] & near[b])) for a, b in pairs}
    assert not re.search(r"hashpartitioning\(a#\d+, b#\d+", executed_plan(cn))
    inter = spark.createDataFrame([(1, "#t00"), (1, "#t01"), (1, "#t01"), (2, "#none"), (3, "#t05")],
                                  "user_id long, tag string")
    sim = spark.createDataFrame([(t, s, 0.5, 1) for t in tags for s in sorted(near[t])[:4]],
                                "query string, neighbor string, score double, rank int")
    out = gr.recommend(edges, inter, 3, sim)
    assert not re.search(r"hashpartitioning\(tag#\d+, cand#\d+", executed_plan(out))
    exp = set()
    for user, own in ((1, {"#t00", "#t01"}), (3, {"#t05"})):
        cand = {s for t in own for s in sorted(near[t])[:4]} - own
        best = sorted(cand, key=lambda c: (-len(near[c] & own), c))[:3]
        exp |= {(user, c, len(near[c] & own), k + 1) for k, c in enumerate(best)}
    assert {(r["user_id"], r["tag"], r["score"], r["rank"]) for r in out.collect()} == exp


def hash_free(pair):
    """A fixed choice of pairs: about two of three."""
    return (int(pair[0][2:]) * 7 + int(pair[1][2:])) % 3 != 0


def test_rare_tokens_alone_are_joined(spark):
    """a vocabulary above the limit still serves its frequent tokens as a dictionary."""
    rows = [(i, [f"w{j % 3}" for j in range(20)] + [f"r{i}", f"r{i}", None]) for i in range(30)]
    rows += [(7, ["w0", "rx"]), (7, ["w0", "rx"]), (None, ["rx", "w1"]), (99, []), (100, None)]
    df = spark.createDataFrame(rows, "post_id long, tokens array<string>")
    vocab = en.build_vocab(df, "tokens").where("token != 'r3'")
    size = vocab.agg(F.sum(F.octet_length("token") + 100)).first()[0]
    known = {r["token"]: r["id"] for r in vocab.collect()}
    exp = sorted(str((i, [known.get(t, en.UNK_ID) for t in ts or []])) for i, ts in rows)
    for limit in (size, size // 4, 0):
        got = en.token_ids(df, "post_id", "tokens", vocab, dictionary_bytes=limit)
        assert got.columns == ["post_id", "tokens", "ids"]
        assert sorted(str((r["post_id"], list(r["ids"]))) for r in got.collect()) == exp
    assert "posexplode" not in executed_plan(en.token_ids(df, "post_id", "tokens", vocab, dictionary_bytes=0))


def test_stems_are_worked_out_once_per_batch(spark, monkeypatch):
    """a worker's memory follows the distinct tokens of a batch, not all of them."""
    from postlytics.operators import stem as st
    monkeypatch.setattr(st, "KNOWN_STEMS", 2)
    rows = [(1, ["running", "runs", "running", "flies"]), (2, None), (3, []), (4, ["flies"] * 3)]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    out = st.stem_tokens(df, "id", "t", "s")
    assert {r["id"]: list(r["s"]) for r in out.collect()} == {
        i: [st.porter_stem(t) for t in ts or []] for i, ts in rows}
    assert "ArrowEvalPython" in executed_plan(out) and not hasattr(st, "pd")
