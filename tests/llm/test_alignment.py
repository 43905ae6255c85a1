import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from helpers import EDGE, edge_docs, no_docs, random_texts
from tokenizers import Tokenizer

from postlytics.llm import alignment as op
from postlytics.llm.common import table
from postlytics.llm.tokens import BYTES

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    t.no_truncation()
    return t, sentencepiece.SentencePieceProcessor(model_file=MODEL), {c: b for b, c in BYTES.items()}


def slow(tools, text):
    """(ids of A, ids of B, groups of index lists) by offsets, or None."""
    t, sp, back = tools
    if not text:
        return None
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    bytes_a = [bytes(back[c] for c in t.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
               for p in map(sp.id_to_piece, b)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum(list(map(len, bytes_a))), np.cumsum(list(map(len, bytes_b)))
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    groups = [([], []) for _ in cuts]
    for ends, side in ((ends_a, 0), (ends_b, 1)):
        for i, at in enumerate(np.searchsorted(cuts, ends)):
            groups[at][side].append(i)
    return a, b, groups


def brute(tools, rows):
    made = [slow(tools, t) for _, t in rows]
    links = [Counter((x[0][i], x[1][j]) for i_s, j_s in x[2] for i in i_s for j in j_s) if x else {} for x in made]
    n = Counter(p for k in links for p in k)
    most = defaultdict(int)
    for (a, _), c in n.items():
        most[a] = max(most[a], c)
    out = []
    for (d, _), x, k in zip(rows, made, links):
        said = ";".join(",".join(str(x[0][i]) for i in i_s) + "|" + ",".join(str(x[1][j]) for j in j_s)
                        for i_s, j_s in x[2]) if x else ""
        out.append((str(d), len(x[0]) if x else 0, len(x[1]) if x else 0, len(x[2]) if x else 0,
                    sum(k.values()), sum(c for p, c in k.items() if n[p] == most[p[0]]),
                    sum(c * n[p] for p, c in k.items()),
                    hashlib.sha256(said.encode()).hexdigest() if x else ""))
    return sorted(out)


def digests(df, **how):
    got = op.with_counts(op.align(df, JSON, MODEL), **how).collect()
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                  for r in got)


ODD = ["<|endoftext|> a <s> b</s>", "▁ under", "tab\tline\n\n  two", " lead", "ﬁ ligature é é", "日本語のテキスト 👩‍👩‍👧",
       "a" * 700, "=" * 333, "ab" * 500 + " " * 40 + "x", "\x00nul", " sep", "Ünï ñ" * 50, "1234567890" * 9]


@pytest.mark.parametrize("hot,block", [(op.HOT_PAIRS, op.BLOCK_BYTES), (60, 500), (0, 40)])
def test_against_brute_force(spark, tools, monkeypatch, hot, block):
    monkeypatch.setattr(op, "BLOCK_BYTES", block)
    monkeypatch.setattr(op, "PIECES", block)
    texts = ODD + random_texts(4, 80)
    rows = EDGE + [(100 + i, t) for i, t in enumerate(texts)] + [((1 << 60) + 1, ODD[4])]
    docs = edge_docs(spark).select("doc_id", "text", "n", "h").unionByName(
        spark.createDataFrame([(d, t, "n", "h") for d, t in rows[len(EDGE):]],
                              "doc_id long, text string, n string, h string"))
    assert digests(docs, hot_pairs=hot) == brute(tools, rows)


def test_given_documents(spark, tools):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = brute(tools, [(r.doc_id, r.text) for r in docs.collect()])
    assert digests(docs) == want and sum(w[4] > 0 for w in want) > 100
    assert digests(no_docs(spark)) == []


def test_products_equal_dense_ones():
    rnd = np.random.default_rng(1)
    for most in (1, 7, 1000):
        for _ in range(30):
            h, k, w = rnd.integers(1, 9, 3)
            x, y = rnd.integers(0, 3, (h, k)), rnd.integers(0, 3, (k, w))

            def sparse(m):
                i, j = np.nonzero(m)
                order = rnd.permutation(len(i))
                return op.CSR.of_pairs(i[order], j[order], m[i, j][order], *m.shape)

            def dense(s):
                out = np.zeros((s.height, s.width), int)
                out[s.rows(), s.indices] = s.data
                return out
            assert (dense(sparse(x).transposed()) == x.T).all()
            assert (dense(sparse(x).times(sparse(y), most)) == x @ y).all()


def test_groups_end_where_both_sides_end():
    # 3+2+4 bytes against 2+3+1+3: both end after 5 and 9
    met = op.Aligned(np.array([1, 2, 3]), np.array([0, 1, 2, 1]), np.array([0, 3, 2, 4]), np.array([2, 3, 1]),
                     np.zeros(3, int), np.zeros(4, int))
    assert met.overlaps.rows().tolist() == [0, 0, 1, 2, 2]
    assert met.overlaps.indices.tolist() == [0, 1, 1, 2, 3] and met.overlaps.data.tolist() == [2, 1, 2, 1, 3]
    assert met.a_group.tolist() == [0, 0, 1] and met.b_group.tolist() == [0, 0, 1, 1]
    _, pairs, times = met.pairs()
    assert dict(zip(pairs.tolist(), times.tolist())) == {
        1 << 32: 1, 1 << 32 | 1: 1, 2 << 32: 1, 2 << 32 | 1: 1, 3 << 32 | 1: 1, 3 << 32 | 2: 1}


def test_overlaps_count_shared_bytes():
    rnd = random.Random(2)
    sizes = np.arange(1, 6)   # id i has i + 1 bytes
    for _ in range(50):
        texts = []
        for _ in range(rnd.randint(0, 4)):
            n = rnd.randint(1, 30)
            cut = lambda: np.diff([0, *sorted(rnd.sample(range(1, n), rnd.randint(0, n - 1))), n])
            a, b = cut(), cut()
            while a.max() > 5:
                a = cut()
            while b.max() > 5:
                b = cut()
            texts.append((a - 1, b - 1))
        flat = [np.concatenate([np.zeros(0, int), *x]) for x in ([a for a, _ in texts], [b for _, b in texts])]
        owner = [np.repeat(np.arange(len(texts)), [len(x) for x in y]) for y in ([a for a, _ in texts], [b for _, b in texts])]
        met = op.Aligned(*flat, sizes, sizes, *owner)
        want, at_a, at_b = Counter(), 0, 0
        for a, b in texts:
            rows, cols = np.repeat(np.arange(len(a)), a + 1), np.repeat(np.arange(len(b)), b + 1)
            want.update(zip((rows + at_a).tolist(), (cols + at_b).tolist()))
            at_a, at_b = at_a + len(a), at_b + len(b)
        got = dict(zip(zip(met.overlaps.rows().tolist(), met.overlaps.indices.tolist()),
                       met.overlaps.data.tolist()))
        assert got == dict(want)
