import random
import re

import pytest
import xxhash
from helpers import EDGE, docs_of, edge_docs, no_docs, random_texts

from postlytics.llm.line_dedup import dedup_lines


def chunks(text, divisor):
    """(first line, last line, content) of the chunks between boundaries."""
    full = [(i, x) for i, x in enumerate(text.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
    ends = [k for k, (_, x) in enumerate(full) if xxhash.xxh64_intdigest(x.encode(), 42) % divisor == 0]
    return [(full[a][0], full[b][0], tuple(x for _, x in full[a:b + 1])) for a, b in zip(ends, ends[1:])]


def brute(rows, divisor=1):
    """rows with distinct (id, text)."""
    first = {}
    out = []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for a, b, c in chunks(t or "", divisor):
            if first.setdefault(c, (d, a)) != (d, a):
                gone.update(range(a, b + 1))
        out.append((str(d), len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out)


def made(df, **how):
    return sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept) for r in dedup_lines(df, **how).collect())


def test_edge_rows(spark):
    rows = [r for i, r in enumerate(EDGE) if r not in EDGE[:i]]
    assert made(edge_docs(spark).dropDuplicates(["doc_id", "text"])) == brute(rows)
    assert len(made(edge_docs(spark))) == len(EDGE)
    assert dedup_lines(no_docs(spark)).count() == 0


@pytest.mark.parametrize("seed,divisor", [(1, 1), (2, 1)])
def test_against_brute_force(spark, seed, divisor):
    texts = random_texts(seed, 120)
    want = brute(list(enumerate(texts)), divisor)
    assert made(docs_of(spark, texts), divisor=divisor) == want
    assert any(w[2] for w in want)


def planted(seed, docs=200):
    """Documents of lines that occur once, with passages of 2 to 9 lines planted in several of
    them, at any place; -> (texts, lines of the passages but for their first occurrence)."""
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 6) for _ in range(8)) + f" {rnd.random()}"
    passages = [[line() if rnd.random() < 0.8 else "" for _ in range(rnd.randint(2, 9))] for _ in range(30)]
    passages = [[line(), *p[1:-1], line()] for p in passages]
    texts, again, seen = [], [], set()
    for _ in range(docs):
        lines = [line() for _ in range(rnd.randint(0, 12))]
        late = set()
        if rnd.random() < 0.5:
            k, at = rnd.randrange(len(passages)), rnd.randint(0, len(lines))
            lines[at:at] = passages[k]
            if k in seen:
                late = set(range(at, at + len(passages[k])))
            seen.add(k)
        texts.append("\n".join(lines))
        again.append(late)
    return texts, again


def test_planted_passages_go_and_nothing_else(spark):
    texts, again = planted(7)
    got = {r.doc_id: r for r in dedup_lines(docs_of(spark, texts)).collect()}
    assert sum(map(len, again)) > 100
    for i, (text, late) in enumerate(zip(texts, again)):
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in late)
        assert got[i].kept == left and got[i].n_removed == len(late)


def test_blocks_of_one_line_and_exact_copies(spark):
    block = "\n".join(["all rights reserved"] * 40)
    texts = [block, "before\n" + block + "\nafter", "once\nonly\n\n\nhere", "once\nonly\n\n\nhere", "\n\n\n", "\n\n\n"]
    got = [(r.n_removed, r.kept) for r in dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == (39, "all rights reserved") and got[1] == (40, "before\nafter")
    assert got[2][0] == 0 and got[3] == (5, "") and got[4] == got[5] == (0, "\n\n\n")


def test_fewer_boundaries_still_find_long_passages(spark):
    rnd = random.Random(2)
    shared = [f"shared line {rnd.random()}" for _ in range(60)]
    texts = ["\n".join([f"own {i} {k}" for k in range(5)] + shared + [f"end {i}"]) for i in range(2)]
    got = [r.n_removed for r in dedup_lines(docs_of(spark, texts), divisor=3).orderBy("doc_id").collect()]
    assert got[0] == 0 and 40 <= got[1] <= 60
