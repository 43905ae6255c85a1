"""Operator 3, SimHash near-dedup through vantage-point trees.

A tree node holds a vantage point v and a distance mu: fingerprints within mu of v go
left, the others right. By the triangle inequality a right fingerprint within the link
distance r of some left one is at most mu + r from v, so it goes left as well
(boundary overlap); any two linked fingerprints thus meet in some leaf, and leaves are
searched exactly. A tree fitted on a bounded sample deals the distinct fingerprints to
shards, and each shard goes on with trees over its own fingerprints.

On whole 64-bit fingerprints of unlike texts the bounds hardly prune (distances are
32 +- 4, as wide as r = 4). So the metric is the Hamming distance on a band of the bits:
of ``BANDS`` bands one differs in at most r // BANDS bits, and there is a tree for each
band. A leaf still too large goes on with the other bands in the same way. Every link
is decided on all 64 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm.common import register, stored, table, whole_id, with_nulls
from postlytics.llm.components import components

SHINGLE = 4
MAX_BITS = 4
BANDS = 4
SAMPLE = 20_000       # fingerprints that the routing trees are fitted on
SHARD_ROWS = 8_000    # fingerprints aimed at in a shard
LEAF = 512            # fingerprints compared all with all
SEED = 42
STEP = 1 << 16        # shingles whose bits are counted at a time


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a whole text (A-Z lower-cased)."""
    import numpy as np
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(parts)
    if not n:
        return 0
    whole = b" ".join(parts)
    length = np.fromiter(map(len, parts), np.int64, n)
    end = np.cumsum(length + 1) - 1
    start = end - length
    if n > words:
        start, end = start[:n - words + 1], end[words - 1:]
    else:
        start, end = start[:1], end[-1:]
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(start), STEP):
        h = np.array([xxh64_intdigest(whole[i:j], SEED) for i, j in
                      zip(start[lo:lo + STEP].tolist(), end[lo:lo + STEP].tolist())], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(start)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def band(values, i: int, of: int):
    """Band ``i`` of ``of`` bands of uint64 fingerprints."""
    import numpy as np

    lo, hi = 64 * i // of, 64 * (i + 1) // of
    return (values >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)


def best_split(values, vantage, r: int):
    """(distances, mu) with the least work left, or None if no mu shrinks both sides."""
    import numpy as np

    d = np.bitwise_count(values ^ vantage)
    upto = np.cumsum(np.bincount(d, minlength=66 + r))
    n = len(values)
    left, right = upto[r:r + 65], n - upto[:65]
    work = left.astype(float) ** 2 + right.astype(float) ** 2
    work[(left > 0.95 * n) | (right > 0.95 * n)] = np.inf
    mu = int(work.argmin())
    return (d, mu) if np.isfinite(work[mu]) else None


class Tree:
    """A vantage-point tree over band values; routes values to leaves."""

    def __init__(self, values, r: int, leaf: int):
        import numpy as np

        self.r, self.nodes, self.leaves = r, [], 0
        todo = [(np.asarray(values), None)]
        while todo:
            part, link = todo.pop()
            split = best_split(part, part[len(part) // 2], r) if len(part) > leaf else None
            at = len(self.nodes)
            if link:
                self.nodes[link[0]][link[1]] = at
            if split is None:
                self.nodes.append([None, self.leaves, None, None])
                self.leaves += 1
                continue
            d, mu = split
            self.nodes.append([part[len(part) // 2], mu, None, None])
            todo += [(part[d <= mu + r], (at, 2)), (part[d > mu], (at, 3))]

    def route(self, values):
        """(leaf, indices of the values that belong to it or overlap it)."""
        import numpy as np

        todo = [(0, np.arange(len(values)))]
        while todo:
            at, rows = todo.pop()
            vantage, mu, left, right = self.nodes[at]
            if vantage is None:
                yield mu, rows
                continue
            d = np.bitwise_count(values[rows] ^ vantage)
            for child, some in ((left, rows[d <= mu + self.r]), (right, rows[d > mu])):
                if len(some):
                    todo.append((child, some))


def _label(values, r: int):
    """Smallest index reachable from each by links of at most r bits; all pairs of a small leaf."""
    import numpy as np

    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= r
    label = np.arange(len(values))
    if near.sum() == len(values):
        return label
    while True:
        new = np.where(near, label[None, :], len(values)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def _flood(values, r: int):
    """As ``_label`` for large leaves: linked fingerprints leave the search at once, so a
    dense group costs a few scans and never its pairs."""
    import numpy as np

    n = len(values)
    label, rest = np.arange(n), np.arange(n)
    while len(rest):
        root, rest = rest[0], rest[1:]
        todo = [root]
        while todo and len(rest):
            near = np.bitwise_count(values[rest] ^ values[todo.pop()]) <= r
            if near.any():
                found = rest[near]
                label[found] = root
                todo += found.tolist()
                rest = rest[~near]
    return label


def links(values, r: int, bands: int, used: tuple[int, ...], leaf: int = LEAF):
    """Edges (index, index) that span all groups of fingerprints linked by <= r bits and by
    the pigeonhole bound of the bands that are not ``used``."""
    import numpy as np

    n = len(values)
    if n < 2:
        return []
    free = [b for b in range(bands) if b not in used]
    if n <= leaf or not free:
        label = _label(values, r) if n <= leaf else _flood(values, r)
        i = np.nonzero(label != np.arange(n))[0]
        return [(i, label[i])]
    out = []
    for b in free:
        some = band(values, b, bands)
        for _, rows in Tree(some, r // len(free), leaf).route(some):
            # a leaf that no vantage point splits any more goes on with the other bands
            out += [(rows[i], rows[j]) for i, j in
                    links(values[rows], r, bands, used + (b,), leaf)]
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, h): SimHash, and a hash of the text that tells rows of one id apart."""
    def run(batches):
        for pdf in batches:
            yield pdf[["doc_id", "no_id"]].assign(fp=[fingerprint(t, words) for t in pdf["text"]],
                                                  h=pdf["h"])

    rows = docs.select(*whole_id(id_col), F.col(text_col).alias("text"),
                       F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    return with_nulls(rows.mapInPandas(run, "doc_id long, no_id boolean, fp long, h long"))


def link_edges(fps: DataFrame, r: int = MAX_BITS, bands: int = BANDS,
               shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct fingerprints (column fp) -> edges (u, v) that span the link graph's groups."""
    import numpy as np

    total = fps.count()
    every = max(1, total // SAMPLE)
    sample = np.array(
        [x.fp for x in fps.filter(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(every)) == 0)
         .select("fp").limit(2 * SAMPLE).collect()] or [0], "<i8").view("<u8")
    leaf = max(16, int(len(sample) * shard_rows / max(total, 1)))
    trees = [Tree(band(sample, b, bands), r // bands, leaf) for b in range(bands)]
    first = [sum(t.leaves for t in trees[:b]) for b in range(bands)]

    def deal(batches):
        import pandas as pd

        for pdf in batches:
            v = pdf["fp"].to_numpy("<i8").view("<u8")
            for b, tree in enumerate(trees):
                for at, rows in tree.route(band(v, b, bands)):
                    yield pd.DataFrame({"shard": first[b] + at,
                                        "b": b, "fp": v[rows].view("<i8")})

    def link(pdf):
        import pandas as pd

        v = pdf["fp"].to_numpy("<i8").view("<u8")
        # the shard's own band first; then, in leaves that are still large, the others
        b = int(pdf["b"].iloc[0])
        some, found = band(v, b, bands), []
        for _, rows in Tree(some, r // bands, LEAF).route(some):
            found += [(rows[i], rows[j]) for i, j in links(v[rows], r, bands, (b,))]
        i = np.concatenate([x for x, _ in found]) if found else np.zeros(0, int)
        j = np.concatenate([x for _, x in found]) if found else np.zeros(0, int)
        return pd.DataFrame({"u": v[i].view("<i8"), "v": v[j].view("<i8")}).drop_duplicates()

    return (fps.select("fp").mapInPandas(deal, "shard int, b int, fp long")
            .groupBy("shard").applyInPandas(link, "u long, v long"))


def near_groups(docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS,
                id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id
    (smallest doc_id reachable over links of at most ``max_bits`` bits), kept.

    Texts without words (null, empty, blank) have fingerprint zero, which links like any
    other. ``kept`` is true for the row with the component's smallest id (of several texts
    with that id, one); null ids come last, and a component of null ids only has a null
    component_id. Rows repeated in full share the verdict. Other columns are ignored; an
    empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, words, id_col, text_col))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = stored(fps.groupBy("fp").agg(F.min(who).alias("who")))
    roots = components(stored(link_edges(classes, max_bits)))
    joined = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    alone = joined.filter("component IS NULL").select("fp", "who")
    linked = joined.filter("component IS NOT NULL")
    best = linked.groupBy("component").agg(F.min("who").alias("best"))
    of = alone.unionByName(linked.join(best, "component").select("fp", F.col("best").alias("who")))
    return fps.join(of, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("who.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("who.doc_id")) & (F.col("h") == F.col("who.h")))
        .alias("kept"), *(["h"] if with_hash else []))


def keep_near(docs: DataFrame, words: int = SHINGLE, max_bits: int = MAX_BITS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``near_groups`` does not keep; all columns stay."""
    gone = (near_groups(docs, words, max_bits, id_col, text_col, with_hash=True)
            .filter(~F.col("kept")).select("doc_id", "h").distinct().alias("g"))
    rows = docs.withColumn("_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).alias("d")
    return rows.join(gone, F.col(f"d.{id_col}").eqNullSafe(F.col("g.doc_id"))
                     & (F.col("d._h") == F.col("g.h")), "left_anti").select(*docs.columns)


@register("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 4-word shingles, links of at most 4 bits.
    SQL has no XXH64: the tests check fingerprints and all pairs by brute force."""
    return near_groups(table(spark, sf_dir, "documents"))
