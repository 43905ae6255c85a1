"""Operator 9, removal of long byte strings that occur twice, by suffix sorting.

Sorting all suffixes of a corpus isn't needed to find strings of at least ``length``
bytes. Every window of ``length`` bytes has an anchor, the place of the least hash among
its ``GRAM``-byte strings; equal windows have it at the same offset. The windows of a
document that share an anchor form a run, about one for every 170 bytes.

1. Runs with equal extents (all bytes of their windows; anchor hash and extent hash) are
   counted. All windows of a run whose extent occurs twice are repeated.
2. Runs whose anchor also has another extent meet, one representative per extent, by
   anchor hash. Their texts right of the anchor are suffix-sorted, and so are the reversed
   texts left of it: a mergesort whose comparisons find the common extension by binary
   search over prefix polynomial hashes, then compare the next byte. A run's neighbours in
   both orders give its longest common extensions to either side. Between these bounds,
   windows that no single neighbour explains are looked up by window hash in the group.
3. Every match claimed by step 2 is compared byte by byte; a hash collision is recomputed on
   bytes. Step 1 rests on the two 64-bit hashes alone.

Anchors with over ``HOT`` distinct extents (a passage in a third of all documents) are
not sorted in one task: their windows are dealt out by two window hashes and counted.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlytics.llm.common import register, stored, table

LENGTH = 400
GRAM = 64
HOT = 20_000       # extents of one anchor that a task sorts at most
SHARD = 4_000      # extents aimed at in a task's sort
BASE = 0x9E3779B97F4A7C15
BASE2 = 0xC2B2AE3D27D4EB4F
BLOCK = 1 << 21    # windows anchored at a time

_POWERS: dict[int, tuple] = {}


def powers(base: int, n: int):
    """base**i and base**-i modulo 2**64 for i < n or more; kept by the worker."""
    import numpy as np

    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                made.append(np.multiply.accumulate(a))
        have = _POWERS[base] = tuple(made)
    return have


def byte_codes(seed: int):
    import numpy as np

    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


class Hashes:
    """Prefix polynomial hashes of a byte string: the hash of any substring in O(1)."""

    def __init__(self, data, base: int = BASE):
        import numpy as np

        self.n = len(data)
        up, self.down = powers(base, self.n + 1)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(byte_codes(base & 0xFFFF)[data] * up[:self.n], out=self.prefix[1:])

    def of(self, start, end):
        """Hashes of [start, end), arrays or slices of equal length."""
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def mixed(h):
    """Spreads the bits of uint64 hashes."""
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def runs(data, length: int = LENGTH, gram: int = GRAM):
    """Arrays (first window, last window, anchor, anchor hash, extent hash) of a text's runs."""
    import numpy as np

    n = len(data)
    if n < length:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    hashes, w = Hashes(data), length - gram + 1
    grams = mixed(hashes.of(slice(0, n - gram + 1), slice(gram, n + 1)))
    pos_bits = np.uint64(22)
    firsts, anchors = [], []
    for lo in range(0, n - length + 1, BLOCK):
        windows = min(BLOCK, n - length + 1 - lo)
        g = grams[lo:lo + windows + w - 1]
        # least (hash, place): the leftmost of equal grams wins
        key = (g >> pos_bits << pos_bits) | np.arange(len(g), dtype=np.uint64)
        padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:len(key)] = key
        rows = padded.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:windows], ahead[w - 1:w - 1 + windows])
        at = (least & np.uint64((1 << 22) - 1)).astype(np.int64) + lo
        change = np.nonzero(np.diff(at, prepend=-1))[0]
        firsts.append(change + lo)
        anchors.append(at[change])
    first, anchor = np.concatenate(firsts), np.concatenate(anchors)
    new = np.diff(anchor, prepend=-1) != 0      # a run may go on in the next block
    first, anchor = first[new], anchor[new]
    last = np.append(first[1:], n - length + 1) - 1
    extent = hashes.of(first, last + length)
    shape = ((last - first).astype(np.uint64) << np.uint64(32)) | (anchor - first).astype(np.uint64)
    return (first, last, anchor, grams[anchor].view(np.int64),
            mixed(extent ^ mixed(shape)).view(np.int64))


class Extents:
    """Extents of several anchors in one buffer, with their anchors' places."""

    def __init__(self, texts: list[bytes], offsets, group):
        import numpy as np

        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size) - size
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.hashes = Hashes(self.data)
        self.group = np.asarray(group)
        self.at = base + np.asarray(offsets)
        self.left = np.asarray(offsets, np.int64)
        self.right = size - self.left

    def common(self, i, j, side: int):
        """Length of the common extension of i and j to the right (1) or left (-1)."""
        import numpy as np

        a, b = self.at[i], self.at[j]
        have = self.right if side > 0 else self.left
        low, high = np.zeros(len(a), np.int64), np.minimum(have[i], have[j])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = (self.hashes.of(a, a + mid) == self.hashes.of(b, b + mid) if side > 0
                    else self.hashes.of(a - mid, a) == self.hashes.of(b - mid, b))
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, i, j, side: int):
        """Whether suffix i sorts before suffix j (a prefix before what it begins)."""
        import numpy as np

        n = self.common(i, j, side)
        have = self.right if side > 0 else self.left
        end_i, end_j = n >= have[i], n >= have[j]
        step = n if side > 0 else -n - 1
        last = len(self.data) - 1
        x = self.data[np.clip(self.at[i] + step, 0, last)]
        y = self.data[np.clip(self.at[j] + step, 0, last)]
        return np.where(end_i | end_j, end_i & (~end_j | (i < j)), x < y)

    def sort(self, side: int):
        """Indices in order of group, then suffix: mergesort of all groups at once."""
        import numpy as np

        order = np.argsort(self.group, kind="stable")
        n = len(order)
        g = self.group[order]
        first = np.maximum.accumulate(np.where(np.diff(g, prepend=g[:1] - 1) != 0, np.arange(n), 0))
        end = np.zeros(n, np.int64)
        end[first] = np.append(np.unique(first)[1:], n)[np.searchsorted(np.unique(first), first)]
        end = end[first]
        place = np.arange(n) - first                 # within the group
        width, widest = 1, int((end - first).max(initial=0))
        while width < widest:
            block = place // width
            mine = first + block * width
            other = first + (block ^ 1) * width      # the block to merge with
            lo, hi = np.minimum(other, end), np.minimum(other + width, end)
            # rank in the other block, by binary search
            base = lo.copy()
            active = np.nonzero(lo < hi)[0]
            while len(active):
                mid = (lo[active] + hi[active]) // 2
                before = self.less(order[mid], order[active], side)
                lo[active[before]] = mid[before] + 1
                hi[active[~before]] = mid[~before]
                active = active[lo[active] < hi[active]]
            to = np.minimum(mine, other) + (np.arange(n) - mine) + (lo - base)
            new = np.empty_like(order)
            new[to] = order
            order, width = new, width * 2
        return order

    def matches(self, length: int, wanted):
        """(extent, least offset, greatest offset) of windows that occur in another extent of
        the group, the window's start lying so many bytes before the anchor."""
        import numpy as np

        n = len(self.at)
        found, bound = [], {}
        for side in (1, -1):
            order = self.sort(side)
            x, y = order[:-1], order[1:]
            near = self.group[x] == self.group[y]
            x, y = x[near], y[near]
            pairs = np.concatenate([np.stack([x, y]), np.stack([y, x])], axis=1)
            pairs = pairs[:, wanted[pairs[0]]]
            r, left = self.common(*pairs, 1), self.common(*pairs, -1)
            best = np.zeros(n, np.int64)
            np.maximum.at(best, pairs[0], r if side > 0 else left)
            bound[side] = best
            hit = np.nonzero(r + left >= length)[0]
            for i, j, a, b in zip(pairs[0][hit].tolist(), pairs[1][hit].tolist(),
                                  left[hit].tolist(), r[hit].tolist()):
                if self.raw[self.at[i] - a:self.at[i] + b] != self.raw[self.at[j] - a:self.at[j] + b]:
                    a, b = self._plainly(i, j)       # a collision
                if a + b >= length:
                    found.append((i, length - b, a))
        return found + self._between(found, bound, length, wanted)

    def _plainly(self, i: int, j: int) -> tuple[int, int]:
        a = b = 0
        p, q = int(self.at[i]), int(self.at[j])
        while a < min(self.left[i], self.left[j]) and self.raw[p - a - 1] == self.raw[q - a - 1]:
            a += 1
        while b < min(self.right[i], self.right[j]) and self.raw[p + b] == self.raw[q + b]:
            b += 1
        return a, b

    def _between(self, found, bound, length: int, wanted):
        """Offsets within the bounds of both sides that no neighbour covers, looked up."""
        import numpy as np

        low, high = length - bound[1], bound[-1]
        covered: dict[int, list] = {}
        for i, a, b in found:
            covered.setdefault(i, []).append((a, b))
        todo = []
        for i in np.nonzero(wanted & (low <= high))[0].tolist():
            at = max(int(low[i]), 0)
            for a, b in sorted(covered.get(i, [])):
                todo += [(i, o) for o in range(at, min(a, int(high[i]) + 1))]
                at = max(at, b + 1)
            todo += [(i, o) for o in range(at, int(high[i]) + 1)]
        if not todo:
            return []
        asked = set(todo)
        out = []
        places: dict[tuple, list] = {}
        by_group: dict[int, list[int]] = {}
        for i, g in enumerate(self.group.tolist()):
            by_group.setdefault(g, []).append(i)
        for g, o in sorted({(int(self.group[i]), o) for i, o in todo}):
            members = np.array(by_group[g])
            members = members[(self.left[members] >= o) & (self.right[members] >= length - o)]
            starts = self.at[members] - o
            for i, h in zip(members.tolist(), self.hashes.of(starts, starts + length).tolist()):
                places.setdefault((g, o, h), []).append(i)
        for (_, o, _), some in places.items():
            if len(some) > 1 and any((i, o) in asked for i in some):
                texts: dict[bytes, list[int]] = {}
                for i in some:
                    s = int(self.at[i]) - o
                    texts.setdefault(self.raw[s:s + length], []).append(i)
                out += [(i, o, o) for same in texts.values() if len(same) > 1
                        for i in same if (i, o) in asked]
        return out


RUNS = "id long, h long, s0 int, s1 int, a int, m long, x long"


def find_runs(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for doc, h, text in zip(pdf["id"], pdf["h"], pdf["text"], strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                s0, s1, a, m, x = runs(data, length, min(GRAM, length))
                if len(s0):
                    out.append(pd.DataFrame({"id": doc, "h": h, "s0": s0, "s1": s1, "a": a, "m": m, "x": x}))
            if out:
                yield pd.concat(out)

    return docs.mapInPandas(run, RUNS)


def merged_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes; touching spans are one run."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _with(rows: DataFrame, more: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with ``more`` on (id, h)."""
    return rows.join(more, ["id", "h"], how).select(
        *rows.columns, *[c for c in more.columns if c not in ("id", "h")])


def repeated_spans(rows: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(id, h, start, end) of repeated bytes of ``rows`` (id, h, text; no nulls); spans may overlap."""
    found = stored(find_runs(rows, length))
    who = F.struct("id", "h", "s0", "s1", "a")
    extents = stored(found.groupBy("m", "x").agg(F.count("*").alias("n"), F.min(who).alias("r")))
    shared = (extents.groupBy("m").agg(F.count("*").alias("g")).filter("g > 1"))
    whole = (found.join(extents.filter("n > 1").select("m", "x"), ["m", "x"])
             .select("id", "h", F.col("s0").alias("start"), (F.col("s1") + length).alias("end")))
    # representatives with other extents of their anchor, at least one of them occurring once
    partial = stored(extents.join(shared, "m").select("m", "n", "g", "r.*"))
    total = partial.count()
    of_doc = partial.groupBy("id", "h").agg(
        F.collect_list(F.struct("m", "n", "g", "s0", "s1", "a")).alias("reps"))

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for doc, h, text, reps in zip(pdf["id"], pdf["h"], pdf["text"], pdf["reps"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                out += [(doc, h, r["m"], r["n"], r["g"], r["s0"], r["a"],
                         data[r["s0"]:r["s1"] + length]) for r in reps]
            yield pd.DataFrame(out, columns=["id", "h", "m", "n", "g", "s0", "a", "bytes"])

    pieces = stored(_with(rows, of_doc, "inner").mapInPandas(
        cut, "id long, h long, m long, n long, g long, s0 int, a int, bytes binary"))

    def match(pdf):
        import numpy as np
        import pandas as pd

        anchor = pdf["a"].to_numpy("int64")
        group = np.unique(pdf["m"].to_numpy("int64"), return_inverse=True)[1]
        texts = Extents(list(pdf["bytes"]), anchor - pdf["s0"].to_numpy("int64"), group)
        hits = texts.matches(length, pdf["n"].to_numpy() == 1)
        i = np.array([x[0] for x in hits], np.int64)
        return pd.DataFrame({
            "id": pdf["id"].to_numpy()[i], "h": pdf["h"].to_numpy()[i],
            "start": anchor[i] - np.array([x[2] for x in hits], np.int64),
            "end": anchor[i] - np.array([x[1] for x in hits], np.int64) + length})

    shards = max(1, -(-total // SHARD))
    near = (pieces.filter(F.col("g") <= hot)
            .groupBy(F.pmod(F.xxhash64("m"), F.lit(shards)))
            .applyInPandas(match, "id long, h long, start long, end long"))

    def spread(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples():
                data = np.frombuffer(row.bytes, np.uint8)
                s = np.arange(len(data) - length + 1)
                one, two = Hashes(data).of(s, s + length), Hashes(data, BASE2).of(s, s + length)
                yield pd.DataFrame({
                    "id": row.id, "h": row.h, "once": row.n == 1, "start": s + row.s0,
                    "one": mixed(one).view(np.int64), "two": mixed(two).view(np.int64)})

    windows = pieces.filter(F.col("g") > hot).mapInPandas(
        spread, "id long, h long, once boolean, start long, one long, two long")
    twice = windows.groupBy("one", "two").agg(F.count("*").alias("k")).filter("k > 1")
    far = (windows.filter("once").join(twice, ["one", "two"])
           .select("id", "h", "start", (F.col("start") + length).alias("end")))
    return whole.unionByName(near).unionByName(far)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id",
                   text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_removed, n_spans, and ``kept`` (bytes of the UTF-8 text
    that no repeated string of ``length`` bytes covers).

    Strings count as repeated if they start anywhere else in any row, the same one included;
    matches don't cross rows. Null counts as empty; texts shorter than ``length`` are kept.
    Null or repeated ids are told apart by a hash of the text; rows repeated in full are
    copies of each other. Other columns are ignored; an empty table gives an empty result.
    """
    # no column with nulls goes to Python (ids would become floats): the last bit of h says
    # that a row has no id
    none = F.col(id_col).isNull().cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"), none.alias("none"))
    rows = rows.select("id", "text", F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("none")).alias("h"))
    spans = repeated_spans(rows, length, hot)
    of_doc = spans.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def strip(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for doc, h, text, spans in zip(pdf["id"], pdf["h"], pdf["text"], pdf["spans"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                gone = merged_spans((s["start"], s["end"]) for s in spans) if spans is not None else []
                kept, at = [], 0
                for s, e in gone:
                    kept.append(data[at:s])
                    at = e
                out.append((doc, h, len(data), sum(e - s for s, e in gone), len(gone),
                            b"".join([*kept, data[at:]])))
            yield pd.DataFrame(out, columns=["id", "h", "n_bytes", "n_removed", "n_spans", "kept"])

    out = _with(rows, of_doc, "left").mapInPandas(
        strip, "id long, h long, n_bytes long, n_removed long, n_spans long, kept binary")
    has_id = F.col("h").bitwiseAND(F.lit(1)) == 0
    return out.select(F.when(has_id, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without bytes of 400-byte strings that occur twice; ``text`` is what is
    left, with U+FFFD for characters that a cut went through. SQL would need a row per byte:
    the tests compare with a brute-force count of all windows."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"),
                      F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
