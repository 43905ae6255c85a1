"""Operator 13, alignment of two tokenizers through token-byte incidence matrices.

Both tokenizers cut the same bytes. With A (tokens x bytes) and B alike, both in CSR form:

* A B^T, by Gustavson's row products, has a value for every pair of tokens that share
  bytes: the overlap links, in text order.
* Where a link shares neither token with the one before, both tokenizers have a boundary:
  these places cut the tokens into groups.
* With G (token ids x groups) for either side, G_A G_B^T has for every pair of ids the
  number of its token pairs that share a group: the shared-group links.

Neither side has a token across a space that follows other characters, so no group crosses
it either: a text is a row of pieces, words mostly, that recur. A worker aligns the pieces
that it has not met yet, a block of them at a time (the matrices are block-diagonal), and
keeps a bounded table. The links of documents are the product of the counts (documents x
pieces) and the pieces' links. Products are made in blocks of rows, and a long piece in
segments, so only a text itself and its links are held as a whole.

How many documents hold a pair of ids linked is counted over the corpus. The most frequent
pairs, ``HOT_PAIRS`` at most, go to the workers as sorted arrays; other pairs, each in few
documents, are joined. Both paths are exact.
"""

from __future__ import annotations

import json
import re
from functools import cache
from itertools import chain

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlytics.llm.common import register, stored, table, whole_id, with_nulls
from postlytics.llm.tokens import BYTES, cuts_at_space, single_blanks
from postlytics.session import ship_package

BLOCK_BYTES = 1 << 16     # of texts, and of new pieces, aligned together; of a segment: arrays
                          # of a block stay in the processor's cache
OUT_BYTES = 1 << 20       # of texts whose results are handed on together
PIECES = 250_000          # pieces a worker keeps
BLOCK_PRODUCTS = 1 << 18  # products of a matrix multiplication held at a time
HOT_PAIRS = 1 << 20       # pairs of ids whose counts every worker holds at most
CUT = re.compile(r"(?<=\S)(?= )")


class CSR:
    """A sparse matrix: row i has the columns ``indices[indptr[i]:indptr[i + 1]]``, ascending,
    with their ``data``."""

    def __init__(self, indptr, indices, data, width: int):
        self.indptr, self.indices, self.data, self.width = indptr, indices, data, width

    @classmethod
    def of_spans(cls, ends):
        """Row i covers the columns from ``ends[i - 1]`` (first: 0) to ``ends[i]``."""
        import numpy as np

        width = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([[0], ends]).astype(np.int64), np.arange(width),
                   np.ones(width, np.int64), width)

    @classmethod
    def of_pairs(cls, rows, cols, values, height: int, width: int):
        """Entries in any order; values of equal places are added up."""
        import numpy as np

        key = rows * width + cols
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.nonzero(np.diff(key, prepend=-1))[0]
        key = key[first]
        data = np.add.reduceat(values, first) if len(first) else values[:0]
        row = key // width if width else key
        indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=height))])
        return cls(indptr, key - row * width, data, width)

    @property
    def height(self) -> int:
        return len(self.indptr) - 1

    def rows(self):
        import numpy as np

        return np.repeat(np.arange(self.height), np.diff(self.indptr))

    def transposed(self) -> CSR:
        import numpy as np

        order = np.argsort(self.indices, kind="stable")
        indptr = np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=self.width))])
        return CSR(indptr, self.rows()[order], self.data[order], self.height)

    def times(self, other: CSR, most: int = BLOCK_PRODUCTS) -> CSR:
        """The product with ``other``: row i is the sum of other's rows that its entries name."""
        import numpy as np

        sizes = np.diff(other.indptr)[self.indices]           # products of each entry
        upto = np.concatenate([[0], np.cumsum(sizes)])[self.indptr]
        parts, lo = [], 0
        while lo < self.height:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + most, "right")) - 1)
            entries = slice(int(self.indptr[lo]), int(self.indptr[hi]))
            n = sizes[entries]
            row = np.repeat(np.repeat(np.arange(hi - lo), np.diff(self.indptr[lo:hi + 1])), n)
            at = np.arange(n.sum()) + np.repeat(
                other.indptr[self.indices[entries]] - (np.cumsum(n) - n), n)
            parts.append(CSR.of_pairs(row, other.indices[at], np.repeat(self.data[entries], n)
                                      * other.data[at], hi - lo, other.width))
            lo = hi
        if len(parts) == 1:
            return parts[0]
        ends = np.concatenate([[0], np.cumsum(np.concatenate(
            [np.diff(p.indptr) for p in parts] or [np.zeros(0, np.int64)]))])
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
        return CSR(ends, join([p.indices for p in parts]), join([p.data for p in parts]), other.width)


class Sides:
    """The two tokenizers: ids of a piece, and the bytes of every id."""

    def __init__(self, byte_json: str, piece_model: str):
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        with open(byte_json, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in BYTES.items()}
        size = max(spec["model"]["vocab"].values()) + 1
        self.a_bytes = [b""] * size
        for s, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        self.a = Tokenizer.from_file(byte_json)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True     # their strings are ordinary text
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        self.blank = self.pieces.piece_to_id("▁")
        # whether no token of either side reaches over a space that follows other characters
        self.cuts = cuts_at_space(spec) and not any(re.search("[^▁]▁", p) for p in names)
        self.a_size = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), np.int64)
        self.a_name, self.b_name = list(map(str, range(size))), list(map(str, range(n)))

    def split(self, text: str | None) -> list[str]:
        """The pieces of a text, each without the space before it."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        if not single_blanks(text):
            return [p[1:] for p in CUT.split(" " + text)]
        return text.split(" ")

    def plain(self, piece: str) -> bool:
        """Whether another piece may follow in one text without a change to this one's tokens."""
        return self.cuts and piece != "" and not piece[-1].isspace() and "▁" not in piece

    def ids(self, pieces: list[str], joined: bool):
        """Ids of pieces and the spaces before them: (ids of A, how many in each piece, ids of B, how
        many, whether both sides' bytes are the text's). Plain pieces may be ``joined``: encoded as
        one text, whose ids are dealt to them by their bytes; others, and all if that fails, are
        encoded one by one."""
        import numpy as np

        if joined:
            text = " ".join(pieces)
            a, b, same = self._encoded(text)
            bounds = np.cumsum([len(p.encode("utf-8", "surrogatepass")) + 1 for p in pieces])
            ends = [np.cumsum(size[x]) for size, x in ((self.a_size, a), (self.b_size, b))]
            upto = [np.searchsorted(e, bounds, "right") for e in ends]
            if same and all((e[u - 1] == bounds).all() for e, u in zip(ends, upto, strict=True)):
                n_a, n_b = (np.diff(u, prepend=0) for u in upto)
                return a, n_a, b, n_b, np.ones(len(pieces), bool)
        each = [self._encoded(p) for p in pieces]
        a, b = (np.concatenate([e[k] for e in each]) for k in (0, 1))
        n_a, n_b = (np.array([len(e[k]) for e in each], np.int64) for k in (0, 1))
        return a, n_a, b, n_b, np.array([e[2] for e in each], bool)

    def _encoded(self, text: str):
        """(ids of A of a space and the text, ids of B, whether the bytes of both are these)."""
        import numpy as np

        a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.pieces.encode(text) if text else [self.blank], np.int64)
        said = (" " + text).encode("utf-8", "surrogatepass")
        same = all(b"".join(map(names.__getitem__, ids.tolist())) == said
                   for names, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        return a, b, same


def _starts(flags):
    import numpy as np

    return np.nonzero(flags)[0]


class Aligned:
    """Alignment of the tokens ``a`` and ``b`` of some texts; ``of_a`` and ``of_b`` say (in
    ascending order) whose they are.

    ``overlaps`` is A B^T over all tokens; ``a_group`` and ``b_group`` are the tokens' groups,
    counted through all texts; ``links`` is G_A G_B^T, whose rows and columns stand for the
    distinct (owner, id) of ``a_key`` and ``b_key`` (owner << 32 | id)."""

    def __init__(self, a, b, a_size, b_size, of_a, of_b):
        import numpy as np

        left = CSR.of_spans(np.cumsum(a_size[a]))
        right = CSR.of_spans(np.cumsum(b_size[b]))
        self.overlaps = left.times(right.transposed())
        i, j = self.overlaps.rows(), self.overlaps.indices
        new = (np.diff(i, prepend=-1) != 0) & (np.diff(j, prepend=-1) != 0)
        group = np.cumsum(new) - 1
        self.n_groups = n = int(new.sum())
        self.a_group = group[_starts(np.diff(i, prepend=-1))]
        self.b_group = group[_starts(np.diff(j, prepend=-1))]
        self.a_key, row = np.unique(of_a << 32 | a, return_inverse=True)
        self.b_key, col = np.unique(of_b << 32 | b, return_inverse=True)
        in_a = CSR.of_pairs(row, self.a_group, np.ones(len(row), np.int64), len(self.a_key), n)
        in_b = CSR.of_pairs(col, self.b_group, np.ones(len(col), np.int64), len(self.b_key), n)
        self.links = in_a.times(in_b.transposed())

    def pairs(self):
        """Arrays (owner, pair of ids as a << 32 | b, number of its links)."""
        key = self.a_key[self.links.rows()]
        ids = (key & 0xFFFFFFFF) << 32 | self.b_key[self.links.indices] & 0xFFFFFFFF
        return key >> 32, ids, self.links.data


def segments(a, b, a_size, b_size, most: int):
    """Ids of both sides cut where both have a token's end, about every ``most`` bytes."""
    import numpy as np

    ends_a, ends_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
    if ends_a[-1] <= most:
        return [(a, b)]
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    cuts = both[np.searchsorted(both, np.arange(most, ends_a[-1], most))]
    cuts = np.unique(cuts[cuts < ends_a[-1]])
    return list(zip(np.split(a, np.searchsorted(ends_a, cuts) + 1),
                    np.split(b, np.searchsorted(ends_b, cuts) + 1), strict=True))


class Growing:
    """Rows of numbers that are appended to, in an array with room for more."""

    def __init__(self, *shape: int):
        import numpy as np

        self.held, self.n = np.zeros((1024, *shape), np.int64), 0

    @property
    def rows(self):
        return self.held[:self.n]

    def add(self, values) -> None:
        import numpy as np

        end = self.n + len(values)
        if end > len(self.held):
            more = np.zeros((2 * end, *self.held.shape[1:]), np.int64)
            more[:self.n] = self.rows
            self.held = more
        self.held[self.n:end] = values
        self.n = end

    def keep(self, at) -> None:
        rows = self.held[at]
        self.held[:len(rows)], self.n = rows, len(rows)


class PieceTable:
    """The alignments of about ``PIECES`` pieces (or of those that a block needs): numbers
    (n_a, n_b, n_groups, n_links, n_overlaps), groups as text, and linked pairs in CSR form. A
    full table keeps the half that was used most."""

    def __init__(self, sides: Sides):
        import numpy as np

        self.sides = sides
        self.slot: dict[str, int] = {}
        self.said: list[str | None] = []     # None: the bytes differ
        self.uses, self.numbers = Growing(), Growing(5)
        self.start, self.size = Growing(), Growing()     # of a piece's pairs
        self.pairs, self.times = Growing(), Growing()

    def slots(self, pieces: list[str]):
        """The places of pieces in the table, new ones aligned."""
        import numpy as np

        new = set(pieces).difference(self.slot)
        if new and len(self.slot) + len(new) > PIECES:
            self._keep(np.sort(np.argsort(-self.uses.rows, kind="stable")[:PIECES // 2]))
            new = set(pieces).difference(self.slot)
        if new:
            odd = [p for p in new if not self.sides.plain(p)]
            new.difference_update(odd)
            self._add([*new, *odd], len(new))
        out = np.fromiter(map(self.slot.__getitem__, pieces), np.int64, len(pieces))
        np.add.at(self.uses.held, out, 1)
        return out

    def _keep(self, places) -> None:
        import numpy as np

        names = list(self.slot)
        self.slot = {names[i]: k for k, i in enumerate(places.tolist())}
        self.said = list(map(self.said.__getitem__, places.tolist()))
        at, sizes = self._entries(places)
        for rows in (self.pairs, self.times):
            rows.keep(at)
        for rows in (self.size, self.uses, self.numbers):
            rows.keep(places)
        self.start.n = 0
        self.start.add(np.cumsum(sizes) - sizes)
        self.uses.rows[:] //= 2

    def _entries(self, places):
        """(indices of the pairs of some places, how many of each)."""
        import numpy as np

        sizes = self.size.held[places]
        return np.arange(sizes.sum()) + np.repeat(self.start.held[places] - (np.cumsum(sizes) - sizes), sizes), sizes

    def _add(self, new: list[str], plain: int) -> None:
        """Aligns new pieces, of which the first ``plain`` ones are plain."""
        import numpy as np

        base, numbers, said, found = len(self.said), np.zeros((len(new), 5), np.int64), [], []
        self.slot.update(zip(new, range(base, base + len(new)), strict=True))
        lo = held = 0
        for hi, piece in enumerate(new):
            # a long piece is a block of its own
            if held and (held + len(piece) > BLOCK_BYTES or hi == plain):
                found.append(self._align(new[lo:hi], lo, numbers, said, hi <= plain))
                lo, held = hi, 0
            held += len(piece) + 1
        found.append(self._align(new[lo:], lo, numbers, said, len(new) <= plain))
        owner, pairs, times = (np.concatenate([f[k] for f in found]) for k in range(3))
        ids, col = np.unique(pairs, return_inverse=True)
        links = CSR.of_pairs(owner, col, times, len(new), max(len(ids), 1))
        numbers[:, 3] = np.bincount(links.rows(), links.data, len(new))
        self.said += said
        self.numbers.add(numbers)
        self.uses.add(np.zeros(len(new), np.int64))
        self.start.add(self.pairs.n + links.indptr[:-1])
        self.size.add(np.diff(links.indptr))
        self.pairs.add(ids[links.indices] if len(ids) else pairs)
        self.times.add(links.data)

    def _align(self, pieces: list[str], first: int, numbers, said: list, joined: bool):
        """Aligns pieces at once (their numbers are written from row ``first`` on, their groups added
        to ``said``); arrays (row, pair, times)."""
        import numpy as np

        s = self.sides
        a, n_a, b, n_b, same = s.ids(pieces, joined)
        if not same.all():
            a, b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)]
            n_a, n_b = n_a * same, n_b * same
        of_a, of_b = (np.repeat(np.arange(first, first + len(pieces)), n) for n in (n_a, n_b))
        if len(pieces) > 1 or not same[0]:
            return self._segment(a, b, of_a, of_b, n_a, numbers, first, said)
        texts, found = [], []                 # one piece, perhaps a very long one
        for x, y in segments(a, b, s.a_size, s.b_size, BLOCK_BYTES):
            found.append(self._segment(x, y, of_a[:len(x)], of_b[:len(y)], np.array([len(x)]), numbers, first, texts))
        said.append(";".join(texts))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def _segment(self, a, b, of_a, of_b, n_a, numbers, first: int, said: list):
        import numpy as np

        s = self.sides
        if not len(a):
            said += [None] * len(n_a)
            return (np.zeros(0, np.int64),) * 3
        met = Aligned(a, b, s.a_size, s.b_size, of_a, of_b)
        last = np.cumsum(n_a)
        have = n_a > 0
        # the first and the last group of every piece
        lo, hi = np.zeros(len(n_a), np.int64), np.zeros(len(n_a), np.int64)
        lo[have] = met.a_group[(last - n_a)[have]]
        hi[have] = met.a_group[last[have] - 1] + 1
        rows = slice(first, first + len(n_a))
        overlaps = np.diff(met.overlaps.indptr[np.concatenate([[0], last])])
        n_b = np.bincount(of_b - first, minlength=len(n_a))
        numbers[rows] += np.stack([n_a, n_b, hi - lo, np.zeros_like(n_a), overlaps], axis=1)
        # a1,a2|b1 of every group, then the groups of every piece
        names_a = list(map(s.a_name.__getitem__, a.tolist()))
        names_b = list(map(s.b_name.__getitem__, b.tolist()))
        lo_a, lo_b = (_starts(np.diff(g, prepend=-1)).tolist() for g in (met.a_group, met.b_group))
        join = ",".join
        groups = [names_a[p] + "|" + names_b[r] if q - p == 1 == t - r else
                  join(names_a[p:q]) + "|" + join(names_b[r:t])
                  for p, q, r, t in zip(lo_a, [*lo_a[1:], len(names_a)], lo_b, [*lo_b[1:], len(names_b)],
                                        strict=True)]
        join = ";".join
        said += [None if g == h else groups[g] if g + 1 == h else join(groups[g:h])
                 for g, h in zip(lo.tolist(), hi.tolist(), strict=True)]
        return met.pairs()

    def links(self, used) -> tuple[CSR, list]:
        """(links of some places, columns standing for the pairs of the array returned)."""
        import numpy as np

        at, sizes = self._entries(used)
        ids, col = np.unique(self.pairs.held[at], return_inverse=True)
        row = np.repeat(np.arange(len(used)), sizes)
        return CSR.of_pairs(row, col, self.times.held[at], len(used), max(len(ids), 1)), ids


ALIGNED = ("doc_id long, no_id boolean, n_a long, n_b long, n_groups long, n_links long, "
           "n_overlaps long, groups string, pairs array<long>, times array<long>")
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]


@cache
def piece_table(byte_json: str, piece_model: str) -> PieceTable:
    """The tokenizers and the table, once for each worker process."""
    return PieceTable(Sides(byte_json, piece_model))


def align_texts(table: PieceTable, texts: list[str | None]) -> dict[str, list]:
    """Columns of ``ALIGNED`` (but for the ids) of some texts."""
    import numpy as np

    split = list(map(table.sides.split, texts))
    lengths = np.array(list(map(len, split)), np.int64)
    slots = table.slots(list(chain.from_iterable(split)))
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), lengths)
    said = [list(map(table.said.__getitem__, slots[e - n:e].tolist())) for e, n in zip(ends, lengths, strict=True)]
    whole = np.array([None not in x for x in said], bool)
    keep = whole[text]
    text, slots = text[keep], slots[keep]
    out = {name: np.bincount(text, table.numbers.held[slots, k], len(texts)).astype(np.int64)
           for k, name in enumerate(NUMBERS)}
    used, col = np.unique(slots, return_inverse=True)
    links, ids = table.links(used)
    of_text = CSR.of_pairs(text, col, np.ones(len(col), np.int64), len(texts), max(len(used), 1)).times(links)
    cut = of_text.indptr[1:-1]
    return out | {"groups": [";".join(x) if ok else "" for x, ok in zip(said, whole, strict=True)],
                  "pairs": np.split(ids[of_text.indices] if len(ids) else np.zeros(0, np.int64), cut),
                  "times": np.split(of_text.data, cut)}


def align(docs: DataFrame, byte_json: str, piece_model: str, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Per row: doc_id, tokens of both sides (n_a, n_b; a blank before the text), n_groups, n_links
    and n_overlaps, ``groups`` (``a1,a2|b1;a3|b2,b3``), and the distinct linked ``pairs`` of ids
    (a << 32 | b) with the ``times`` they are linked.

    Null and empty texts, and texts that one side doesn't give back byte by byte, have no
    tokens: zeros, and no groups. Rows are independent: null or repeated ids, other columns and
    empty tables need no care.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        table = piece_table(byte_json, piece_model)
        for pdf in batches:
            first = lo = held = given = 0
            parts, texts = [], pdf["text"].tolist()
            for hi, text in enumerate(texts, 1):
                held += len(text or "")
                if held >= BLOCK_BYTES or hi == len(texts):
                    parts.append(align_texts(table, texts[lo:hi]))
                    lo, held, given = hi, 0, given + held
                    if given >= OUT_BYTES or hi == len(texts):
                        yield pdf[["doc_id", "no_id"]].iloc[first:hi].assign(
                            **{c: list(chain.from_iterable(p[c] for p in parts)) for c in parts[0]})
                        first, given, parts = hi, 0, []

    rows = docs.select(*whole_id(id_col), F.col(text_col).alias("text"))
    return with_nulls(rows.mapInPandas(run, ALIGNED))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n: rows that hold it linked, top: whether no pair of the same id of A is in more)."""
    each = aligned.select(F.explode_outer("pairs").alias("pair")).where("pair IS NOT NULL")
    counts = each.groupBy("pair").agg(F.count("*").alias("n"))
    # at most as many pairs meet here as B has ids
    same = Window.partitionBy(F.shiftright("pair", 32))
    return counts.withColumn("top", F.col("n") == F.max("n").over(same))


def with_counts(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """The rows of ``aligned`` (columns of ``align``) without pairs and groups, with n_best (links of
    pairs that are ``top``), count_sum (n of its pair over all links) and groups_sha256
    ('' without tokens)."""
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    rows = stored(aligned.withColumn("groups_sha256", sha).drop("groups"))
    counts = stored(pair_counts(rows))
    # steps of a sixteenth of a doubling; the commonest steps that fit are held by all workers
    step = F.floor(F.log2("n") * 16)
    cut, held = None, 0
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        if held + r["count"] > hot_pairs:
            break
        cut, held = r["s"], held + r["count"]
    rare = counts if cut is None else counts.where(step < cut)
    hot = counts.where(F.lit(False) if cut is None else step >= cut).toPandas().sort_values("pair")
    shared = rows.sparkSession.sparkContext.broadcast(
        (hot["pair"].to_numpy("int64"), hot["n"].to_numpy("int64"), hot["top"].to_numpy("bool")))
    numbers = [*NUMBERS, "groups_sha256"]

    def look_up(batches):
        import numpy as np

        known, n, top = shared.value
        for pdf in batches:
            pairs = np.concatenate([*pdf["pairs"], np.zeros(0, np.int64)]).astype(np.int64)
            times = np.concatenate([*pdf["times"], np.zeros(0, np.int64)]).astype(np.int64)
            ends = np.cumsum(pdf["pairs"].map(len).to_numpy("int64"))
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = [np.concatenate([[0], np.cumsum(np.where(found, x[at] * times, 0)
                                                   if len(known) else np.zeros(len(pairs), np.int64))])[
                np.concatenate([[0], ends])] for x in (n, top)]
            left = [np.split(np.where(found, -1, x), ends[:-1]) for x in (pairs, times)]
            yield pdf[["doc_id", "no_id", *numbers]].assign(
                count_sum=np.diff(sums[0]), n_best=np.diff(sums[1]),
                rare=[p[p >= 0] for p in left[0]], rare_times=[t[p >= 0] for p, t in zip(*left)])

    schema = ("doc_id long, no_id boolean, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, "
              "groups_sha256 string, count_sum long, n_best long, rare array<long>, rare_times array<long>")
    given = rows.select(*whole_id(), *numbers, "pairs", "times")
    out = with_nulls(given.mapInPandas(look_up, schema))
    if held == counts.count():
        return out.drop("rare", "rare_times")
    # texts of equal groups have equal pairs: one of them is looked up
    out = stored(out)
    asked = (out.where(F.size("rare") > 0).dropDuplicates(["groups_sha256"])
             .select("groups_sha256", F.explode(F.arrays_zip("rare", "rare_times")).alias("r"))
             .select("groups_sha256", F.col("r.rare").alias("pair"), F.col("r.rare_times").alias("k")))
    more = (asked.join(rare, "pair").groupBy("groups_sha256")
            .agg(F.sum(F.col("k") * F.col("n")).alias("more"),
                 F.sum(F.when(F.col("top"), F.col("k")).otherwise(0)).alias("best")))
    both = out.drop("rare", "rare_times").join(more, "groups_sha256", "left")
    return both.select("doc_id", *numbers, (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
                       (F.col("n_best") + F.coalesce("best", F.lit(0))).alias("n_best"))


@register("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents aligned between a byte-level and a piece vocabulary. SQL has no tokenizer: the
    tests compare with brute force over byte offsets and with a count of all pairs."""
    import public_tokenizers

    return with_counts(align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                             public_tokenizers.path("piece_bpe_32k.model")))
