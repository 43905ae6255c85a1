"""Token output (2), transducer (6) and packing (10) against the library."""
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from helpers import EDGE, edge_docs, no_docs, random_texts
from tokenizers import Tokenizer

from postlytics.llm import bpe, packing, token_output
from postlytics.llm.common import scratch_folder, table
from postlytics.llm.tokens import TextEncoder, evenly_spaced, single_blanks

SF = "/root/testdata/sf0.001"
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def odd_texts():
    rnd = random.Random(1)
    abc = "ab é'sS \n\t 1.!<|>Σ́\x1c 日"
    out = ["".join(rnd.choice(abc) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    out += ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(600, 2500))) for _ in range(8)]
    return out + ["日本語" * 2000, "a" * 4000, "<|endoftext|> a<|startoftext|>b"] + [
        t for _, t in EDGE if t is not None] + random_texts(5)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoders_equal_the_library(path):
    encode, transduce, lib = TextEncoder(path), bpe.Transducer(path), library(path)
    decode = bpe.decoder(path)
    for t in odd_texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), "<u4").tolist() == ids
        assert transduce(t) == ids
        for step in (1, 7):
            said = "".join(decode.feed(ids[i:i + step]) for i in range(0, len(ids), step)) + decode.finish()
            assert said == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("window", [1, 40])
def test_lookahead_bounds_the_window(window):
    rnd = random.Random(2)
    merges, made = [], ["a", "b", "c"]
    for _ in range(40):   # a proper list
        u, v = rnd.choice(made), rnd.choice(made)
        if (u, v) not in merges and len(u + v) < 12 and u + v not in made:
            merges.append((u, v))
            made.append(u + v)
    t = bpe.StreamingBPE({}, merges, window=window)
    assert t.lookahead is not None
    for _ in range(300):
        word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 400)))
        assert list(t._stream(iter(word), window + t.lookahead)) == bpe.merge_window(list(word), t.ranks)
    assert bpe.lookahead([("ab", "c"), ("a", "b")]) is None


def test_round_trip_of_all_documents(spark):
    lib = library(WORD)
    docs = table(spark, SF, "documents")
    for df in (docs, edge_docs(spark)):
        want = []
        for r in df.collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = [tuple(r) for r in bpe.roundtrip_digests(df, WORD).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe.roundtrip_digests(no_docs(spark), WORD).count() == 0


def test_sequences_in_files(spark):
    lib = library(WORD)
    for df in (table(spark, SF, "documents"), edge_docs(spark)):
        index = token_output.write_sequences(df, WORD, 2, scratch_folder(spark), sequence=64, partitions=3)
        got = token_output.read_digests(index).collect()
        rows = df.collect()
        ids = {(r.doc_id, r.text): np.array(lib.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")
               for r in rows}
        order = sorted(got, key=lambda r: r.start)
        keys = [-1 if r.doc_id is None else r.doc_id for r in order]
        assert keys == sorted(keys) and len(order) == len(rows)
        at = 0
        for r in order:
            assert r.start == at
            at += r.n_tokens
        assert at == sum(len(ids[(r.doc_id, r.text)]) for r in rows)
        assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(
            (str(r.doc_id), len(x), zlib.crc32(x.tobytes())) for r in rows for x in [ids[(r.doc_id, r.text)]])
        # random access to a sequence and its mask
        last = max(index.collect(), key=lambda r: (r.shard, r.place))
        reader = token_output.SequenceReader(last.file)
        end = last.place + last.n_tokens
        seq, mask = reader.sequence_at((end - 1) // 64)
        assert len(seq) == 64 and seq.dtype == np.uint16 and not seq.flags.owndata
        assert mask.tolist() == [True] * ((end - 1) % 64 + 1) + [False] * (63 - (end - 1) % 64)
        assert seq[(end - 1) % 64] == 2
    empty = token_output.write_sequences(no_docs(spark), WORD, 2, scratch_folder(spark))
    assert token_output.read_digests(empty).count() == 0


def check_packed(rows, packed, lib, capacity=2048):
    packed = packed.sort_values(["sequence_id", "offset"])
    by = packed.groupby("sequence_id")
    assert (packed["offset"] == by["length"].cumsum() - packed["length"]).all()
    assert by["length"].sum().max() <= capacity
    want = []
    for d, t in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at, k, n = 0, 0, len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        while at < len(ids):
            want.append((str(d), k, at, n, zlib.crc32(ids[at:at + n].tobytes())))
            at, k, n = at + n, k + 1, capacity
    got = [("None" if x.doc_id != x.doc_id else str(int(x.doc_id)), x.piece, x.start, x.length, x.ids_crc32)
           for x in packed.itertuples()]
    assert sorted(got) == sorted(want)
    return packed["sequence_id"].nunique(), -(-int(packed["length"].sum()) // capacity)


def test_packing(spark):
    lib = library(BYTE)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    used, least = check_packed([(r.doc_id, r.text) for r in docs.collect()],
                               packing.pack_documents(docs, BYTE, 0).toPandas(), lib)
    assert used <= 1.02 * least + 1
    check_packed(EDGE, packing.pack_documents(edge_docs(spark), BYTE, 0).toPandas(), lib)
    assert packing.pack_documents(no_docs(spark), BYTE, 0).count() == 0


def test_sum_of_squares_choice():
    # a brute-force version recomputes the whole sum for every choice
    rnd = random.Random(4)
    lengths = [rnd.randint(1, 20) for _ in range(300)]
    where, offset = packing.sum_of_squares(lengths, 20)
    gaps: list[int] = []
    for i, n in enumerate(lengths):
        def cost(j, n=n):
            g = [*gaps, 20] if j == len(gaps) else gaps[:]
            g[j] -= n
            count = [0] * 21
            for x in g:
                count[x] += 1
            return sum(c * c for c in count[1:20])
        best = min(cost(j) for j in [j for j, g in enumerate(gaps) if g >= n] + [len(gaps)])
        j = int(where[i])
        assert cost(j) == best
        if j == len(gaps):
            gaps.append(20)
        assert offset[i] == 20 - gaps[j]
        gaps[j] -= n


def test_spacing_and_single_entries():
    """op10: the cheap test of the spaces says what a pattern says; a new word has one entry, not two."""
    rng, odd = random.Random(1), re.compile(r"\s\s|[^\S \n]|^\s")
    chars = "ab  \n\n\t\r\x0b\x1c\x85\xa0\u3000\u200b\ufeffé"
    for _ in range(20_000):
        text = "".join(rng.choice(chars[:rng.choice((5, 6, 16))]) for _ in range(rng.randint(1, 7)))
        assert evenly_spaced(text) == (not odd.search(text) and text[-1] not in " \n"), repr(text)
    encoder = TextEncoder(BYTE)
    text = "one two three two one, two"
    assert np.frombuffer(encoder(text), "<u4").tolist() == library(BYTE).encode(text, add_special_tokens=False).ids
    assert set(encoder.cores) == {"Ġone"}


def test_single_blanks():
    """op13: the cheap test of the blanks says what the pattern said."""
    rng, odd = random.Random(2), re.compile(r"  |[^\S \n]|\n |^\s| $")
    chars = "ab  \n\n\t\r\x0b\x1c\x85\xa0\u3000\u200b\ufeffé"
    for _ in range(20_000):
        text = "".join(rng.choice(chars[:rng.choice((5, 6, 16))]) for _ in range(rng.randint(1, 7)))
        assert single_blanks(text) == (not odd.search(text)), repr(text)
