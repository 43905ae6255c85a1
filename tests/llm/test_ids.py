"""Ids above 2^53 beside a null id in one batch come out unchanged."""
import public_tokenizers as P
import pytest

from postlytics.llm import bpe, packing, simhash, suffix_dedup, token_output
from postlytics.llm.common import scratch_folder

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
SHARED = "".join(f"{i} " for i in range(300))
IDS = [(1 << 60) + 1, None, (1 << 60) + 3, -(1 << 62) - 1, None, 0]


def arrow_files(docs):
    index = token_output.write_sequences(docs, WORD, 2, scratch_folder(docs.sparkSession), partitions=2)
    read = token_output.read_digests(index)
    assert sorted(map(str, IDS)) == sorted(str(r.doc_id) for r in index.collect())
    return read


OPERATORS = {
    "op2": arrow_files,
    "op3": simhash.near_groups,
    "op6": lambda docs: bpe.roundtrip_digests(docs, WORD),
    "op9": suffix_dedup.remove_repeats,
    "op10": lambda docs: packing.pack_documents(docs, BYTE, 0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_large_ids_beside_nulls(spark, name):
    texts = [SHARED + str(i) for i in range(len(IDS))]
    docs = spark.createDataFrame(list(zip(IDS, texts)), "doc_id long, text string").coalesce(1)
    got = OPERATORS[name](docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, IDS))
    if name == "op3":
        assert {str(r.component_id) for r in got} <= set(map(str, IDS))
    if name == "op9":
        assert all(r.n_removed > 400 for r in got)


def test_hot_paths_keep_large_ids(spark):
    texts = [f"{i} " * 30 + SHARED + f" {i}" * 30 for i in range(len(IDS))]
    docs = spark.createDataFrame(list(zip(IDS, texts)), "doc_id long, text string").coalesce(1)
    got = suffix_dedup.remove_repeats(docs, hot=1).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, IDS))
    assert all(r.n_removed > 400 for r in got)
