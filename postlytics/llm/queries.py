"""The registered queries of the training-data operators."""

from __future__ import annotations

from postlytics.llm.common import QUERIES, LlmQuery


def load_llm() -> dict[str, LlmQuery]:
    # importing the modules registers their queries
    from postlytics.llm import (  # noqa: F401
        alignment, bpe, exact_dedup, line_dedup, mixing, packing, pii, quality, resampling, simhash, suffix_dedup,
        token_output, topk)
    return QUERIES
