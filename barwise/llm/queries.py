"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barwise.llm.alignment import op13_alignment
from barwise.llm.hamming import OP1_SQL, op1_hamming_topk
from barwise.llm.lexicon import op3_bpe_lexicon
from barwise.llm.licenses import op7_licenses
from barwise.llm.merkle import op5_merkle
from barwise.llm.mixing import op9_mixing
from barwise.llm.quality import op6_quality
from barwise.llm.separators import op10_separator_scan
from barwise.llm.simhash import op4_simhash
from barwise.llm.simple8b import op8_simple8b
from barwise.llm.toxicity import op11_toxicity
from barwise.llm.tries import op12_prefix_trie
from barwise.llm.urls import OP2_SQL, op2_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_hamming_topk, op2_url_filter, op3_bpe_lexicon, op4_simhash, op5_merkle, op6_quality,
                            op7_licenses, op8_simple8b, op9_mixing, op10_separator_scan,
                            op11_toxicity, op12_prefix_trie, op13_alignment)}

ORACLES: dict[str, str] = {"op1_hamming_topk": OP1_SQL, "op2_url_filter": OP2_SQL}
