"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, lexical
from .decontaminate import op8_decontaminate
from .divergence import op13_source_divergence
from .huffman import op12_huffman_ids
from .lexical import op11_impact_search
from .minhash import op6_one_permutation_minhash
from .packing import op9_best_fit_packing
from .paragraphs import op1_paragraph_minhash
from .pii import op7_pii_weak
from .quality import op4_quality_rules
from .secrets import op3_secret_scan
from .simhash import op5_simhash_anchors
from .substrings import op10_suffix_dedup
from .warc import op2_warc_roundtrip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_paragraph_minhash": op1_paragraph_minhash,
    "op2_warc_roundtrip": op2_warc_roundtrip,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash_anchors": op5_simhash_anchors,
    "op6_one_permutation_minhash": op6_one_permutation_minhash,
    "op7_pii_weak": op7_pii_weak,
    "op8_decontaminate": op8_decontaminate,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_impact_search": op11_impact_search,
    "op12_huffman_ids": op12_huffman_ids,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {"op11_impact_search": lexical.ORACLE, "op13_source_divergence": divergence.ORACLE}
