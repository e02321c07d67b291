"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP10_SQL, op10_decontamination
from .fim import OP13_SQL, op13_fim
from .htmltext import op7_html
from .linechunks import op6_line_chunks
from .lm import op2_lm
from .ngramjoin import OP12_SQL, op12_ngram_join
from .pieces import op4_pieces
from .pii import op8_pii
from .prefixtrie import OP11_SQL, op11_prefix_trie
from .quality import OP9_SQL, op9_quality
from .simhash import op5_simhash
from .suffix import OP1_SQL, op1_repeats
from .toxicity import op3_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repeats": op1_repeats,
    "op2_lm": op2_lm,
    "op3_toxicity": op3_toxicity,
    "op4_pieces": op4_pieces,
    "op5_simhash": op5_simhash,
    "op6_line_chunks": op6_line_chunks,
    "op7_html": op7_html,
    "op8_pii": op8_pii,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ngram_join": op12_ngram_join,
    "op13_fim": op13_fim,
}

ORACLES: dict[str, str] = {
    "op1_repeats": OP1_SQL,
    "op9_quality": OP9_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_ngram_join": OP12_SQL,
    "op13_fim": OP13_SQL,
}
