"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from tessera.llm.balanced_postings import op12_balanced_postings
from tessera.llm.bpe_heap import op9_bpe
from tessera.llm.compression_bands import op2_compression_bands
from tessera.llm.conversation_repair import op11_conversation_repair
from tessera.llm.cover_tree import ORACLE as COVER_TREE_SQL
from tessera.llm.cover_tree import op5_cover_tree
from tessera.llm.histogram_sort import op7_histogram_sort
from tessera.llm.hyperminhash import ORACLE as HYPERMINHASH_SQL
from tessera.llm.hyperminhash import op10_hyperminhash
from tessera.llm.langid_crf import op1_crf_langid
from tessera.llm.merkle_manifest import ORACLE as MERKLE_SQL
from tessera.llm.merkle_manifest import op13_merkle
from tessera.llm.pii_spans import op3_pii
from tessera.llm.rans_tokens import op6_rans
from tessera.llm.toxic_segments import op4_toxicity
from tessera.llm.window_packing import op8_packing

QUERIES = {
    "op1_crf_langid": op1_crf_langid,
    "op2_compression_bands": op2_compression_bands,
    "op3_pii": op3_pii,
    "op4_toxicity": op4_toxicity,
    "op5_cover_tree": op5_cover_tree,
    "op6_rans": op6_rans,
    "op7_histogram_sort": op7_histogram_sort,
    "op8_packing": op8_packing,
    "op9_bpe": op9_bpe,
    "op10_hyperminhash": op10_hyperminhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_balanced_postings": op12_balanced_postings,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op5_cover_tree": COVER_TREE_SQL,
    "op10_hyperminhash": HYPERMINHASH_SQL,
    "op13_merkle": MERKLE_SQL,
}
