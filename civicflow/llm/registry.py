"""The queries of this subpackage and their DuckDB SQL, for ``__spark_entry__``."""

from __future__ import annotations

from civicflow.llm.decontaminate import op2_decontaminate
from civicflow.llm.language_id import op3_language_id
from civicflow.llm.line_windows import LINES_SQL, op9_line_windows
from civicflow.llm.manifest import MANIFEST_SQL, op13_manifest
from civicflow.llm.mixing import MIXING_SQL, op11_mixing
from civicflow.llm.near_dups import NEAR_DUPS_SQL, op8_near_dups
from civicflow.llm.piece_samples import op7_piece_samples
from civicflow.llm.quality import op4_quality
from civicflow.llm.quotations import op6_quotations
from civicflow.llm.sharding import SHARDS_SQL, op5_shards
from civicflow.llm.topk import TOPK_SQL, op10_exact_topk
from civicflow.llm.toxicity import op1_toxicity
from civicflow.llm.whitening import op12_whitening

LLM_QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_shards": op5_shards,
    "op6_quotations": op6_quotations,
    "op7_piece_samples": op7_piece_samples,
    "op8_near_dups": op8_near_dups,
    "op9_line_windows": op9_line_windows,
    "op10_exact_topk": op10_exact_topk,
    "op11_mixing": op11_mixing,
    "op12_whitening": op12_whitening,
    "op13_manifest": op13_manifest,
}

LLM_ORACLE_SQL = {
    "op5_shards": SHARDS_SQL,
    "op8_near_dups": NEAR_DUPS_SQL,
    "op9_line_windows": LINES_SQL,
    "op10_exact_topk": TOPK_SQL,
    "op11_mixing": MIXING_SQL,
    "op13_manifest": MANIFEST_SQL,
}
