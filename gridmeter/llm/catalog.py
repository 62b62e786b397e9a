"""Contract queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat
from .dedup import OP6_SQL, op6_exact_dedup
from .fingerprints import op5_fingerprints
from .mixing import OP1_SQL, op1_mixing
from .near_dedup import op10_near_dedup
from .packing import op3_packing
from .quality import op8_quality
from .runs import op13_runs
from .sharding import op7_sharding
from .token_counts import op11_token_counts
from .token_files import op2_token_files
from .toxicity import op4_toxicity
from .whitening import op12_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_files": op2_token_files,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_fingerprints": op5_fingerprints,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_chat": op9_chat,
    "op10_near_dedup": op10_near_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_runs": op13_runs,
}

SQL = {"op1_mixing": OP1_SQL, "op6_exact_dedup": OP6_SQL, "op9_chat": OP9_SQL}
