"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op13_alignment
from .audio import op8_audio
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .mixing import op1_mixing
from .near_dedup import OP7_SQL, op7_near_dedup
from .packing import op6_packing
from .quality import op2_quality
from .secrets_scan import op5_secrets
from .sharding import OP9_SQL, op9_sharding
from .simhash import op11_simhash
from .token_files import op3_token_files
from .toxicity import op10_toxicity
from .whitening import op12_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_token_files": op3_token_files,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secrets": op5_secrets,
    "op6_packing": op6_packing,
    "op7_near_dedup": op7_near_dedup,
    "op8_audio": op8_audio,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_simhash": op11_simhash,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL = {
    "op4_exact_dedup": OP4_SQL,
    "op7_near_dedup": OP7_SQL,
    "op9_sharding": OP9_SQL,
}
