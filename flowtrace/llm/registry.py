"""The corpus queries, by the names under which __spark_entry__ adds them, and their SQL."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroids
from .kneser_ney import op6_kneser_ney
from .licenses import OP2_SQL, op2_licenses
from .mixing import OP1_SQL, op1_mixing
from .packing import op10_packing
from .pii import op4_pii
from .quality import OP9_SQL, op9_quality
from .quoting import OP3_SQL, op3_quoting
from .sharding import OP11_SQL, op11_sharding
from .simhash import op7_simhash
from .spelling import OP13_SQL, op13_spelling
from .toxicity import op8_toxicity
from .vafile import OP5_SQL, op5_topk

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_licenses": op2_licenses,
    "op3_quoting": op3_quoting,
    "op4_pii": op4_pii,
    "op5_topk": op5_topk,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_sharding": op11_sharding,
    "op12_centroids": op12_centroids,
    "op13_spelling": op13_spelling,
}
ORACLES = {"op1_mixing": OP1_SQL, "op2_licenses": OP2_SQL, "op3_quoting": OP3_SQL, "op5_topk": OP5_SQL, "op9_quality": OP9_SQL, "op11_sharding": OP11_SQL, "op12_centroids": OP12_SQL, "op13_spelling": OP13_SQL}
