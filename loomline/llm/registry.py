"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import ball_kmeans as op12
from . import bpe_codec as op11
from . import decontaminate as op3
from . import knn_search as op6
from . import license_scan as op7
from . import line_dedup as op1
from . import lm_scoring as op10
from . import packing as op4
from . import pii as op9
from . import simhash as op2
from . import substring_dedup as op8
from . import token_alignment as op13
from . import toxicity as op5

QUERIES = {
    "op1_line_dedup": op1.op1_line_dedup,
    "op2_simhash": op2.op2_simhash,
    "op3_decontaminate": op3.op3_decontaminate,
    "op4_packing": op4.op4_packing,
    "op5_toxicity": op5.op5_toxicity,
    "op6_knn_search": op6.op6_knn_search,
    "op7_license_scan": op7.op7_license_scan,
    "op8_substring_dedup": op8.op8_substring_dedup,
    "op9_pii": op9.op9_pii,
    "op10_lm_scoring": op10.op10_lm_scoring,
    "op11_bpe_codec": op11.op11_bpe_codec,
    "op12_centroids": op12.op12_centroids,
    "op13_token_alignment": op13.op13_token_alignment,
}

SQL = {
    "op1_line_dedup": op1.SQL,
    "op3_decontaminate": op3.SQL,
    "op6_knn_search": op6.SQL,
    "op8_substring_dedup": op8.SQL,
    "op10_lm_scoring": op10.SQL,
    "op12_centroids": op12.SQL,
}
