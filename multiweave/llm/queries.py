"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import licenses
from .embedding_dedup import op5_embedding_dedup
from .language_id import op1_language_id
from .licenses import op10_license_scan
from .mixing import op4_mixing
from .near_dedup import op2_near_dedup
from .nearest import op3_nearest
from .packing import op7_best_fit_packing
from .quality import op6_quality
from .sharding import op8_sharding
from .warc import op9_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_near_dedup": op2_near_dedup,
    "op3_nearest": op3_nearest,
    "op4_mixing": op4_mixing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality": op6_quality,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_sharding": op8_sharding,
    "op9_warc": op9_warc,
    "op10_license_scan": op10_license_scan,
}

ORACLE: dict[str, str] = {
    "op10_license_scan": licenses.ORACLE,
}
