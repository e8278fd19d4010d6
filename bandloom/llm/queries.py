"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .audit import OP13_SQL, op13_filter_audit
from .bpe import op4_bpe
from .hosts import op9_host_verdicts
from .language import op5_language
from .merkle import OP12_SQL, op12_merkle_manifest
from .neardup import OP7_SQL, op7_near_duplicates
from .packing import op1_packing
from .sharding import op10_shards
from .syncmers import op2_syncmers
from .token_counts import op6_token_counts
from .tokenfile import op11_token_files
from .topk import OP3_SQL, op3_topk
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_syncmers, op3_topk, op4_bpe, op5_language, op6_token_counts, op7_near_duplicates, op8_toxicity, op9_host_verdicts, op10_shards,
        op11_token_files, op12_merkle_manifest, op13_filter_audit,
    )
}
ORACLE_SQL = {"op3_topk": OP3_SQL, "op7_near_duplicates": OP7_SQL, "op12_merkle_manifest": OP12_SQL, "op13_filter_audit": OP13_SQL}
