"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .audio import op1_telephony_audio
from .chat import OP5_SQL, op5_chat_masks
from .divergence import OP13_SQL, op13_source_divergence
from .licences import OP6_SQL, op6_license_scan
from .minhash import OP4_SQL, op4_near_duplicates
from .packing import op2_packed_sequences
from .pieces import op8_merge_dropout
from .quality import OP7_SQL, op7_quality_rules
from .search import OP11_SQL, op11_ranked_search
from .secrets import OP10_SQL, op10_secret_spans
from .sharding import OP9_SQL, op9_hash_tree_shards
from .vectors import OP12_SQL, op12_exact_search
from .warc import OP3_SQL, op3_content_archive

QUERIES = {
    "op1_telephony_audio": op1_telephony_audio,
    "op2_packed_sequences": op2_packed_sequences,
    "op3_content_archive": op3_content_archive,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_chat_masks": op5_chat_masks,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_merge_dropout": op8_merge_dropout,
    "op9_hash_tree_shards": op9_hash_tree_shards,
    "op10_secret_spans": op10_secret_spans,
    "op11_ranked_search": op11_ranked_search,
    "op12_exact_search": op12_exact_search,
    "op13_source_divergence": op13_source_divergence,
}
SQL = {
    "op3_content_archive": OP3_SQL,
    "op4_near_duplicates": OP4_SQL,
    "op5_chat_masks": OP5_SQL,
    "op6_license_scan": OP6_SQL,
    "op7_quality_rules": OP7_SQL,
    "op9_hash_tree_shards": OP9_SQL,
    "op10_secret_spans": OP10_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_exact_search": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
