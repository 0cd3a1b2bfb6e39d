"""The queries of this subpackage and their SQL, as `__spark_entry__` registers them."""

from __future__ import annotations

from .embedding_links import op5_embedding_links
from .language_id import op2_language_id
from .mixture import OP6_SQL, op6_mixture
from .packing import op8_packing
from .pii import op11_personal
from .quality_model import op9_quality_model
from .quality_rules import OP1_SQL, op1_quality_rules
from .secret_scan import OP7_SQL, op7_secrets
from .sessions import OP12_SQL, op12_sessions
from .simhash import op4_simhash
from .spelling import op13_spelling
from .token_binary import op10_token_binary
from .token_counts import op3_token_counts

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_simhash": op4_simhash,
    "op5_embedding_links": op5_embedding_links,
    "op6_mixture": op6_mixture,
    "op7_secrets": op7_secrets,
    "op8_packing": op8_packing,
    "op9_quality_model": op9_quality_model,
    "op10_token_binary": op10_token_binary,
    "op11_personal": op11_personal,
    "op12_sessions": op12_sessions,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL = {
    "op1_quality_rules": OP1_SQL,
    "op6_mixture": OP6_SQL,
    "op7_secrets": OP7_SQL,
    "op12_sessions": OP12_SQL,
}
