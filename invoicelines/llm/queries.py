"""The operators' queries and their SQL, by name."""

from __future__ import annotations

from .audit import OP13_SQL, op13_filter_audit
from .bpe import op12_byte_bpe
from .decontaminate import OP2_SQL, op2_decontaminate
from .dom import op6_html_text
from .importance import OP11_SQL, op11_importance_resampling
from .langid import op3_language_id
from .lattice import op9_lattice
from .mixing import OP7_SQL, op7_mixing
from .pitman_yor import op1_language_model
from .simhash import op10_simhash
from .tokenfile import op4_token_output
from .toxicity import op5_toxicity
from .trie_counts import op8_token_counts

QUERIES = {f.__name__: f for f in (op1_language_model, op2_decontaminate, op3_language_id, op4_token_output, op5_toxicity, op6_html_text, op7_mixing, op8_token_counts, op9_lattice, op10_simhash, op11_importance_resampling, op12_byte_bpe, op13_filter_audit)}
ORACLE_SQL = {"op2_decontaminate": OP2_SQL, "op7_mixing": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op13_filter_audit": OP13_SQL}
