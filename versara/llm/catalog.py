"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from .fingerprint import op5_fingerprint
from .html_text import op9_html
from .langid import op3_langid
from .media import op4_media
from .mixing import OP10_SQL, op10_mixing
from .packing import op2_packing
from .sharding import OP7_SQL, op7_sharding
from .simhash import op8_simhash
from .token_files import op6_token_files
from .url_templates import op1_url_templates

QUERIES = {
    "op1_url_templates": op1_url_templates,
    "op2_packing": op2_packing,
    "op3_langid": op3_langid,
    "op4_media": op4_media,
    "op5_fingerprint": op5_fingerprint,
    "op6_token_files": op6_token_files,
    "op7_sharding": op7_sharding,
    "op8_simhash": op8_simhash,
    "op9_html": op9_html,
    "op10_mixing": op10_mixing,
}
#: The others need a tokenizer, a trained model, a hash that DuckDB lacks, or a parser; tests hold them
#: against brute force, round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op7_sharding": OP7_SQL, "op10_mixing": OP10_SQL}
