"""The queries of this package, by name, and their SQL."""

from __future__ import annotations

from tessella.llm import chat, fim, licenses
from tessella.llm.bpe import op13_byte_bpe
from tessella.llm.chat import op7_chat_rotation
from tessella.llm.fim import op12_fill_in_middle
from tessella.llm.html_text import op8_html_extraction
from tessella.llm.langid import op3_language_id
from tessella.llm.licenses import op2_license_scan
from tessella.llm.mixing import op1_source_mixing
from tessella.llm.near_dup import op10_minhash_near_dedup
from tessella.llm.ogg import op6_ogg_media
from tessella.llm.packing import op5_best_fit_packing
from tessella.llm.quality import op4_quality_rules
from tessella.llm.runs import op11_periodic_runs
from tessella.llm.secret_scan import op9_secret_scan

_ALL = (
    op1_source_mixing, op2_license_scan, op3_language_id, op4_quality_rules, op5_best_fit_packing,
    op6_ogg_media, op7_chat_rotation, op8_html_extraction, op9_secret_scan, op10_minhash_near_dedup,
    op11_periodic_runs, op12_fill_in_middle, op13_byte_bpe,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL = {"op2_license_scan": licenses.ORACLE, "op7_chat_rotation": chat.ORACLE, "op12_fill_in_middle": fim.ORACLE}
