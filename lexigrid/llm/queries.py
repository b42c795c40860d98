"""The queries of the training-data operators, and SQL where it can express them."""

from lexigrid.llm.concurrency import OP13_SQL, op13_peak_concurrency
from lexigrid.llm.decontaminate import op4_decontaminate
from lexigrid.llm.html import op7_html_extract
from lexigrid.llm.language import op3_language_id
from lexigrid.llm.lines import OP10_SQL, op10_line_dedup
from lexigrid.llm.mixing import op8_mix_sources
from lexigrid.llm.quality import op11_quality_rules
from lexigrid.llm.secrets import op1_secret_scan
from lexigrid.llm.simhash import op2_simhash_dedup
from lexigrid.llm.spelling import OP12_SQL, op12_spelling_variants
from lexigrid.llm.syncmers import op6_syncmers
from lexigrid.llm.tokens import op5_token_output
from lexigrid.llm.urls import OP9_SQL, op9_url_filter

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_language_id": op3_language_id,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_output": op5_token_output,
    "op6_syncmers": op6_syncmers,
    "op7_html_extract": op7_html_extract,
    "op8_mix_sources": op8_mix_sources,
    "op9_url_filter": op9_url_filter,
    "op10_line_dedup": op10_line_dedup,
    "op11_quality_rules": op11_quality_rules,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_peak_concurrency": op13_peak_concurrency,
}
ORACLE = {"op9_url_filter": OP9_SQL, "op10_line_dedup": OP10_SQL, "op12_spelling_variants": OP12_SQL, "op13_peak_concurrency": OP13_SQL}
