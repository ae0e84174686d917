"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from recordlink.llm.decontaminate import op10_decontaminate
from recordlink.llm.html_text import op4_html_text
from recordlink.llm.language import op3_language_id
from recordlink.llm.lexical_search import OP11_SQL, op11_lexical_search
from recordlink.llm.line_dedup import OP8_SQL, op8_line_dedup
from recordlink.llm.minhash import op5_minhash
from recordlink.llm.ngram_join import OP13_SQL, op13_ngram_join
from recordlink.llm.packing import op6_best_fit_packing
from recordlink.llm.pii import OP9_SQL, op9_pii
from recordlink.llm.resampling import OP12_SQL, op12_resampling
from recordlink.llm.substring_dedup import op1_suffix_dedup
from recordlink.llm.topk import OP7_SQL, op7_topk
from recordlink.llm.url_reputation import OP2_SQL, op2_url_filter

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_html_text": op4_html_text,
    "op5_minhash": op5_minhash,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_topk": op7_topk,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
    "op11_lexical_search": op11_lexical_search,
    "op12_resampling": op12_resampling,
    "op13_ngram_join": op13_ngram_join,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_url_filter": OP2_SQL,
    "op7_topk": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_pii": OP9_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_resampling": OP12_SQL,
    "op13_ngram_join": OP13_SQL,
}
