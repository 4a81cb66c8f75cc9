"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from portage.llm.bpe import op8_bpe_encoding_and_decoding
from portage.llm.chat import op10_chat_formatting
from portage.llm.covertree import op1_exact_top_k_search
from portage.llm.decontaminate import op4_benchmark_decontamination
from portage.llm.fingerprint import op11_document_fingerprints
from portage.llm.langid import op6_language_id
from portage.llm.lexical import op12_ranked_lexical_search
from portage.llm.repair import op13_conversation_structure_repair
from portage.llm.simhash import op3_simhash_near_dedup
from portage.llm.substring import op7_substring_dedup
from portage.llm.toxicity import op9_toxicity
from portage.llm.urlfilter import op2_url_filters
from portage.llm.warc import op5_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_top_k_search, op2_url_filters, op3_simhash_near_dedup, op4_benchmark_decontamination, op5_warc,
        op6_language_id, op7_substring_dedup, op8_bpe_encoding_and_decoding, op9_toxicity, op10_chat_formatting,
        op11_document_fingerprints, op12_ranked_lexical_search, op13_conversation_structure_repair,
    )
}
