"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from roundsmith.llm import spelling, vector_codes, warc
from roundsmith.llm.decontaminate import op7_bm25_leaks
from roundsmith.llm.html_text import op5_html_blocks
from roundsmith.llm.line_quality import op3_line_crf
from roundsmith.llm.ngram_join import op2_ngram_join
from roundsmith.llm.packing import op10_packing
from roundsmith.llm.pii import op6_skip_chain_pii
from roundsmith.llm.repeats import op8_run_length_index
from roundsmith.llm.simhash import op11_simhash_blocks
from roundsmith.llm.token_files import op1_token_planes
from roundsmith.llm.unigram_count import op9_token_counts

QUERIES = {
    "op1_token_planes": op1_token_planes,
    "op2_ngram_join": op2_ngram_join,
    "op3_line_crf": op3_line_crf,
    "op4_warc_zstd": warc.op4_warc_zstd,
    "op5_html_blocks": op5_html_blocks,
    "op6_skip_chain_pii": op6_skip_chain_pii,
    "op7_bm25_leaks": op7_bm25_leaks,
    "op8_run_length_index": op8_run_length_index,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_simhash_blocks": op11_simhash_blocks,
    "op12_va_codes": vector_codes.op12_va_codes,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLES: dict[str, str] = {"op4_warc_zstd": warc.ORACLE_SQL, "op12_va_codes": vector_codes.ORACLE_SQL, "op13_spelling_variants": spelling.ORACLE_SQL}
