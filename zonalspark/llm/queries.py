"""The queries of the training-data operators, and their SQL where SQL can express them."""

from zonalspark.llm.alignment import op13_alignment
from zonalspark.llm.byte_bpe import op5_byte_bpe
from zonalspark.llm.decontamination import OP9_SQL, op9_decontamination
from zonalspark.llm.fingerprints import op7_fingerprints
from zonalspark.llm.html_extraction import op3_html_extraction
from zonalspark.llm.lm_scoring import op10_lm_scoring
from zonalspark.llm.merkle import OP11_SQL, op11_merkle
from zonalspark.llm.mixing import OP12_SQL, op12_mixing
from zonalspark.llm.ngram_join import OP2_SQL, op2_ngram_join
from zonalspark.llm.quality import op6_quality
from zonalspark.llm.suffix_dedup import op8_suffix_dedup
from zonalspark.llm.token_counts import op1_token_counts
from zonalspark.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_join": op2_ngram_join,
    "op3_html_extraction": op3_html_extraction,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality": op6_quality,
    "op7_fingerprints": op7_fingerprints,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_merkle": op11_merkle,
    "op12_mixing": op12_mixing,
    "op13_alignment": op13_alignment,
}

ORACLE_SQL = {"op2_ngram_join": OP2_SQL, "op9_decontamination": OP9_SQL, "op11_merkle": OP11_SQL, "op12_mixing": OP12_SQL}
