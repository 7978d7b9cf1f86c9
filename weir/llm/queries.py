"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from weir.llm.bpe import op5_lexicon_bpe
from weir.llm.decontam import OP3_SQL, op3_positional_index
from weir.llm.langid import op8_script_viterbi
from weir.llm.lm import op4_log_bilinear
from weir.llm.media import op6_gear_chunks
from weir.llm.near_dedup import OP2_SQL, op2_circulant_minhash
from weir.llm.pii import op10_keyed_surrogates
from weir.llm.sharding import op1_histogram_shards
from weir.llm.suffix_dedup import op7_cover_suffixes
from weir.llm.toxicity import op9_crf_toxicity

QUERIES = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_circulant_minhash": op2_circulant_minhash,
    "op3_positional_index": op3_positional_index,
    "op4_log_bilinear": op4_log_bilinear,
    "op5_lexicon_bpe": op5_lexicon_bpe,
    "op6_gear_chunks": op6_gear_chunks,
    "op7_cover_suffixes": op7_cover_suffixes,
    "op8_script_viterbi": op8_script_viterbi,
    "op9_crf_toxicity": op9_crf_toxicity,
    "op10_keyed_surrogates": op10_keyed_surrogates,
}

#: The other operators need checksums, models or byte strings that SQL doesn't have; the tests hold them against brute force.
ORACLES = {"op2_circulant_minhash": OP2_SQL, "op3_positional_index": OP3_SQL}
