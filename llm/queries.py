"""Queries over the given tables, one per operator, and their SQL twins where SQL can express them."""

from llm.bpe import op5_bpe_segment_tree
from llm.chat import OP2_SQL, op2_perspective_rotation
from llm.embed import OP9_SQL, op9_int8_near_dedup
from llm.language import op3_crf_language
from llm.lexical import OP11_SQL, op11_shared_lexical_search
from llm.packing import op10_mixture_packing
from llm.pii import op1_pii_anchor_expansion
from llm.repeats import op8_difference_cover_dedup
from llm.sharding import OP6_SQL, op6_jump_hash_shards
from llm.sigtree import op7_signature_tree_join
from llm.trie import OP12_SQL, op12_burst_trie
from llm.vafile import OP4_SQL, op4_va_file_top_k
from llm.warc import OP13_SQL, op13_warc_segments

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii_anchor_expansion,
        op2_perspective_rotation,
        op3_crf_language,
        op4_va_file_top_k,
        op5_bpe_segment_tree,
        op6_jump_hash_shards,
        op7_signature_tree_join,
        op8_difference_cover_dedup,
        op9_int8_near_dedup,
        op10_mixture_packing,
        op11_shared_lexical_search,
        op12_burst_trie,
        op13_warc_segments,
    )
}

ORACLES = {
    "op2_perspective_rotation": OP2_SQL,
    "op4_va_file_top_k": OP4_SQL,
    "op6_jump_hash_shards": OP6_SQL,
    "op9_int8_near_dedup": OP9_SQL,
    "op11_shared_lexical_search": OP11_SQL,
    "op12_burst_trie": OP12_SQL,
    "op13_warc_segments": OP13_SQL,
}
