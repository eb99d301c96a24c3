"""The queries of this subpackage, one for each numbered operator, and their SQL where SQL can express them."""

from __future__ import annotations

from seqweft.llm import licenses
from seqweft.llm.bpe import op10_bpe
from seqweft.llm.decontaminate import op3_decontaminate
from seqweft.llm.jaccard import op5_jaccard
from seqweft.llm.licenses import op9_licenses
from seqweft.llm.quality import op6_quality
from seqweft.llm.ranked_search import op12_ranked_search
from seqweft.llm.secrets import op7_secrets
from seqweft.llm.suffix_dedup import op2_suffix_dedup
from seqweft.llm.token_frames import op13_token_frames
from seqweft.llm.toxicity import op8_toxicity
from seqweft.llm.warc import op1_warc
from seqweft.llm.webp import op4_webp
from seqweft.llm.whitening import op11_whitening

QUERIES = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_webp": op4_webp,
    "op5_jaccard": op5_jaccard,
    "op6_quality": op6_quality,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_licenses": op9_licenses,
    "op10_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_ranked_search": op12_ranked_search,
    "op13_token_frames": op13_token_frames,
}

ORACLE_SQL: dict[str, str] = {"op9_licenses": licenses.oracle_sql()}
