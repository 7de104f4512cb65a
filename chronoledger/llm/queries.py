"""The registered queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from .audio import op9_audio_features
from .bpe import op11_bpe_encoding
from .langmodel import op3_lm_scoring
from .merkle import MERKLE_SQL, op13_merkle_manifest
from .mixing import op2_source_mixing
from .near_dedup import op5_minhash_near_dedup
from .pii import op8_pii_pseudonyms
from .quality import op6_quality_classifier
from .sentencepieces import op4_sentencepiece
from .substring_dedup import op1_substring_dedup
from .token_rollup import ROLLUP_SQL, op10_token_rollup
from .topk import TOPK_SQL, op7_exact_topk
from .variants import VARIANTS_SQL, op12_spelling_variants


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_substring_dedup, op2_source_mixing, op3_lm_scoring, op4_sentencepiece, op5_minhash_near_dedup,
            op6_quality_classifier, op7_exact_topk, op8_pii_pseudonyms, op9_audio_features, op10_token_rollup,
            op11_bpe_encoding, op12_spelling_variants, op13_merkle_manifest,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_topk": TOPK_SQL, "op10_token_rollup": ROLLUP_SQL, "op12_spelling_variants": VARIANTS_SQL, "op13_merkle_manifest": MERKLE_SQL}
