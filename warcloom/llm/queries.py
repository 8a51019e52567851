"""The queries that apply each operator to its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .embedding_dedup import LOOSE_SQL, OP7_SQL, embedding_classes_loose, op7_embedding_near_dedup
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .langid import op3_language_id
from .mixing import OP4_SQL, op4_mixing_curriculum
from .ngram_join import OP6_SQL, op6_ngram_jaccard_join
from .packing import op2_best_fit_packing
from .pii import op8_personal_data
from .secret_scan import op9_secret_scan
from .token_scan import op10_token_counts
from .toxicity import op5_toxicity

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_mixing_curriculum": op4_mixing_curriculum,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_personal_data": op8_personal_data,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_counts": op10_token_counts,
    "embedding_classes_loose": embedding_classes_loose,
}

ORACLE_SQL = {
    "op1_exact_dedup": OP1_SQL,
    "op4_mixing_curriculum": OP4_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
    "embedding_classes_loose": LOOSE_SQL,
}
