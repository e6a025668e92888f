"""Names of the queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, jaccard, mixing, negatives, secrets
from .chat import op8_chat_formatting
from .classes import op12_lm_scoring
from .jaccard import op1_ngram_jaccard
from .language import op4_language_id
from .licences import op2_license_scans
from .mixing import op9_mixing
from .negatives import op13_hard_negatives
from .neighbours import op6_nearest_neighbours
from .pieces import op7_sentencepiece
from .quality import op10_quality_rules
from .repeats import op5_repeated_substrings
from .runs import op11_periodic_runs
from .secrets import op3_secret_scans

QUERIES = {run.__name__: run for run in (
    op1_ngram_jaccard, op2_license_scans, op3_secret_scans, op4_language_id, op5_repeated_substrings,
    op6_nearest_neighbours, op7_sentencepiece, op8_chat_formatting, op9_mixing, op10_quality_rules,
    op11_periodic_runs, op12_lm_scoring, op13_hard_negatives)}
ORACLES = {"op1_ngram_jaccard": jaccard.SQL, "op3_secret_scans": secrets.SQL, "op8_chat_formatting": chat.SQL,
           "op9_mixing": mixing.SQL, "op13_hard_negatives": negatives.SQL}
