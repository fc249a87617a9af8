"""The text operators' queries and their SQL, by name."""

from __future__ import annotations

from .ann import op8_ivfpq_search
from .bpe import op9_bpe_encode
from .collocations import OP13_SQL, op13_collocations
from .html import op10_html_extract
from .licenses import op2_license_scan
from .lm_score import op3_lm_score
from .mixing import op5_pfair_mixing
from .ngram_join import OP4_SQL, op4_ngram_join
from .periodic_runs import op12_periodic_runs
from .shuffle_shards import op11_shuffle_shards
from .spotsigs import op6_spot_signatures
from .toxicity import op1_toxicity
from .warc import OP7_SQL, op7_warc_round_trip

QUERIES = {
    "op2_license_scan": op2_license_scan,
    "op3_lm_score": op3_lm_score,
    "op6_spot_signatures": op6_spot_signatures,
    "op4_ngram_join": op4_ngram_join,
    "op1_toxicity": op1_toxicity,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op10_html_extract": op10_html_extract,
    "op8_ivfpq_search": op8_ivfpq_search,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op9_bpe_encode": op9_bpe_encode,
    "op11_shuffle_shards": op11_shuffle_shards,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_join": OP4_SQL,
    "op7_warc_round_trip": OP7_SQL,
    "op13_collocations": OP13_SQL,
}
