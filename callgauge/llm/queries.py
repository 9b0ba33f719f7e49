"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from callgauge.llm import lexical_search, spelling, warc
from callgauge.llm.decontaminate import op3_decontamination
from callgauge.llm.fingerprints import op10_fingerprints
from callgauge.llm.licenses import op9_licenses
from callgauge.llm.mixing import op4_mixing
from callgauge.llm.ngram_join import op1_ngram_join
from callgauge.llm.personal import op12_personal_data
from callgauge.llm.quality import op7_quality
from callgauge.llm.secrets import op2_secrets
from callgauge.llm.token_store import op5_token_store
from callgauge.llm.toxicity import op6_toxicity

REGISTRY = {
    "op1_ngram_join": op1_ngram_join,
    "op2_secrets": op2_secrets,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_token_store": op5_token_store,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_warc": warc.op8_warc,
    "op9_licenses": op9_licenses,
    "op10_fingerprints": op10_fingerprints,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_personal_data": op12_personal_data,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

#: The other operators' methods choose, score or hash in ways that SQL doesn't express; their
#: tests hold them against brute force, round trips or held-out labels.
ORACLE: dict[str, str] = {"op8_warc": warc.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op13_lexical_search": lexical_search.ORACLE}
