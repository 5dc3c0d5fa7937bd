"""Registered queries of the training-data operators."""

from shoal.llm import mixing, quality
from shoal.llm.alignment import op12_alignment
from shoal.llm.decontaminate import op7_decontaminate
from shoal.llm.language import op9_language
from shoal.llm.licenses import op5_licenses
from shoal.llm.packing import op11_packing
from shoal.llm.periodic import op13_periodic_runs
from shoal.llm.pii import op10_pii
from shoal.llm.secrets import op6_secrets
from shoal.llm.simhash import op4_simhash
from shoal.llm.suffixes import op3_suffix_dedup
from shoal.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality": quality.op2_quality,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_secrets": op6_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_pii": op10_pii,
    "op11_packing": op11_packing,
    "op12_alignment": op12_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op2_quality": quality.ORACLE,
}
