"""Queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from tessera.llm import fill_middle, licenses, mixing, periodic, quality, repeats
from tessera.llm.bpe import op4_byte_bpe
from tessera.llm.html_content import op5_dom_content
from tessera.llm.language import op1_language_mixture
from tessera.llm.language_model import op8_suffix_tree_lm
from tessera.llm.media import op6_png_media
from tessera.llm.quality import op3_quality_divergence
from tessera.llm.simhash import op2_simhash_pivots
from tessera.llm.toxicity import op7_toxicity_nbsvm


def queries() -> dict:
    import corpus_pipeline

    ops = [op1_language_mixture, op2_simhash_pivots, op3_quality_divergence, op4_byte_bpe, op5_dom_content, op6_png_media, op7_toxicity_nbsvm, op8_suffix_tree_lm, licenses.op9_license_digests, mixing.op10_source_mixing, repeats.op11_repeated_windows, fill_middle.op12_fill_in_middle, periodic.op13_periodic_runs]
    return {op.__name__: op for op in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_divergence": quality.SQL, "op9_license_digests": licenses.sql(), "op10_source_mixing": mixing.SQL, "op11_repeated_windows": repeats.SQL, "op12_fill_in_middle": fill_middle.SQL, "op13_periodic_runs": periodic.SQL}
