"""Registered queries of this folder and their DuckDB forms."""

from __future__ import annotations

from logweave.llm import collocations, fingerprint, kneser_ney, langid, mixing, negatives, ngram_join, packing, perspectives, quality, secrets, surrogates, toxicity
from logweave.session import tune


def _job(run):
    def query(spark, sf_dir):
        return run(tune(spark), sf_dir)

    query.__doc__ = run.__doc__
    return query


QUERIES = {
    "op1_language_id": _job(langid.query),
    "op2_line_quality": _job(quality.query),
    "op3_ngram_jaccard": _job(ngram_join.query),
    "op4_secret_scan": _job(secrets.query),
    "op5_toxicity": _job(toxicity.query),
    "op6_mix_sources": _job(mixing.query),
    "op7_fingerprint": _job(fingerprint.query),
    "op8_chat_perspectives": _job(perspectives.query),
    "op9_pii_surrogates": _job(surrogates.query),
    "op10_pack_hilbert": _job(packing.query),
    "op11_hard_negatives": _job(negatives.query),
    "op12_kneser_ney": _job(kneser_ney.query),
    "op13_collocations": _job(collocations.query),
}

ORACLES = {
    "op2_line_quality": quality.SQL,
    "op8_chat_perspectives": perspectives.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op13_collocations": collocations.SQL,
}
