"""The queries of this subpackage and their SQL, where SQL can express them."""

from tidebar.llm import decontaminate, language, linededup, ngram_join, pieces, pii, quality, spelling, suffixes, toxicity, warc, wavelet, whitening

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_language": language.op2_language,
    "op3_wavelet": wavelet.op3_wavelet,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_suffixes": suffixes.op5_suffixes,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pieces": pieces.op7_pieces,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_line_dedup": linededup.op9_line_dedup,
    "op10_ngram_join": ngram_join.op10_ngram_join,
    "op11_whitening": whitening.op11_whitening,
    "op12_spelling": spelling.op12_spelling,
    "op13_warc": warc.op13_warc,
}
ORACLES = {"op9_line_dedup": linededup.OP9_SQL, "op4_decontaminate": decontaminate.OP4_SQL, "op8_quality_rules": quality.OP8_SQL, "op13_warc": warc.OP13_SQL}
