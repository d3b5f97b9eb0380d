"""The queries of this folder and, where SQL can express them, what DuckDB must return."""

import corpus_pipeline
from pressloom.llm import (
    bpe, chat, collocations, exact_dedup, lexical, licenses, merkle, mixing, near_dups, packing, pii, quality, syncmers,
)

QUERIES = {
    "op1_merkle": merkle.op1_merkle,
    "op2_packing": packing.op2_packing,
    "op3_licenses": licenses.op3_licenses,
    "op4_syncmers": syncmers.op4_syncmers,
    "op5_quality": quality.op5_quality,
    "op6_near_duplicates": near_dups.op6_near_duplicates,
    "op7_mixing": mixing.op7_mixing,
    "op8_pii": pii.op8_pii,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_chat_format": chat.op10_chat_format,
    "op11_lexical": lexical.op11_lexical,
    "op12_bpe": bpe.op12_bpe,
    "op13_collocations": collocations.op13_collocations,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_merkle": merkle.ORACLE,
    "op3_licenses": licenses.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "op11_lexical": lexical.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
