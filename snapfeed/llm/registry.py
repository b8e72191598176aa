"""Registered queries of this subpackage and their SQL."""

from . import (archives, bitsliced, fingerprints, licenses, mixing, neardup, negatives, packing, passages, quality, secrets, spelling,
               toxicity)

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_licenses": licenses.op2_licenses,
    "op3_packing": packing.op3_packing,
    "op4_passages": passages.op4_passages,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_neardup": neardup.op7_neardup,
    "op8_archives": archives.op8_archives,
    "op9_bitsliced": bitsliced.op9_bitsliced,
    "op10_secrets": secrets.op10_secrets,
    "op11_quality": quality.op11_quality,
    "op12_negatives": negatives.op12_negatives,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {"op6_mixing": mixing.OP6_SQL, "op8_archives": archives.OP8_SQL, "op9_bitsliced": bitsliced.OP9_SQL,
              "op12_negatives": negatives.OP12_SQL, "op13_spelling": spelling.OP13_SQL}
