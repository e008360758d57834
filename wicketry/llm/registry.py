"""The corpus queries and the SQL that checks them."""

from . import bpe, decontaminate, infill, licenses, minhash, mixing, negatives, neighbours, paragraphs, phrases, pii, simhash, toxicity


def queries():
    return {
        "op1_fingerprints": simhash.op1_fingerprints,
        "op2_near_dedup": minhash.op2_near_dedup,
        "op3_pii": pii.op3_pii,
        "op4_substring_dedup": paragraphs.op4_substring_dedup,
        "op5_licenses": licenses.op5_licenses,
        "op6_bpe": bpe.op6_bpe,
        "op7_mixing": mixing.op7_mixing,
        "op8_suffix_dedup": phrases.op8_suffix_dedup,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_neighbours": neighbours.op10_neighbours,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_infill": infill.op12_infill,
        "op13_decontamination": decontaminate.op13_decontamination,
    }


def oracle_sql():
    return {"op2_near_dedup": minhash.OP2_SQL, "op7_mixing": mixing.OP7_SQL, "op11_hard_negatives": negatives.OP11_SQL, "op12_infill": infill.OP12_SQL, "op13_decontamination": decontaminate.OP13_SQL}
