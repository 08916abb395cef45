"""Queries of the llm subpackage."""

from __future__ import annotations

from folio.llm import bpe, encoding, mixing, packing, residue, scan_noise, splitting, truncation


def queries():
    return {
        "p1_found": scan_noise.p1_found,
        "p1_paragraphs": scan_noise.p1_paragraphs,
        "p2_found": truncation.p2_found,
        "p2_rates": truncation.p2_rates,
        "p3_found": splitting.p3_found,
        "p3_pieces": splitting.p3_pieces,
        "p4_found": packing.p4_found,
        "p4_containers": packing.p4_containers,
        "p4_fill": packing.p4_fill,
        "p5_found": residue.p5_found,
        "p5_clean": residue.p5_clean,
        "p6_ids": bpe.p6_ids,
        "p8_found": encoding.p8_found,
        "p8_restored": encoding.p8_restored,
        "p7_mix": mixing.p7_mix,
        "p7_shares": mixing.p7_shares,
    }


def oracle_sql():
    return {"p3_found": splitting.P3_FOUND_SQL, "p4_found": packing.P4_FOUND_SQL}
