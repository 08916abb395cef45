"""Lookups broadcast whole, in part and not at all give the same rows over whole tables."""

import os

import pytest

from folio.llm import encoding, residue, scan_noise, truncation
from folio.session import table

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
RUNS = {
    "p1": lambda spark, limit: scan_noise.find_noise(table(spark, DATA, "pages"), table(spark, DATA, "chapters"), limit),
    "p2": lambda spark, limit: truncation.find_cut(table(spark, DATA, "model_outputs"), limit=limit),
    "p5": lambda spark, limit: residue.find_residue(table(spark, DATA, "model_outputs"), limit=limit),
    "p8": lambda spark, limit: encoding.restore_all(table(spark, DATA, "documents"), limit=limit),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_same_rows(spark, name):
    whole, part, none = (sorted(map(tuple, RUNS[name](spark, limit).collect()), key=repr) for limit in (None, 60_000, 0))
    assert whole and whole == part == none
