"""A source's limits bound folders; tables are screened whole."""

import dataclasses

import pandas as pd
import pytest

from siftwell.functions import contracts as C
from siftwell.plans import queries
from siftwell.sources import providers
from tests.oracle import both, connect


@pytest.mark.parametrize("name", ["candidate_order", "session_manifest", "evidence_by_ids", "session_refinement", "session_review_targets", "session_summary"])
def test_tables_beyond_the_limits_are_screened_whole(spark, tmp_path, monkeypatch, name):
    texts = [f"line {i}\nthe token: a{i} and\npassword = b{i}" if i % 3 else f"none {i}" for i in range(40)]
    pd.DataFrame({"doc_id": range(40), "text": texts, "lang": "en", "source": [f"src{i % 4}" for i in range(40)]}).to_parquet(tmp_path / "documents.parquet")
    small = dataclasses.replace(queries.AUDIT.source, limits=C.Limits(1, 1, 1))
    monkeypatch.setattr(queries, "AUDIT", dataclasses.replace(queries.AUDIT, source=small))
    got, want = both(spark, connect(str(tmp_path)), str(tmp_path), queries.QUERIES[name], queries.SQL[name])
    assert got == want and got[1]


def test_folders_beyond_the_limits_are_refused(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("x x")
    source = lambda *limits: C.Source(("*.txt",), patterns=(C.Pattern("p", "p", "x"),), limits=C.Limits(*limits))
    found = lambda *limits: providers.GenericProvider(source(*limits)).discover(spark, str(tmp_path)).count()
    assert found(2, 3, 4) == 4
    for limits in ((1, 3, 4), (2, 2, 4), (2, 3, 3)):
        with pytest.raises(C.ContractError):
            found(*limits)
