"""SQL twins against the plain models on odd rows: null, empty, very long and repeated texts, null ids."""

from __future__ import annotations

from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from voxweave.llm import queries

from . import brute
from .test_operators import BASE, odd_rows

TWINS = [(n, m, w) for n, m, w in BASE if n in queries.SQL]
ITEMS = [(1, "beta alpha"), (2, None), (3, ""), (4, odd_rows()[0][1][:300]), (4, odd_rows()[0][1][:300]), (None, "one")]


def answer(name, rows, items):
    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()),
                          "source": pa.array([None if d == 5 else f"s{(d or 0) % 3}" for d, _ in rows], pa.string())})
    benchmark = pa.table({"item_id": pa.array([r[0] for r in items], pa.int64()), "text": pa.array([r[1] for r in items], pa.string())})
    con.register("documents", documents), con.register("benchmark", benchmark)
    return con.execute(queries.SQL[name]).fetchall()


@pytest.mark.parametrize("name,model,width", TWINS, ids=[t[0] for t in TWINS])
def test_twin_equals_model(name, model, width):
    got = [r[:width] for r in answer(name, odd_rows(), ITEMS)]
    assert Counter(got) == Counter(model(odd_rows(), ITEMS))
    assert answer(name, [], []) == []


def test_null_and_repeated_ids():
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (4, text), (4, text), (2, text)]
    assert Counter((r[0], r[2]) for r in answer("op1_substring_dedup", rows, [])) == Counter({(None, 60): 2, (4, 60): 2, (2, 0): 1})
    got = Counter((r[0], r[2], r[3]) for r in answer("op7_near_dedup", rows, []))
    assert got == Counter({(None, 2, False): 2, (4, 2, False): 2, (2, 2, True): 1})
