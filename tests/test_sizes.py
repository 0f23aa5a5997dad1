"""Work that must not grow faster than the tables, or stay in one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from shelfspark.functions import products as P
from shelfspark.operators import graph, resolve


@pytest.mark.parametrize("name", ["terpene_profile", "link_harvest", "table_records", "enriched_records"])
def test_one_file_of_keys_is_dealt_out(spark, sf, name):
    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_a_terpene_is_named_once(spark):
    told = str(P.fold_terpenes(F.col("raw"))._jc.toString())
    assert told.count("regexp_replace") == 1


def test_stores_at_one_point_are_tied_in_proportion(spark, monkeypatch):
    n, edges = 120, []

    def counted(e, *more):
        edges.append(e.count())
        return graph.components(e, *more)

    monkeypatch.setattr(resolve, "components", counted)
    one = lambda i, state, name, lat: (i, i, name, state, "own", f"{name} {i}", f"{i} Oak Ave", "Town", str(10000 + i), lat, -75.0, None, None, None)
    rows = [one(i, "PA", "Acme", 40.0) for i in range(1, n + 1)]
    rows += [one(500, "PA", "Acme", 40.0005), one(501, "PA", "Acme", 40.01), one(502, "PA", "Other", 40.0), one(503, "OH", "Acme", 40.0), one(504, "PA", None, 40.0), one(505, "PA", "Acme", 41.0), one(506, "PA", "Acme", -41.0), one(507, "PA", "Acme", None)]
    rows += [(508, 3, "None", None, "own", "x", "9 Oak Ave", "Town", "17011", None, None, None, None, None), (509, 4, "None", None, "own", "x", "9 Oak Avenue", "Town", "17011", None, None, None, None, None)]
    schema = "id long, company_id long, canonical_name string, state string, source string, name string, address string, city string, zip_code string, latitude double, longitude double, platform string, external_id string, canonical_company_id int"
    got = {r.id: r for r in resolve.dedupe(spark.createDataFrame(rows, schema)).collect()}
    want = {**dict.fromkeys([*range(1, n + 1), 500], 1), **{i: i for i in range(501, 509)}, 509: 508}
    assert {i: r.grp for i, r in got.items()} == want
    assert got[n].operator == got[1].operator and got[508].kept == got[509].kept
    assert edges[0] < 4 * len(rows)


def test_a_size_is_read_once(spark):
    told = lambda c: str(c._jc.toString()).count("try_to_number")
    assert told(P.enrich_variants(F.col("v"), F.col("c"), ["price"])) == told(P.size_to_grams(F.col("o")))
