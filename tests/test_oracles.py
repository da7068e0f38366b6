"""Queries against their SQL twins on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from travelfields import oracles, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = ["p3_p5_way_rules", "g5_cut_segments", "g7_components", "g10_directed_edges", "g13_junctions", "d4_points_in_rings", "d8_nearest_within", "d10_zone_of_cells", "c1_weekly_cost", "c3_summary", "c5_compare_places", "v3_band_borders", "k1_clean_measurements", "k5_merged_template", "k9_normal_equations"]


def _norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.8g}" if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    want = Counter(tuple(_norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


STORED = ["s1_elements", "s2_merged_nodes", "s2_merged_ways", "s3_boundary_names", "d2_assembled_rings", "s4_s5_stored_measurements", "s6_stored_nodes", "s6_stored_edges", "s6_stored_cells", "s7_stored_slots", "s8_parsed_points", "k6_new_rows", "k7_snapped_pairs", "k7_unknown_pairs", "k13_diagnostics", "d9_nearest_any"]


@pytest.mark.parametrize("name", STORED)
def test_stored_and_snapped(spark, name):
    test_twin(spark, name)
