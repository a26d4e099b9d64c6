"""Registered queries against their SQL in DuckDB, on the smallest driver tables where they are present."""

import os

import duckdb
import pytest

from tessera import registry

PLACE = "/root/testdata/sf0.001"
NAMES = ["clean_adaptive", "clean_funnel", "gene_harmonize", "cut_fraction", "fourmer_abundance", "fisher_clones", "betabinom_nll", "auroc", "average_precision", "recall_at_k", "depth_nested", "driver_match", "age_match", "gene_components", "repertoire_distance", "streamed_ingest", "knn_vectors", "close_pairs", "sequence_decisions", "attributed_motifs", "simulated_chance", "betabinom_posterior"]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted("|".join("N" if x is None or x != x else str(x) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{PLACE}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(PLACE), reason="no driver tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, engine, name):
    assert rows(registry.QUERIES[name](spark, PLACE).toPandas()) == rows(engine.sql(registry.ORACLE_SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
