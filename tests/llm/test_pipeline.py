"""The pipeline's stages against plain statements of what each must do to its own input, and the SQL twins."""
import glob
import os
import re

import duckdb
import pytest
from brute import contamination, near_components

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare
from tidemark.llm.common import table
from tidemark.llm.toxicity import toxicity
from tidemark.staging import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = staged(stage(spark, docs, SF), name)
        seen[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == columns and all(r == before[r.doc_id] for r in seen[name][1])
    kept = {name: {r.doc_id for r in after} for name, (_, after) in seen.items()}
    whole = table(spark, SF, "documents")
    assert kept["toxicity"] == {r.doc_id for r in toxicity(whole, whole, table(spark, SF, "labels")).where("not rejected").collect()}
    first = {}
    for i, r in sorted(seen["exact_dedup"][0].items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), i)
    assert kept["exact_dedup"] == set(first.values())
    groups = near_components([(i, r.text) for i, r in seen["near_dedup"][0].items()], 5)
    assert kept["near_dedup"] == {i for i, c in groups.items() if i == c}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    hit = contamination([(i, r.text) for i, r in seen["decontamination"][0].items()], items)
    assert kept["decontamination"] == {i for i, h in hit.items() if not h[-1]} and any(h[-1] for h in hit.values())
    assert kept["packing"] == kept["decontamination"]


@pytest.mark.parametrize("name", ["op5_near_dedup", "op6_licenses", "op7_exact_dedup", "op9_decontamination", "op11_prefix_trie", "op12_turn_repair"])
def test_query_equals_twin(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert compare(queries()[name](spark, SF).toPandas(), con.execute(oracle_sql()[name]).fetchdf()) == "ok"


def test_every_operator_has_its_query():
    assert {f"op{n}_" for n in range(1, 14)} == {name.split("_")[0] + "_" for name in queries() if name.startswith("op")} and "pipeline" in queries()
