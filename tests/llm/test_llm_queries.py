"""All llm queries run on the smallest tables; those with SQL agree with it."""

import duckdb
import pytest

from qaloom.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in catalogue.ORACLES:
        con = duckdb.connect()
        for t in ("request", "responses", "train_sft", "selected_qids", "detailed_results", "documents", "sample_target", "mix_target", "eval_item"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.sql(catalogue.ORACLES[name])
        key = lambda rows, columns: sorted(str([r[columns.index(c)] for c in sorted(columns)]) for r in rows)
        assert sorted(df.columns) == sorted(want.columns)
        assert key([tuple(r) for r in rows], df.columns) == key(want.fetchall(), want.columns)


def test_found_rows_come_from_the_operators(spark, sf, monkeypatch):
    """p5_found draws its samples and p8_found its mixture; their rows are those that the plans call short."""
    calls = []
    for module, name in ((catalogue.proportional, "proportional_sample"), (catalogue.mixing, "mixture")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **kw: calls.append(n) or f(*a, **kw))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    p5, p8 = rows(catalogue.p5_found(spark, sf)), rows(catalogue.p8_found(spark, sf))
    assert calls == ["proportional_sample"] * len(catalogue.FIELDS) + ["mixture"]
    assert p5 == rows(catalogue.p5_plan(spark, sf).where("not met").select("field_name", "category").distinct())
    assert p8 == rows(catalogue.p8_plan(spark, sf).where("short").select("source").distinct())
