import numpy as np
import pytest
from llm_fixtures import DOCS, brute_components, odd

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as C
    from scenaria.llm.common import store, table

    out = [table(spark, SF, "documents")]
    for name, f in C.STAGES:
        out.append(store(f(spark, out[-1], SF), f"test-{name}"))
    return out


def test_each_stage_does_its_work(spark, stages):
    from scenaria.llm import compression_quality as Q
    from scenaria.llm.decontaminate import matches
    from scenaria.llm.piece_tokens import Vocabulary, decode

    rows = [{r.doc_id: r for r in s.collect()} for s in stages]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = {r.doc_id for r in Q.quality_scores(stages[0], labels).where("predicted = 0").collect()}
    assert set(rows[1]) == set(rows[0]) - rejected
    good = [r.doc_id for r in labels.where("quality = 1").collect()]
    assert np.mean([i in rows[1] for i in good]) > 0.97
    ids = sorted(rows[1])
    assert set(rows[2]) == {c for _, c in brute_components(ids, [rows[1][i].text for i in ids], 5, 80).values()}
    held = {r.doc_id for r in matches(stages[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    exact = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows[3]) == set(rows[2]) - held and not any(t in r.text for t in exact for r in rows[3].values())
    assert set(rows[4]) == set(rows[3]) and all(r.n_chars == len(r.text) for r in rows[4].values())
    v = Vocabulary()
    assert all(decode(v, np.array(r.tokens)) == rows[4][i].text for i, r in rows[5].items())
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_stages_take_odd_and_empty_tables(spark):
    import corpus_pipeline as C

    df = odd(spark)
    for name, f in C.STAGES:
        out = f(spark, df, SF)
        assert set(df.columns) <= set(out.columns), name
        assert out.count() <= df.count()
        assert f(spark, df.limit(0), SF).collect() == []


def test_registered(spark):
    import __spark_entry__ as E

    q = E.queries()
    assert "pipeline" in q and all(sum(k.startswith(f"op{n}_") for k in q) == 1 for n in range(1, 11))
    assert set(E.oracle_sql()) <= set(q)
