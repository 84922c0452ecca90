import pytest
from comparing import assert_same, connect

from tesela.llm import queries as q

QUERIES, SQL = q.queries(), q.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf_dir, name):
    assert_same(spark, con, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns
    df.collect()


FOUND = {
    "p1_found": ["tabla", "doc_id", "linea", "idioma"], "p2_found": ["doc_id", "clase"], "p3_found": ["doc_id", "termino"], "p4_found": ["doc_id", "linea"], "p5_found": ["termino", "clase"],
    "p6_found": ["tabla", "id", "linea"], "p7_found": ["doc_id"], "p8_found": ["item_id", "doc_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_columns(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns == FOUND[name]
