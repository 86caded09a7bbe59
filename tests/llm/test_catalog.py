import pytest

from lodestrata.llm import catalog
from tests.conftest import DATA

SHAPES = {
    "p1_found": "sha256 string, start_at bigint, kind string", "p2_found": "sha256_a string, sha256_b string", "p3_found": "sha256 string, field string", "p4_found": "sha256 string, seg_no bigint, lang string",
    "p5_found": "field string, sha256 string", "p6_found": "sha256 string, line_no bigint", "p8_found": "doc_id bigint, item_id bigint", "p9_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_runs_with_distinct_rows(name, spark):
    df = catalog.QUERIES[name](spark, DATA).cache()
    if name in SHAPES:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == SHAPES[name]
        assert df.count() == df.distinct().count() > 0
    else:
        assert df.count() > 0
    df.unpersist()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(name, same):
    same(catalog.QUERIES[name], catalog.SQL[name])
