"""The registered queries against their SQL on the smallest tables, and what every one of them returns."""

import duckdb
import pytest

from strandmix.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_like_its_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.execute(ORACLE[name])
    names = [x[0] for x in want.description]
    show = lambda row: tuple("null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(names) == sorted(got.columns)
    assert sorted(show(r) for r in got.select(*names).collect()) == sorted(show(r) for r in want.fetchall())


def test_pages_are_those_of_the_digests(spark):
    pages, digests = QUERIES["tiff_pages"](spark, SF).collect(), {r.doc_id: r for r in QUERIES["op5_tiff"](spark, SF).collect()}
    assert not any(r.error for r in pages)
    per = {}
    for r in pages:
        per.setdefault(r.doc_id, []).append(r)
    assert set(per) == set(digests)
    for doc, own in per.items():
        assert len(own) == digests[doc].pages and sum(r.width * r.length * r.channels for r in own) == digests[doc].payload_bytes
        assert len(own) > 1 or own[0].feature == digests[doc].feature
