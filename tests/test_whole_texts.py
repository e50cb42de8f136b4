"""The registered queries read whole texts."""

import pytest

from revulet import queries
from revulet.fixtures import raw_reviews

LONG = "word " * 40 + "end of a long text"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, ("=" if i == 5 else "") + LONG, "en") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_csv_cells_hold_whole_texts(spark, folder):
    got = {r.doc_id: r.cell for r in queries.csv_cells_guarded(spark, folder).collect()}
    assert got == {0: "'=" + LONG, 1: "'+" + LONG, 2: "'-" + LONG, 3: "'@" + LONG, 4: '"' + LONG, 5: "'=" + LONG}


def test_review_bodies_hold_whole_texts(spark, folder):
    bodies = [r.body for r in raw_reviews(spark, folder).collect()]
    assert len(bodies) == 8 and all(b.endswith(". " + LONG) or b.endswith(". =" + LONG) for b in bodies)
    assert all(r.body.endswith(LONG) for r in queries.normalize_reviews(spark, folder).collect())
