import glob
import os

import duckdb
import pytest

from sievelake import queries as core

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_same_as_sql(spark, duck, name):
    df = core.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.sql(core.oracle_sql()[name])
    assert sorted(found.columns) == columns
    want = found.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, want))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_known_figures(spark):
    from sievelake.operators import content, survey
    from sievelake.sources.tables import documents_as_files, with_shared_inode

    files = documents_as_files(spark, DATA)
    totals = survey.totals(files).first()
    assert (totals["files"], totals["distinct_sizes"]) == (200, 183)
    row = content.stats(content.hashed(files)).first()
    assert (row["files_deduped"], row["bytes_saved"]) == (11, 29443)
    shared = content.stats(with_shared_inode(files)).first()
    assert (shared["files_deduped"], shared["already_deduped"], shared["bytes_saved"]) == (9, 2, 25246)
    assert [tuple(r) for r in survey.top(survey.size_survey(files), 2).collect()] == [(4186, 3, 8372), (5991, 2, 5991)]
