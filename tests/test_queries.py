"""Every registered query of the engine, against its SQL where it has one."""

import pytest

from tests.conftest import rows_of, sql
from tidemark.queries import ORACLES, QUERIES, flagship


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    found = QUERIES[name](spark, small).toPandas()
    if name in ORACLES:
        wanted = sql(small, ORACLES[name])
        assert sorted(found.columns) == sorted(wanted.columns)
        assert rows_of(found) == rows_of(wanted)
    else:
        assert len(found)


@pytest.mark.parametrize("name", ["entity_mentions", "entity_merge", "unit_mentions"])
def test_names_beside_accents(spark, tmp_path, name):
    """Names next to accented letters, vertical tabs and brackets, as the SQL's regular expressions see them."""
    texts = ["Der wandaserver lief, ñdaserverpf und señorserverí", "clientñ ñclient() token()x a_token()() timeout", "Tom\x0bSawyer met Huck \t Finn"]
    rows = [(i, t, f"src{i % 2}", "en", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint").toPandas().to_parquet(tmp_path / "documents.parquet")
    assert rows_of(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows_of(sql(str(tmp_path), ORACLES[name]))


def test_flagship(spark, small):
    rows = flagship(spark, small).toPandas()
    assert len(rows) and set(rows.columns) == {"query_id", "chunk_id", "score", "rank", "holds_passage"}
    assert rows["holds_passage"].any()
