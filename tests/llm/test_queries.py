"""The registered queries against their SQL on the smallest tables, and the columns that their contracts name."""

import pytest

from skeinwork.llm import queries
from skeinwork.llm.common import table
from tests import oracle

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ("pages", ["page_id", "host", "path", "rule", "verdict"]),
    "op2": ("documents", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    "op3": ("documents", ["doc_id"]),
    "op4": ("documents", ["doc_id", "class_id", "n_links"]),
    "op5": ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    "op7": ("documents", ["doc_id", "kept"]),
    "op8": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op9": ("documents", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    "op10": ("documents", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    "op11": ("documents", ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]),
    "op12": ("documents", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    oracle.check(queries.QUERIES[name](spark, SF), oracle.connection(SF), queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in queries.ORACLES and n.split("_")[0] in COLUMNS))
def test_a_row_for_each_row(spark, name):
    source, columns = COLUMNS[name.split("_")[0]]
    found = queries.QUERIES[name](spark, SF)
    assert set(columns) <= set(found.columns)
    assert found.count() == table(spark, SF, source).count()
