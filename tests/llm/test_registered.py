"""Every registered query of this subpackage over a small table, and the SQL of those that have any."""

import duckdb
import pytest

from lodestone.llm import queries
from tests.test_queries import TABLES, key, plain

COLUMNS = {
    "op1": {"doc_id", "held_out", "score", "predicted"},
    "op2": {"doc_id", "fingerprint", "component_id"},
    "op3": {"page_id", "url", "text", "n_chars"},
    "op4": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op5": {"page_id", "host", "path", "rule", "verdict"},
    "op6": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op7": {"doc_id", "held_out", "lang_pred", "score"},
    "op8": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9": {"doc_id", "size", "source_size", "target", "taken"},
    "op11": {"doc_id", "n_features", "weight", "score", "rank"},
    "op12": {"word", "form", "root", "n", "n_near", "form_n"},
    "op13": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op10": {"doc_id", "item_id", "contaminated", "coverage"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    op = name.split("_")[0]
    assert COLUMNS[op] <= set(df.columns)
    table = "pages" if op in ("op3", "op5", "op6") else "documents"
    n, all_rows = df.count(), spark.read.parquet(f"{sf}/{table}.parquet").count()
    assert n == all_rows if op not in ("op10", "op12") else 0 < n and (op == "op12" or n < all_rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = c.execute(queries.ORACLES[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(plain(r[names.index(k)]) for k in cols) for r in cur.fetchall()), key=key)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=key) == want
