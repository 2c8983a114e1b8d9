from __future__ import annotations

from findrift.functions import paths
from findrift.llm.common import table
from findrift.queries import QUERIES


def test_whole_texts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    assert max(len(t) for t in texts.values() if t) > 60
    got = {r["doc_id"]: r["encoded"] for r in QUERIES["uri_encode"](spark, sf_dir).collect()}
    assert got == {d: None if t is None else paths.encode_uri_body(t) for d, t in texts.items()}
