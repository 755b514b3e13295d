import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.llm import queries as Q
from maskwright.llm.bpe import bpe_decode, bpe_encode
from maskwright.llm.token_counts import count_tokens

from .conftest import SF

BPE, PIECES = f"{Q.TOKENIZERS}/word_bpe_49k.json", f"{Q.TOKENIZERS}/piece_bpe_32k.model"
pytestmark = pytest.mark.skipif(not os.path.exists(BPE), reason="no vocabularies")


def _library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.no_truncation()
    t.no_padding()
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def test_op1_equals_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    got = Q.op1_bpe(spark, SF).toPandas().set_index("doc_id").loc[docs.index]
    ids, texts = _library(docs.text.fillna("").tolist())
    assert got.n_tokens.tolist() == [len(i) for i in ids]
    assert got.ids_sha256.tolist() == [hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in ids]
    assert got.decoded_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_bpe_odd_rows(odd, empty):
    rows = bpe_decode(bpe_encode(odd, BPE), BPE).collect()
    ids, texts = _library([r.text or "" for r in rows])
    assert [np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows] == ids
    assert [r.decoded for r in rows] == texts
    assert bpe_encode(empty, BPE).count() == 0


def test_op8_equals_library(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    got = Q.op8_token_counts(spark, SF).toPandas().set_index("doc_id").loc[docs.index]
    assert got.n_tokens.tolist() == [len(x) for x in model.encode(docs.text.fillna("").tolist())]
    assert got.n_bytes.tolist() == [len(x.encode()) for x in docs.text.fillna("")]
    assert got.over_limit.tolist() == (got.n_tokens > 4096).tolist()
    rows = count_tokens(odd, PIECES).collect()
    assert [r.n_tokens for r in rows] == [len(model.encode(r.text or "")) for r in rows]
    assert count_tokens(odd.where(F.lit(False)), PIECES).count() == 0
