import hashlib
from collections import Counter

import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from maskwright.llm import queries as Q

from .conftest import SF
from .test_dedup import LOWER, _jaccard


def test_pipeline_brute_force(spark, documents):
    """The deterministic stages by plain Python, from what the classifier keeps; the mixture by its own operator."""
    scores = {r.doc_id: r.predicted for r in Q.op3_toxicity(spark, SF).collect()}
    docs = [r for r in documents.collect() if not scores[r.doc_id]]
    assert 0 < len(docs) < documents.count()
    last = {}
    for r in docs:
        key = (r.text or "").translate(LOWER)
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    docs = [r for r in docs if r.doc_id in set(last.values())]
    least = {i: c for i, _, c in _jaccard([(r.doc_id, r.text) for r in docs], 5, 80, 100)}
    docs = [r for r in docs if least[r.doc_id] == r.doc_id]
    mixed = corpus_pipeline.mixing(spark, spark.createDataFrame(docs, documents.schema), SF).collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in docs}
    library = tokenizers.Tokenizer.from_file(f"{Q.TOKENIZERS}/word_bpe_49k.json")
    library.no_truncation()
    library.no_padding()
    want = Counter()
    ids_of = {}
    for r in mixed:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        packed, decoded = b"".join(i.to_bytes(4, "little") for i in ids), library.decode(ids, skip_special_tokens=False)
        ids_of[r.doc_id] = packed
        want[r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(bytes(r.ids) == ids_of[r.doc_id] for r in got) and {(r.doc_id, r.source) for r in got} == {(r.doc_id, r.source) for r in mixed}


def test_stages_on_odd_rows(spark, odd, empty, tmp_path):
    """Nulls, repeated ids and rows, clashing columns, an empty table: every stage keeps what it says."""
    spark.createDataFrame([(1, 0), (6, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    assert corpus_pipeline.toxicity(spark, odd, sf).columns == odd.columns
    assert corpus_pipeline.toxicity(spark, odd.withColumn("score", F.lit("x")), sf).columns == odd.columns
    kept = corpus_pipeline.exact(spark, odd, sf)
    # of 1 to 3 the last, of the empty texts that of the largest id, of the two equal rows one
    assert sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "")[:4]) for r in kept.collect())) == sorted(
        [(False, 3, "the "), (False, 5, ""), (False, 6, "Stra"), (False, 6, "same"), (True, 0, "no i"), (False, 7, " \n\t "[:4]), (False, 8, "word"), (False, 9, "xxxx")]
    )
    assert kept.columns == odd.columns
    near = corpus_pipeline.near(spark, odd, sf)
    # rows 1, 2 and 3 have one set, so have the rows of id 8; the rows of id 6 differ
    assert sorted((r.doc_id or 0, (r.text or "")[:4]) for r in near.collect()) == sorted([(1, "The "), (4, ""), (5, ""), (6, "Stra"), (6, "same"), (0, "no i"), (7, " \n\t "), (8, "word"), (9, "xxxx")])
    mixed = corpus_pipeline.mixing(spark, odd, sf)
    assert mixed.columns == odd.columns
    coded = corpus_pipeline.encoding(spark, odd, sf).collect()
    assert len(coded) == 12 and {r.n_tokens for r in coded if r.doc_id in (4, 5, 7)} == {0}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
