"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

try:
    import public_tokenizers
except ImportError:  # the vocabularies' folder is a parameter then
    public_tokenizers = None

from .ann import nearest_neighbours
from .bpe import bpe_round_trip
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_join
from .licenses import scan_licenses
from .mixing import mix_sources
from .prefix_trie import forked, number_turns, prefix_trie
from .quality import measure, score_quality, train_quality
from .quotes import link_quotes
from .spark_util import cut
from .substring_dedup import substring_dedup
from .token_counts import count_tokens
from .toxicity import score_toxicity, train_toxicity
from .vector_codes import label_errors, vector_codes

#: Folder of the public vocabularies, the same on all machines: that of the package unless it is set.
TOKENIZERS = os.environ.get("MASKWRIGHT_TOKENIZERS") or (os.path.dirname(public_tokenizers.path("x")) if public_tokenizers else "")
#: Documents of more tokens than this are over the limit.
TOKEN_LIMIT = 4096
#: Documents of this score or more are toxic.
TOXIC = 0.7
#: Documents of less than this score are of low quality.
GOOD = 0.3
#: Domains, and target weights of the tree's nodes (level, name, weight); those not named weigh 1.
DOMAINS = ("web", "books", "forum", "news")
WEIGHTS = [(0, "web", 3.0), (0, "books", 2.0), (1, "en", 2.0)]


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digests(coded, *more):
    """Token counts and digests of ids and decoded texts, and ``more`` columns."""
    made = [(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]
    return coded.select("doc_id", *made, *more)


def op1_bpe(spark, sf_dir):
    path = f"{TOKENIZERS}/word_bpe_49k.json"
    coded = bpe_round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, drop=True)
    return digests(coded)


def op2_nearest_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def held_out(doc_id, folds=3, fold=1):
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op3_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score_toxicity(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, drop=True)
    return scored.withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


def domain(source):
    """The domain of a source: by the number in its name; sources without one are of the first."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(%s, '([0-9]{1,9})', 1) AS int)" % source), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS) + 1)


def mixing_weights(spark):
    return spark.createDataFrame(WEIGHTS, "level int, name string, weight double")


def op4_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumn("domain", domain("source"))
    return mix_sources(docs, weights=mixing_weights(spark)).select("doc_id", "domain", "lang", "source", "copies")


def op5_substring_dedup(spark, sf_dir):
    found = substring_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op7_quotation_linking(spark, sf_dir):
    linked = link_quotes(_table(spark, sf_dir, "conversations"))
    return linked.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def op8_token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(sized, f"{TOKENIZERS}/piece_bpe_32k.model", drop=True)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join(_table(spark, sf_dir, "documents"), shingle=4, num=85, den=100)


def op10_license_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return scan_licenses(docs, F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def op11_prefix_trie(spark, sf_dir):
    turns, sizes = forked(number_turns(_table(spark, sf_dir, "conversations")))
    return prefix_trie(turns, sizes).drop("turn_key").withColumnRenamed("saved_bytes", "saved_tokens")


def op12_vector_codes(spark, sf_dir):
    coded, books = vector_codes(_table(spark, sf_dir, "embeddings"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    return label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _codes_sql(rounds=4):
    """Rounds of assignment and movement, one after another."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
        near{i} AS (
            SELECT vec_id, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (
                SELECT vec_id, p.part, entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
                FROM parts p JOIN book{i} b USING (part)) GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""
        book{i + 1} AS (
            SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN (
                SELECT part, entry, list(mean ORDER BY nth) AS x FROM (
                    SELECT part, entry, nth, floor(sum(x[nth]) / count(*))::BIGINT AS mean
                    FROM near{i} JOIN parts USING (vec_id, part), unnest(range(1, len(x) + 1)) u(nth) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))""")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
        parts AS (
            SELECT vec_id, part, v[(part * len(v)) // 4 + 1 : ((part + 1) * len(v)) // 4] AS x FROM kept, range(4) r(part)),
        book0 AS (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts
            QUALIFY entry < 256),{",".join(steps)},
        coded AS (
            SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


def op13_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    measured = cut(measure(docs))
    model = train_quality(measured, _table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0)))
    return score_quality(measured, model).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_nearest_neighbours, op3_toxicity, op4_mixing, op5_substring_dedup, op6_exact_dedup, op7_quotation_linking, op8_token_counts, op9_jaccard_join, op10_license_scan, op11_prefix_trie, op12_vector_codes, op13_quality)}

ORACLE_SQL = {
    "op6_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    # crc32 of the decimal id: eight steps a byte; a sequence of turns is named by its digests so far
    "op11_prefix_trie": """
        WITH turns AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
                   sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key,
                   strlen(coalesce(text, '')) AS n_bytes
            FROM conversations WHERE conv_id IS NOT NULL),
        convs AS (
            SELECT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT),
                lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM turns)),
        built AS (
            SELECT c.conv_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY t.pos) AS pos, turn_key, n_bytes
            FROM convs c JOIN turns t ON (t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= h) OR (t.conv_id = c.conv_id AND t.pos > h)),
        path AS (
            SELECT conv_id, pos AS depth, n_bytes, string_agg(turn_key, ',' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM built
            UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
        deepest AS (SELECT conv_id, max(depth) AS n FROM path GROUP BY conv_id),
        node AS (
            SELECT depth, prefix, min(conv_id) AS top, count(*) AS n_convs, (count(*) - 1) * max(n_bytes) AS saved,
                   sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id END, ',' ORDER BY conv_id), '')) AS ends_sha256
            FROM path JOIN deepest USING (conv_id) GROUP BY depth, prefix),
        named AS (SELECT path.conv_id AS member, path.depth, top FROM path JOIN node USING (depth, prefix)),
        edge AS (
            SELECT n.depth, n.top, up.top AS parent FROM node n JOIN named up ON up.member = n.top AND up.depth = n.depth - 1),
        kids AS (SELECT depth - 1 AS depth, parent AS top, count(*) AS n_children FROM edge GROUP BY ALL),
        sums AS (
            SELECT up.depth, up.top, sum(n.saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
            FROM node n LEFT JOIN kids USING (depth, top) JOIN named up ON up.member = n.top AND up.depth <= n.depth GROUP BY ALL)
        SELECT top AS conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
               saved_tokens::BIGINT AS saved_tokens, ends_sha256
        FROM node LEFT JOIN edge USING (depth, top) LEFT JOIN kids USING (depth, top) JOIN sums USING (depth, top)""",
    "op12_vector_codes": _codes_sql(),
}
