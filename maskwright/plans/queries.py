"""Registered queries of the masking engine, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab as V
from ..cluster import kept
from ..functions import text as T
from ..functions.geometry import to_rect
from ..operators import regions
from ..operators.decide import decide, kept_of, mask_text, masks_of, merge_ordered_runs
from ..operators.names import with_name_runs
from ..operators.spans import FLAGS, spanned_units, spanned_words, spread_units, with_spans
from ..sources import phrases
from ..sources.pages import page_lines
from ..sources.units import choose_route, glyph_lines, line_units, lines_of, long_lines, own_units, read_ocr, spread, token_units, units_of, with_tokens, word_blocks
from ..vocab import Rules
from . import edit_queries, oracle, page_queries, phrase_queries, picture_queries, samples, token_queries
from .page_queries import decide_pages, table_link
from .export import decision_log, elements, text_runs, wireframe

#: Production parameters: phrases of the user, interface labels, patterns for masking text.
TERMS = ("the and", "of the")
LABEL_PHRASES = ("the", "and", "for the")
MASK_EMAIL, MASK_DIGITS = "[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "[0-9][0-9-]*[0-9]"


def _table(spark, sf_dir, name):
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _units(spark, sf_dir):
    units = units_of(lines_of(_table(spark, sf_dir, "documents"), "doc_id")).withColumnRenamed("id", "doc_id")
    return T.once(T.once(units, folded=T.fold(F.col("text"))), line_reason=T.folded_reason(F.col("folded")), unit_metric=T.folded_is_metric(F.col("folded"))).drop("folded")


def normalize_fold(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize(F.col("text")), 256).alias("normal"), F.sha2(T.fold(F.col("text")), 256).alias("folded"))


def phrase_normalize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_phrase(F.col("text")), 256).alias("phrase"))


def judge_words(spark, sf_dir):
    words = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("([^ \\t\\r\\n\\x0B\\f]+)"), F.lit(1))).alias("word"))
    said = T.judged(words, "word")
    return said.select("conv_id", "turn", "word", T.masks(F.col("reason")).alias("mask"), "reason")


def judge_reason_counts(spark, sf_dir):
    words = units_of(lines_of(_table(spark, sf_dir, "documents"), "doc_id"))
    # each distinct word is judged once; sums before the shuffle keep a frequent word from one task
    counted = words.groupBy("text").agg(F.count("*").alias("k"))
    return T.judged(counted, "text").groupBy("reason").agg(F.sum("k").alias("n")).orderBy("reason")


def mask_email_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(mask_text(F.col("text"), MASK_EMAIL, "█"), 256).alias("masked"))


def mask_digit_run_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(mask_text(F.col("text"), MASK_DIGITS, "█"), 256).alias("masked"))


def unit_metric(spark, sf_dir):
    return _units(spark, sf_dir).where("unit_metric").select("doc_id", "block_id", "unit_idx", "text")


def line_reason_units(spark, sf_dir):
    return _units(spark, sf_dir).where("line_reason IS NOT NULL").select("doc_id", "block_id", "unit_idx", "text", "line_reason")


def line_pattern_units(spark, sf_dir):
    words = spanned_words(lines_of(_table(spark, sf_dir, "documents"), "doc_id"), flags=("line_reason",))
    return words.where("line_reason IS NOT NULL").select(F.col("id").alias("doc_id"), "block_id", "unit_idx", "text", "line_reason")


def decide_masks(spark, sf_dir):
    return decide(_units(spark, sf_dir)).where("mask").select("doc_id", "block_id", "unit_idx", "text", "reason")


def decide_kept(spark, sf_dir):
    return decide(_units(spark, sf_dir)).where("NOT mask").select("doc_id", "block_id", "unit_idx", "text", "reason")


def decision_summary(spark, sf_dir):
    return decide(_units(spark, sf_dir)).groupBy("doc_id", "mask", "reason").agg(F.count("*").alias("n"))


def cascade_units(spark, sf_dir):
    """Every unit of the documents through the whole cascade: patterns, measures and labels over its line."""
    return _cascade(lines_of(_table(spark, sf_dir, "documents"), "doc_id")).select("doc_id", "block_id", "unit_idx", "text", "mask", "reason")


def _cascade(lines):
    units = spanned_words(lines, flags=("line_reason", "unit_metric", "label_kept"), gaps=True)
    return decide(units).withColumnRenamed("id", "doc_id")


def cascade_summary(spark, sf_dir):
    # the reason alone says whether a unit is masked
    counted = _cascade(lines_of(_table(spark, sf_dir, "documents"), "doc_id").select("id", "line")).groupBy("doc_id", "reason").agg(F.count("*").alias("n"))
    return counted.select("doc_id", T.masks(F.col("reason")).alias("mask"), "reason", "n")


def _phrases(spark, sf_dir, flag, rules):
    blocks = word_blocks(lines_of(_table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), "text"), "key"))
    return spread_units(with_spans(blocks, rules, flags=(flag,))).where(flag).select("id.conv_id", "id.turn", "block_id", "unit_idx", "text")


def user_phrase_protect(spark, sf_dir):
    return _phrases(spark, sf_dir, "user_kept", Rules(terms=TERMS, labels=()))


def label_phrase_protect(spark, sf_dir):
    return _phrases(spark, sf_dir, "label_kept", Rules(labels=LABEL_PHRASES))


def run_merge(spark, sf_dir):
    """Masked units of documents, read word by word without spaces, and their runs."""
    units = spanned_words(lines_of(_table(spark, sf_dir, "documents"), "doc_id"), flags=("line_reason", "unit_metric", "label_kept"))
    return merge_ordered_runs(decide(units), ["id", "block_id"]).select(F.col("id").alias("doc_id"), "block_id", "start", "end", "reason", "text")


#: Phrases of ``long_line_units``, and where its lines are cut: far below what a task can hold, so that many are.
LONG_TERMS, LONG_LINE = ("the and", "of the", "in the on"), 700


def long_line_units(spark, sf_dir):
    """Every unit of the documents, each document one line: patterns, measures and phrases over lines that are cut in pieces."""
    whole = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("block_id"), F.translate("text", "\n", " ").alias("line"))
    rules = Rules(terms=LONG_TERMS)
    pieces = long_lines(whole, max(map(len, LONG_TERMS)), LONG_LINE)
    units = own_units(spanned_words(pieces, rules, ("line_reason", "unit_metric", "user_kept"), gaps=True))
    flagged = units.where("line_reason IS NOT NULL OR unit_metric OR user_kept")
    return flagged.select(F.col("id").alias("doc_id"), "unit_idx", "text", "line_reason", "unit_metric", "user_kept")


def wrapped_lines(spark, sf_dir):
    """Lines of texts that wrap, from the boxes of their characters."""
    width, height = map(F.lit, samples.GLYPH_SCREEN)
    lines = glyph_lines(samples.set_texts(_table(spark, sf_dir, "conversations")), SCREEN_KEYS, width=width, height=height)
    word = F.col("words")[0]
    return lines.select(*SCREEN_KEYS, "piece", word["text"].alias("text"), F.size(word["symbols"]).alias("symbols"), *(word["bbox"][c].alias(c) for c in ("x0", "y0", "x1", "y1")))


def html_lines(spark, sf_dir):
    return page_lines(_table(spark, sf_dir, "pages"))


def html_semantics(spark, sf_dir):
    return html_lines(spark, sf_dir).groupBy("semantic", "kind").agg(F.count("*").alias("n"))


def html_table_link(spark, sf_dir):
    return table_link(html_lines(spark, sf_dir))


def html_decide(spark, sf_dir):
    return decide_pages(_table(spark, sf_dir, "pages"))


def props_mask(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", mask_text(F.col("props"), MASK_DIGITS, "█").alias("props"))


def coverage_metrics(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").rlike(MASK_EMAIL), F.lit(False)).alias("hit"))
    return docs.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("toxic").agg(F.count_if("hit").alias("hits"), F.count("*").alias("n"))


def reason_hue(spark, sf_dir):
    return judge_reason_counts(spark, sf_dir).select("reason", T.reason_hue(F.col("reason")).alias("hue"))


def phrase_merge(spark, sf_dir):
    terms = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\\.")).alias("term")).select("item_id", F.regexp_replace("term", f"^[{V.JS_SPACE}]+|[{V.JS_SPACE}]+\\z", "").alias("term"))
    return terms.where("term != ''").groupBy("term").agg(F.min("item_id").alias("first_id"))


#: What the screens of ``samples`` are decided by.
SCREEN_RULES = Rules(terms=samples.SCREEN_TERMS)
SCREEN_KEYS = ["conv_id", "turn"]


def _screen(spark, sf_dir):
    """Units of screens with their spans, which reach over units and not over visual lines where measures are concerned."""
    return spanned_units(samples.screen_units(_table(spark, sf_dir, "conversations")), SCREEN_KEYS, SCREEN_RULES)


def screen_flags(spark, sf_dir):
    """Units that a pattern, measure or phrase touches."""
    units = _screen(spark, sf_dir).where("line_reason IS NOT NULL OR unit_metric OR user_kept OR label_kept")
    return units.select(*SCREEN_KEYS, "unit_idx", "text", *FLAGS)


def _decided(spark, sf_dir):
    return decide(_screen(spark, sf_dir), SCREEN_RULES)


def screen_decide(spark, sf_dir):
    """The whole cascade with places, confidence, patterns, measures, labels and the user's phrases."""
    return _decided(spark, sf_dir).select(*SCREEN_KEYS, "unit_idx", "text", "mask", "reason")


def _masks(decided):
    return masks_of(decided, SCREEN_KEYS, SCREEN_RULES)


def screen_masks(spark, sf_dir):
    """Masks of screens as rectangles, runs on one visual line merged."""
    return _masks(_decided(spark, sf_dir)).drop("source")


def screen_summary(spark, sf_dir):
    """Masks and kept texts by reason, in order."""
    decided = _decided(spark, sf_dir)
    both = _masks(decided).select("reason").unionByName(kept_of(decided, SCREEN_KEYS).select("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def screen_coverage(spark, sf_dir):
    """Over-masking and leaks against what each unit is known to be: numbers and addresses are to be masked, labels and
    measures kept."""
    expected = {"mask": ("090-1234-", "5678", "ann@", "mail.example.org"), "keep": ("Save", "検索", "99.95%", "+12", "件")}
    check = F.when(F.col("text").isin(*expected["mask"]), "mask").when(F.col("text").isin(*expected["keep"]), "keep")
    units = _decided(spark, sf_dir).withColumn("check", check).where("check IS NOT NULL")
    wrong = (F.col("check") == "mask") != F.col("mask")
    return units.groupBy("check").agg(F.count_if(wrong).alias("violations"), F.count("*").alias("n"))


def _page(df):
    """A message as a page of its own: masks and texts of one screen block."""
    return df.withColumn("page_id", F.col("conv_id") * 1000 + F.col("turn")).withColumn("block_id", F.col("turn").cast("int"))


def text_run_merge(spark, sf_dir):
    """Kept texts of screens, neighbours on a line merged."""
    return text_runs(_page(kept_of(_decided(spark, sf_dir), SCREEN_KEYS)).withColumn("ord", F.col("unit_idx").cast("long")))


#: Drawings of one task.
TASK_PAGES = 2000


def _page_parts(spark, pages):
    """So many tasks for drawings that one holds no more of them in a larger table than in a small one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pages // TASK_PAGES))


def _drawn(spark, sf_dir):
    decided = kept(_decided(spark, sf_dir))  # read for texts and masks, twice each
    screen = samples.screen_elements(_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id")))
    runs = text_runs(_page(kept_of(decided, SCREEN_KEYS)).withColumn("ord", F.col("unit_idx").cast("long")))
    masks = kept(_page(_masks(decided)))  # read for those that stay and those taken away
    removed = masks.where("reason = 'dom-data'")
    pictures = regions.icons(screen, ["page_id"]).withColumn("data_url", F.concat(F.lit("data:image/png;"), "ord"))
    parts = _page_parts(spark, _table(spark, sf_dir, "conversations").count())
    return elements(masks.where("reason != 'dom-data'"), runs, removed, regions.decor(screen, ["page_id"]), pictures, parts_of_pages=parts), regions.page_ground(screen, ["page_id"])


def wireframe_elements(spark, sf_dir):
    """Elements of drawings: decoration, icons, merged and revealed texts, masks, numbered from the back."""
    drawn, _ = _drawn(spark, sf_dir)
    return drawn.select("page_id", "n", "id", "file_id", "layer", "role", "reason", "kind", "table_id", "col", "x", "y", "w", "h", "text", "font_size")


def wireframe_layers(spark, sf_dir):
    """How many elements of each role a drawing has, and their ids' first and last number."""
    return wireframe_elements(spark, sf_dir).groupBy("page_id", "role").agg(F.count("*").alias("n"), F.min("n").alias("first"), F.max("n").alias("last"))


def wireframe_json(spark, sf_dir):
    return wireframe(*_drawn(spark, sf_dir))


def decision_logs(spark, sf_dir):
    """What was decided on each screen, for its reviewer."""
    decided = kept(_decided(spark, sf_dir))  # read for decisions, masks and texts
    return decision_log(decided, _masks(decided), kept_of(decided, SCREEN_KEYS), SCREEN_KEYS, ("unit_idx",))


def screen_tokens(spark, sf_dir):
    """Screen lines through a tokenizer: pieces with the boxes and the confidence of their characters."""
    lines = with_tokens(samples.screen_lines(_table(spark, sf_dir, "conversations")), samples.halves)
    return token_units(lines).select(*SCREEN_KEYS, "unit_idx", "text", *(F.round(f"bbox.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")), "confidence")


def ocr_units(spark, sf_dir):
    """Recognised text, read at twice the size, as units with rectangles of the picture."""
    units = line_units(read_ocr(samples.ocr_pages(_table(spark, sf_dir, "conversations"))))
    rect = [c.alias(n) for n, c in to_rect(F.col("bbox"), 0.0, 2.0).items()]
    return units.select("conv_id", "block_id", "line_id", "unit_idx", "text", "confidence", *rect)


def route_lines(spark, sf_dir):
    """Lines of each page by the route they came: its own where it has any (here: every other), else recognised ones."""
    talks = _table(spark, sf_dir, "conversations")
    own = samples.screen_lines(talks.where("conv_id % 2 = 0")).withColumn("block_id", F.col("turn").cast("int"))
    lines = choose_route(own, read_ocr(samples.ocr_pages(talks)), ["conv_id"])
    return lines.groupBy("conv_id", "route").agg(F.count("*").alias("lines"), F.sum(F.size("words")).alias("words"))


def _morphemes(spark, sf_dir):
    return with_name_runs(samples.morpheme_units(_table(spark, sf_dir, "documents")), ["doc_id"])


def judge_tokens(spark, sf_dir):
    """Verdicts on morphemes alone."""
    return _morphemes(spark, sf_dir).select("doc_id", "unit_idx", T.judge_token(F.col("token"))["reason"].alias("reason"))


def name_runs(spark, sf_dir):
    """Morphemes that belong to a run which may be a name."""
    return _morphemes(spark, sf_dir).where("name_run IS NOT NULL").select("doc_id", "unit_idx", "text", "name_run")


def token_decide(spark, sf_dir):
    """The cascade over morphemes with name runs, places and confidence."""
    return decide(_morphemes(spark, sf_dir)).select("doc_id", "unit_idx", "text", "mask", "reason")


def form_lines(spark, sf_dir):
    """Lines of pages with menus, tables, forms and grids."""
    return page_lines(samples.form_pages(_table(spark, sf_dir, "documents")))


def form_table_link(spark, sf_dir):
    """Data cells of those pages and the header of their column."""
    return table_link(form_lines(spark, sf_dir))


def form_decide(spark, sf_dir):
    return decide_pages(samples.form_pages(_table(spark, sf_dir, "documents")))


def _elements(spark, sf_dir):
    return samples.screen_elements(_table(spark, sf_dir, "documents"))


def opaque_regions(spark, sf_dir):
    """Masks over what cannot be read, in the picture's pixels (twice the page's)."""
    return regions.opaque_masks(_elements(spark, sf_dir), ["page_id"], 2.0, 2.0).drop("source")


def icon_regions(spark, sf_dir):
    return regions.icons(_elements(spark, sf_dir), ["page_id"])


def decor_regions(spark, sf_dir):
    return regions.decor(_elements(spark, sf_dir), ["page_id"])


def page_grounds(spark, sf_dir):
    """The colour under each page: every fourth element is a body with a ground of its own, laid over those before it."""
    body = F.when(F.col("ord") % 4 == 0, "body").otherwise(F.col("tag"))
    return regions.page_ground(_elements(spark, sf_dir).withColumn("tag", body), ["page_id"])


def _crowded(spark, sf_dir):
    """Screens of fifty documents' elements each: more than a page may give."""
    rows = _elements(spark, sf_dir).withColumn("ord", F.col("page_id") % samples.CROWD * 30 + F.col("ord"))
    return rows.withColumn("page_id", F.floor(F.col("page_id") / samples.CROWD))


def crowded_decor(spark, sf_dir):
    """Decoration of crowded pages, the first boxes of each."""
    return regions.decor(_crowded(spark, sf_dir), ["page_id"])


def crowded_icons(spark, sf_dir):
    """Icons of crowded pages, the first of each; pictures behind elements only while there is room for decoration."""
    return regions.icons(_crowded(spark, sf_dir), ["page_id"])


def phrase_lists(spark, sf_dir):
    """Two lists of phrases, one as JSON, merged in order without repeats."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.concat(F.lit(" "), F.substring_index("text", " ", 2)).alias("term"))
    read = phrases.parse_phrases(phrases.phrases_json(items))
    more = items.select((F.col("ord") + 1).alias("ord"), F.substring_index(F.trim("term"), " ", 1).alias("term"))
    return phrases.merge_phrases(read, more)


QUERIES = {f.__name__: f for f in (
    normalize_fold, phrase_normalize, judge_words, judge_reason_counts, mask_email_text, mask_digit_run_text, unit_metric, line_reason_units, line_pattern_units,
    decide_masks, decide_kept, decision_summary, cascade_units, cascade_summary, user_phrase_protect, label_phrase_protect, run_merge, long_line_units, wrapped_lines, html_lines, html_semantics, html_table_link, html_decide,
    props_mask, coverage_metrics, reason_hue, phrase_merge, text_run_merge, wireframe_json,
    screen_flags, screen_decide, screen_masks, screen_summary, screen_coverage, wireframe_elements, wireframe_layers, decision_logs, screen_tokens, ocr_units, route_lines, judge_tokens, name_runs, token_decide,
    form_lines, form_table_link, form_decide, opaque_regions, icon_regions, decor_regions, page_grounds, crowded_decor, crowded_icons, phrase_lists,
)}

# -- SQL ------------------------------------------------------------------------------------------------------------
_RE2, _FOLD, _TRIM, _HAS, _JUDGE = oracle.RE2, oracle.FOLD, oracle.TRIM, oracle.HAS, oracle.JUDGE
_LINE = f"""CASE WHEN {_HAS('f', V.DIGIT_RUN)} THEN 'digit-run' WHEN {_HAS('f', V.EMAIL)} THEN 'email'
    WHEN {_HAS('f', V.EMAIL_HEAD)} OR {_HAS('f', V.EMAIL_TAIL)} THEN 'email-frag' END"""
_UNITS = f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS block_id FROM documents),
    words AS (SELECT doc_id, block_id, unnest(regexp_extract_all(line, '[^ \\t\\r\\x0B\\f]+')) AS text, unnest(range(len(regexp_extract_all(line, '[^ \\t\\r\\x0B\\f]+')))) AS k FROM lines),
    units AS (SELECT doc_id, CAST(block_id AS INT) AS block_id, CAST(2 * k AS INT) AS unit_idx, text, {_FOLD('text')} AS f, {_TRIM('text')} AS r, {_FOLD(_TRIM('text'))} AS n FROM words),
    said AS (SELECT *, {_LINE} AS line_reason, regexp_matches(f, '^{V.METRIC}$') AS metric, {_JUDGE} AS own FROM units),
    decided AS (SELECT *, metric AND coalesce(line_reason, '') NOT LIKE 'email%' AS measure,
        CASE WHEN metric AND coalesce(line_reason, '') NOT LIKE 'email%' THEN 'unit-metric' ELSE coalesce(line_reason, own) END AS reason,
        NOT (metric AND coalesce(line_reason, '') NOT LIKE 'email%') AND (line_reason IS NOT NULL OR own NOT IN ('empty', 'allowlist')) AS mask FROM said)
"""
_MASKED = lambda p: f"SELECT doc_id, sha256(regexp_replace(text, '{p}', '█', 'g')) AS masked FROM documents"

ORACLE_SQL = {
    "normalize_fold": f"SELECT doc_id, sha256({_FOLD(_TRIM('text'))}) AS normal, sha256({_FOLD('text')}) AS folded FROM documents",
    "phrase_normalize": f"SELECT doc_id, sha256({_FOLD(f'''regexp_replace(text, '[{V.PHRASE_DROP}]+', '', 'g')''')}) AS phrase FROM documents",
    "judge_words": f"""WITH words AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^ \\t\\r\\n\\x0B\\f]+')) AS word FROM conversations),
        forms AS (SELECT *, {_TRIM('word')} AS r, {_FOLD(_TRIM('word'))} AS n FROM words), said AS (SELECT *, {_JUDGE} AS reason FROM forms)
        SELECT conv_id, turn, word, reason NOT IN ('empty', 'allowlist') AS mask, reason FROM said""",
    "judge_reason_counts": _UNITS + "SELECT own AS reason, count(*) AS n FROM said GROUP BY 1",
    "mask_email_text": _MASKED(MASK_EMAIL),
    "mask_digit_run_text": _MASKED(MASK_DIGITS),
    "unit_metric": _UNITS + "SELECT doc_id, block_id, unit_idx, text FROM said WHERE metric",
    "line_reason_units": _UNITS + "SELECT doc_id, block_id, unit_idx, text, line_reason FROM said WHERE line_reason IS NOT NULL",
    "decide_masks": _UNITS + "SELECT doc_id, block_id, unit_idx, text, reason FROM decided WHERE mask",
    "decide_kept": _UNITS + "SELECT doc_id, block_id, unit_idx, text, reason FROM decided WHERE NOT mask",
    "decision_summary": _UNITS + "SELECT doc_id, mask, reason, count(*) AS n FROM decided GROUP BY ALL",
    "props_mask": f"SELECT event_id, regexp_replace(props, '{MASK_DIGITS}', '█', 'g') AS props FROM events",
    "coverage_metrics": f"SELECT toxic, count(*) FILTER (regexp_matches(text, '{MASK_EMAIL}')) AS hits, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY toxic",
    "phrase_merge": f"SELECT term, min(item_id) AS first_id FROM (SELECT item_id, {_TRIM('term')} AS term FROM (SELECT item_id, unnest(string_split(text, '.')) AS term FROM benchmark)) WHERE term <> '' GROUP BY term",
}
ORACLE_SQL |= oracle.ORACLE_SQL
for _more in (edit_queries, phrase_queries, page_queries, token_queries, picture_queries):
    QUERIES |= _more.QUERIES
    ORACLE_SQL |= _more.ORACLE_SQL
