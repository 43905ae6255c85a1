"""Registered queries: sources, frames, text functions, labels, metrics, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlytics.functions import text as tx
from postlytics.operators import frames as fr
from postlytics.operators import metrics as mt
from postlytics.operators import sampling as sp
from postlytics.plans import derived as dv
from postlytics.plans.derived import WS, with_ctes
from postlytics.plans.registry import register
from postlytics.sources import io
from postlytics.sources import runlog as rl

R6 = 6  # decimals kept on floating results so that both engines agree


def _r(c, name):
    return F.round(c, R6).alias(name)


def _join(c, sep=" "):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


# --- SQL fragments shared by several queries ---------------------------------
SQL_CLEAN = "lower(regexp_replace({x}, '[^a-zA-Z]', ' ', 'g'))"
SQL_URL = (r"https?://[^" + WS + r"]+|www\.[^" + WS + r"]+")
SQL_CONTRACTIONS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"),
                    ("lem", "me"), ("wan", "na")]


def sql_tokenize(x: str) -> str:
    s = x
    for a, b in SQL_CONTRACTIONS:
        s = f"regexp_replace({s}, '\\b({a})({b})\\b', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(trim({s}), '[{WS}]+'), lambda t: t <> '')"


def sql_stop_filter(tokens: str) -> str:
    from postlytics.functions.stopwords import ENGLISH_STOPWORDS
    lst = ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS)
    return f"list_filter({tokens}, lambda t: t NOT IN ({lst}))"


def sql_preprocess_tokens(x: str) -> str:
    return sql_stop_filter(sql_tokenize(SQL_CLEAN.format(x=x)))


# ============================== A: sources ===================================

@register("a1_load_posts", sql=with_ctes(["posts"], "SELECT post_id, text, label, split FROM posts"))
def a1_load_posts(spark, sf):
    """A1: labelled corpus with all splits (derived from documents + labels)."""
    return dv.posts(spark, sf)


@register("a2_pick_split", sql=with_ctes(
    ["posts"], "SELECT post_id, text, label FROM posts WHERE split = 'train'"))
def a2_pick_split(spark, sf):
    """A2: the train split only."""
    return io.pick_split(dv.posts(spark, sf), "train").select("post_id", "text", "label")


_A3_SAMPLE = 60


def _sql_strat_sample(src: str, size: int, seed: int = 42) -> str:
    """SQL twin of stratified_sample over the CTE ``src`` (post_id, label)."""
    return f"""(
  WITH cnt AS (SELECT label, count(*) AS c FROM {src} GROUP BY label),
       tot AS (SELECT sum(c) AS n FROM cnt),
       q0 AS (SELECT label, ({size} * c) // n AS fl, ({size} * c) % n AS rem FROM cnt, tot),
       q1 AS (SELECT label, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
                               <= {size} - (SELECT sum(fl) FROM q0) THEN 1 ELSE 0 END AS quota
              FROM q0),
       r AS (SELECT s.*, row_number() OVER (PARTITION BY label
                 ORDER BY md5(CAST(post_id AS VARCHAR) || ':{seed}'), post_id) AS rn FROM {src} s)
  SELECT r.* EXCLUDE (rn) FROM r JOIN q1 USING (label) WHERE rn <= quota)"""


@register("a3_assemble_splits", sql=with_ctes(
    ["posts"],
    f"""SELECT post_id, label, 'train' AS split FROM {_sql_strat_sample(
        "(SELECT post_id, label FROM posts WHERE split = 'train')", _A3_SAMPLE)}
    UNION ALL
    SELECT post_id, label, 'validation' AS split FROM {_sql_strat_sample(
        "(SELECT post_id, label FROM posts WHERE split = 'validation')", 12)}"""))
def a3_assemble_splits(spark, sf):
    """A3: stratified samples of train and validation re-assembled into one frame."""
    p = dv.posts(spark, sf).select("post_id", "label", "split")
    train = sp.stratified_sample(io.pick_split(p, "train").drop("split"), "label", _A3_SAMPLE)
    val = sp.stratified_sample(io.pick_split(p, "validation").drop("split"), "label", 12)
    return io.assemble_splits({"train": train, "validation": val})


@register("a5_eval_metrics", sql=with_ctes(
    ["run_metrics"],
    "SELECT experiment, run_id, metric, step, ts, value FROM run_metrics "
    "WHERE starts_with(metric, 'eval_')"))
def a5_eval_metrics(spark, sf):
    """A5: keep only metric observations whose name starts with ``eval_``."""
    return rl.eval_only(dv.run_metrics(spark, sf)).select(
        "experiment", "run_id", "metric", "step", "ts", "value")


@register("a7_scan_run_log", sql=with_ctes(
    ["run_metrics"], "SELECT experiment, run_id, metric, epoch_us(ts) // 1000 AS ms, value, step FROM run_metrics"))
def a7_scan_run_log(spark, sf):
    """The metric history written as a tree of log files in the shared folder, then scanned."""
    root = io.scratch_path(spark, "runlog")
    # the table's times have no zone: they count as UTC, whatever the session's zone is
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    rl.write_metrics(dv.run_metrics(spark, sf).withColumn("ts", F.timestamp_millis(ms)), root)
    back = rl.read_metrics(spark, root)
    return back.select("experiment", "run_id", "metric", F.unix_millis("ts").alias("ms"), "value", "step")


@register("a8_dedupe_metrics", sql=with_ctes(
    ["run_metrics"],
    """SELECT experiment, run_id, metric, step, ts, value FROM (
         SELECT *, row_number() OVER (PARTITION BY experiment, run_id, metric, step
                                      ORDER BY ts, value) AS rn FROM run_metrics) WHERE rn = 1"""))
def a8_dedupe_metrics(spark, sf):
    """One observation per (run, metric, step): the first logged."""
    return rl.dedupe_history(dv.run_metrics(spark, sf))


@register("a9_best_checkpoint", sql=with_ctes(
    ["run_metrics"],
    """SELECT experiment, run_id, metric, step AS best_step, round(value, 6) AS best_value FROM (
         SELECT *, row_number() OVER (PARTITION BY experiment, run_id, metric
                                      ORDER BY value DESC, step) AS rn
         FROM run_metrics WHERE starts_with(metric, 'eval_')) WHERE rn = 1"""))
def a9_best_checkpoint(spark, sf):
    """Per run and eval metric, the step with the highest value (ties: lowest step)."""
    best = rl.best_step(rl.eval_only(dv.run_metrics(spark, sf)), maximize=True)
    return best.select("experiment", "run_id", "metric", "best_step",
                       _r(F.col("best_value"), "best_value"))


# ============================== B: frames ====================================

@register("b1_row_map", sql=with_ctes(
    ["posts"],
    f"""SELECT post_id, CAST(length(text) AS BIGINT) AS n_chars,
               {dv.SQL_LABEL_NAME.format(x='label')} AS label_name FROM posts"""))
def b1_row_map(spark, sf):
    """B1: row map adding columns with native expressions."""
    p = dv.posts(spark, sf)
    return p.select("post_id", F.length("text").cast("long").alias("n_chars"),
                    tx.label_to_output("label").alias("label_name"))


@register("b2_batch_map", sql="""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_code_points,
    CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM documents""")
def b2_batch_map(spark, sf):
    """B2: a batch (pandas) map over Arrow batches, for logic with no native form."""
    def fn(pdf):
        pdf = pdf.copy()
        pdf["n_code_points"] = pdf["text"].str.len().astype("int64")
        pdf["n_lines"] = (pdf["text"].str.count("\n") + 1).astype("int64")
        return pdf[["doc_id", "n_code_points", "n_lines"]]
    docs = io.read_table(spark, sf, "documents").select("doc_id", "text")
    return fr.batch_map(docs, fn, "doc_id long, n_code_points long, n_lines long")


@register("b3_apply_preprocess", sql=with_ctes(
    ["texts"],
    f"SELECT post_id, array_to_string({sql_preprocess_tokens('text')}, ' ') AS preprocessed_text FROM texts"))
def b3_apply_preprocess(spark, sf):
    """Column apply of the classical preparation (C1, C7, C8 joined by spaces)."""
    p = dv.texts(spark, sf)
    return p.select("post_id", F.array_join(tx.preprocess_tokens("text"), " ")
                    .alias("preprocessed_text"))


@register("b4_drop_rename", sql=with_ctes(
    ["posts"], "SELECT post_id, label AS labels, split FROM posts"))
def b4_drop_rename(spark, sf):
    """Drop the text, rename label to labels."""
    return fr.drop_rename(dv.posts(spark, sf), drop=["text"], rename={"label": "labels"})


@register("b5_explode_tags", sql=with_ctes(
    ["tags"], "SELECT post_id, tag FROM (SELECT post_id, unnest(tags) AS tag FROM tags) "
              "WHERE tag IS NOT NULL"))
def b5_explode_tags(spark, sf):
    """One row per (post, tag); empty lists and nulls dropped."""
    return fr.explode_nonnull(dv.tags(spark, sf), "tags", keep=["post_id"], alias="tag")


@register("b6_promote_scalar", sql="""SELECT doc_id, array_to_string([lang], ' ') AS langs,
    CAST(len([lang]) AS INTEGER) AS n FROM documents""")
def b6_promote_scalar(spark, sf):
    """A scalar column promoted to a one-element list (by schema)."""
    d = io.read_table(spark, sf, "documents")
    lst = fr.as_list(d, "lang")
    return d.select("doc_id", F.array_join(lst, " ").alias("langs"), F.size(lst).alias("n"))


@register("b7_distinct_tags", sql=with_ctes(
    ["tags"], "SELECT DISTINCT unnest(tags) AS element FROM tags"))
def b7_distinct_tags(spark, sf):
    """Distinct hashtags over all posts."""
    return fr.distinct_elements(dv.tags(spark, sf), "tags")


@register("b8_row_mean", sql="""SELECT l_orderkey, l_linenumber, round(
    (l_quantity + l_discount + coalesce(CASE WHEN l_linenumber > 3 THEN l_tax END, 0))
    / (2 + CASE WHEN l_linenumber > 3 THEN 1 ELSE 0 END), 6) AS row_mean FROM lineitem""")
def b8_row_mean(spark, sf):
    """Row-wise mean across columns with nulls skipped."""
    li = io.read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount",
        F.when(F.col("l_linenumber") > 3, F.col("l_tax")).alias("tax_or_null"))
    return li.select("l_orderkey", "l_linenumber",
                     _r(fr.row_mean(["l_quantity", "l_discount", "tax_or_null"]), "row_mean"))


@register("b9_concat_splits", sql=with_ctes(
    ["posts"], "SELECT post_id, label FROM posts WHERE split IN ('train', 'validation')"))
def b9_concat_splits(spark, sf):
    """Train and validation concatenated."""
    p = dv.posts(spark, sf).select("post_id", "label", "split")
    return fr.concat_rows(io.pick_split(p, "train"), io.pick_split(p, "validation")) \
             .select("post_id", "label")


@register("b11_exclude_chosen", sql=with_ctes(
    ["posts"],
    f"""SELECT post_id, label FROM posts WHERE split = 'train' AND post_id NOT IN (
          SELECT post_id FROM {_sql_strat_sample(
              "(SELECT post_id, label FROM posts WHERE split = 'train')", _A3_SAMPLE)})"""))
def b11_exclude_chosen(spark, sf):
    """The train rows not drawn by the stratified sample (anti join)."""
    train = io.pick_split(dv.posts(spark, sf), "train").select("post_id", "label")
    chosen = sp.stratified_sample(train, "label", _A3_SAMPLE)
    return fr.exclude(train, chosen, ["post_id"])


@register("b12_max_encoded_length", sql=with_ctes(
    ["texts"],
    f"SELECT CAST(least(max(len({sql_tokenize(SQL_CLEAN.format(x='text'))})), 512) AS BIGINT) "
    "AS max_length FROM texts"))
def b12_max_encoded_length(spark, sf):
    """Longest token list, capped at the model maximum (512)."""
    p = dv.texts(spark, sf).select(tx.tokenize(tx.clean_text("text")).alias("tokens"))
    return fr.max_length(p, "tokens", model_max=512)


@register("b13_argmax", sql="""SELECT vec_id,
    CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax FROM embeddings""")
def b13_argmax(spark, sf):
    """Index of the largest component of each embedding (first on ties)."""
    e = io.read_table(spark, sf, "embeddings")
    return e.select("vec_id", mt.argmax("embedding").alias("argmax"))


@register("b14_top_n_per_group", sql="""SELECT lang, doc_id, n_chars, rank FROM (
    SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang
           ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5""")
def b14_top_n_per_group(spark, sf):
    """The five longest documents per language (ties by id), salted top-n."""
    d = io.read_table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    out = fr.top_n_per_group(d, ["lang"], [F.col("n_chars").desc(), F.col("doc_id")], 5,
                             salt=F.col("doc_id"))
    return out.select("lang", "doc_id", "n_chars", F.col("rank").cast("long").alias("rank"))


@register("b15_threshold", sql="""SELECT event_id, round(value, 6) AS value FROM events
    WHERE value >= 100.0""")
def b15_threshold(spark, sf):
    """Inclusive threshold filter (pushed to the parquet scan)."""
    ev = io.read_table(spark, sf, "events")
    return ev.where(fr.at_least("value", 100.0)).select("event_id", _r(F.col("value"), "value"))


# ============================== C: text ======================================

@register("c1_clean_text", sql=f"SELECT doc_id, {SQL_CLEAN.format(x='text')} AS clean FROM documents")
def c1_clean_text(spark, sf):
    """Clean every document (whole texts)."""
    d = io.read_table(spark, sf, "documents")
    return d.select("doc_id", tx.clean_text("text").alias("clean"))


@register("c2_remove_urls", sql=f"SELECT page_id, regexp_replace(html, '{SQL_URL}', '', 'g') "
                                "AS no_urls FROM pages")
def c2_remove_urls(spark, sf):
    """Remove URLs from every page."""
    pg = io.read_table(spark, sf, "pages")
    return pg.select("page_id", tx.remove_urls("html").alias("no_urls"))


@register("c3_encoder_prep", sql=f"""SELECT page_id,
    lower(regexp_replace({SQL_CLEAN.format(x='html')}, '{SQL_URL}', '', 'g')) AS prep_ref,
    lower({SQL_CLEAN.format(x=f"regexp_replace(html, '{SQL_URL}', '', 'g')")}) AS prep_urls_first
    FROM pages""")
def c3_encoder_prep(spark, sf):
    """Encoder preparation in the reference order and URLs-first order."""
    pg = io.read_table(spark, sf, "pages")
    return pg.select("page_id", tx.normalize("html", urls_first=False).alias("prep_ref"),
                     tx.normalize("html", urls_first=True).alias("prep_urls_first"))


@register("c4_hashtags", sql=r"""SELECT page_id,
    array_to_string(regexp_extract_all(html, '#[\p{L}\p{N}_]+'), ' ') AS hashtags,
    CAST(len(regexp_extract_all(html, '#[\p{L}\p{N}_]+')) AS INTEGER) AS n FROM pages""")
def c4_hashtags(spark, sf):
    """C4: hashtags of every page (anchors such as ``#top`` included)."""
    pg = io.read_table(spark, sf, "pages")
    h = tx.hashtags("html")
    return pg.select("page_id", F.array_join(h, " ").alias("hashtags"), F.size(h).alias("n"))


@register("c5_mentions", sql=r"""SELECT doc_id,
    array_to_string(regexp_extract_all(text, '@[\p{L}\p{N}_]+'), ' ') AS mentions,
    CAST(len(regexp_extract_all(text, '@[\p{L}\p{N}_]+')) AS INTEGER) AS n FROM documents""")
def c5_mentions(spark, sf):
    """Mentions of every document (e-mail addresses fire too)."""
    d = io.read_table(spark, sf, "documents")
    m = tx.mentions("text")
    return d.select("doc_id", F.array_join(m, " ").alias("mentions"), F.size(m).alias("n"))


@register("c6_urls", sql=f"""SELECT page_id,
    array_to_string(regexp_extract_all(html, '{SQL_URL}'), ' ') AS urls,
    CAST(len(regexp_extract_all(html, '{SQL_URL}')) AS INTEGER) AS n FROM pages""")
def c6_urls(spark, sf):
    """URLs of every page."""
    pg = io.read_table(spark, sf, "pages")
    u = tx.urls("html")
    return pg.select("page_id", F.array_join(u, " ").alias("urls"), F.size(u).alias("n"))


@register("c7_tokenize", sql=f"""SELECT doc_id,
    array_to_string({sql_tokenize(SQL_CLEAN.format(x='text'))}, ' ') AS tokens,
    CAST(len({sql_tokenize(SQL_CLEAN.format(x='text'))}) AS INTEGER) AS n FROM documents""")
def c7_tokenize(spark, sf):
    """Word tokens of every cleaned document."""
    d = io.read_table(spark, sf, "documents")
    t = tx.tokenize(tx.clean_text("text"))
    return d.select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@register("c8_remove_stopwords", sql=f"""SELECT doc_id,
    array_to_string({sql_preprocess_tokens('text')}, ' ') AS tokens,
    CAST(len({sql_preprocess_tokens('text')}) AS INTEGER) AS n FROM documents""")
def c8_remove_stopwords(spark, sf):
    """Tokens without English stop words (order and repeats kept)."""
    d = io.read_table(spark, sf, "documents")
    t = tx.preprocess_tokens("text")
    return d.select("doc_id", F.array_join(t, " ").alias("tokens"), F.size(t).alias("n"))


@register("c11_output_to_label", sql=with_ctes(
    ["posts", "predictions"],
    f"SELECT post_id, {dv.sql_output_to_label('raw')} AS label FROM predictions"))
def c11_output_to_label(spark, sf):
    """C11: model output text -> label, without splitting on the marker."""
    p = dv.predictions(spark, sf)
    return p.select("post_id", tx.output_to_label("raw").alias("label"))


@register("c12_label_to_output", sql=with_ctes(
    ["posts", "predictions"],
    """SELECT post_id, CASE y_pred WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral'
                                  WHEN 2 THEN 'Positive' END AS output FROM predictions"""))
def c12_label_to_output(spark, sf):
    """Predicted label (0..3) -> name; 3 gives NULL."""
    p = dv.predictions(spark, sf)
    return p.select("post_id", tx.label_to_output("y_pred").alias("output"))


@register("c13_compound_to_label", sql=with_ctes(
    ["scores"],
    """SELECT event_id, CASE WHEN compound IS NULL THEN NULL WHEN isnan(compound) THEN 1
         WHEN compound >= 0.05 THEN 2 WHEN compound <= -0.05 THEN 0 ELSE 1 END AS label
       FROM scores"""))
def c13_compound_to_label(spark, sf):
    """Compound score -> label with the +-0.05 thresholds."""
    s = dv.scores(spark, sf)
    return s.select("event_id", tx.compound_to_label("compound").alias("label"))


@register("c15_parse_generation", sql=with_ctes(
    ["posts", "predictions"],
    f"""SELECT post_id, {dv.sql_parse_generation('raw')} AS y_pred,
               {dv.sql_output_to_label(dv.sql_strip('raw'))} AS y_pred_nosplit FROM predictions"""))
def c15_parse_generation(spark, sf):
    """Parse generations (after the last marker) and the no-split variant."""
    p = dv.predictions(spark, sf)
    return p.select("post_id", tx.parse_generation("raw").alias("y_pred"),
                    tx.parse_generation("raw", split_marker=False).alias("y_pred_nosplit"))


@register("c16_model_family", sql="""SELECT page_id,
    array_to_string(list_slice(string_split(array_to_string(list_slice(string_split(url, '_'), 1, 2), ''), '/'),
        greatest(len(string_split(array_to_string(list_slice(string_split(url, '_'), 1, 2), ''), '/')) - 1, 1),
        len(string_split(array_to_string(list_slice(string_split(url, '_'), 1, 2), ''), '/'))), '/') AS family,
    array_to_string(list_slice(string_split(url, '/'),
        greatest(len(string_split(url, '/')) - 2, 1), len(string_split(url, '/')) - 1), '/') AS family_completion
    FROM pages""")
def c16_model_family(spark, sf):
    """Model family from a path (both variants), over every page URL."""
    pg = io.read_table(spark, sf, "pages")
    return pg.select("page_id", tx.model_family("url").alias("family"),
                     tx.model_family("url", completion=True).alias("family_completion"))


# ============================== I: metrics ===================================

def _sql_metrics(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""
  cm AS (SELECT {g}y_true, y_pred, count(*) AS n FROM {src} GROUP BY ALL),
  cls AS (SELECT {g}label, sum(tp) AS tp, sum(pn) AS pn, sum(tn) AS support FROM (
            SELECT {g}y_true AS label, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS tp, 0 AS pn, n AS tn FROM cm
            UNION ALL SELECT {g}y_pred AS label, 0, n, 0 FROM cm) GROUP BY ALL),
  st AS (SELECT *, CASE WHEN pn = 0 THEN 0.0 ELSE tp / pn END AS p,
                   CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS r,
                   CASE WHEN pn + support = 0 THEN 0.0 ELSE 2.0 * tp / (pn + support) END AS f FROM cls),
  ag AS (SELECT {g}sum(tp) AS tp, sum(support) AS n, avg(p) AS pm, avg(r) AS rm, avg(f) AS fm,
                sum(p * support) AS pw, sum(r * support) AS rw, sum(f * support) AS fw,
                avg(CASE WHEN support > 0 THEN r END) AS bal FROM st {gb})"""


_METRIC_SELECT = """round(tp / n, 6) AS accuracy, round(bal, 6) AS balanced_accuracy,
    round(tp / n, 6) AS precision_micro, round(pm, 6) AS precision_macro, round(pw / n, 6) AS precision_weighted,
    round(tp / n, 6) AS recall_micro, round(rm, 6) AS recall_macro, round(rw / n, 6) AS recall_weighted,
    round(tp / n, 6) AS f1_micro, round(fm, 6) AS f1_macro, round(fw / n, 6) AS f1_weighted"""


def _round_metrics(df, keep=()):
    return df.select(*keep, *[_r(F.col(m), m) for m in mt.METRIC_NAMES])


@register("i1_metrics", sql=with_ctes(
    ["posts", "predictions"], f"SELECT {_METRIC_SELECT} FROM ag",
    extra=[_sql_metrics("(SELECT y_true, y_pred FROM predictions WHERE split = 'test')").strip()]))
def i1_metrics(spark, sf):
    """The eleven classification metrics of the test-split predictions."""
    p = io.pick_split(dv.predictions(spark, sf), "test")
    return _round_metrics(mt.classification_metrics(p))


@register("i1_metrics_per_split", sql=with_ctes(
    ["posts", "predictions"], f"SELECT split, {_METRIC_SELECT} FROM ag",
    extra=[_sql_metrics("(SELECT split, y_true, y_pred FROM predictions)", "split").strip()]))
def i1_metrics_per_split(spark, sf):
    """I1 for every split in one job (grouped metrics)."""
    p = dv.predictions(spark, sf)
    return _round_metrics(mt.classification_metrics(p, group_cols=["split"]), keep=["split"])


@register("i2_classification_report", sql=with_ctes(
    ["posts", "predictions"],
    """SELECT CAST(label AS VARCHAR) AS row, round(p, 6) AS precision, round(r, 6) AS recall,
              round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM st
       UNION ALL SELECT 'accuracy', NULL, NULL, round(tp / n, 6), CAST(n AS BIGINT) FROM ag
       UNION ALL SELECT 'macro avg', round(pm, 6), round(rm, 6), round(fm, 6), CAST(n AS BIGINT) FROM ag
       UNION ALL SELECT 'weighted avg', round(pw / n, 6), round(rw / n, 6), round(fw / n, 6),
                        CAST(n AS BIGINT) FROM ag""",
    extra=[_sql_metrics("(SELECT y_true, y_pred FROM predictions)").strip()]))
def i2_classification_report(spark, sf):
    """Per-class report plus accuracy / macro / weighted rows."""
    rep = mt.classification_report(dv.predictions(spark, sf))
    return rep.select("row", _r(F.col("precision"), "precision"), _r(F.col("recall"), "recall"),
                      _r(F.col("f1"), "f1"), F.col("support").cast("long").alias("support"))


@register("i3_confusion_matrix", sql=with_ctes(
    ["posts", "predictions"],
    """SELECT t.l AS y_true, p.l AS y_pred, CAST(coalesce(cm.n, 0) AS BIGINT) AS n
       FROM lab t JOIN lab p ON true LEFT JOIN cm ON cm.y_true = t.l AND cm.y_pred = p.l""",
    extra=["cm AS (SELECT y_true, y_pred, count(*) AS n FROM predictions GROUP BY ALL)",
           "lab AS (SELECT DISTINCT l FROM (SELECT y_true AS l FROM cm UNION SELECT y_pred FROM cm))"]))
def i3_confusion_matrix(spark, sf):
    """Dense confusion matrix (long form), labels = union of true and predicted."""
    return mt.confusion_matrix(dv.predictions(spark, sf))


@register("i4_weighted_f1_from_scores", sql=with_ctes(
    [], "SELECT round(fw / n, 6) AS f1_weighted FROM ag",
    extra=[_sql_metrics("""(SELECT label AS y_true,
        CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS y_pred
        FROM (SELECT label, list_transform(range(10), lambda k: list_sum(list_transform(
                range(k + 1, len(embedding) + 1, 10), lambda i: CAST(embedding[i] AS DOUBLE)))) AS s
              FROM embeddings))""").strip()]))
def i4_weighted_f1_from_scores(spark, sf):
    """I4: weighted F1 of the argmax of ten scores vs the label; score k is the sum of the
    embedding's components k, k + 10, k + 20, ..."""
    def score(k):
        mine = F.filter("embedding", lambda x, i: i % 10 == k)
        return F.aggregate(mine, F.lit(0.0), lambda s, x: s + x.cast("double"))
    e = io.read_table(spark, sf, "embeddings").select(
        "label", F.array(*[score(k) for k in range(10)]).alias("logits"))
    return mt.weighted_f1_from_scores(e).select(_r(F.col("f1_weighted"), "f1_weighted"))


# ============================== E: sampling ==================================

@register("e1_stratified_sample", sql=with_ctes(
    ["posts"], f"""SELECT post_id, label FROM {_sql_strat_sample(
        "(SELECT post_id, label FROM posts WHERE split = 'train')", 100)}"""))
def e1_stratified_sample(spark, sf):
    """Exact stratified sample of 100 train posts (seed 42)."""
    train = io.pick_split(dv.posts(spark, sf), "train").select("post_id", "label")
    return sp.stratified_sample(train, "label", 100)


def _sql_few_shot(src: str, k: int, n_classes_sql: str, seed: int = 42) -> str:
    return f"""(
  WITH r AS (SELECT s.*, md5(CAST(post_id AS VARCHAR) || ':{seed}') AS h,
                    row_number() OVER (PARTITION BY label ORDER BY md5(CAST(post_id AS VARCHAR) || ':{seed}'),
                                       post_id) AS rn FROM {src} s),
       per AS (SELECT {k} // ({n_classes_sql}) AS q),
       picked AS (SELECT r.*, 0 AS part FROM r, per WHERE rn <= q),
       rest AS (SELECT r.*, 1 AS part FROM r, per WHERE rn > q ORDER BY h, post_id
                LIMIT {k} - (SELECT q FROM per) * ({n_classes_sql})),
       allp AS (SELECT * FROM picked UNION ALL SELECT * FROM rest)
  SELECT post_id, label, row_number() OVER (ORDER BY part, CASE WHEN part = 0 THEN label END,
                                            h, post_id) AS shot FROM allp)"""


@register("e2_few_shot_sample", sql=with_ctes(
    ["posts"], "SELECT post_id, label, CAST(shot AS INTEGER) AS shot FROM " + _sql_few_shot(
        "(SELECT post_id, label FROM posts WHERE split = 'train')", 7,
        "SELECT count(DISTINCT label) FROM posts WHERE split = 'train'")))
def e2_few_shot_sample(spark, sf):
    """Seven few-shot examples: 2 per class + 1 more, in listing order."""
    train = io.pick_split(dv.posts(spark, sf), "train").select("post_id", "label")
    return sp.few_shot_sample(train, 7).select("post_id", "label", "shot")
