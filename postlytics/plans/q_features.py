"""Registered queries: features (D1-D4, D10-D13) and the lexicon score (C14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlytics.functions import text as tx
from postlytics.operators import encode as en
from postlytics.operators import features as ft
from postlytics.operators import frames as fr
from postlytics.plans import derived as dv
from postlytics.plans.derived import with_ctes
from postlytics.plans.q_core import SQL_CLEAN, _r, sql_preprocess_tokens, sql_tokenize
from postlytics.plans.registry import register
from postlytics.sources import io

SQL_WORDS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _sql_tfidf(src: str, name: str = "w") -> list[str]:
    """CTEs ``{name}_tf``, ``{name}_idf``, ``{name}`` (id, term, tfidf) over ``src(post_id, text)``."""
    return [
        f"{name}_tok AS (SELECT post_id, unnest({SQL_WORDS.format(x='text')}) AS term FROM {src})",
        f"{name}_tf AS (SELECT post_id, term, count(*) AS tf FROM {name}_tok GROUP BY ALL)",
        f"{name}_n AS (SELECT count(*) AS n FROM {src})",
        f"""{name}_idf AS (SELECT term, ln((1.0 + n) / (1.0 + count(*))) + 1.0 AS idf
                           FROM {name}_tf, {name}_n GROUP BY term, n)""",
        f"""{name}_raw AS (SELECT post_id, term, tf * idf AS w FROM {name}_tf JOIN {name}_idf USING (term))""",
        f"""{name}_nr AS (SELECT post_id, sqrt(sum(w * w)) AS nr FROM {name}_raw GROUP BY post_id)""",
        f"""{name} AS (SELECT post_id, term, CASE WHEN nr = 0 THEN 0.0 ELSE w / nr END AS tfidf
                       FROM {name}_raw JOIN {name}_nr USING (post_id))""",
    ]


@register("d1_extract_count", sql=with_ctes(
    ["texts"], f"""SELECT post_id, term, CAST(count(*) AS BIGINT) AS tf FROM (
        SELECT post_id, unnest({SQL_WORDS.format(x='text')}) AS term FROM texts) GROUP BY ALL"""))
def d1_extract_count(spark, sf):
    """D1 with method='count': the count features through the dispatcher."""
    feats, _ = ft.extract_features(dv.texts(spark, sf), method="count")
    return feats


@register("d2_term_counts", sql=f"""SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (
    SELECT doc_id, unnest({SQL_WORDS.format(x='text')}) AS term FROM documents) GROUP BY ALL""")
def d2_term_counts(spark, sf):
    """Term counts of every document (long form)."""
    d = io.read_table(spark, sf, "documents")
    return ft.term_counts(d, id_col="doc_id")


@register("d3_tfidf", sql=with_ctes(
    ["texts"], "SELECT post_id, term, round(tfidf, 6) AS tfidf FROM w",
    extra=_sql_tfidf("texts")))
def d3_tfidf(spark, sf):
    """D3: smoothed, L2-normalised TF-IDF of all documents (long form)."""
    w, _ = ft.tfidf(dv.texts(spark, sf))
    return w.select("post_id", "term", _r(F.col("tfidf"), "tfidf"))


@register("d3_top_terms_per_label", sql=with_ctes(
    ["posts"],
    """SELECT label, term, round(score, 6) AS score, rank FROM (
         SELECT label, term, score, row_number() OVER (PARTITION BY label
                ORDER BY round(score, 9) DESC, term) AS rank FROM (
           SELECT p.label, w.term, sum(w.tfidf) AS score FROM w JOIN posts p USING (post_id)
           GROUP BY ALL)) WHERE rank <= 5""",
    extra=_sql_tfidf("posts")))
def d3_top_terms_per_label(spark, sf):
    """Flagship: clean -> TF-IDF -> summed weight per (label, term) -> top 5 per label."""
    p = dv.posts(spark, sf)
    w, _ = ft.tfidf(p.select("post_id", "text"))
    scored = (w.join(p.select("post_id", "label"), "post_id")
              .groupBy("label", "term").agg(F.sum("tfidf").alias("score")))
    top = fr.top_n_per_group(scored, ["label"], [F.round("score", 9).desc(), F.col("term")], 5)
    return top.select("label", "term", _r(F.col("score"), "score"),
                      F.col("rank").cast("long").alias("rank"))


@register("d4_transform_unseen", sql=with_ctes(
    ["posts"],
    """SELECT post_id, term, round(CASE WHEN nr = 0 THEN 0.0 ELSE w / nr END, 6) AS tfidf FROM (
         SELECT post_id, term, w, sqrt(sum(w * w) OVER (PARTITION BY post_id)) AS nr FROM (
           SELECT t.post_id, t.term, t.tf * f.idf AS w FROM te_tf t JOIN f_idf f USING (term)))""",
    extra=_sql_tfidf("(SELECT post_id, text FROM posts WHERE split IN ('train', 'validation'))", "f")
    + [f"""te_tf AS (SELECT post_id, term, count(*) AS tf FROM (
           SELECT post_id, unnest({SQL_WORDS.format(x='text')}) AS term FROM posts
           WHERE split = 'test') GROUP BY ALL)"""]))
def d4_transform_unseen(spark, sf):
    """Fit on train + validation, transform the test split (unseen terms ignored)."""
    p = dv.posts(spark, sf)
    model = ft.fit_tfidf(p.where(F.col("split").isin("train", "validation")).select("post_id", "text"))
    w = model.transform(io.pick_split(p, "test").select("post_id", "text"))
    return w.select("post_id", "term", _r(F.col("tfidf"), "tfidf"))


# --- D10-D13 -----------------------------------------------------------------
MAX_LEN = 512  # the encoder's maximum, as in B12


def _sql_vocab_ids(tok_cte: str) -> list[str]:
    """CTEs vocab(token, id) and ids(post_id, ids) over ``tok_cte(post_id, tokens)``."""
    return [
        f"ex AS (SELECT post_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM {tok_cte})",
        """vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS INTEGER) AS id
                      FROM (SELECT token, count(*) AS n FROM ex GROUP BY token))""",
        f"""idl AS (SELECT post_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids FROM ex LEFT JOIN vocab v USING (token)
                    GROUP BY post_id)""",
        f"""ids AS (SELECT t.post_id, coalesce(i.ids, []::INTEGER[]) AS ids FROM {tok_cte} t
                    LEFT JOIN idl i USING (post_id))""",
    ]


@register("d10_encode", sql=with_ctes(
    ["texts"],
    f"""SELECT post_id,
          array_to_string(s || list_transform(range({MAX_LEN} - len(s)), lambda x: 0), ' ') AS input_ids,
          array_to_string(list_transform(range(len(s)), lambda x: 1)
                          || list_transform(range({MAX_LEN} - len(s)), lambda x: 0), ' ') AS attention_mask
        FROM (SELECT post_id, [2] || ids[1:{MAX_LEN - 2}] || [3] AS s FROM ids)""",
    extra=[f"tok AS (SELECT post_id, {sql_preprocess_tokens('text')} AS tokens FROM texts)"]
    + _sql_vocab_ids("tok")))
def d10_encode(spark, sf):
    """Whole word vocabulary -> ids -> [CLS] ids [SEP], truncated/padded to 512."""
    p = dv.texts(spark, sf).select("post_id", tx.preprocess_tokens("text").alias("tokens"))
    vocab = en.build_vocab(p, "tokens")
    enc = en.encode(p, "post_id", "tokens", vocab, MAX_LEN)
    return enc.select("post_id", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), " ")
                      .alias("input_ids"),
                      F.array_join(F.transform("attention_mask", lambda x: x.cast("string")), " ")
                      .alias("attention_mask"))


@register("d10_token_ids", sql=with_ctes(
    ["texts"], "SELECT post_id, array_to_string(ids, ' ') AS ids FROM ids",
    extra=[f"tok AS (SELECT post_id, {sql_preprocess_tokens('text')} AS tokens FROM texts)"]
    + _sql_vocab_ids("tok")))
def d10_token_ids(spark, sf):
    """D10 before cutting and padding: the ids of every token of all documents."""
    p = dv.texts(spark, sf).select("post_id", tx.preprocess_tokens("text").alias("tokens"))
    ids = en.token_ids(p, "post_id", "tokens", en.build_vocab(p, "tokens"))
    return ids.select("post_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
                      .alias("ids"))


def _training_prompt_sql(x: str) -> str:
    from postlytics.plans.q_prompts import sql_training_example
    return sql_training_example(x)


def _sql_d11() -> str:
    from postlytics.plans.q_prompts import PHI3, sql_training_example
    tmpl = "['#', '#', '#', 'Sentiment', ':']"
    return with_ctes(
        ["posts"],
        """SELECT post_id, CAST(len(ids) AS INTEGER) AS n_ids, CAST(len(ids) - e AS INTEGER) AS n_target,
                  array_to_string(list_transform(range(e), lambda x: -100) || ids[e + 1:], ' ') AS labels
           FROM (SELECT post_id, ids, CASE WHEN last IS NULL THEN len(ids)
                                          ELSE least(last + 4, len(ids)) END AS e FROM lab)""",
        extra=[f"pr AS (SELECT post_id, {sql_training_example('text', model=PHI3)} AS prompt FROM posts)",
               r"tok AS (SELECT post_id, regexp_extract_all(prompt, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') "
               "AS tokens FROM pr)"]
        + _sql_vocab_ids("tok")
        + [f"""tm AS (SELECT list(coalesce(v.id, 1) ORDER BY t.i) AS tids FROM (
                 SELECT unnest({tmpl}) AS token, unnest(range(5)) AS i) t LEFT JOIN vocab v USING (token))""",
           """lab AS (SELECT post_id, ids, list_max(list_filter(range(1, greatest(len(ids) - 4, 1) + 1),
                                                     lambda i: ids[i:i + 4] = tids)) AS last
                      FROM ids, tm)"""])


@register("d11_completion_mask", sql=_sql_d11())
def d11_completion_mask(spark, sf):
    """Completion-only labels on encoded training prompts (ids up to the
    end of the last response marker set to -100)."""
    from postlytics.functions import prompts as pr
    p = dv.posts(spark, sf)
    ex = p.select("post_id", pr.training_example(pr.MODELS[0], "text", "label").alias("prompt"))
    toks = ex.select("post_id", en.prompt_tokens("prompt").alias("tokens"))
    vocab = en.build_vocab(toks, "tokens")
    ids = en.token_ids(toks, "post_id", "tokens", vocab)
    tmpl_tokens = [r[0] for r in spark.range(1).select(
        F.explode(en.prompt_tokens(F.lit(en.RESPONSE_TEMPLATE)))).collect()]
    m = {r["token"]: r["id"] for r in vocab.where(F.col("token").isin(tmpl_tokens)).collect()}
    tmpl_ids = [m.get(t, en.UNK_ID) for t in tmpl_tokens]
    lab = en.completion_only_labels("ids", tmpl_ids)
    return ids.select("post_id", F.size("ids").cast("int").alias("n_ids"),
                      F.size(F.filter(lab, lambda x: x != en.IGNORE_INDEX)).cast("int").alias("n_target"),
                      F.array_join(F.transform(lab, lambda x: x.cast("string")), " ").alias("labels"))


@register("d12_pack", sql=with_ctes(
    ["texts"],
    """SELECT post_id, CAST(b AS BIGINT) AS block_id,
              CAST(greatest(o, b * 2048) - b * 2048 AS BIGINT) AS start,
              CAST(least(o + l, (b + 1) * 2048) - greatest(o, b * 2048) AS BIGINT) AS n_tokens
       FROM (SELECT post_id, o, l, unnest(range(CAST(o // 2048 AS BIGINT), CAST((o + l - 1) // 2048 + 1 AS BIGINT))) AS b
             FROM off WHERE l > 0), tot WHERE b < nb""",
    extra=[f"lens AS (SELECT post_id, len({sql_preprocess_tokens('text')}) + 1 AS l FROM texts)",
           """off AS (SELECT post_id, l, coalesce(sum(l) OVER (ORDER BY post_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM lens)""",
           "tot AS (SELECT sum(l) // 2048 AS nb FROM lens)"]))
def d12_pack(spark, sf):
    """Pack the token streams of all documents (id order, end token between
    examples) into 2048-token blocks; the last short block is dropped."""
    p = dv.texts(spark, sf).select("post_id", F.size(tx.preprocess_tokens("text")).alias("n"))
    return en.pack(p, "post_id", "n", 2048)


@register("d13_group_by_length", sql=f"""SELECT doc_id, length, CAST(
    (row_number() OVER (ORDER BY length, doc_id) - 1) // 8 AS BIGINT) AS batch_id FROM (
    SELECT doc_id, CAST(len({sql_tokenize(SQL_CLEAN.format(x='text'))}) AS INTEGER) AS length FROM documents)""")
def d13_group_by_length(spark, sf):
    """Batches of 8 documents of like token length."""
    d = io.read_table(spark, sf, "documents").select(
        "doc_id", F.size(tx.tokenize(tx.clean_text("text"))).alias("length"))
    return en.group_by_length(d, "doc_id", "length", 8)


# --- C14 ---------------------------------------------------------------------

@register("c14_lexicon_score", sql=with_ctes(
    ["posts"],
    """SELECT p.post_id, round(coalesce(s.s, 0), 6) AS sum_valence,
              round(coalesce(s.s, 0) / sqrt(coalesce(s.s, 0) * coalesce(s.s, 0) + 15.0), 6) AS compound,
              CASE WHEN coalesce(s.s, 0) / sqrt(coalesce(s.s, 0) * coalesce(s.s, 0) + 15.0) >= 0.05 THEN 2
                   WHEN coalesce(s.s, 0) / sqrt(coalesce(s.s, 0) * coalesce(s.s, 0) + 15.0) <= -0.05 THEN 0
                   ELSE 1 END AS label
       FROM ptok p LEFT JOIN s USING (post_id) WHERE p.split = 'test'""",
    extra=[f"ptok AS (SELECT post_id, label, split, {sql_preprocess_tokens('text')} AS tokens FROM posts)",
           """lex AS (SELECT token, avg(label - 1.0) AS valence FROM (
                SELECT DISTINCT post_id, label, unnest(tokens) AS token FROM ptok WHERE split = 'train')
                GROUP BY token)""",
           """s AS (SELECT post_id, sum(valence) AS s FROM (
                SELECT post_id, unnest(tokens) AS token FROM ptok WHERE split = 'test')
                JOIN lex USING (token) GROUP BY post_id)"""]))
def c14_lexicon_score(spark, sf):
    """C14: lexicon (learnt on train) -> summed valence -> compound -> C13 label, on test."""
    p = dv.posts(spark, sf)
    lex = ft.fit_lexicon(io.pick_split(p, "train"))
    sc = ft.lexicon_scores(io.pick_split(p, "test"), lex)
    return sc.select("post_id", _r(F.col("sum_valence"), "sum_valence"),
                     _r(F.col("compound"), "compound"),
                     tx.compound_to_label("compound").alias("label"))


# --- C9 / C10 ----------------------------------------------------------------

@register("c9_stem_vocabulary")
def c9_stem_vocabulary(spark, sf):
    """Porter stems of every distinct token of all documents (after C8)."""
    from postlytics.operators import stem as st
    d = io.read_table(spark, sf, "documents")
    toks = (d.select(F.explode_outer(tx.preprocess_tokens("text")).alias("token"))
            .where(F.col("token").isNotNull()))
    return st.stem_table(toks)


@register("c10_preprocess")
def c10_preprocess(spark, sf):
    """The classical preparation (clean, tokenize, stop words, stem) of all documents."""
    from postlytics.operators import stem as st
    return st.preprocess(dv.texts(spark, sf), "post_id", "text")
