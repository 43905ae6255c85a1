"""Registered queries: prompt building."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlytics.functions import prompts as pr
from postlytics.operators import sampling as sp
from postlytics.plans import derived as dv
from postlytics.plans.derived import with_ctes
from postlytics.plans.q_core import _sql_few_shot
from postlytics.plans.registry import register
from postlytics.sources import io

PHI3, MISTRAL = pr.MODELS


def sql_lit(s: str) -> str:
    """A SQL string literal; newlines as chr(10)."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")"


def sql_fill(template: str, **values: str) -> str:
    parts = []
    for lit, field in pr.template_pieces(template):
        if lit:
            parts.append(sql_lit(lit))
        if field is not None:
            parts.append(f"({values[field]})")
    return "(" + " || ".join(parts) + ")" if parts else "''"


def sql_label_text(x: str) -> str:
    return (f"coalesce(CASE {x} WHEN 0 THEN 'Negative' WHEN 1 THEN 'Neutral' "
            f"WHEN 2 THEN 'Positive' END, 'None')")


def sql_model_prompt(model: str, prompt: str) -> str:
    return sql_fill(pr.MODEL_PROMPT_TEMPLATE.get(model, "{prompt}"), prompt=prompt)


def sql_training_example(text: str, label: str = "label", model: str = PHI3,
                         include_target: bool = True) -> str:
    inp = sql_fill(pr.SA_TEMPLATE_TRAINING_COMPLETION_ONLY, examples="''", text=text, sentiment="''")
    out = sql_label_text(label) if include_target else "''"
    return sql_fill(pr.MODEL_FINETUNING_PROMPT_TEMPLATE[model], input_text=inp, output=out)


def sql_test_prompt(model: str, text: str, examples: str = "''") -> str:
    return sql_model_prompt(model, sql_fill(pr.SA_TEMPLATE, examples=examples, text=text))


def _sql_block(k: int) -> str:
    """A one-row CTE body with the few-shot block for ``k`` examples."""
    if k == 0:
        return "SELECT '' AS block"
    shots = _sql_few_shot("(SELECT post_id, text, label FROM posts WHERE split = 'train')", k,
                          "SELECT count(DISTINCT label) FROM posts WHERE split = 'train'")
    ex = sql_fill(pr.SA_EXAMPLE_TEMPLATE, text="p.text", sentiment=sql_label_text("s.label"))
    return (f"SELECT {sql_lit(pr.FEW_SHOT_HEADER)} || string_agg({ex}, chr(10) ORDER BY s.shot) "
            f"|| chr(10) AS block FROM {shots} s JOIN posts p USING (post_id)")


def _block(spark, sf, k: int) -> str:
    if k == 0:
        return ""
    p = dv.posts(spark, sf)
    train = io.pick_split(p, "train").select("post_id", "label")
    shots = sp.few_shot_sample(train, k).join(p.select("post_id", "text"), "post_id")
    return pr.few_shot_block(shots)


@register("p1_zero_shot_prompt", sql=with_ctes(
    ["posts"], f"SELECT post_id, {sql_fill(pr.SA_TEMPLATE, examples=chr(39) * 2, text='text')} AS prompt, "
               f"{sql_fill(pr.SA_TEMPLATE_COMPLETION, examples=chr(39) * 2, text='text')} AS prompt_completion "
               "FROM posts WHERE split = 'test'"))
def p1_zero_shot_prompt(spark, sf):
    """The task templates filled with the test posts (no examples)."""
    t = io.pick_split(dv.posts(spark, sf), "test")
    return t.select("post_id", pr.fill(pr.SA_TEMPLATE, examples=F.lit(""), text="text").alias("prompt"),
                    pr.fill(pr.SA_TEMPLATE_COMPLETION, examples=F.lit(""), text="text")
                    .alias("prompt_completion"))


@register("p2_model_prompt", sql=with_ctes(
    ["texts"], f"""SELECT post_id, {sql_model_prompt(PHI3, 'text')} AS phi3,
        {sql_model_prompt(MISTRAL, 'text')} AS mistral, {sql_model_prompt('unknown/model', 'text')} AS other
        FROM texts"""))
def p2_model_prompt(spark, sf):
    """Chat wrappers of both models and of an unknown model (bare prompt)."""
    p = dv.texts(spark, sf)
    return p.select("post_id", pr.model_prompt(PHI3, "text").alias("phi3"),
                    pr.model_prompt(MISTRAL, "text").alias("mistral"),
                    pr.model_prompt("unknown/model", "text").alias("other"))


@register("p2_model_prompt_by_column", sql=with_ctes(
    ["posts"], f"""SELECT post_id, model, CASE model
        WHEN '{PHI3}' THEN {sql_model_prompt(PHI3, 'text')}
        WHEN '{MISTRAL}' THEN {sql_model_prompt(MISTRAL, 'text')} ELSE text END AS prompt
      FROM (SELECT post_id, text, CASE label WHEN 0 THEN '{PHI3}' WHEN 1 THEN '{MISTRAL}'
            ELSE 'other/model' END AS model FROM posts)"""))
def p2_model_prompt_by_column(spark, sf):
    """P2 with a per-row model (broadcast join to the template table)."""
    p = dv.posts(spark, sf)
    m = F.when(F.col("label") == 0, PHI3).when(F.col("label") == 1, MISTRAL).otherwise("other/model")
    df = p.select("post_id", "text", m.alias("model"))
    return pr.model_prompt_by_column(df, "model", "text").select("post_id", "model", "prompt")


@register("p3_finetuning_prompt", sql=with_ctes(
    ["posts"], f"""SELECT post_id,
        {sql_fill(pr.MODEL_FINETUNING_PROMPT_TEMPLATE[PHI3], input_text='text', output=sql_label_text('label'))} AS phi3,
        {sql_fill(pr.MODEL_FINETUNING_PROMPT_TEMPLATE[MISTRAL], input_text='text', output=sql_label_text('label'))} AS mistral
        FROM posts"""))
def p3_finetuning_prompt(spark, sf):
    """Fine-tuning wrappers (input = post text, output = label name)."""
    p = dv.posts(spark, sf)
    out = pr.label_text("label")
    return p.select("post_id", pr.finetuning_prompt(PHI3, "text", out).alias("phi3"),
                    pr.finetuning_prompt(MISTRAL, "text", out).alias("mistral"))


@register("p4_training_example", sql=with_ctes(
    ["posts"], f"""SELECT post_id, {sql_training_example('text')} AS with_target,
        {sql_training_example('text', include_target=False)} AS without_target
        FROM posts WHERE split = 'train'"""))
def p4_training_example(spark, sf):
    """Training examples (Phi-3), with and without the target."""
    t = io.pick_split(dv.posts(spark, sf), "train")
    return t.select("post_id", pr.training_example(PHI3, "text", "label").alias("with_target"),
                    pr.training_example(PHI3, "text", "label", include_target=False)
                    .alias("without_target"))


@register("p5_batch_training_examples", sql=with_ctes(
    ["posts"], f"""SELECT post_id, '{PHI3}' AS model, {sql_training_example('text', model=PHI3)} AS example
        FROM posts WHERE split IN ('train', 'validation')
        UNION ALL
        SELECT post_id, '{MISTRAL}', {sql_training_example('text', model=MISTRAL)}
        FROM posts WHERE split IN ('train', 'validation')"""))
def p5_batch_training_examples(spark, sf):
    """P5: the batch formatter = the same Column over whole splits, both models."""
    p = dv.posts(spark, sf).where(F.col("split").isin("train", "validation"))
    out = None
    for m in (PHI3, MISTRAL):
        part = p.select("post_id", F.lit(m).alias("model"),
                        pr.training_example(m, "text", "label", completion_only=True).alias("example"))
        out = part if out is None else out.unionByName(part)
    return out


@register("p6_few_shot_block", sql=with_ctes(["posts"], _sql_block(6)))
def p6_few_shot_block(spark, sf):
    """The examples block for k = 6 (2 per class)."""
    return spark.range(1).select(F.lit(_block(spark, sf, 6)).alias("block"))


@register("p7_test_prompts", sql=with_ctes(
    ["posts"], f"SELECT post_id, {sql_test_prompt(PHI3, 'text', 'b.block')} AS prompt "
               "FROM posts, b WHERE split = 'test'",
    extra=[f"b AS ({_sql_block(3)})"]))
def p7_test_prompts(spark, sf):
    """Few-shot (k = 3) Phi-3 test prompts for every test post."""
    t = io.pick_split(dv.posts(spark, sf), "test")
    return t.select("post_id", pr.test_prompt(PHI3, "text", F.lit(_block(spark, sf, 3))).alias("prompt"))


@register("p8_few_shot_sweep", sql=with_ctes(
    ["posts"], f"SELECT k, post_id, {sql_test_prompt(MISTRAL, 'text', 'b.block')} AS prompt "
               "FROM posts JOIN blocks b ON true WHERE split = 'test'",
    extra=["blocks AS (" + " UNION ALL ".join(
        f"SELECT {k} AS k, block FROM ({_sql_block(k)})" for k in pr.FEW_SHOT_KS) + ")"]))
def p8_few_shot_sweep(spark, sf):
    """The whole k sweep (0, 3, ..., 21) as one frame keyed by k."""
    train = io.pick_split(dv.posts(spark, sf), "train").select("post_id", "text", "label")
    by_k = pr.few_shot_blocks(train, pr.FEW_SHOT_KS)
    blocks = [(k, by_k[k]) for k in pr.FEW_SHOT_KS]
    arr = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(b).alias("block")) for k, b in blocks])
    t = io.pick_split(dv.posts(spark, sf), "test").select("post_id", "text", F.explode(arr).alias("kb"))
    return t.select(F.col("kb.k").alias("k"), "post_id",
                    pr.test_prompt(MISTRAL, "text", F.col("kb.block")).alias("prompt"))
