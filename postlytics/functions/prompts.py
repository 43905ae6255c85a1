"""Prompt building (P1-P8) as Column expressions.

Templates are constants, so they are split on the driver into literal
pieces around their ``{placeholders}`` and rebuilt with ``concat``: the
post text is inserted verbatim (braces inside a post are never
re-interpreted, unlike chained string replacement).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlytics.functions.text import label_to_output

# --- fixed values (must equal the reference's templates) -------------------
SA_TEMPLATE = """
Classify the following text as either positive, neutral or negative sentiment.
Return label only without any other text.
{examples}
Text: {text}
Sentiment:"""

SA_TEMPLATE_COMPLETION = """
Classify the following text as either positive, neutral or negative sentiment.
Return label only without any other text.
{examples}
Text: {text}
### Sentiment:
"""

SA_EXAMPLE_TEMPLATE = """
Text: {text}
Sentiment: {sentiment}"""

SA_TEMPLATE_TRAINING_COMPLETION_ONLY = """
Classify the following text as either positive, neutral or negative sentiment.
Return label only without any other text.
{examples}
Text: {text}
### Sentiment: {sentiment}"""

MODEL_PROMPT_TEMPLATE = {
    "microsoft/Phi-3-mini-4k-instruct": "<|system|>\nYou are a helpful AI assistant.<|end|>\n<|user|>\n{prompt}<|end|>\n<|assistant|>\n",
    "mistralai/Mistral-7B-Instruct-v0.2": "<s>[INST] {prompt} [/INST]",
}

MODEL_FINETUNING_PROMPT_TEMPLATE = {
    "microsoft/Phi-3-mini-4k-instruct": "<|system|>\nYou are a helpful AI assistant.<|end|>\n<|user|>\n{input_text}<|end|>\n<|assistant|>\n{output}",
    "mistralai/Mistral-7B-Instruct-v0.2": "<s>[INST] {input_text} [/INST]\n {output} </s>",
}

FEW_SHOT_HEADER = "\nHere are some examples:\n"
FEW_SHOT_KS = (0, 3, 6, 9, 12, 15, 18, 21)
# ---------------------------------------------------------------------------

MODELS = tuple(MODEL_PROMPT_TEMPLATE)


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x)


def template_pieces(template: str):
    """``[(literal, field or None), ...]`` of a format string."""
    return [(lit, field) for lit, field, _, _ in string.Formatter().parse(template)]


def fill(template: str, **values) -> Column:
    """``template.format(**values)``; values are Columns or column names."""
    parts = []
    for lit, field in template_pieces(template):
        if lit:
            parts.append(F.lit(lit))
        if field is not None:
            v = values[field]
            parts.append(_c(v))
    return F.concat(*parts) if parts else F.lit("")


def model_prompt(model: str, prompt) -> Column:
    """Chat wrapper of ``model``; an unknown model gives the bare prompt."""
    return fill(MODEL_PROMPT_TEMPLATE.get(model, "{prompt}"), prompt=prompt)


def finetuning_prompt(model: str, input_text, output) -> Column:
    """Fine-tuning wrapper with the output; an unknown model is an error."""
    if model not in MODEL_FINETUNING_PROMPT_TEMPLATE:
        raise KeyError(model)
    return fill(MODEL_FINETUNING_PROMPT_TEMPLATE[model], input_text=input_text, output=output)


def label_text(label) -> Column:
    """Label name as Python's ``str.format`` would print it (``None`` for
    labels without a name)."""
    return F.coalesce(label_to_output(label), F.lit("None"))


def training_example(model: str, text, label, include_target: bool = True,
                     completion_only: bool = False) -> Column:
    """One training example: the completion-only training template
    with empty examples and empty sentiment, the label name as the output
    (``""`` without target). ``completion_only`` is accepted and ignored."""
    inp = fill(SA_TEMPLATE_TRAINING_COMPLETION_ONLY, examples=F.lit(""), text=text,
               sentiment=F.lit(""))
    out = label_text(label) if include_target else F.lit("")
    return finetuning_prompt(model, inp, out)


def example_text(text, label) -> Column:
    """One few-shot example line block."""
    return fill(SA_EXAMPLE_TEMPLATE, text=text, sentiment=label_text(label))


def few_shot_block(examples: DataFrame, text_col: str = "text", label_col: str = "label",
                   order_col: str = "shot") -> str:
    """The examples block for a (small, k-row) example frame; ``""`` for none.

    The k examples are fetched (k is a prompt size, a handful of rows) and
    the block becomes a literal of the prompt expression.
    """
    rows = (examples.select(order_col, example_text(text_col, label_col).alias("e"))
            .orderBy(order_col).collect())
    if not rows:
        return ""
    return FEW_SHOT_HEADER + "\n".join(r["e"] for r in rows) + "\n"


def few_shot_blocks(train: DataFrame, ks=FEW_SHOT_KS, text_col: str = "text",
                    label_col: str = "label", id_col: str = "post_id", seed: int = 42) -> dict:
    """The examples block of every ``k`` from one sampling pass."""
    from postlytics.operators.sampling import few_shot_samples

    def name(label):
        return {0: "Negative", 1: "Neutral", 2: "Positive"}.get(label, "None")

    samples = few_shot_samples(train, [k for k in ks if k > 0] or [0], label_col, id_col, seed,
                               keep=[text_col])
    out = {}
    for k in ks:
        if k == 0:
            out[k] = ""
            continue
        ex = [SA_EXAMPLE_TEMPLATE.format(text=r[text_col], sentiment=name(r[label_col]))
              for r in samples[k]]
        out[k] = FEW_SHOT_HEADER + "\n".join(ex) + "\n"
    return out


def test_prompt(model: str, text, examples: str | Column = "", completion: bool = False) -> Column:
    """Model wrapper around the task template with examples and text.

    ``examples`` is the block itself (a str literal) or a Column holding it.
    """
    if isinstance(examples, str):
        examples = F.lit(examples)
    tmpl = SA_TEMPLATE_COMPLETION if completion else SA_TEMPLATE
    return model_prompt(model, fill(tmpl, examples=examples, text=text))


def templates_frame(spark) -> DataFrame:
    """The template registry as a small frame ``(model_id, kind, template)``."""
    rows = [(m, "prompt", t) for m, t in MODEL_PROMPT_TEMPLATE.items()]
    rows += [(m, "finetune", t) for m, t in MODEL_FINETUNING_PROMPT_TEMPLATE.items()]
    return spark.createDataFrame(rows, "model_id string, kind string, template string")


def model_prompt_by_column(df: DataFrame, model_col: str, prompt_col: str,
                           out_col: str = "prompt") -> DataFrame:
    """P2 when the model varies per row: join to the (fixed, 2-row) template
    table, broadcast; unknown model -> bare prompt."""
    t = (templates_frame(df.sparkSession).where(F.col("kind") == "prompt")
         .select(F.col("model_id").alias("_m"), F.col("template").alias("_t")))
    joined = df.join(F.broadcast(t), F.col(model_col) == F.col("_m"), "left")
    tpl = F.coalesce(F.col("_t"), F.lit("{prompt}"))
    filled = F.concat(F.substring_index(tpl, "{prompt}", 1), F.col(prompt_col),
                      F.substring_index(tpl, "{prompt}", -1))
    return joined.withColumn(out_col, filled).drop("_m", "_t")
