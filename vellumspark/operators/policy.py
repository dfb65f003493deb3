"""Policies by tensor name: ordered conditions, keep rules first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Rows of a program's own dimensions that may be broadcast.
DIMENSION = 10_000


def _ends(name: Column, *tails: str) -> Column:
    return name.rlike("(" + "|".join(t.replace(".", "\\.") for t in tails) + ")$")


def _starts(name: Column, *heads: str) -> Column:
    return name.rlike("^(" + "|".join(h.replace(".", "\\.") for h in heads) + ")")


def recipe(name: Column) -> Column:
    """keep, int8, or gated classes of the recipe; unknown names are kept. The order of
    the conditions decides (fixed rules)."""
    attention = name.contains(".self_attn.") & _ends(name, ".q_proj.weight", ".k_proj.weight", ".v_proj.weight", ".o_proj.weight")
    norm = name.rlike("layernorm|layer_norm|LayerNorm|\\.norm1\\.|\\.norm2\\.|\\.ln_") | (name == "model.norm.weight") | _ends(name, ".norm.weight", ".norm.bias", ".ln_post.weight", ".ln_post.bias")
    ffn = _ends(name, ".gate_proj.weight", ".up_proj.weight", ".down_proj.weight") & _starts(name, "model.layers.", "layers.") & name.contains(".mlp.")
    return (
        F.when(_starts(name, "model.vision_model.", "model.sam_model.", "vision_model.", "sam_model."), "keep-vision")
        .when(_starts(name, "model.projector.", "projector."), "keep-projector")
        .when(name.isin("model.embed_tokens.weight", "embed_tokens.weight"), "keep-embedding")
        .when(name.isin("model.image_newline", "model.view_seperator", "image_newline", "view_seperator"), "keep-connector")
        .when(_ends(name, ".mlp.gate.weight", ".mlp.gate.bias"), "keep-router")
        .when(norm, "keep-norm")
        .when(attention, "gated-attention")
        .when(name == "lm_head.weight", "gated-head")
        .when(ffn, "int8")
        .otherwise("keep-unknown")
    )


def resolved(policy: Column, attention: bool = False, head: bool = False) -> Column:
    """Gated classes by their switches."""
    return F.when(policy == "gated-attention", "int8" if attention else "keep").when(policy == "gated-head", "int8" if head else "keep").when(policy == "int8", "int8").otherwise("keep")


def converter(name: Column) -> Column:
    """The converter's own, broader rule, without switches."""
    rest = F.when(name.startswith("model.layers."), F.substring(name, F.lit(len("model.layers.") + 1), F.char_length(name)))
    attention = rest.contains(".self_attn.")
    return (name == "lm_head.weight") | F.coalesce(F.when(attention, _ends(rest, ".q_proj.weight", ".k_proj.weight", ".v_proj.weight", ".o_proj.weight")).otherwise(rest.contains(".mlp.") & _ends(rest, ".gate_proj.weight", ".up_proj.weight", ".down_proj.weight")), F.lit(False))


def _preset(models: DataFrame) -> Row:
    rows = models.take(DIMENSION + 1)
    if len(rows) > DIMENSION:
        raise ValueError(f"over {DIMENSION} models")
    preset = [r for r in rows if r["preset"]]
    if len(preset) != 1:
        raise ValueError(f"{len(preset)} models are preset instead of one")
    return preset[0]


def feasible(requests: DataFrame, tasks: DataFrame, models: DataFrame) -> DataFrame:
    """``requests`` (task, spec, ...) with ``verdict``: ok, unknown task, not implemented,
    or needs <model>.

    tasks: (task, needs, planned); models: (model, mark, preset), one of them preset.
    Both are dimensions of a program, a few rows each, and what is broadcast of them is
    checked. A request without a spec takes the preset model. A spec rules out the model
    that its task needs only where its file name has the preset's mark and not that
    model's; a task without needs runs with any.
    """
    usual = _preset(models)
    if len(tasks.take(DIMENSION + 1)) > DIMENSION:
        raise ValueError(f"over {DIMENSION} tasks")
    needed = models.select(F.col("model").alias("needs"), F.lower("mark").alias("_mark"), F.coalesce("preset", F.lit(False)).alias("_own"))
    known = tasks.select("task", "needs", "planned").join(F.broadcast(needed), "needs", "left").withColumn("_known", F.lit(True))
    name = F.lower(F.element_at(F.split("spec", "[/\\\\]"), -1))
    other = F.when(F.col("spec").isNull(), ~F.col("_own")).otherwise(name.contains(F.lower(F.lit(usual["mark"]))) & ~name.contains(F.col("_mark")))
    verdict = F.when(F.col("_known").isNull(), "unknown task").when(F.col("planned"), "not implemented").when(F.col("needs").isNotNull() & F.coalesce(other, F.lit(False)), F.concat(F.lit("needs "), "needs")).otherwise("ok")
    return requests.join(F.broadcast(known), "task", "left").select(*[requests[c] for c in requests.columns], verdict.alias("verdict"))


def architecture(requests: DataFrame, models: DataFrame, model: str = "model") -> DataFrame:
    """``requests`` with the row of ``models`` that they name as ``found``: the preset one
    where they name none, null where no model has that name."""
    usual = _preset(models)["model"]
    rows = models.select(F.col("model").alias("_m"), F.struct(*models.columns).alias("found"))
    return requests.join(F.broadcast(rows), F.coalesce(F.col(model), F.lit(usual)) == F.col("_m"), "left").drop("_m")
