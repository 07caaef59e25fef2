"""Prompts for a whole corpus."""

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import fixed
from gradeloom.functions.prompts import apply_template, linearize


def template_text(template_id: Column, templates: dict[str, str] | None = None) -> Column:
    """Look a template up by id in a small literal catalogue; null for an unknown id."""
    pairs = [F.lit(x) for item in (templates or fixed.TEMPLATES).items() for x in item]
    return F.try_element_at(F.create_map(*pairs), template_id)


MOST_TEMPLATES = 10_000


def with_templates(corpus: DataFrame, templates: DataFrame) -> DataFrame:
    """Attach ``template`` from a ``(template_id, template)`` table; null where the table lacks the id.

    A favourite template is on most rows. The table goes to all tasks if it has at most ``MOST_TEMPLATES`` rows, which
    is counted; a larger one is joined by key, and adaptive execution splits the favourite.
    """
    table = templates.select("template_id", "template")
    small = table.limit(MOST_TEMPLATES + 1).count() <= MOST_TEMPLATES
    return corpus.join(F.broadcast(table) if small else table, "template_id", "left")


def linearized(style: str, **options) -> Column:
    """:func:`linearize` over the corpus columns."""
    return linearize(
        F.col("question"), F.col("answers"), F.col("correct_answers"), style=style, **options
    )


def render_prompts(
    corpus: DataFrame,
    template_id: str | Column = "0",
    *,
    style: str = "open",
    left_parenthesis: bool | Column = False,
    templates: dict[str, str] | None = None,
) -> DataFrame:
    """Add ``prompt``: the rendered question inside its template."""
    key = F.lit(template_id) if isinstance(template_id, str) else template_id
    body = linearized(style, left_parenthesis=left_parenthesis)
    return corpus.withColumn("prompt", apply_template(template_text(key, templates), body))


def few_shot_block(
    pool: DataFrame, shots: int | None = None, order_by: str = "id", *, style: str = "gold", **options
) -> DataFrame:
    """One row with the pool's questions rendered with their answers, in order.

    A chosen pool is shown whole: without ``shots`` it is one value and must be of bounded size. ``shots`` is how many
    examples the prompt shows of a larger one; Spark takes the first with a distributed top-k, so that pool may be any size.
    """
    shown = pool.select(F.col(order_by).alias("ord"), linearized(style, **options).alias("txt"))
    if shots is not None:
        shown = shown.orderBy("ord").limit(shots)
    rows = F.sort_array(F.collect_list(F.struct("ord", "txt")))
    return shown.agg(F.array_join(F.transform(rows, lambda r: r["txt"]), "\n\n").alias("block"))


def few_shot_prompts(
    corpus: DataFrame,
    pool: DataFrame,
    shots: int | None = None,
    template_id: str | Column = "0",
    *,
    order_by: str = "id",
    style: str = "gold",
    templates: dict[str, str] | None = None,
    **options,
) -> DataFrame:
    """Add ``prompt``: the shots, then the open question, separated by blank lines.

    ``style`` is that of the shots' answers; ``options`` go to shots and question alike. The pool should not hold the
    questions asked, or they show their own answer. The block is a scalar subquery: computed once and used as a
    constant, without a join.
    """
    key = F.lit(template_id) if isinstance(template_id, str) else template_id
    block = few_shot_block(pool, shots, order_by, style=style, **options).scalar()
    body = F.array_join(F.array(F.nullif(block, F.lit("")), linearized("open", **options)), "\n\n")
    return corpus.withColumn("prompt", apply_template(template_text(key, templates), body))
