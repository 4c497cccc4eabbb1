"""Single-event suppression in micro-batches, with the decisions of the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..operators.suppression import SingleEventRule, decide, first_rule

STATE_SCHEMA = "id string, timestamp timestamp, rule string"


def rule_key(rule: SingleEventRule) -> str:
    """The whole definition: a rule that is replaced by another finds no state."""
    return repr(rule)


def judged(batch: DataFrame, rules: list[SingleEventRule], state: DataFrame | None) -> DataFrame:
    """Rows of ``batch`` and, with ``__old``, of ``state``, with ``__rule`` and ``suppressed``.

    ``state`` holds the newest rows of each rule before this batch.  With
    batches that come in time order the verdicts are those of the batch operator.
    """
    tagged = batch.withColumns({"__rule": first_rule(rules), "__old": F.lit(False)})
    if state is not None and rules:
        number = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (rule_key(r), i)])
        old = state.select("id", "timestamp", number.getItem(F.col("rule")).alias("__rule"), F.lit(True).alias("__old"))
        tagged = tagged.unionByName(old.where("__rule IS NOT NULL"), allowMissingColumns=True)
    return decide(tagged, rules)


def next_state(rows: DataFrame, rules: list[SingleEventRule]) -> DataFrame:
    """The newest ``skip_amount`` + 1 judged rows of each rule; more decide nothing.

    The limit by number is taken in every partition before rows move.
    """
    keys = F.array(*[F.lit(rule_key(r)) for r in rules])
    amounts = F.array(*[F.lit(r.skip_amount + 1) for r in rules])
    last = Window.partitionBy("__rule").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return (
        rows.where("__rule IS NOT NULL").select("id", "timestamp", "__rule")
        .withColumn("__n", F.row_number().over(last))
        .where(F.col("__n") <= max(r.skip_amount for r in rules) + 1)
        .where(F.col("__n") <= amounts[F.col("__rule")])
        .select("id", "timestamp", keys[F.col("__rule")].alias("rule"))
    )


def verdicts(rows: DataFrame) -> DataFrame:
    """id, rule, at (micros), suppressed of the batch's rows that a rule matches."""
    return rows.where("__rule IS NOT NULL AND NOT __old").select("id", F.col("__rule").alias("rule"), F.unix_micros("timestamp").alias("at"), "suppressed")
