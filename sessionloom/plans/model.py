"""The relational model that every check reads: sessions, turns, steps, calls and seams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from sessionloom.session import store_by

CALLS = (
    "session string, call_no long, step long, turn long, tool string, path string, command string, key string, "
    "line_offset long, line_limit long, windowed boolean, written long, file_path string, ok boolean, declined boolean, "
    "result_chars long, result_head string, error_text string, params string"
)
STEPS = "session string, step long, turn long, model string, effort string, depth long, out_tokens long, text string"
TURNS = "session string, turn long, prompt string, first_step long"
SEAMS = (
    "session string, seam long, step long, turn long, trigger string, pre_tokens long, post_tokens long, "
    "cumulative_dropped long, summary_chars long, preserved long, from_boundary boolean"
)


@dataclass(frozen=True)
class Model:
    """``sessions`` has one row for each session with its counts; the others hang on ``session``."""

    sessions: DataFrame
    turns: DataFrame
    steps: DataFrame
    calls: DataFrame
    seams: DataFrame
    record_types: DataFrame | None = None

    def cache(self) -> Model:
        """Keep the parsed tables (memory, then disk) when many checks read them."""
        return Model(*[x.cache() if x is not None else None for x in (self.sessions, self.turns, self.steps, self.calls, self.seams, self.record_types)])

    def stored(self) -> Model:
        """The tables in the shared folder, dealt out by session once for all that reads them."""
        return Model(*[store_by(x, "session") if x is not None else None for x in (self.sessions, self.turns, self.steps, self.calls, self.seams, self.record_types)])

    def only(self, sessions: DataFrame) -> Model:
        """The model of some sessions (a table with ``session``)."""
        keep = sessions.select("session").distinct()
        return Model(*[x.join(keep, "session", "left_semi") if x is not None else None for x in (self.sessions, self.turns, self.steps, self.calls, self.seams, self.record_types)])


def replies(model: Model, cap: int) -> DataFrame:
    """``session``, ``turn``, ``reply``: a turn's step texts in order, joined by a space, then cut."""
    said = model.steps.where("text <> ''").groupBy("session", "turn").agg(F.array_sort(F.collect_list(F.struct("step", "text"))).alias("parts"))
    return said.select("session", "turn", F.left(F.array_join(F.col("parts.text"), " "), F.lit(cap)).alias("reply"))


def exchanges(model: Model, cap: int) -> DataFrame:
    """Turns with their reply ("" if none) and the reply before (null for the first turn)."""
    by_session = W.partitionBy("session").orderBy("turn")
    return (
        model.turns.join(replies(model, cap), ["session", "turn"], "left")
        .withColumn("reply", F.coalesce("reply", F.lit("")))
        .withColumn("previous", F.lag("reply").over(by_session))
    )
