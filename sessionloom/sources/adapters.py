"""Tables of other shapes as the session model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import Window as W

from sessionloom.plans.model import CALLS, SEAMS, STEPS, TURNS, Model
from sessionloom.sources.transcripts import summarise


def _typed(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema string; those that a source lacks are null."""
    pairs = [x.rsplit(" ", 1) for x in ddl.split(", ")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in pairs])


def of_conversations(conversations: DataFrame) -> Model:
    """Rows (conv_id, turn, role, text): a user row is a turn, an assistant row a step, and a system
    row a seam in front of the next step."""
    spark = conversations.sparkSession
    so_far = W.partitionBy("session").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = (
        conversations.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("at"), "role", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("asked", F.sum((F.col("role") == "user").cast("long")).over(so_far))
        .withColumn("said", F.sum((F.col("role") == "assistant").cast("long")).over(so_far))
    )
    turns = _typed(rows.where("role = 'user'").select("session", (F.col("asked") - 1).alias("turn"), F.col("text").alias("prompt"), F.col("said").alias("first_step")), TURNS)
    steps = _typed(
        rows.where("role = 'assistant'").select("session", (F.col("said") - 1).alias("step"), F.greatest(F.col("asked") - 1, F.lit(0)).alias("turn"), F.lit(0).alias("depth"), F.lit(0).alias("out_tokens"), "text"), STEPS
    )
    marks = rows.where("role = 'system'").select(
        "session",
        (F.row_number().over(W.partitionBy("session").orderBy("at")) - 1).alias("seam"),
        F.col("said").alias("step"),
        F.greatest(F.col("asked") - 1, F.lit(0)).alias("turn"),
        F.lit("auto").alias("trigger"),
        F.length("text").alias("summary_chars"),
        F.lit(True).alias("from_boundary"),
    )
    calls, seams = spark.createDataFrame([], CALLS), _typed(marks, SEAMS).na.fill(0)
    files = rows.select("session").distinct().select("session", F.col("session").alias("path"), F.lit(None).cast("timestamp").alias("modified"), F.lit(False).alias("truncated"), F.lit(0).cast("long").alias("dropped_bytes"))
    kinds = rows.groupBy("session", F.col("role").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return Model(summarise(files, None, turns, steps, calls, seams), turns, steps, calls, seams, kinds)


#: users below the first number share as many sessions as the second says
SHARED_USERS, SHARED_SESSIONS = 100, 25
#: a session whose number leaves this remainder by seven was resumed in another file before this day
FORKED, FORK_DAY = 3, "2024-01-20"
LONG_SEARCH = "grep --line-number --with-filename --ignore-case --extended-regexp pattern f%d.txt --color=never --max-count=100"


def of_events(events: DataFrame) -> Model:
    """Rows (event_id, ts, user_id, event_type, value, props) as sessions of tool calls.

    A user's events are a session's calls (some users share a session), a day's events one step; the
    first twelve steps are one turn, each later step is a turn. Some sessions have a fork, with the
    calls of their first days. view reads a file or a spilled result, in parts or whole; click
    searches or fetches a page; purchase edits, but not in quiet sessions; signup and error are shell
    commands, errors failed ones. The file is named by ``props.k``, result sizes by ``value``.
    """
    spark = events.sparkSession
    by_user = W.partitionBy("session").orderBy("day")
    k = F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')")
    event, kind = F.col("event_id"), F.col("event_type")
    own = F.when(F.col("user_id") < SHARED_USERS, F.col("user_id") % SHARED_SESSIONS).otherwise(F.col("user_id"))
    quiet = F.col("own") % 5 == 4
    forked = (F.col("own") % 7 == FORKED) & (F.col("ts") < F.lit(FORK_DAY).cast("timestamp"))
    rows = (
        events.withColumn("k", k)
        .withColumn("own", own)
        .withColumn("session", F.explode(F.when(forked, F.array(F.col("own").cast("string"), F.concat("own", F.lit("-fork")))).otherwise(F.array(F.col("own").cast("string")))))
        .withColumn("day", F.date_trunc("day", "ts"))
        .withColumn("step", (F.dense_rank().over(by_user) - 1).cast("long"))
        .withColumn("call_no", F.row_number().over(W.partitionBy("session").orderBy("ts", "event_id")).cast("long"))
    )
    file = F.when((kind == "view") & (event % 31 == 0), F.format_string("tool-results/r%d.txt", F.col("k"))).otherwise(F.format_string("src/f%d.txt", F.col("k")))
    fetched = (kind == "click") & (event % 13 == 0)
    shell = kind.isin("signup", "error")
    signup = (
        F.when(event % 4 == 0, F.format_string("app%d --help", F.col("k") % 5))
        .when(event % 4 == 1, F.format_string("strings bin%d | grep p%d", F.col("k") % 2, event % 7))
        .when(event % 8 == 2, F.format_string(LONG_SEARCH, F.col("k")))
        .when(event % 4 == 2, F.format_string("grep x f%d.txt", F.col("k")))
        .when(quiet, "ls -l")
        .when(event % 24 == 7, "git checkout main")
        .otherwise(F.format_string("sed -i s/a/b/ f%d.txt", F.col("k")))
    )
    error = F.concat(F.lit("cat "), file, F.when(event % 5 == 0, " | grep x").otherwise(""))
    part = (kind == "view") & (event % 3 == 0)
    edits = (kind == "purchase") & ~quiet
    path = F.when(shell | fetched, "").otherwise(file)
    command = F.when(kind == "signup", signup).when(kind == "error", error).otherwise("")
    calls = rows.select(
        "session",
        "call_no",
        "step",
        F.greatest(F.lit(0), F.col("step") - 11).alias("turn"),
        F.when(kind == "view", "Read").when(fetched, "WebFetch").when(edits, "Edit").when(shell, "Bash").otherwise("Grep").alias("tool"),
        path.alias("path"),
        command.alias("command"),
        F.when(fetched, F.format_string("https://example.org/%d", F.col("k"))).when(shell, command).otherwise(path).alias("key"),
        F.when(part, event % 27 * 10).alias("line_offset"),
        F.when(part & (event % 15 != 0), F.when(event % 2 == 0, 45).otherwise(20)).alias("line_limit"),
        part.alias("windowed"),
        F.when(edits, event % 500).otherwise(0).alias("written"),
        path.alias("file_path"),
        (kind != "error").alias("ok"),
        (event % 17 == 0).alias("declined"),
        F.floor(F.col("value") * 100).cast("long").alias("result_chars"),
        F.when(event % 29 == 0, F.concat(F.lit("Output too large, saved to: "), file)).otherwise("").alias("result_head"),
        F.when(kind == "error", F.when(event % 3 == 0, F.format_string("permission denied: %s", file)).when(event % 3 == 1, F.format_string("timeout after %d s", event % 10)).otherwise(F.format_string("Error: %s at line %d", file, event % 10)))
        .otherwise("")
        .alias("error_text"),
        F.lit("{}").alias("params"),
        "own",
    )
    grouped = calls.groupBy("session", "step", "turn").agg(F.sum("result_chars").alias("size"), F.max("own").alias("own"))
    calls = _typed(calls, CALLS)
    level = (F.col("step") + F.col("own")) % 4
    effort = F.when(level == 0, "max").when(level == 1, "low").when(level == 2, "high")
    # some sessions carry no token counts, and some a tag that cleaning should have removed
    depth = F.when(F.col("own") % 13 == 5, 0).otherwise(F.col("size"))
    shown = grouped.withColumn("depth", depth)
    steps = _typed(shown.select("session", "step", "turn", F.lit("m1").alias("model"), effort.alias("effort"), "depth", F.lit(0).alias("out_tokens"), F.lit("").alias("text")), STEPS)
    prompt = F.concat(F.lit("task "), "turn", F.when((F.col("own") % 11 == 0) & (F.col("turn") == 5), " <task-notification>").otherwise(""))
    turns = _typed(grouped.groupBy("session", "own", "turn").agg(F.min("step").alias("first_step")).withColumn("prompt", prompt), TURNS)
    # every seventh step opens behind a seam
    seams = shown.where("step % 7 = 6").select(
        "session",
        F.expr("step div 7").alias("seam"),
        "step",
        "turn",
        F.when(F.col("own") % 4 == 1, "manual").when(F.col("own") % 4 == 2, "unknown").otherwise("auto").alias("trigger"),
        (F.col("depth") * 2).alias("pre_tokens"),
        F.lit(0).alias("post_tokens"),
        F.lit(0).alias("cumulative_dropped"),
        F.lit(0).alias("summary_chars"),
        F.lit(0).alias("preserved"),
        F.lit(True).alias("from_boundary"),
    )
    seams = _typed(seams, SEAMS)
    files = rows.groupBy("session").agg(F.max("ts").alias("modified"), F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("started"))
    files = files.select("session", F.col("session").alias("path"), "modified", "started", F.lit(False).alias("truncated"), F.lit(0).cast("long").alias("dropped_bytes"))
    kinds = rows.groupBy("session", F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return Model(summarise(files, None, turns, steps, calls, seams), turns, steps, calls, seams, kinds)
