"""Session logs in JSON lines, one file a session, as the relational model.

Files are read whole (a record's place in its file decides turns and steps), split into numbered
lines and parsed into VARIANT; a bad line is counted and passed over. All steps, turns and seams
come from one window over each session's records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window as W

from sessionloom.functions import pytext as P
from sessionloom.plans.model import Model
from sessionloom.session import ensure_checkpoint_dir, present, store_by

READ_CAP = 24 * 1024 * 1024


def plain_path(path: str) -> str:
    """A path without the scheme that Spark puts before it."""
    return path.split(":", 1)[-1].lstrip("/") if ":" in path.split("/", 1)[0] else path.lstrip("/")


def raw_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Spark's binary files, none where a path names none; a file that cannot be read is passed over."""
    if isinstance(path, list):
        path = [p for p in path if present(spark, p)]
    if not path or isinstance(path, str) and not present(spark, path):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").load(path)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Non-empty session files of all projects (``root/projects/*/*.jsonl``), with their folder, age
    and size; logs one level deeper belong to subagents and are not listed. Contents are not read."""
    return raw_files(spark, f"{root}/projects/*/*.jsonl").where("length > 0").select(
        "path",
        F.element_at(F.split("path", "/"), -2).alias("project"),
        F.regexp_replace(P.basename("path"), r"\.jsonl$", "").alias("stem"),
        F.col("modificationTime").alias("modified"),
        F.col("length").alias("bytes"),
    )


def mangled(folder: str) -> str:
    """The name of a working folder's project."""
    return folder.replace("/", "-").replace(".", "-")


def current(files: DataFrame, session_id: str | None = None) -> DataFrame:
    """The newest file, or the one with that stem; an unknown stem falls back to the newest."""
    newest = [F.col("modified").desc(), F.col("path")]
    return files.orderBy(*([(F.col("stem") == session_id).desc()] if session_id else []), *newest).limit(1)


def with_needle(spark: SparkSession, path: str | list[str], needle: str) -> DataFrame:
    """(session, modified) of the files that hold the needle anywhere, also before the part that is read."""
    files = raw_files(spark, path)
    return files.where((F.col("length") > 0) & F.contains("content", F.lit(needle).cast("binary"))).select(F.col("path").alias("session"), F.col("modificationTime").alias("modified"))


def newest_with_needle(spark: SparkSession, path: str, needle: str, limit: int) -> DataFrame:
    """The newest ``limit`` rows of ``with_needle``. Files are looked into from the newest on, four times as
    many each time, until there are so many, so the rest of a large corpus is not read."""
    files = raw_files(spark, path).where("length > 0").select("path", "modificationTime", "length").orderBy(F.col("modificationTime").desc(), "path")
    n, asked = files.count(), 16 * limit
    while True:
        paths = [r["path"] for r in files.limit(asked).select("path").collect()] if asked < n else path
        found = with_needle(spark, paths, needle).orderBy(F.col("modified").desc(), "session").limit(limit).checkpoint()
        if asked >= n or found.count() >= limit:
            return found
        asked *= 4


def first_folder(content: Column) -> Column:
    """The working folder that a log's first record with one names."""
    lines = F.filter(F.split(content, "\n", -1), lambda x: F.contains(x, F.lit('"cwd"')))
    named = F.transform(lines, lambda x: F.call_function("try_variant_get", F.try_parse_json(x), F.lit("$.cwd"), F.lit("string")))
    return F.get(F.filter(named, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))


def of_folder(files: DataFrame, folder: str) -> DataFrame:
    """The rows of ``listing`` that belong to a working folder: those of the project by its name, or, if
    there is none, of the project whose newest log names the folder; one file of each project is read."""
    named = files.where(F.col("project") == mangled(folder))
    if not named.isEmpty():
        return named
    newest = files.groupBy("project").agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))
    paths = [r["path"] for r in newest.select("path").collect()]  # one for each project
    if not paths:
        return named
    spark = files.sparkSession
    found = raw_files(spark, paths).where(first_folder(F.col("content").cast("string")) == folder).orderBy(F.col("modificationTime").desc(), "path").limit(1)
    project = found.select(F.element_at(F.split("path", "/"), -2).alias("project"))
    return files.join(F.broadcast(project), "project", "left_semi")  # one row


def read_files(spark: SparkSession, path: str | list[str], read_cap: int = READ_CAP, empty: bool = False) -> DataFrame:
    """Files with the part that is read: all of a file, or its tail from the first whole line.

    No path, file or line makes this fail. Empty files are left out; with ``empty``, a path under which
    there is nothing to read is a log without records.
    """
    files = raw_files(spark, path).where("length > 0")
    if empty and files.isEmpty():
        files = spark.createDataFrame([(path if isinstance(path, str) else path[0], None, 0, b"")], "path string, modificationTime timestamp, length long, content binary")
    over = F.col("length") > read_cap
    tail = F.substr("content", F.greatest(F.col("length") - read_cap, F.lit(0)) + 1, F.lit(read_cap))
    lost = F.octet_length(F.substring_index(tail.cast("string"), "\n", 1)) + 1
    return files.select(
        F.col("path").alias("session"),
        "path",
        F.col("modificationTime").alias("modified"),
        over.alias("truncated"),
        F.when(over, F.col("length") - read_cap + lost).otherwise(0).cast("long").alias("dropped_bytes"),
        F.make_valid_utf8(F.when(over, F.substr(tail, lost + 1, F.lit(read_cap))).otherwise(F.col("content")).cast("string")).alias("content"),
    )


def _text(path: str, of: str = "v") -> Column:
    return F.expr(f"try_variant_get({of}, '{path}', 'string')")


def _kind(path: str, of: str = "v") -> Column:
    return F.expr(f"schema_of_variant(variant_get({of}, '{path}', 'variant'))")


def _long(path: str, of: str = "v") -> Column:
    return F.coalesce(F.expr(f"try_variant_get({of}, '{path}', 'bigint')"), F.lit(0))


def _true(path: str, of: str = "v") -> Column:
    """Whether a value is there and not empty, false or zero."""
    return ~F.coalesce(_text(path, of), F.lit("")).isin("", "false", "0", "0.0", "[]", "{}")


def _string(path: str, of: str) -> Column:
    """A value only if it is text."""
    return F.when(_kind(path, of) == "STRING", _text(path, of))


def _whole(path: str, of: str) -> Column:
    return F.when(_kind(path, of) == "BIGINT", F.expr(f"try_variant_get({of}, '{path}', 'bigint')"))


def records(files: DataFrame) -> DataFrame:
    """One row for each line that is not blank: its number, parsed value and kind."""
    lines = files.select("session", F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    tidy = P.strip("line")
    # the parser takes text behind a value; a record ends with its brace
    whole = F.when(tidy.rlike(r"[}\]]\z") | ~tidy.startswith("{"), F.try_parse_json(tidy))
    parsed = lines.where(tidy != "").select("session", F.col("n").cast("long"), whole.alias("v"))
    type_ = F.coalesce(_text("$.type"), F.lit("None"))
    shape = F.expr("schema_of_variant(v)")
    kind = (
        F.when(F.col("v").isNull(), "<unparsed>")
        .when(~shape.startswith("OBJECT"), "<not-an-object>")
        .when(type_ == "system", F.concat(F.lit("system/"), F.coalesce(_text("$.subtype"), F.lit("None"))))
        .otherwise(type_)
    )
    return parsed.withColumn("kind", kind)


def _joined_text(blocks: Column, want_type: bool) -> Column:
    def take(b: Column) -> Column:
        return F.coalesce(F.call_function("try_variant_get", b, F.lit("$.text"), F.lit("string")), F.lit(""))

    def is_text(b: Column) -> Column:
        if want_type:
            return F.call_function("try_variant_get", b, F.lit("$.type"), F.lit("string")) == "text"
        return F.call_function("try_variant_get", b, F.lit("$.text"), F.lit("string")).isNotNull()

    return F.array_join(F.transform(F.filter(blocks, is_text), take), "\n")


def parse(files: DataFrame, store: bool = False) -> Model:
    """The model of ``read_files`` (``session``, ``content``, ``truncated``, ``dropped_bytes``).

    With ``store`` the placed records and the tables go to the shared folder: a corpus is parsed
    once, later plans begin at files and stay short, and a lost executor costs no second parse. All
    tables are dealt out by session there, and what is later grouped, joined or put in order by it
    moves no row.
    """
    spark = files.sparkSession
    if store:
        ensure_checkpoint_dir(spark)
    kept = (lambda df: store_by(df, "session")) if store else (lambda df: df)
    every = records(files)
    record_types = kept(every.groupBy("session", "kind").agg(F.count(F.lit(1)).alias("n")))
    good = every.where(~F.col("kind").isin("<unparsed>", "<not-an-object>"))
    stamped = _true("$.timestamp")
    first = F.struct((~stamped).cast("int"), F.when(stamped, F.col("n")).otherwise(-F.col("n")))
    heads = good.groupBy("session").agg(
        F.coalesce(F.min_by(F.when(stamped, _text("$.timestamp")), first), F.lit("")).alias("started"),
        F.coalesce(F.min_by(_text("$.sessionId"), first), F.lit("")).alias("session_id"),
    )
    blocks = F.expr("try_variant_get(v, '$.message.content', 'array<variant>')")
    text = F.when(_kind("$.message.content") == "STRING", _text("$.message.content")).otherwise(F.coalesce(_joined_text(F.col("blocks"), True), F.lit("")))
    has_result = F.coalesce(F.exists("blocks", lambda b: F.call_function("try_variant_get", b, F.lit("$.type"), F.lit("string")) == "tool_result"), F.lit(False))
    main = (
        good.where(~_true("$.isSidechain"))
        .withColumn("type", _text("$.type"))
        .withColumn("blocks", F.when(_kind("$.message.content").startswith("ARRAY"), blocks))
        .withColumn("text", text)
        .withColumn("has_result", has_result)
    )
    depth = _long("$.message.usage.input_tokens") + _long("$.message.usage.cache_creation_input_tokens") + _long("$.message.usage.cache_read_input_tokens")
    group = F.coalesce(P.blank_to_null(_text("$.requestId")), P.blank_to_null(_text("$.message.id")))
    is_user = (F.col("type") == "user") & ~F.col("has_result")
    summary = is_user & _true("$.isCompactSummary")
    prompt = F.when(is_user & ~_true("$.isCompactSummary") & ~_true("$.isMeta"), P.blank_to_null(P.clean("text")))
    flagged = main.select(
        "session",
        "n",
        "v",
        "blocks",
        "text",
        F.coalesce(F.col("type") == "assistant", F.lit(False)).alias("is_step"),
        F.when(F.col("type") == "assistant", group).alias("group"),
        F.when(F.col("type") == "assistant", depth).alias("own_depth"),
        prompt.alias("prompt"),
        F.coalesce(summary, F.lit(False)).alias("is_summary"),
        F.coalesce((F.col("kind") == "system/compact_boundary"), F.lit(False)).alias("is_boundary"),
        F.coalesce((F.col("type") == "user") & F.col("has_result"), F.lit(False)).alias("is_result"),
    )
    in_kind = W.partitionBy("session", "is_step").orderBy("n")
    so_far = W.partitionBy("session").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    opens = F.col("is_step") & (F.col("group").isNull() | ~F.col("group").eqNullSafe(F.lag("group").over(in_kind)))
    placed = (
        flagged.withColumn("opens", opens)
        .withColumn("steps", F.sum(F.col("opens").cast("long")).over(so_far))
        .withColumn("asked", F.sum(F.col("prompt").isNotNull().cast("long")).over(so_far))
        .withColumn("carried", F.last(F.expr("nullif(own_depth, 0)"), ignorenulls=True).over(so_far))
    )
    placed = placed.checkpoint() if store else placed
    merged = F.aggregate(
        F.slice("texts", 2, F.greatest(F.size("texts") - 1, F.lit(0))),
        F.element_at("texts", 1),
        lambda whole, more: F.when(more == "", whole).otherwise(P.strip(F.concat(whole, F.lit("\n"), more))),
    )
    steps = (
        placed.where("is_step")
        .withColumn("model", _text("$.message.model"))
        .groupBy("session", (F.col("steps") - 1).alias("step"))
        .agg(
            F.min_by(F.greatest(F.col("asked") - 1, F.lit(0)), "n").alias("turn"),
            F.min_by("model", F.when(F.col("model").isNotNull(), F.col("n"))).alias("model"),
            F.min_by(_text("$.effort"), "n").alias("effort"),
            F.coalesce(F.min_by("carried", "n"), F.lit(0)).alias("depth"),
            F.min_by(_long("$.message.usage.output_tokens"), "n").alias("out_tokens"),
            F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("texts"),
        )
        .withColumn("text", merged)
        .drop("texts")
    )
    steps = kept(steps)
    turns = placed.where("prompt IS NOT NULL").select("session", (F.col("asked") - 1).alias("turn"), "prompt", F.col("steps").alias("first_step"))
    calls = kept(_calls(placed, steps))
    seams = kept(_seams(placed, steps, turns))
    sessions = summarise(files.select("session", "path", "modified", "truncated", "dropped_bytes"), heads, turns, steps, calls, seams)
    return Model(kept(sessions), kept(turns), steps, calls, seams, record_types)


def _calls(placed: DataFrame, steps: DataFrame) -> DataFrame:
    block_order = (F.col("n") * 100_000 + F.col("at")).alias("order")
    uses = (
        placed.where("is_step")
        .select("session", "n", F.col("steps") - 1, F.posexplode("blocks").alias("at", "b"))
        .toDF("session", "n", "step", "at", "b")
        .where(_text("$.type", "b") == "tool_use")
        .select("session", block_order, "step", F.coalesce(P.blank_to_null(_text("$.id", "b")), F.concat(F.lit("\0"), F.col("n"), F.lit("/"), F.col("at"))).alias("id"), F.col("b"))
    )
    answers = (
        placed.where("is_result")
        .select("session", "n", "v", F.posexplode("blocks").alias("at", "b"))
        .where(_text("$.type", "b") == "tool_result")
        .select("session", block_order, _text("$.tool_use_id", "b").alias("id"), "v", "b")
    )
    body = F.expr("try_variant_get(b, '$.content', 'array<variant>')")
    text = F.when(_kind("$.content", "b") == "STRING", _text("$.content", "b")).when(_kind("$.content", "b").startswith("ARRAY"), _joined_text(body, False))
    failed = _true("$.is_error", "b") | F.left(F.col("text"), F.lit(80)).rlike(P.FAILED_START) | _true("$.toolUseResult.is_error") | _true("$.toolUseResult.interrupted")
    results = answers.withColumn("text", F.coalesce(text, F.lit(""))).withColumn("declined", F.left("text", F.lit(400)).rlike(P.DECLINED))
    results = results.select(
        "session",
        "order",
        "id",
        F.struct(
            F.length("text").cast("long").alias("chars"),
            F.left("text", F.lit(300)).alias("head"),
            "declined",
            (F.col("declined") | ~failed).alias("ok"),
            F.when(~F.col("declined") & failed, F.left("text", F.lit(2000))).otherwise("").alias("error"),
        ).alias("r"),
    )
    # a result belongs to the event just before it under its id, if that is a call
    empty = uses.select("session", "order", "id", F.lit(None).cast(results.schema["r"].dataType).alias("r"))
    events = empty.unionByName(results)
    under_id = W.partitionBy("session", "id").orderBy("order")
    answered = events.withColumn("r", F.lead("r").over(under_id)).join(uses.select("session", "order"), ["session", "order"], "left_semi")
    joined = uses.join(answered.select("session", "order", "r"), ["session", "order"]).join(steps.select("session", "step", "turn"), ["session", "step"])
    fields = {k: _string(f"$.input.{k}", "b") for k in ("file_path", "notebook_path", "path", "pattern", "url", "command", "query")}
    params = F.coalesce(F.when(_kind("$.input", "b").startswith("OBJECT"), F.expr("to_json(variant_get(b, '$.input', 'variant'))")), F.lit("{}"))
    edits = F.expr("try_variant_get(b, '$.input.edits', 'array<variant>')")
    edited = F.aggregate(
        F.coalesce(F.transform(edits, lambda e: F.length(F.when(F.call_function("schema_of_variant", F.call_function("variant_get", e, F.lit("$.new_string"), F.lit("variant"))) == "STRING", F.call_function("try_variant_get", e, F.lit("$.new_string"), F.lit("string"))))), F.array().cast("array<int>")),
        F.lit(0).cast("long"),
        lambda total, x: total + F.coalesce(x, F.lit(0)),
    )
    written = sum((F.coalesce(F.length(_string(f"$.input.{k}", "b")), F.lit(0)) for k in ("content", "new_string", "new_source")), edited)
    return joined.select(
        "session",
        F.col("order").alias("call_no"),
        "step",
        "turn",
        F.coalesce(P.blank_to_null(_text("$.name", "b")), F.lit("?")).alias("tool"),
        F.coalesce(P.blank_to_null(fields["file_path"]), P.blank_to_null(fields["notebook_path"]), P.blank_to_null(fields["path"]), F.lit("")).alias("path"),
        F.coalesce(fields["command"], F.lit("")).alias("command"),
        P.target_key(fields, params).alias("key"),
        _whole("$.input.offset", "b").alias("line_offset"),
        _whole("$.input.limit", "b").alias("line_limit"),
        (_true("$.input.offset", "b") | _true("$.input.limit", "b")).alias("windowed"),
        F.when(F.coalesce(F.col("b").isNotNull(), F.lit(False)), written).otherwise(0).cast("long").alias("written"),
        F.coalesce(fields["file_path"], F.lit("")).alias("file_path"),
        F.col("r.ok").alias("ok"),
        F.coalesce("r.declined", F.lit(False)).alias("declined"),
        F.coalesce("r.chars", F.lit(0)).cast("long").alias("result_chars"),
        F.coalesce("r.head", F.lit("")).alias("result_head"),
        F.coalesce("r.error", F.lit("")).alias("error_text"),
        params.alias("params"),
    )


def _seams(placed: DataFrame, steps: DataFrame, turns: DataFrame) -> DataFrame:
    meta = "$.compactMetadata"
    events = placed.where("is_boundary OR is_summary").select(
        "session",
        "n",
        F.col("steps").alias("step"),
        "is_boundary",
        F.length("text").cast("long").alias("chars"),
        F.when(F.col("is_boundary"), F.coalesce(P.blank_to_null(_text(f"{meta}.trigger")), F.lit("unknown"))).otherwise("unknown").alias("trigger"),
        _long(f"{meta}.preTokens").alias("pre_tokens"),
        _long(f"{meta}.postTokens").alias("post_tokens"),
        _long(f"{meta}.cumulativeDroppedTokens").alias("cumulative_dropped"),
        F.coalesce(F.size(F.expr(f"try_variant_get(v, '{meta}.preservedMessages.uuids', 'array<variant>')")), F.lit(0)).alias("kept"),
    )
    # a summary belongs to its step's first seam; without one it is a seam of its own
    at_step = W.partitionBy("session", "step").orderBy("n")
    rank = F.row_number().over(at_step)
    last_summary = F.last(F.when(~F.col("is_boundary"), F.col("chars")), ignorenulls=True).over(at_step.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    found = events.withColumn("rank", rank).withColumn("summary", last_summary).where("is_boundary OR rank = 1")
    ended = turns.groupBy("session").agg(F.count(F.lit(1)).alias("asked"))
    return (
        found.join(steps.select("session", "step", F.col("turn").alias("step_turn")), ["session", "step"], "left")
        .join(ended, "session", "left")
        .select(
            "session",
            (F.row_number().over(W.partitionBy("session").orderBy("n")) - 1).cast("long").alias("seam"),
            "step",
            F.coalesce("step_turn", F.coalesce("asked", F.lit(0)) - 1).alias("turn"),
            "trigger",
            F.when(F.col("is_boundary"), F.col("pre_tokens")).otherwise(0).cast("long").alias("pre_tokens"),
            F.when(F.col("is_boundary"), F.col("post_tokens")).otherwise(0).cast("long").alias("post_tokens"),
            F.when(F.col("is_boundary"), F.col("cumulative_dropped")).otherwise(0).cast("long").alias("cumulative_dropped"),
            F.when(F.col("rank") == 1, F.coalesce("summary", F.lit(0))).otherwise(0).cast("long").alias("summary_chars"),
            F.greatest("kept", F.lit(0)).cast("long").alias("preserved"),
            F.col("is_boundary").alias("from_boundary"),
        )
    )


def summarise(files: DataFrame, heads: DataFrame | None, turns: DataFrame, steps: DataFrame, calls: DataFrame, seams: DataFrame) -> DataFrame:
    """One row for each session: its file's facts and the counts of its parts."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("session").agg(F.count(F.lit(1)).alias(name))

    by_step = steps.groupBy("session").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max_by("depth", "step").alias("depth"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("step"))).alias("model"),
    )
    out = files if heads is None else files.join(heads, "session", "left")
    out = out.join(by_step, "session", "left").join(counted(turns, "n_turns"), "session", "left")
    out = out.join(counted(calls, "n_calls"), "session", "left").join(counted(seams, "n_seams"), "session", "left")
    return out.na.fill(0, ["n_steps", "n_turns", "n_calls", "n_seams", "depth"])


def load(spark: SparkSession, path: str, read_cap: int = READ_CAP, store: bool = False) -> Model:
    return parse(read_files(spark, path, read_cap), store)
