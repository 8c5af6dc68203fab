"""Packing long conversations into token budgets.

Turn costs are summed first (map-side combined), and only the per-turn rows go
through running sums, so the work per task is bounded for any conversation.
Messages here carry ``turn_start`` from :func:`turn_groups`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators.conversations import has_tool_calls, with_turns
from supportlake.operators.scan import join_per_key, ordered_lists, running

# Kept answer length, the tool marker and the cut-off notes.
ASSISTANT_CHARS = 60
TOOL_MARKER = ("[工具结果：", "；详细观察保留于完整历史]")
CUT_NOTE = "[工具观察超长，已按输入预算截短；完整结果保留在checkpoint]"
SHORT_CUT_NOTE = "…"
PROMPT_ROLES = {"user": "human", "assistant": "ai"}


def turn_groups(messages: DataFrame) -> DataFrame:
    """Messages with the id of the user message that opens their turn; leading others dropped."""
    return with_turns(messages).filter(F.col("turn_start").isNotNull())


def turn_tokens(turns: DataFrame, ratio: float = 1.0) -> DataFrame:
    return turns.groupBy("conversation_id", "turn_start").agg(
        F.sum(tx.message_tokens("content", "tool_calls", ratio)).alias("tokens")
    )


def _anchored(turns: DataFrame, anchors: DataFrame) -> DataFrame:
    """Turn rows after the summarised part, with the conversation's anchors."""
    meta = anchors.select("conversation_id", "summary_upto_msg_id", "layer1_from_msg_id", "current_id")
    return join_per_key(turns, meta, ["conversation_id"], "turn_start").filter(
        F.col("turn_start") > F.coalesce("summary_upto_msg_id", F.lit(0))
    )


def layer1(turns: DataFrame, anchors: DataFrame, budget: int, ratio: float = 1.0) -> DataFrame:
    """New layer-1 boundary per conversation: newest whole turns that fit the budget.

    Anchors: conversation_id, summary_upto_msg_id, layer1_from_msg_id and
    current_id (the message being answered). The boundary never moves back.
    """
    costs = _anchored(turn_tokens(turns, ratio), anchors)
    eligible = costs.filter(F.col("turn_start") >= F.coalesce("layer1_from_msg_id", F.lit(0)))
    suffix = running(
        eligible, ["conversation_id"], "turn_start", {"suffix_tokens": ("sum", F.col("tokens"))}, descending=True
    )
    fitting = suffix.groupBy("conversation_id").agg(
        F.min(F.when(F.col("suffix_tokens") <= budget, F.col("turn_start"))).alias("start"),
        F.max(F.when(F.col("suffix_tokens") <= budget, F.col("suffix_tokens"))).alias("layer1_tokens"),
    )
    out = anchors.join(fitting, "conversation_id", "left")
    start = F.coalesce("start", "current_id")
    return out.select(
        "conversation_id", "summary_upto_msg_id", "current_id",
        F.col("layer1_from_msg_id").alias("previous_layer1_from"),
        advance_anchor(F.col("layer1_from_msg_id"), start).alias("layer1_from_msg_id"),
        F.coalesce("layer1_tokens", F.lit(0)).alias("layer1_tokens"),
    )


def advance_anchor(old: Column, new: Column) -> Column:
    """Monotone anchor update."""
    return F.greatest(F.coalesce(old, new), new)


def layer2_shorten(turns: DataFrame, bounds: DataFrame, assistant_chars: int = ASSISTANT_CHARS) -> DataFrame:
    """Shortened rows of the turns between the summary and layer 1.

    Questions stay verbatim, plain answers are cut, tool rows give one marker
    per turn placed second. ``position`` orders the rows inside a turn.
    """
    limits = bounds.select("conversation_id", "summary_upto_msg_id", "layer1_from_msg_id")
    old = join_per_key(turns, limits, ["conversation_id"], "id").filter(
        (F.col("turn_start") > F.coalesce("summary_upto_msg_id", F.lit(0)))
        & (F.col("turn_start") < F.col("layer1_from_msg_id"))
    )
    key = ["conversation_id", "turn_start"]
    kept = old.filter(
        (F.col("role") == "user")
        | ((F.col("role") == "assistant") & ~has_tool_calls() & (F.length("content") > 0))
    ).select(
        *key, F.col("id"), "role",
        F.when(F.col("role") == "user", F.col("content"))
        .otherwise(F.substring("content", 1, assistant_chars)).alias("content"),
        F.when(F.col("role") == "user", F.col("id")).otherwise(F.col("id") + 1).alias("position"),
    )
    # By blocks of ids, so that a turn of very many tool rows is gathered by many tasks.
    tools = ordered_lists(old.filter(F.col("role") == "tool"), key, "id", {"calls": F.col("tool_call_id")})
    marker = tools.select(
        *key, F.lit(None).cast("bigint").alias("id"), F.lit("assistant").alias("role"),
        F.concat(
            F.lit(TOOL_MARKER[0]), F.array_join("calls", ", "), F.lit(TOOL_MARKER[1])
        ).alias("content"),
        (F.col("turn_start") + 1).alias("position"),
    )
    return kept.unionByName(marker)


def layer2_overflow(shortened: DataFrame, budget: int, ratio: float = 1.0) -> DataFrame:
    """Conversations whose shortened rows cost more than the layer-2 budget."""
    return (
        shortened.groupBy("conversation_id")
        .agg(F.sum(tx.message_tokens("content", None, ratio)).alias("layer2_tokens"))
        .filter(F.col("layer2_tokens") > budget)
    )


def summary_batch(
    shortened: DataFrame, turns: DataFrame, max_input: int, ratio: float = 1.0
) -> DataFrame:
    """Longest prefix of whole shortened turns whose rendered text fits ``max_input``.

    Rows render as ``role: content`` lines with a line break before each turn
    and between rows. Characters are accumulated and rounded once, as one text.
    ``error`` is set where not even the first turn fits.
    """
    role = F.when(F.col("role") == "user", PROMPT_ROLES["user"]).otherwise(PROMPT_ROLES["assistant"])
    rendered = F.concat(F.lit("\n"), role, F.lit(": "), F.col("content"))
    cjk = tx.cjk_chars(rendered)
    costs = shortened.groupBy("conversation_id", "turn_start").agg(
        F.sum(cjk).alias("cjk"), F.sum(F.length(rendered) - cjk).alias("other")
    )
    upto = turns.groupBy("conversation_id", "turn_start").agg(F.max("id").alias("turn_end"))
    prefix = running(
        costs.join(upto, ["conversation_id", "turn_start"]), ["conversation_id"], "turn_start",
        {"cjk": ("sum", F.col("cjk")), "other": ("sum", F.col("other"))},
    )
    tokens = F.ceil(F.col("cjk") * F.lit(float(ratio)) + F.col("other") / F.lit(4.0)).cast("bigint")
    fits = tokens <= max_input
    return prefix.groupBy("conversation_id").agg(
        F.min(F.when(fits, F.col("turn_start"))).alias("from_msg_id"),
        F.max(F.when(fits, F.col("turn_end"))).alias("upto_msg_id"),
        F.count_if(fits).alias("n_turns"),
        F.max(F.when(fits, tokens)).alias("input_tokens"),
    ).withColumn("error", F.when(F.col("n_turns") == 0, "turn_exceeds_summary_input"))


def pick_summaries(summaries: DataFrame, budget: int, ratio: float = 1.0) -> DataFrame:
    """Newest summary segments that fit, stopping at the first that does not."""
    cost = tx.estimate_tokens("content", ratio) + tx.MESSAGE_OVERHEAD
    suffix = running(
        summaries, ["conversation_id"], "segment", {"suffix_tokens": ("sum", cost)}, descending=True
    )
    return suffix.withColumn("chosen", F.col("suffix_tokens") <= budget)


def summary_texts(picked: DataFrame) -> DataFrame:
    """Joined text of the chosen segments (bounded by the budget) and how many were left out."""
    chosen = F.when(F.col("chosen"), F.struct("segment", "content"))
    return picked.groupBy("conversation_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(chosen)), lambda s: s["content"]), "\n").alias("summary"),
        F.count_if(~F.col("chosen")).alias("omitted"),
    )


def append_summary(batches: DataFrame, anchors: DataFrame, summaries: DataFrame) -> DataFrame:
    """Accepted summary rows: only where the stored boundary is still the batch's own."""
    stored = anchors.select("conversation_id", "summary_upto_msg_id")
    current = batches.join(stored, "conversation_id").filter(
        F.col("summary_upto_msg_id").eqNullSafe(F.col("previous_upto"))
    )
    last = summaries.groupBy("conversation_id").agg(F.max("segment").alias("last_segment"))
    return current.join(last, "conversation_id", "left").select(
        "conversation_id", (F.coalesce("last_segment", F.lit(0)) + 1).cast("bigint").alias("segment"),
        "from_msg_id", "upto_msg_id", "content",
    )


def cap_observation(content: Column | str, budget: int, n_calls: Column | int, ratio: float = 1.0) -> Column:
    """Tool text cut to its share of the budget, with a note that it was cut.

    The text is seen as runs of CJK and other characters; how much of a run
    still fits is plain arithmetic, so no text is rescanned per length tried.
    """
    text = tx._c(content)
    calls = n_calls if isinstance(n_calls, Column) else F.lit(n_calls)
    allowance = F.greatest(F.floor(F.lit(budget) / F.greatest(calls, F.lit(1))), F.lit(1))
    note = F.when(tx.estimate_tokens(F.lit(CUT_NOTE), ratio) > allowance, F.lit(SHORT_CUT_NOTE)).otherwise(F.lit(CUT_NOTE))
    note_cjk = tx.cjk_chars(note)
    room = allowance - note_cjk * F.lit(float(ratio)) - (F.length(note) - note_cjk) / F.lit(4.0)
    # No character costs less than this, so text beyond it cannot fit.
    reachable = F.substring(text, F.lit(1), F.ceil(allowance / F.lit(min(0.25, float(ratio)))).cast("int") + 1)
    runs = F.regexp_extract_all(reachable, F.lit(rf"{tx.CJK}+|[^㐀-鿿]+"), F.lit(0))

    def step(acc: Column, run: Column) -> Column:
        price = F.when(run.rlike(f"^{tx.CJK}"), F.lit(float(ratio))).otherwise(F.lit(0.25))
        fitting = F.greatest(F.floor(acc["room"] / price), F.lit(0)).cast("int")
        taken = F.when(acc["open"], F.least(fitting, F.length(run))).otherwise(F.lit(0))
        return F.struct(
            (acc["room"] - taken * price).alias("room"), (acc["n"] + taken).alias("n"),
            (acc["open"] & (taken == F.length(run))).alias("open"),
        )

    start = F.struct(room.cast("double").alias("room"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    kept = F.aggregate(runs, start, step, lambda acc: acc["n"])
    return F.when(tx.estimate_tokens(text, ratio) > allowance, F.concat(F.substring(text, F.lit(1), kept), note)).otherwise(text)


def context_view(turns: DataFrame, bounds: DataFrame, shortened: DataFrame) -> DataFrame:
    """Prompt rows per conversation: layer-2 rows, then verbatim layer-1 rows, in order."""
    limits = bounds.select("conversation_id", "layer1_from_msg_id")
    recent = join_per_key(turns, limits, ["conversation_id"], "id").filter(F.col("turn_start") >= F.col("layer1_from_msg_id"))
    newer = recent.select(
        "conversation_id", "turn_start", "id", "role", "content", F.col("id").alias("position"), F.lit(1).alias("layer")
    )
    return shortened.withColumn("layer", F.lit(2)).unionByName(newer)


def conversation_context(bounds: DataFrame, view: DataFrame, picked: DataFrame) -> DataFrame:
    """One row per conversation of ``bounds``: rows per layer, the summary text and how many segments it leaves out.

    View: from ``context_view``. Picked: from ``pick_summaries``. Without segments the summary is empty.
    """
    sizes = view.groupBy("conversation_id").agg(
        F.count_if(F.col("layer") == 2).alias("n_layer2"), F.count_if(F.col("layer") == 1).alias("n_layer1")
    )
    known = bounds.select("conversation_id").join(sizes, "conversation_id", "left")
    return known.join(summary_texts(picked), "conversation_id", "left").select(
        "conversation_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_layer2", "n_layer1")],
        F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("omitted", F.lit(0)).cast("bigint").alias("omitted"),
    )


def admission_check(
    df: DataFrame, input_tokens: str, window: int, output: int, safety: int, max_tokens: int, used: str, max_output: int
) -> DataFrame:
    """Whether a request fits the window, and the output tokens it may still use."""
    tokens = F.col(input_tokens)
    left = F.lit(max_tokens) - F.col(used) - tokens
    return df.withColumns({
        "admitted": tokens + output + safety <= window,
        "output_allowance": F.when(left >= 1, F.least(F.lit(max_output), left)).cast("bigint"),
    })
