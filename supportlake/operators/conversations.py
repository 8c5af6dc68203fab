"""Chat messages to question-answer candidates, staging and promotion.

Messages carry ``id`` (unique, increasing inside a conversation),
``conversation_id``, ``role``, ``content``, ``tool_calls`` (JSON list or NULL)
and ``tool_call_id``. Message order is always the id. Per-conversation running
values go through :func:`supportlake.operators.scan.running`, so one very long
conversation is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supportlake.functions import text as tx
from supportlake.operators.scan import dense_numbers, first_per_key, join_per_key, read_once, running

# Limits of an extraction candidate and the preview length.
MAX_CATEGORY = 256
MAX_QUESTIONS = 8
PREVIEW_CHARS = 80


def _is_user() -> Column:
    return F.col("role") == "user"


def has_tool_calls(col: str = "tool_calls") -> Column:
    """True for a non-empty JSON list of calls."""
    return F.coalesce(~F.regexp_replace(F.col(col), r"\s", "").isin("", "[]", "null"), F.lit(False))


def _is_answer() -> Column:
    return (F.col("role") == "assistant") & ~has_tool_calls() & ~tx.is_blank("content")


def pending_conversations(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Conversations with a user message after their cursor (0 where none is stored)."""
    latest = messages.filter(_is_user()).groupBy("conversation_id").agg(F.max("id").alias("latest_user_id"))
    cursor = cursors.select("conversation_id", F.col("last_message_id").alias("cursor"))
    return (
        latest.join(cursor, "conversation_id", "left")
        .withColumn("cursor", F.coalesce("cursor", F.lit(0).cast("bigint")))
        .filter(F.col("latest_user_id") > F.col("cursor"))
    )


def with_turns(messages: DataFrame) -> DataFrame:
    """Add ``turn_start``: id of the user message that opened the row's turn (or NULL)."""
    return running(
        messages, ["conversation_id"], "id",
        {"turn_start": ("max", F.when(_is_user(), F.col("id")))},
    )


def user_turns(messages: DataFrame) -> DataFrame:
    """One row per user message: its answer id (first qualifying one) and the next user id."""
    turns = with_turns(messages).filter(F.col("turn_start").isNotNull())
    answers = turns.groupBy("conversation_id", "turn_start").agg(
        F.min(F.when(_is_answer(), F.col("id"))).alias("assistant_message_id")
    )
    return running(
        answers, ["conversation_id"], "turn_start", {"next_user_id": ("min", F.col("turn_start"))},
        descending=True, inclusive=False,
    ).withColumnRenamed("turn_start", "user_message_id")


def pair_turns(messages: DataFrame) -> DataFrame:
    """User message with the first later answer before the next user message."""
    return with_texts(user_turns(messages).filter(F.col("assistant_message_id").isNotNull()).drop("next_user_id"), messages)


def with_texts(pairs: DataFrame, messages: DataFrame) -> DataFrame:
    """The texts of the paired messages, looked up by their unique ids."""
    texts = messages.select("id", "content")
    users = texts.select(F.col("id").alias("user_message_id"), F.col("content").alias("user_text"))
    answers = texts.select(F.col("id").alias("assistant_message_id"), F.col("content").alias("assistant_text"))
    return pairs.join(users, "user_message_id").join(answers, "assistant_message_id").select(
        "conversation_id", "user_message_id", "assistant_message_id", "user_text", "assistant_text"
    )


def advance_cursor(messages: DataFrame, cursors: DataFrame, limit: int | None = None) -> DataFrame:
    """Next cursor per conversation after reading at most ``limit`` user messages.

    An answered turn moves it to the answer, an unanswered one that is followed
    by another user message to just before that message; a trailing unanswered
    turn stops it. With no user message left it moves to the last message.
    """
    cursor = cursors.select("conversation_id", F.col("last_message_id").alias("cursor"))

    def after_cursor(df: DataFrame, id_col: str) -> DataFrame:
        joined = join_per_key(df, cursor, ["conversation_id"], id_col, "left").withColumn(
            "cursor", F.coalesce("cursor", F.lit(0).cast("bigint"))
        )
        return joined.filter(F.col(id_col) > F.col("cursor"))

    turns = after_cursor(user_turns(messages), "user_message_id")
    if limit is not None:
        turns = running(turns, ["conversation_id"], "user_message_id", {"n": ("sum", F.lit(1))})
        turns = turns.filter(F.col("n") <= limit)
    reach = F.coalesce(F.col("assistant_message_id"), F.col("next_user_id") - 1)
    moved = turns.groupBy("conversation_id").agg(
        F.max(reach).alias("reach"),
        F.count_if(F.col("assistant_message_id").isNotNull()).alias("n_turns"),
    )
    # Without a later user message every remaining row is read over.
    latest = after_cursor(messages, "id").groupBy("conversation_id", "cursor").agg(F.max("id").alias("latest_id"))
    return latest.join(moved, "conversation_id", "left").select(
        "conversation_id", "cursor",
        F.when(F.col("n_turns").isNull(), F.col("latest_id"))
        .otherwise(F.greatest(F.col("reach"), F.col("cursor"))).alias("next_cursor"),
        F.coalesce("n_turns", F.lit(0)).alias("n_turns"),
    )


def budget_batches(pending: DataFrame, n_turns: str, budget: int, order: str = "latest_user_id") -> DataFrame:
    """Share a turn budget over conversations in order; 0 means not read this run."""
    if budget < 1:
        raise ValueError("the turn budget must be positive")
    before = running(pending, [], order, {"turns_before": ("sum", F.col(n_turns))}, inclusive=False)
    left = F.greatest(F.lit(budget) - F.col("turns_before"), F.lit(0))
    return before.withColumn("allowed_turns", F.least(F.col(n_turns), left).cast("bigint"))


def batch_stats(messages: DataFrame, batches: DataFrame) -> DataFrame:
    """Messages read in (cursor, next_cursor] and the tool messages among them."""
    joined = join_per_key(messages, batches.select("conversation_id", "cursor", "next_cursor"), ["conversation_id"], "id")
    inside = joined.filter((F.col("id") > F.col("cursor")) & (F.col("id") <= F.col("next_cursor")))
    return inside.groupBy("conversation_id").agg(
        F.count("*").alias("messages_read"),
        F.count_if((F.col("role") == "tool") | has_tool_calls()).alias("skipped_tool_messages"),
    )


def validate_candidates(candidates: DataFrame, turns: DataFrame) -> DataFrame:
    """Redact candidates, attach their turn, and state what is wrong with each.

    Candidates: batch_id, source_turn_index, category, questions, answer.
    Turns: batch_id, turn_index, user_message_id, assistant_message_id. A batch
    with any violation must not be staged nor move its cursor, so each row also
    carries ``batch_ok``.
    """
    index = turns.select(
        "batch_id", F.col("turn_index").alias("source_turn_index"), "user_message_id", "assistant_message_id"
    )
    joined = candidates.join(index, ["batch_id", "source_turn_index"], "left")
    category, answer = tx.strip("category"), tx.strip("answer")
    questions = F.transform("questions", tx.strip)
    clean = {
        "category": tx.redact_pii(category),
        "questions": F.transform(questions, tx.redact_pii),
        "answer": tx.redact_pii(answer),
    }
    checked = joined.withColumn(
        "violation",
        F.when(F.coalesce(F.col("source_turn_index") < 0, F.lit(True)), "negative_turn_index")
        .when(F.col("user_message_id").isNull(), "turn_outside_batch")
        .when(F.coalesce(~F.length(category).between(1, MAX_CATEGORY), F.lit(True)), "category_length")
        .when(F.coalesce(~F.size("questions").between(1, MAX_QUESTIONS), F.lit(True)), "question_count")
        .when(F.coalesce(F.length(answer) < 1, F.lit(True)), "answer_empty")
        .when(F.exists(questions, lambda q: q == ""), "question_blank"),
    ).withColumns(clean)
    checked = read_once(checked)
    bad = checked.filter(F.col("violation").isNotNull()).select("batch_id").distinct().withColumn("__bad", F.lit(True))
    return checked.join(bad, "batch_id", "left").withColumn("batch_ok", F.col("__bad").isNull()).drop("__bad")


def stage_candidates(candidates: DataFrame, staging: DataFrame) -> DataFrame:
    """New staging rows: one per (fingerprint, source user message), not staged before.

    ``candidates`` needs a unique ``candidate_id``; the lowest one wins.
    """
    keyed = candidates.withColumn("fingerprint", tx.fingerprint("category", "questions", "answer"))
    key = ["fingerprint", "source_user_message_id"]
    unique = first_per_key(keyed, key, "candidate_id")
    return unique.join(staging.select(*key), key, "left_anti")


def promote_staged(staging: DataFrame, chunks: DataFrame) -> DataFrame:
    """Drafts from unpromoted staging rows: lowest id per fingerprint, none on an active chunk."""
    waiting = staging.filter(F.col("promoted_at").isNull())
    known = chunks.filter("is_active").select(F.col("content_hash").alias("fingerprint"))
    fresh = first_per_key(waiting, ["fingerprint"], "id").join(known, "fingerprint", "left_anti")
    return fresh.select(
        F.concat(F.lit("conversation:"), "fingerprint").alias("source_key"),
        "category", "questions", "answer",
        F.array("category").alias("chapter_path"),
        F.lit("conversation_qa").alias("content_type"),
        F.lit(False).alias("is_critical"),
        F.lit(None).cast("string").alias("previous_source_key"),
        F.lit(None).cast("string").alias("next_source_key"),
        F.col("id").alias("draft_order"),
    )


def promotion_counts(staging: DataFrame, chunks: DataFrame) -> DataFrame:
    """(deduped, inserted) of one promotion run."""
    waiting = staging.filter(F.col("promoted_at").isNull()).groupBy("fingerprint").agg(F.count("*").alias("n"))
    known = chunks.filter("is_active").select(F.col("content_hash").alias("fingerprint")).distinct()
    flagged = waiting.join(known.withColumn("known", F.lit(True)), "fingerprint", "left")
    inserted = F.count_if(F.col("known").isNull())
    return flagged.agg((F.coalesce(F.sum("n"), F.lit(0)) - inserted).alias("deduped"), inserted.alias("inserted"))


def mark_promoted(staging: DataFrame, at: Column) -> DataFrame:
    return staging.withColumn("promoted_at", F.coalesce("promoted_at", at))


def exact_dedup(df: DataFrame, text: str, order: str) -> DataFrame:
    """Keep the first row (lowest unique ``order``) of each text fingerprint."""
    keyed = df.withColumn("fingerprint", tx.fingerprint_text(tx.strip(text)))
    return first_per_key(keyed, ["fingerprint"], order)


def conversation_list(conversations: DataFrame, messages: DataFrame, user_id: str | None = None) -> DataFrame:
    """Preview rows of a user's conversations; order by created_at, first_message_id descending."""
    own = conversations if user_id is None else conversations.filter(F.col("user_id") == user_id)
    first = messages.filter(_is_user()).groupBy("conversation_id").agg(F.min("id").alias("first_message_id"))
    text = messages.select(F.col("id").alias("first_message_id"), "content")
    firsts = first.join(text, "first_message_id")
    return own.join(firsts, "conversation_id", "left").select(
        "user_id", "conversation_id", "created_at",
        F.substring(F.coalesce("content", F.lit("")), 1, PREVIEW_CHARS).alias("preview"),
        F.col("summary_upto_msg_id").isNotNull().alias("has_summary"),
        F.coalesce("first_message_id", F.lit(0)).alias("first_message_id"),
    )


def conversation_thread(messages: DataFrame, refunds: DataFrame) -> DataFrame:
    """Visible messages; an offered refund form gets the saved request's state.

    ``actions`` is JSON with an optional ``refund_form`` object that has a
    ``request_id``. A saved request counts only if it names the same message.
    """
    shown = messages.filter(F.col("role").isin("user", "assistant") & F.col("tool_calls").isNull())
    form = F.get_json_object("actions", "$.refund_form.request_id")
    saved = refunds.select(
        F.col("request_id").alias("application_id"), F.col("message_id").alias("id"),
        F.col("conversation_id"), F.col("status").alias("form_status"), F.col("reason").alias("form_reason"),
    )
    keyed = shown.withColumn("form_request_id", form)
    # Messages without a form skip the join, so NULL request ids cannot pile up in one task.
    with_form = keyed.filter(F.col("form_request_id").isNotNull()).join(
        saved.withColumnRenamed("application_id", "form_request_id").withColumn("found", F.lit(True)),
        ["conversation_id", "id", "form_request_id"], "left",
    ).withColumn("application_id", F.when(F.col("found"), F.col("form_request_id"))).drop("found")
    plain = keyed.filter(F.col("form_request_id").isNull())
    return with_form.unionByName(plain, allowMissingColumns=True)


def number_staging(rows: DataFrame, order: str, start: Column) -> DataFrame:
    """Staging ids for new rows, continuing after ``start``."""
    return dense_numbers(rows, order, "id", start)
