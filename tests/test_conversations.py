"""Chat extraction and context packing, including conversations longer than a block."""

import random

import pytest
from pyspark.sql import functions as F

from supportlake.operators import context as cx
from supportlake.operators import conversations as cv
from supportlake.operators import scan

MESSAGES = "id long, conversation_id string, role string, content string, tool_calls string, tool_call_id string"


def messages(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:6] if len(r) == 4 else r for r in rows], MESSAGES)


def test_running_aggregates_cross_blocks(spark):
    rng = random.Random(3)
    rows = [(k, i * rng.randint(1, 3) + 10_000 * i, rng.randint(-5, 5)) for k in "ab" for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, o long, v long")
    for descending in (False, True):
        for inclusive in (False, True):
            out = scan.running(
                frame, ["k"], "o", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("min", F.col("v"))},
                descending=descending, inclusive=inclusive, bits=14,
            ).collect()
            assert len(out) == len(rows)
            for r in out:
                same_key = [(o, v) for k, o, v in rows if k == r["k"]]
                before = [v for o, v in same_key if (o > r["o"] if descending else o < r["o"]) or (inclusive and o == r["o"])]
                assert r["s"] == sum(before)
                assert r["m"] == (max(before) if before else None) and r["n"] == (min(before) if before else None)


def test_global_numbering_over_levels(spark):
    frame = spark.createDataFrame([(i * 1_000_003,) for i in range(300)], "o long").repartition(5)
    out = scan.running(frame, [], "o", {"n": ("sum", F.lit(1))}, bits=6, levels=4).orderBy("o").collect()
    assert [r["n"] for r in out] == list(range(1, 301))
    dense = scan.dense_numbers(frame, "o", "n", F.lit(10)).orderBy("o").collect()
    assert [r["n"] for r in dense] == list(range(11, 311))


def test_first_answer_wins_and_tools_are_skipped(spark):
    rows = [
        (1, "c", "assistant", "hello", None, None), (2, "c", "user", "q1", None, None), (3, "c", "assistant", "", '[{"n":1}]', None),
        (4, "c", "tool", "data", None, "t1"), (5, "c", "assistant", "  ", None, None), (6, "c", "assistant", "a1", None, None),
        (7, "c", "assistant", "again", None, None), (8, "c", "user", "q2", None, None), (9, "c", "user", "q3", None, None),
        (10, "c", "assistant", "a3", "[]", None), (11, "c", "user", "q4", None, None), (12, "d", "user", "x", None, None),
    ]
    frame = messages(spark, rows)
    pairs = {(r["user_message_id"], r["assistant_message_id"]) for r in cv.pair_turns(frame).collect()}
    assert pairs == {(2, 6), (9, 10)}
    none = spark.createDataFrame([], "conversation_id string, last_message_id long")
    moved = {r["conversation_id"]: (r["next_cursor"], r["n_turns"]) for r in cv.advance_cursor(frame, none).collect()}
    assert moved == {"c": (10, 2), "d": (0, 0)}
    limited = {r["conversation_id"]: r["next_cursor"] for r in cv.advance_cursor(frame, none, limit=2).collect()}
    assert limited["c"] == 8  # second user message is unanswered: just before the third
    past = spark.createDataFrame([("c", 11), ("d", 12)], "conversation_id string, last_message_id long")
    assert cv.pending_conversations(frame, past).count() == 0
    tail = spark.createDataFrame([("c", 8)], "conversation_id string, last_message_id long")
    stats = cv.batch_stats(frame, cv.advance_cursor(frame.filter("id <= 10"), none)).collect()
    assert {(r["conversation_id"], r["messages_read"], r["skipped_tool_messages"]) for r in stats} == {("c", 10, 2)}
    assert cv.pending_conversations(frame, tail).filter("conversation_id = 'c'").first()["cursor"] == 8


def test_cursor_without_user_moves_to_the_end(spark):
    frame = messages(spark, [(1, "c", "user", "q"), (2, "c", "assistant", "a"), (3, "c", "tool", "x"), (4, "c", "assistant", "b")])
    cursor = spark.createDataFrame([("c", 2)], "conversation_id string, last_message_id long")
    row = cv.advance_cursor(frame, cursor).first()
    assert (row["next_cursor"], row["n_turns"]) == (4, 0)


def test_budget_is_shared_in_order(spark):
    frame = spark.createDataFrame([("a", 5, 3), ("b", 9, 4), ("c", 100_000_000_000, 2)], "conversation_id string, latest_user_id long, n long")
    out = {r["conversation_id"]: r["allowed_turns"] for r in cv.budget_batches(frame, "n", 5).collect()}
    assert out == {"a": 3, "b": 2, "c": 0}
    with pytest.raises(ValueError):
        cv.budget_batches(frame, "n", 0)


def test_candidates_are_redacted_and_bad_ones_fail_their_batch(spark):
    turns = spark.createDataFrame([("b1", 0, 10, 11), ("b2", 0, 20, 21)], "batch_id string, turn_index long, user_message_id long, assistant_message_id long")
    rows = [
        ("b1", 0, " c ", [" call 13812345678 "], " x@y.zz "), ("b2", 0, "c", ["q"], "a"), ("b2", 1, "c", ["q"], "a"),
        ("b3", -1, "c", ["q"], "a"), ("b4", 0, "x" * 257, ["q"], "a"),
    ]
    frame = spark.createDataFrame(rows, "batch_id string, source_turn_index long, category string, questions array<string>, answer string")
    out = {(r["batch_id"], r["source_turn_index"]): r for r in cv.validate_candidates(frame, turns).collect()}
    good = out[("b1", 0)]
    assert good["batch_ok"] and (good["category"], good["questions"], good["answer"]) == ("c", ["call [PHONE]"], "[EMAIL]")
    assert out[("b2", 1)]["violation"] == "turn_outside_batch" and not out[("b2", 0)]["batch_ok"]
    assert out[("b3", -1)]["violation"] == "negative_turn_index"
    assert out[("b4", 0)]["violation"] in ("turn_outside_batch", "category_length")


def brute_layers(turns, upto, old, current, budget):
    later = [t for t in turns if t[0] > (upto or 0)]
    eligible = [t for t in later if t[0] >= (old or 0)]
    start, used = current, 0
    for first, cost in reversed(eligible):
        used += cost
        if used > budget:
            break
        start = first
    return max(start, old or start)


def test_layer1_keeps_newest_whole_turns(spark):
    rng = random.Random(5)
    rows, anchors, wanted = [], [], {}
    for c in range(12):
        name, mid, turns = f"c{c}", 0, []
        for _ in range(rng.randint(0, 9)):
            mid += 1
            first, cost = mid, 0
            for role in ["user", *rng.choices(["assistant", "tool"], k=rng.randint(0, 3))]:
                text = "x" * rng.randint(1, 60)
                rows.append((mid, name, role, text, None, None))
                cost += -(-len(text) // 4) + 6
                mid += 1
            turns.append((first, cost))
        upto, old = rng.choice([None, 2]), rng.choice([None, 5])
        anchors.append((name, upto, old, 10_000))
        wanted[name] = brute_layers(turns, upto, old, 10_000, 60)
    bounds = spark.createDataFrame(anchors, "conversation_id string, summary_upto_msg_id long, layer1_from_msg_id long, current_id long")
    out = cx.layer1(cx.turn_groups(messages(spark, rows)), bounds, 60).collect()
    assert {r["conversation_id"]: r["layer1_from_msg_id"] for r in out} == wanted


def test_shortening_places_one_tool_marker_second(spark):
    rows = [
        (1, "c", "user", "u" * 90, None, None), (2, "c", "assistant", "", '[{"id":"t1"}]', None), (3, "c", "tool", "big", None, "t1"),
        (4, "c", "tool", "big", None, "t2"), (5, "c", "assistant", "a" * 90, None, None), (6, "c", "user", "next", None, None),
    ]
    bounds = spark.createDataFrame([("c", None, 6)], "conversation_id string, summary_upto_msg_id long, layer1_from_msg_id long")
    turns = cx.turn_groups(messages(spark, rows))
    short = cx.layer2_shorten(turns, bounds)
    out = short.orderBy("turn_start", "position").collect()
    assert [r["content"] for r in out] == ["u" * 90, "[工具结果：t1, t2；详细观察保留于完整历史]", "a" * 60]
    view = cx.context_view(turns, bounds, short).orderBy("turn_start", "position").collect()
    assert [(r["layer"], r["id"]) for r in view] == [(2, 1), (2, None), (2, 5), (1, 6)]
    over = cx.layer2_overflow(short, 40).first()
    marker = out[1]["content"]
    cjk = sum("㐀" <= ch <= "鿿" for ch in marker)
    assert over["layer2_tokens"] == (23 + 6) + (-(-(4 * cjk + len(marker) - cjk) // 4) + 6) + (15 + 6)


def test_summary_batch_counts_one_text(spark):
    rows = [(i, "c", "user" if i % 2 else "assistant", "abcde") for i in range(1, 9)]
    bounds = spark.createDataFrame([("c", None, 100)], "conversation_id string, summary_upto_msg_id long, layer1_from_msg_id long")
    turns = cx.turn_groups(messages(spark, rows))
    short = cx.layer2_shorten(turns, bounds)
    per_turn = len("\nhuman: abcde") + len("\nai: abcde")
    fits_two = -(-2 * per_turn // 4)
    row = cx.summary_batch(short, turns, fits_two).first()
    assert (row["from_msg_id"], row["upto_msg_id"], row["n_turns"], row["input_tokens"], row["error"]) == (1, 4, 2, fits_two, None)
    assert cx.summary_batch(short, turns, 3).first()["error"] == "turn_exceeds_summary_input"


def test_summaries_stop_at_the_first_miss(spark):
    rows = [("c", 1, "x" * 4), ("c", 2, "y" * 400), ("c", 3, "z" * 4), ("c", 4, "w" * 8)]
    frame = spark.createDataFrame(rows, "conversation_id string, segment long, content string")
    out = cx.summary_texts(cx.pick_summaries(frame, 20)).first()
    assert (out["summary"], out["omitted"]) == ("zzzz\nwwwwwwww", 2)


def test_append_summary_compares_null_anchors(spark):
    anchors = spark.createDataFrame([("a", None), ("b", 5), ("c", None)], "conversation_id string, summary_upto_msg_id long")
    batches = spark.createDataFrame(
        [("a", None, 1, 9, "t"), ("b", 4, 1, 9, "t"), ("c", 3, 1, 9, "t")],
        "conversation_id string, previous_upto long, from_msg_id long, upto_msg_id long, content string",
    )
    summaries = spark.createDataFrame([("a", 3)], "conversation_id string, segment long")
    assert [(r["conversation_id"], r["segment"]) for r in cx.append_summary(batches, anchors, summaries).collect()] == [("a", 4)]


@pytest.mark.parametrize("ratio", [1.0, 0.5])
def test_capped_observation_is_the_longest_that_fits(spark, ratio):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab中文 ") for _ in range(rng.randint(0, 300))) for _ in range(60)]

    def tokens(text):
        cjk = sum("㐀" <= ch <= "鿿" for ch in text)
        return -(-(cjk * ratio * 4 + len(text) - cjk) // 4)

    for budget, calls in ((100, 2), (60, 1), (9, 3)):
        allowance = max(1, budget // calls)
        note = cx.CUT_NOTE if tokens(cx.CUT_NOTE) <= allowance else cx.SHORT_CUT_NOTE
        frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = [r["o"] for r in frame.select("i", cx.cap_observation("t", budget, calls, ratio).alias("o")).orderBy("i").collect()]
        for text, out in zip(texts, got):
            if tokens(text) <= allowance:
                assert out == text
                continue
            best = max([n for n in range(len(text) + 1) if tokens(text[:n] + note) <= allowance], default=0)
            assert out == text[:best] + note


def test_admission(spark):
    frame = spark.createDataFrame([(100, 0), (800, 300), (700, 400)], "t long, u long")
    out = cx.admission_check(frame, "t", 1000, 200, 50, 1200, "u", 512).orderBy("t").collect()
    assert [(r["admitted"], r["output_allowance"]) for r in out] == [(True, 512), (True, 100), (False, 100)]


def test_thread_shows_saved_refund_only_for_its_message(spark):
    schema = "id long, conversation_id string, role string, content string, tool_calls string, actions string"
    form = '{"refund_form":{"request_id":"r1","order_id":"o"}}'
    frame = spark.createDataFrame([(1, "c", "user", "q", None, None), (2, "c", "assistant", "a", None, form), (3, "c", "assistant", "b", "[]", None), (4, "c", "tool", "t", None, None)], schema)
    saved = "request_id string, conversation_id string, message_id long, status string, reason string"
    hit = spark.createDataFrame([("r1", "c", 2, "recorded", "其他")], saved)
    miss = spark.createDataFrame([("r1", "c", 9, "recorded", "其他")], saved)
    rows = {r["id"]: r for r in cv.conversation_thread(frame, hit).collect()}
    assert set(rows) == {1, 2} and rows[2]["form_status"] == "recorded" and rows[2]["application_id"] == "r1"
    assert {r["id"]: r["application_id"] for r in cv.conversation_thread(frame, miss).collect()} == {1: None, 2: None}
