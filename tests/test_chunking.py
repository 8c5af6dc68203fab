"""Chunking against brute force on small documents."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from supportlake.functions import markdown as md
from supportlake.operators import chunking


def brute_pack(sentences, limit, overlap):
    chunks = []
    for sentence in sentences:
        if chunks and len(" ".join([*chunks[-1], sentence])) <= limit:
            chunks[-1].append(sentence)
            continue
        tail = []
        if chunks and overlap:
            for size in range(1, len(chunks[-1]) + 1):
                longer = chunks[-1][-size:]
                if size > 1 and len(" ".join(longer)) > overlap:
                    break
                tail = longer
            if len(" ".join([*tail, sentence])) > limit:
                tail = []
        chunks.append([*tail, sentence])
    return [" ".join(c) for c in chunks]


def random_sentences(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abc中 ") for _ in range(rng.randint(1, 14))).strip(" ") + rng.choice(".!?。") for _ in range(rng.randint(1, 30))]


@pytest.mark.parametrize("limit,overlap", [(22, 10), (20, 5), (25, 0), (16, 0), (40, 39), (1, 0)])
def test_packing(spark, limit, overlap):
    cases = [random_sentences(seed) for seed in range(40)]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>")
    got = frame.select("i", md.pack_sentences("s", limit, overlap).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in got] == [brute_pack(c, limit, overlap) for c in cases]


def test_sentences_equal_python_split(spark):
    texts = ["a. b！c。 d", "pi is 3.14 ok?", "", " . ", "no end", "x...y", "一。二\n三！  "]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["o"] for r in frame.select("i", md.split_sentences("t").alias("o")).orderBy("i").collect()]
    assert got == [[p.strip() for p in re.split(r"(?<=[。！？.!?])\s*", t.strip()) if p.strip()] for t in texts]


def test_table_parts_repeat_header_and_keep_rows(spark):
    table = ["| h |", "|---|", *[f"| row {i} |" for i in range(7)]]
    frame = spark.createDataFrame([(table, 0), (table[:2], 1), (["| one |"], 2)], "t array<string>, i int")
    got = [r["o"] for r in frame.select("i", md.split_table("t", 40).alias("o")).orderBy("i").collect()]
    assert all(part.startswith("| h |\n|---|\n") for part in got[0])
    assert [line for part in got[0] for line in part.split("\n")[2:]] == table[2:]
    assert all(len(part) <= 40 or part.count("\n") == 2 for part in got[0])
    assert got[1] == ["| h |\n|---|"] and got[2] == ["| one |"]


DOC = """intro one.
intro two!
# Returns
para a。para b

still a
| h1 | h2 |
|---|---|
| r1 | x |
| r2 | y |

| t2 |
## How to return?  ##
```py
# not a heading
| not a table

```
after
### Deep
#
####### seven
   ~~~
x
```
"""


def segments(spark, text):
    rows = chunking.document_segments(spark.createDataFrame([("a.md", text)], "source string, text string")).orderBy("position").collect()
    return [(r["path"], r["kind"], r["content"]) for r in rows]


def test_segments_of_a_mixed_document(spark):
    deep = ["Returns", "How to return?", "Deep"]
    assert segments(spark, DOC) == [
        ([], "prose", "intro one. intro two!"),
        (["Returns"], "prose", "para a。para b still a"),
        (["Returns"], "table", "| h1 | h2 |\n|---|---|\n| r1 | x |\n| r2 | y |"),
        (["Returns"], "table", "| t2 |"),
        (deep[:2], "code", "```py\n# not a heading\n| not a table\n\n```"),
        (deep[:2], "prose", "after"),
        (deep, "prose", "# ####### seven"),
        (deep, "code", "~~~\nx\n```"),
    ]


def test_heading_levels_may_skip(spark):
    assert [p for p, _, _ in segments(spark, "### C\na\n## B\nb\n# A\nc\n# A\nd")] == [["C"], ["C", "B"], ["A"]]


def test_line_breaks_of_every_kind(spark):
    assert segments(spark, "# H\r\na b\rc") == [(["H"], "prose", "a b c")]


def test_chunk_rows(spark):
    frame = spark.createDataFrame([("a.md", DOC), ("售后.md", "one. two."), ("empty.md", " \n ")], "source string, text string")
    rows = chunking.chunk_documents(frame, 22, 10).orderBy("source", "position").collect()
    own = [r for r in rows if r["source"] == "a.md"]
    assert {r["source"] for r in rows} == {"a.md", "售后.md"}
    assert [r["previous_source_key"] for r in own] == [None, *[r["source_key"] for r in own[:-1]]]
    assert [r["next_source_key"] for r in own] == [*[r["source_key"] for r in own[1:]], None]
    seen = {}
    for r in own:
        path = tuple(r["chapter_path"])
        ordinal = seen.setdefault(path, 0)
        seen[path] += 1
        digest = hashlib.sha256(f"a.md\0{'/'.join(path)}\0{ordinal}".encode()).hexdigest()[:16]
        assert r["source_key"] == f"doc:a.md:{digest}"
    last = own[-1]
    assert last["category"] == "Returns / How to return?" and last["questions"] == ["How to return?"]
    assert own[0]["category"] == md.DEFAULT_CATEGORY and own[0]["questions"] == [md.DEFAULT_QUESTION]
    other = [r for r in rows if r["source"] == "售后.md"]
    assert [r["content_type"] for r in other] == ["after_sales"] and not other[0]["is_critical"]


def test_chunking_does_not_shuffle(spark):
    frame = spark.createDataFrame([("a.md", DOC)], "source string, text string")
    plan = chunking.chunk_documents(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_bad_limits_are_refused(spark):
    frame = spark.createDataFrame([("a.md", DOC)], "source string, text string")
    for limits in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_documents(frame, *limits)


def test_rows_only_queries_match_brute_force(spark, sf):
    from supportlake.plans.catalog import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    packed = {}
    for r in QUERIES["chk_pack_sentences"](spark, sf).orderBy("doc_id", "part_no").collect():
        packed.setdefault(r["doc_id"], []).append(r["part"])
    for doc_id, text in docs.items():
        sentences = [p for p in re.split(r"(?<=[。！？.!?])\s*", text.strip()) if p]
        assert packed.get(doc_id, []) == brute_pack(sentences, 1200, 200)
    total = QUERIES["chk_chunk_documents"](spark, sf).agg(F.count("*"), F.count_distinct("source_key")).first()
    assert total[0] == total[1] > len(docs)


def many_sections(n):
    more = "More text follows now, and it is long enough. " * 12
    return "".join(f"# Part {i % 40}\n\n## Section {i}?\n\nSome words. {more}\n\n| a | b |\n|---|---|\n| {i} | x |\n\nThe end of {i}.\n\n" for i in range(n))


def test_long_document_takes_time_in_proportion(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([("s", many_sections(n))], "source string, text string").repartition(1).persist()
        df.count()
        began = time.perf_counter()
        rows = chunking.chunk_documents(df).agg(F.count("*"), F.max("answer")).first()[0]
        return time.perf_counter() - began, rows

    seconds(60)
    (short, few), (long, many) = seconds(300), seconds(3000)
    assert many == 10 * few and long <= 15 * short  # ten times the text; the rest is noise of a loaded machine


def test_scan_emits_over_many_blocks(spark):
    frame = spark.createDataFrame([([], 0), ([5], 1), (list(range(1, 1200)), 2)], "a array<int>, i int")

    def step(acc, item):
        total = acc["total"] + item
        return {"total": total}, F.when(item % 3 == 0, F.array(total, item)).otherwise(F.array().cast("array<int>"))

    got = {r.i: r.o for r in frame.select("i", md.scan(F.col("a"), {"total": F.lit(0)}, "array<int>", step, width=7).alias("o")).collect()}
    want, total = [], 0
    for x in range(1, 1200):
        total += x
        want += [total, x] if x % 3 == 0 else []
    assert got == {0: [], 1: [], 2: want}
