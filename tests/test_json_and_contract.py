"""Free-form JSON redaction against a walk in Python; outbox texts that are not JSON; the empty-output rule; lazy reads."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cuebook.functions.text import redact_text_py
from cuebook.operators.outbox import outbox
from cuebook.operators.protect import redact_json, redact_nested
from cuebook.operators.review import tuning_header
from cuebook.operators.signals import NOTE, check_contract
from cuebook.sources.governed import AuditLog, GovernedSource

STRINGS = ["a@b.co", "call 123-45-6789 now", "4111 1111 1111 1111", "plain", "", 'q"uote\\', "tab\tline\nend x.y@z.org", "é ☃ 🙂 m@n.de", "</s>", "\u0000 n@o.pl"]


def walk(v):
    if isinstance(v, str):
        return redact_text_py(v)
    if isinstance(v, list):
        return [walk(x) for x in v]
    return {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else v


def made(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.45:
        return rng.choice(STRINGS)
    if kind < 0.6:
        return rng.choice([1, 2.5, True, None, 1234567890123456, -0.5])
    if kind < 0.8:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(STRINGS) + str(i): made(rng, depth + 1) for i in range(rng.randint(0, 4))}


def test_json_walk(spark):
    rng = random.Random(5)
    docs = [made(rng) for _ in range(200)]
    texts = [json.dumps(d, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: json.loads(r.t) for r in df.select("i", redact_json(F.col("t")).alias("t")).collect()}
    assert got == {i: walk(d) for i, d in enumerate(docs)}
    typed = df.select("i", F.parse_json("t").alias("v"))
    back = redact_nested(typed).select("i", F.to_json("v").alias("t")).collect()
    assert all(json.loads(r.t) == walk(docs[r.i]) for r in back)


def test_json_layout_and_other_texts(spark):
    texts = ['{ "a@b.co" : 1.50, "k":[ "x" ,  "a@b.co"], "l":2e3 }', "not json a@b.co", None, "", '"a@b.co"', json.dumps("\n\"" * 100_000 + "a@b.co")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.t for r in redact_nested(df, [], json=["t"]).collect()}
    assert got[0] == '{ "a@b.co" : 1.50, "k":[ "x" ,  "[EMAIL]"], "l":2e3 }'
    assert (got[1], got[2], got[3], got[4]) == ("not json [EMAIL]", None, "", '"[EMAIL]"')
    assert json.loads(got[5]) == redact_text_py("\n\"" * 100_000 + "a@b.co")


def test_outbox_survives_texts_that_are_not_json(spark):
    cases = spark.createDataFrame([("b", "r", 0, "t0", '{"x":1}'), ("b", "r", 1, "t1", 'broken {"'), ("b", "r", 2, "t2", None)],
                                  "bot_id string, run_id string, case_index long, target_id string, features string")
    runs = spark.createDataFrame([("b", "r", "completed", "", "s", "also {broken"), ("b", "q", "completed", "", "s", '{"k":2}')],
                                 "bot_id string, run_id string, status string, as_of string, summary string, metadata string")
    got = {r.run_id: json.loads(r.payload) for r in outbox(cases, runs).collect()}
    assert [x["features"] for x in got["r"]["data"]] == [{"x": 1}, 'broken {"', None]
    assert got["r"]["metadata"] == "also {broken" and got["q"]["metadata"] == {"k": 2} and got["q"]["data"] == []


@pytest.mark.parametrize(("summary", "ok"), [(None, False), ("nothing found", False), (f"none ({NOTE})", True)])
def test_empty_output_needs_its_note(spark, summary, ok):
    empty = spark.createDataFrame([], "target_id string, score double, confidence string, note string")
    assert check_contract(empty, summary).first().ok is ok
    one = spark.createDataFrame([("t", 0.5, "medium", NOTE)], empty.schema)
    assert check_contract(one, summary).first().ok is True


def test_tuning_header_by_bot(spark):
    labels = spark.createDataFrame([("a", 0.5, True), ("a", None, False), ("b", 0.1, False)], "bot_id string, score double, accepted boolean")
    got = {r.bot_id: tuple(r)[1:] for r in tuning_header(labels, by=["bot_id"]).collect()}
    assert got == {"a": (2, 1, 1, 1), "b": (1, 0, 1, 0)} and tuple(tuning_header(labels).first()) == (3, 1, 2, 1)


def test_lazy_reads_are_counted_when_they_end(spark, tmp_path):
    audit = AuditLog(spark, str(tmp_path / "audit"))
    src = GovernedSource.open(spark, {"n": spark.range(50)}, audit, count_reads=True)
    df = src.scoped(["n"]).query("SELECT * FROM n WHERE id < 20")
    assert [(r.outcome, r.row_count) for r in audit.entries().collect()] == [("planned", -1)]
    df.filter("id > 5").write.format("noop").mode("overwrite").save()
    assert [(r.outcome, r.row_count) for r in audit.entries().collect()] == [("planned", -1), ("read", 20)]
    df.count()
    assert audit.entries().count() == 2  # one row for a query
