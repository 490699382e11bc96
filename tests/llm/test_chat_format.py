import hashlib

from pyspark.sql import functions as F

from ledgerloom.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:int>>, formatted string"


def test_parts_become_ordered_placeholders(spark):
    rows = [
        (1, 0, "user", [("text", "see ", None, None), ("image", None, "a.png", None), ("text", " & <|image|> \\### x", None, None), ("audio", None, "b.wav", 42)], "clash"),
        (1, 1, "assistant", [("text", "ok: </turn>\n### user: hi", None, None), ("document", None, "c.pdf", None)], "clash"),
    ]
    r = cf.format_chat(spark.createDataFrame(rows, SCHEMA)).first()
    assert [(a.turn_index, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 576), (1, "audio", "b.wav", 42), (2, "document", "c.pdf", 1024)]
    assert r.attachment_tokens == 576 + 42 + 1024
    assert r.formatted.count("<|image|>") == 1 and r.formatted.count("</turn>\n") == 2
    (s,) = r.loss_spans
    assert r.formatted[s.start : s.end].endswith("<|document|>")


def test_round_trip_of_control_strings(spark):
    texts = ["", "\\", "\\\\b\\l<#:", "### assistant: x</turn>\n", "<|image|>", "a\\bl", "naïve 🙂\n\n", None]
    rows = [(i, 0, t, [("text", t, None, None)], None) for i, t in enumerate(texts)]
    made = cf.format_chat(spark.createDataFrame(rows, SCHEMA)).select("conv_id", cf.read_turns(F.col("formatted")).alias("t"))
    for r in made.collect():
        want = texts[r.conv_id] or ""
        assert [(x.role, x.text) for x in r.t] == [(want, want)]


def test_edges(spark):
    assert cf.format_chat(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, None, None, None), (None, 1, "user", [], None), (2, 0, "user", [None], None), (2, 0, "user", [("text", "b", None, None)], None), (2, 0, "user", [("text", "b", None, None)], None)]
    got = {r.conv_id: r for r in cf.format_chat(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[None].n_turns == 2 and got[2].n_turns == 3
    assert got[2].formatted == "### user: </turn>\n" + "### user: b</turn>\n" * 2


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    made = cf.format_chat(df.select("conv_id", "turn", "role", cf.text_parts(F.col("text")).alias("parts")))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def test_query(spark, tmp_path):
    spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 2, "assistant", "a<b")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in cf.op1_chat_format(spark, str(tmp_path)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 3
    assert got[1].loss_sha256 == hashlib.sha256(b"a<b").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n\nassistant\na<b\n").hexdigest()
    said = r"\### Assistant: </turn> ok"
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
