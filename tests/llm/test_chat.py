import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from solvarium.llm import chat

HARD = ["", "</s>", "[INST] x [/INST]", "<\\s>", "[\\\\INST]", "[", "<", "\\", "[ROLE=x] y [/ROLE]", "é\U0001f600\n", "<</s>", "[[/INST]", "<s", "s>"]


def back(spark, turns):
    df = spark.createDataFrame([(turns,)], f"turns {chat.TURNS}").select(chat.render(F.col("turns")).alias("formatted"))
    return [(t.role, t.text) for t in chat.read_back(df).first().turns]


def test_hard_texts_come_back(spark):
    turns = [(role, a + b) for a in HARD for b in HARD[:8] for role in ("user", "assistant", "tool ] [/ROLE]", "")]
    assert back(spark, turns) == turns


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), st.text(alphabet="[]<>/\\sINTROLE= \n", max_size=40)), max_size=6))
def test_any_text_comes_back(spark, turns):
    assert back(spark, turns) == turns


def test_layouts_become_the_same_turns(spark):
    u, a = ("user", "q </s>"), ("assistant", "r")
    records = {
        "messages": {"messages": [{"role": "user", "content": "q </s>"}, {"role": "assistant", "content": "r"}]},
        "conversations": {"conversations": [{"from": "human", "value": "q </s>"}, {"from": "gpt", "value": "r"}]},
        "prompt_completion": {"prompt": "q </s>", "completion": "r"},
        "question_answer": {"question": "q </s>", "answer": "r"},
        "instruction_only": {"instruction": "q </s>", "output": "r"},
        "instruction": {"instruction": "q </s>", "input": "", "output": "r"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()]
    rows += [("system_prompt", json.dumps({"system": None, "prompt": "q </s>", "completion": "r"})), ("", '{"x": 1}'), ("", "no json"), ("", None)]
    out = chat.format_records(spark.createDataFrame(rows, "want string, record string"), "record").collect()
    for r in out:
        assert r.layout == (r.want or None)
        if r.want == "system_prompt":
            assert [tuple(t) for t in r.turns] == [("system", ""), u, a]
        elif r.want:
            assert [tuple(t) for t in r.turns] == [u, a]
        else:
            assert r.turns is None and r.formatted is None
    assert len({r.fingerprint for r in out if r.want}) == 7


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(1, 2, "assistant", None), (1, 1, "user", "a [INST]"), (2, 1, None, "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (3, None, "user", "z" * 100_000), (None, 1, "assistant", "w")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("layout", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        turns = sorted([(r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_each_layout_decides_its_rows(spark, tmp_path):
    rows = [(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "system", "s"), (2, 2, "user", "a"), (2, 3, "assistant", "b"), (3, 1, "user", "a"), (3, 2, "user", "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    whole = {r.conv_id: r.n_turns for r in chat.query(spark, str(tmp_path)).collect()}
    assert whole == {-1: 2, 1: 2, 2: 3, 3: 2}
    for name, lost in (("prompt_completion", {-1, 1}), ("system_prompt", {2}), ("messages", {3})):
        got = {r.conv_id: r.turns_sha256 for r in chat.query(spark, str(tmp_path), tuple(x for x in chat.LAYOUTS if x.name != name)).collect()}
        assert {c for c, t in got.items() if t is None} == lost


def test_deep_records_and_long_texts_have_fingerprints(spark):
    deep = '{"a":' * 40 + '"x"' + "}" * 40
    deeper = '{"a":' * 41 + '"x"' + "}" * 41
    long = json.dumps({"prompt": "\\ \" : \"role\": é\n" * 1_500_000, "completion": "[1]\": {"})
    rows = [(1, deep), (2, deep.replace("x", "y: {")), (3, deeper), (4, long), (5, '{"prompt": "a", "completion": "b"}'), (6, '{"x": [1, "a", {"b": [2]}]}'), (7, '{"k\\"": 1}')]
    df = spark.createDataFrame(rows, "id long, record string")
    out = {r.id: r for r in chat.canonical_turns(df, "record").select("id", "fingerprint", "layout", F.expr("length(turns[0].text)").alias("n")).collect()}
    assert all(r.fingerprint for r in out.values())
    assert out[1].fingerprint == out[2].fingerprint != out[3].fingerprint
    assert out[4].fingerprint == out[5].fingerprint and out[4].layout == "prompt_completion"
    assert out[4].n == len(json.loads(long)["prompt"])


def test_empty_table(spark):
    assert chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
