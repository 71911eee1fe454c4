import json

from pyspark.sql import functions as F

from sondage import cli
from sondage.functions import text
from sondage.operators import calls, decisions
from sondage.sources import audit


def test_guarded_calls(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def model(prompt):
        (asked / str(abs(hash(prompt)))).touch()
        if prompt == "fail":
            raise ConnectionError
        return "We should eliminate all villages." if prompt == "bad" else f"{prompt} is fine"

    rows = [("a", "hello", 0.1, [1]), ("b", "bad", 0.1, None), ("c", "fail", 0.1, None), ("d", "costly", 1e9, None), ("e", None, 0.1, None)]
    df = spark.createDataFrame(rows, "audit_id string, prompt string, estimated_kwh double, `odd name` array<int>").withColumn("completion", F.lit("old"))
    out = {r.audit_id: r for r in calls.guarded(df, model).collect()}
    assert [out[x].decision.code for x in "abcde"] == ["", "POPULATION_HARM", "MODEL_ERROR", "COMPUTE_LIMIT", ""]
    assert out["a"].completion == "hello is fine" and out["c"].model_error == "ConnectionError" and out["d"].completion is None and out["a"]["odd name"] == [1]
    assert len(list(asked.iterdir())) == 4  # the refused prompt was never sent
    assert calls.complete(df.limit(0), model).count() == 0


def test_conversations_and_crosswalks(spark, tmp_path):
    turns = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 1, None, "c"), (2, 2, "user", None)], "conv_id int, turn int, role string, text string")
    got = {r.conversation: (r.prompt, r.turns) for r in text.conversations(turns, "conv_id", "turn", "role", "text").collect()}
    assert got == {1: ("user: a\nassistant: b", 2), 2: ("c\nuser: ", 2)}
    (tmp_path / "x.json").write_text(json.dumps({"external_instrument": "Act", "entries": [{"own_article": "Art. 1", "external_provision": "p", "relationship": "aligned", "verify": True}]}))
    r = audit.crosswalk(spark, str(tmp_path / "x.json"), "own_article").first()
    assert (r.instrument, r.article, r.relationship, r.verify, r.notes) == ("Act", "Art. 1", "aligned", True, None)


def test_check_appends_to_a_trail(spark, tmp_path, monkeypatch):
    monkeypatch.setenv(cli.KEY, "k")
    for _ in range(2):
        assert cli.main(["check", "All is well.", "--audit", str(tmp_path / "t.jsonl")]) == 0
    lines = [json.loads(x) for x in (tmp_path / "t.jsonl").read_text().splitlines()]
    assert len(lines) == 2 and lines[0]["status"] == "APPROVED" and len(lines[0]["prompt_digest"]) == 64 and decisions.LABELS
