"""The commands, over one small store."""

import json

import pytest

from riverlog import cli
from riverlog.errors import QuerySyntaxError, TableNotFoundError

from .test_formats import file


def test_commands(spark, tmp_path):
    (tmp_path / "a.mcap").write_bytes(file())

    def run(*argv):
        return list(cli.run(spark, ["--base", f"file://{tmp_path}/store", *argv]))

    assert json.loads(run("import", str(tmp_path / "a.mcap"), "--producer", "robot")[0]) == {"topic-0": 1, "topic-1": 2}
    assert run("databases") == ["db"] and run("topics") == ["topic-0", "topic-1"]
    assert [json.loads(x) for x in run("producers")] == [{"producer": "robot", "topics": ["topic-0", "topic-1"]}]
    lines = [json.loads(x) for x in run("query", "from robot topic-0, topic-1 where topic-0.count = 2024 or topic-1.count = 0;")]
    assert [(x["topic"], round(x["log_time"] * 1e9), x["data"]) for x in lines] == [("topic-0", k, {"data": "hello", "count": 2024}) for k in (10, 20, 30)]
    assert len(run("query", "from robot topic-0;", "--skeleton", "--limit", "2")) == 2
    assert "scan topic-0" in run("query", "explain from robot topic-0;")[0]
    *rows, versions = map(json.loads, run("export", "topic-0", "topic-1=2", "--start", "20"))
    assert [x["log_time"] for x in rows] == [20, 30] and versions == {"versions": {"topic-0": 1, "topic-1": 2}}
    assert len(run("tail", "topic-0", "topic-1", "--polls", "1")) == 6
    stats = [json.loads(x) for x in run("statistics", "topic-0", "count", "mean", "count", "--end", "100")]
    assert [(x["mean"], x["count"]) for x in stats] == [(2024.0, 3)]
    assert any(json.loads(x)["name"] == "messageCount" for x in run("statrange", "topic-0", "--end", "1000"))
    assert {json.loads(x)["field"] for x in run("available", "topic-0")} == {"data", "count"}
    assert {(t["topic"], t["messages"], t["bytes"]) for t in map(json.loads, run("tables"))} == {("topic-0", 3, 33), ("topic-1", 3, 33)}
    run("delete", "robot", "topic-0", "10", "20")
    assert [json.loads(x)["log_time"] for x in run("query", "from robot topic-0;", "--skeleton")] == [20, 30]
    run("truncate", "robot", "topic-0")
    assert run("query", "from robot topic-0;") == []
    with pytest.raises(QuerySyntaxError):
        run("query", "from robot topic-0")
    with pytest.raises(TableNotFoundError):
        run("query", "from robot nothing;")
