import dataclasses
import json

import pytest

from versara.operators import contract
from versara.operators.quality import Expectations, GateError
from versara.plans.errors import RequestError
from versara.plans.publish import Build, Registry, current, publish
from versara.sources.download import DownloadError, download


def test_publish_swaps_whole_generations(spark, tmp_path):
    source = tmp_path / "a.usfm"
    source.write_text("\\id GEN a\n\\c 1\n\\p\n\\v 1 One good day.\n\\v 2 Two.\n", encoding="utf-8")
    known = {"usfm": {"id": 6, "chapter-number": 3, "verse-number": 4}}
    build = Build("t", "eng-t", str(source), Expectations(total=2, books={"GEN": (1, 2)}, dropped=known))
    with pytest.raises(RequestError):
        Registry([build])["zz"]
    with pytest.raises(RequestError):
        build.source(" ")
    first = publish(spark, Registry([build])["t"], str(tmp_path / "out"))
    m, c = current(spark, str(tmp_path / "out"), "t")
    assert m == json.loads(json.dumps(first)) and [(r.bcv, r.sequence) for r in c.verses.orderBy("sequence").collect()] == [("GEN.1.1", 1), ("GEN.1.2", 2)]
    bad = Build("t", "eng-t", str(source), Expectations(total=3, books={"GEN": (1, 3)}, dropped=known))
    with pytest.raises(GateError):
        publish(spark, bad, str(tmp_path / "out"))
    assert current(spark, str(tmp_path / "out"), "t")[0]["generationId"] == first["generationId"]
    source.write_text("\\id GEN a\n\\c 1\n\\p\n\\v 1 One good day!\n\\v 2 Two.\n", encoding="utf-8")
    second = publish(spark, dataclasses.replace(build, searchable=False), str(tmp_path / "out"))
    assert second["generationId"] != first["generationId"] and second["revisionId"] != first["revisionId"]
    assert current(spark, str(tmp_path / "out"), "t")[0]["generationId"] == second["generationId"]


class Server:
    """A source of bytes that breaks off after ``step`` of them."""

    def __init__(self, data, step, ranges=True, length=None):
        self.data, self.step, self.ranges, self.length, self.calls = data, step, ranges, len(data) if length is None else length, 0

    def __call__(self, request):
        server, at = self, int(request.get_header("Range", "bytes=0-")[6:-1])
        server.calls += 1

        class Answer:
            status = 206 if server.ranges else 200
            headers = {"Content-Length": str(server.length)}
            sent = False

            def __enter__(self):
                return self

            def __exit__(self, *_):
                return False

            def read(self, n):
                if self.sent:
                    if at + server.step < len(server.data):
                        raise OSError("broken off")
                    return b""
                self.sent = True
                return server.data[at : at + server.step]

        return Answer()


def test_download(tmp_path):
    data = bytes(range(256)) * 10
    assert download("http://x/y", str(tmp_path / "a"), opener=Server(data, 1000)) == len(data)
    assert (tmp_path / "a").read_bytes() == data
    for name, server in (("b", Server(data, 10)), ("c", Server(data, 1000, ranges=False)), ("d", Server(data, 9999, length=0))):
        with pytest.raises(DownloadError):
            download("http://x/y", str(tmp_path / name), opener=server)


def test_contract(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"type": ["string", "null"], "enum": ["x", None]}, "c": {"type": "array", "items": {"type": "number"}}}}
    assert contract.violations({"a": 1, "b": None, "c": [1.5]}, schema) == []
    assert len(contract.violations({"b": "y", "c": ["z"], "d": 1}, schema)) == 4
    assert contract.violations({"a": True}, schema) and contract.violations([], schema)
    df = spark.createDataFrame([(1, "x")], "a int, timestamp string")
    assert contract.schema_violations(df, {"a": "int", "timestamp": "string"}) == []
    assert len(contract.schema_violations(df, {"a": "bigint"})) == 2
    assert contract.frames('x {"a": "}{\\"", "b": {}} y {"c": 1} {"d"') == ['{"a": "}{\\"", "b": {}}', '{"c": 1}']
    assert contract.snapshot({"q": df}) == '{"q":[{"a":1,"timestamp":"<redacted>"}]}'
    cells = spark.createDataFrame([("s1", "p", "d", "safe", "ok"), ("s2", "p", "d", "unsafe", "no")], "adapter string, probe string, dimension string, verdict string, summary string")
    assert [r.line for r in contract.report(cells).collect()] == ["| probe | s1 | s2 |", "|---|---|---|", "| p | safe: ok | unsafe: no |"]
    samples = spark.createDataFrame([("/a", float(x)) for x in (5, 1, 9, 3)], "path string, cpu_ms double")
    assert tuple(contract.cpu_summary(samples).first()) == ("/a", 4, 5.0, 9.0)
