import hashlib
import threading

import pytest

from millrace.sources import turtle
from millrace.streaming import jobs

TEXT = '''@prefix im: <https://example.org/v1#> . # a comment
@base <https://example.org/> .
im:S1 a im:Sensor ; im:unit "°C"@ko , "A" ; im:limit 4.5 , 7 , 1e3 ; im:on true ;
  im:note """two
lines "quoted" """ .
<x> im:near _:b1 , im:S1 ; im:when "2024-01-01"^^im:date ; im:esc "a\\tb\\u0041" .
'''


def test_parse():
    got = turtle.parse(TEXT)
    im = "https://example.org/v1#"
    assert got[0] == (im + "S1", turtle.TYPE, im + "Sensor", "iri")
    assert [r[2:] for r in got[1:6]] == [("°C", "@ko"), ("A", ""), ("4.5", "decimal"), ("7", "integer"), ("1e3", "double")]
    assert got[6][2:] == ("true", "boolean") and got[7][2:] == ('two\nlines "quoted" ', "")
    assert got[8:] == [("https://example.org/x", im + "near", "_:b1", "blank"), ("https://example.org/x", im + "near", im + "S1", "iri"), ("https://example.org/x", im + "when", "2024-01-01", im + "date"), ("https://example.org/x", im + "esc", "a\tbA", "")]


@pytest.mark.parametrize("bad", ["<a> <b> [ <c> <d> ] .", "<a> <b> ( 1 2 ) .", "x:y <b> <c> .", "<a> <b> <c>", '<a> <b> "open .'])
def test_what_is_not_understood_raises(bad):
    with pytest.raises((ValueError, IndexError)):
        turtle.parse(bad)


def test_files_behind_a_lock(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TEXT)
    (tmp_path / "b.ttl").write_text("<u:s> <u:p> <u:o> .")
    sha = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.glob("*.ttl")}
    rows = turtle.read_turtle(spark, str(tmp_path), sha).collect()
    assert len(rows) == 13 and {r.file for r in rows} == {"a.ttl", "b.ttl"}
    with pytest.raises(Exception, match="b.ttl isn't what was locked"):
        turtle.read_turtle(spark, str(tmp_path), sha | {"b.ttl": "0"}).count()


def test_jobs_run_one_at_a_time_and_end_in_a_state(tmp_path):
    gate, seen = threading.Event(), []

    def run(payload):
        gate.wait(10)
        seen.append(payload["n"])
        if payload["n"] == 2:
            raise RuntimeError("no")
        return {"twice": 2 * payload["n"]}

    def validate(payload):
        if payload["n"] < 0:
            raise ValueError("negative")

    q = jobs.Jobs(str(tmp_path / "q"), validate, run)
    first = q.submit({"n": 1})
    while q.state(first)["state"] != "running":
        pass
    ids = [q.submit({"n": n}) for n in (2, -3, 4)]
    with pytest.raises(jobs.Full):
        q.submit({"n": 5})
    assert len(q.all()) == 4
    gate.set()
    q.close()
    assert seen == [1, 2, 4]
    assert [q.state(i)["state"] for i in (first, *ids)] == ["complete", "failed", "failed", "complete"]
    assert q.state(first)["result"] == {"twice": 2} and q.state(ids[1])["error"] == "ValueError: negative"


def test_unfinished_jobs_are_interrupted(tmp_path):
    (tmp_path / "x.json").write_text('{"id": "x", "state": "running", "payload": {}}')
    (tmp_path / "y.json").write_text('{"id": "y", "state": "complete", "payload": {}}')
    q = jobs.Jobs(str(tmp_path), lambda p: None, lambda p: p)
    assert (q.state("x")["state"], q.state("y")["state"]) == ("interrupted", "complete")
    q.close()
