"""State files of one JSON object, and small rules about errors and addresses."""

import json

import pytest

from cuelake.functions import identity
from cuelake.operators import enrich
from cuelake.sources import states

RECORD = {"path": "/o/a.de.srt", "translation_identity": "t", "output_identity": "o", "sha256": "h"}


def test_keyed_states_keep_what_they_hold(spark, tmp_path):
    whole = {
        "/v/a.mp4": {
            "status": "complete", "stage": "done", "updated_at": "2026-01-01 00:00:00", "error": None,
            "video_identity": {"size": 1 << 40, "mtime_ns": 1_700_000_000_123_456_789, "sample_sha256": "s"},
            "outputs": {"/o/a.de.srt": RECORD, "/o/a.fr.srt": {"path": "x"}}, "output_pending": RECORD,
            "source_attempt": {"path": "p", "stt_identity": "i", "attempt": "n"}, "new_field": [1, {"deep": True}],
        },
        "/v/b.mp4": "a mere string", "/v/c.mp4": {"status": ["of", "another", "type"], "outputs": "none", "stage": "pending"}, "": {},
    }
    for name, text in {"good.json": json.dumps(whole, indent=2), "list.json": "[1]", "broken.json": '{"a": {', "empty.json": "", "text.json": '"x"'}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    found = {r["key"]: r for r in states.read_keyed_states(spark, f"file://{tmp_path}/*.json").collect()}
    assert set(found) == set(whole)
    a = found["/v/a.mp4"]
    assert (a["status"], a["error"], a["video_identity"]["size"], a["video_identity"]["mtime_ns"]) == ("complete", None, 1 << 40, 1_700_000_000_123_456_789)
    assert a["outputs"]["/o/a.de.srt"].asDict() == RECORD and a["outputs"]["/o/a.fr.srt"]["sha256"] is None
    assert a["output_pending"].asDict() == RECORD and a["source_attempt"]["attempt"] == "n" and a["source_pending"] is None
    assert json.loads(a["more"].toJson())["new_field"] == [1, {"deep": True}]
    assert found["/v/b.mp4"]["status"] is None and found["/v/c.mp4"]["status"] == '["of","another","type"]' and found["/v/c.mp4"]["outputs"] is None
    assert found["/v/c.mp4"]["stage"] == "pending" and found[""]["outputs"] is None


def test_waits_asked_for_are_within_bounds():
    assert enrich.wait_seconds("Mon, 01 Jan 99999 00:00:00 GMT", 0.0) is None
    assert enrich.wait_seconds("7", 0.0) == 7.0 and enrich.wait_seconds("Thu, 01 Jan 1970 00:00:30 GMT", 0.0) == 30.0
    assert enrich.wait_seconds("Thu, 01 Jan 1970 02:00:30 GMT", 0.0) == enrich.LONGEST_WAIT and enrich.wait_seconds("3600", 0.0) == enrich.LONGEST_WAIT


def test_the_code_is_that_of_the_innermost_cause():
    try:
        try:
            raise enrich.ProviderError("refused", 401)
        except enrich.ProviderError as inner:
            try:
                raise ValueError("no answer") from inner
            except ValueError as middle:
                raise RuntimeError("batch failed") from middle
    except RuntimeError as error:
        outer = error
    assert enrich.error_code(outer) == 401 and enrich.error_code(ValueError("x")) is None
    loop = ValueError("a")
    loop.__cause__ = KeyError("b")
    loop.__cause__.__cause__ = loop
    assert enrich.error_code(loop) is None


@pytest.mark.parametrize("said, kept", [("https://A.com/v1?", "https://a.com/v1"), ("https://a.com/v1/#", "https://a.com/v1"), ("http://a.com:80?#", "http://a.com")])
def test_empty_queries_and_fragments_are_dropped(said, kept):
    assert identity.normalize_base_url(said) == kept


@pytest.mark.parametrize("said", ["https://a.com/v1?x", "https://a.com/#x", "https://a.com/?#x", "https://u@a.com?"])
def test_other_addresses_are_refused(said):
    with pytest.raises(ValueError):
        identity.normalize_base_url(said)
