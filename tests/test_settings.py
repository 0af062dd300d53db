import datetime as dt
import io
import json
import logging

import pytest

from tidemark.config import Settings, load_settings
from tidemark.log import JsonLines, get_logger
from tidemark.plans import cards


def test_defaults_and_a_batch_of_its_own():
    a, b = load_settings({}), load_settings({})
    assert (a.run_mode, a.environment, a.full) == ("incremental", "local", False)
    assert a.batch_id and a.batch_id != b.batch_id


@pytest.mark.parametrize("name,value", [("run_mode", "full"), ("batch_id", "b7"), ("gold_schema", "au")])
def test_variables_beat_defaults_and_keywords_beat_variables(name, value):
    environ = {f"TIDEMARK_{name.upper()}": value}
    assert getattr(load_settings(environ), name) == value
    given = "incremental" if name == "run_mode" else "other"
    assert getattr(load_settings(environ, **{name: given}), name) == given
    assert getattr(load_settings(environ, **{name: None}), name) == value


@pytest.mark.parametrize("name", ["run_mode", "environment"])
def test_unknown_values_are_refused(name):
    with pytest.raises(ValueError, match=name):
        load_settings({}, **{name: "sometimes"})


def test_unknown_settings_are_refused():
    with pytest.raises(TypeError):
        load_settings({}, nonsense=1)


def test_dates_names_and_paths():
    s = load_settings({"TIDEMARK_AS_OF": "2026-05-01"}, base_path="/lake/", catalog="c")
    assert s.as_of == dt.date(2026, 5, 1)
    assert s.table_name("gold", "t") == "c.gold.t" and Settings().table_name("gold", "t") == "gold.t"
    assert s.table_path("silver", "t") == "/lake/silver/t" and s.quarantine_path("e") == "/lake/silver/_quarantine/e"
    assert s.as_dict()["as_of"] == "2026-05-01"
    with pytest.raises(ValueError):
        s.schema_of("platinum")


def test_log_lines_are_json_with_context():
    out = io.StringIO()
    handler = logging.StreamHandler(out)
    handler.setFormatter(JsonLines())
    log = get_logger("tidemark.test", batch_id="b1")
    log.logger.addHandler(handler)
    log.bind(entity="x").info("done", rows=3)
    try:
        raise KeyError("k")
    except KeyError:
        log.exception("failed")
    first, second = map(json.loads, out.getvalue().splitlines())
    assert (first["message"], first["batch_id"], first["entity"], first["rows"]) == ("done", "b1", "x", 3)
    assert "KeyError" in second["error"]


def test_command_line_leaves_variables_in_force(monkeypatch):
    seen = {}
    monkeypatch.setenv("TIDEMARK_RUN_MODE", "full")
    monkeypatch.setattr(cards, "get_session", lambda: None)
    monkeypatch.setattr(cards, "run", lambda spark, settings, layers: seen.update(settings=settings, layers=layers))
    assert cards.main(["--base-path", "/x", "--layers", "bronze, gold"]) == 0
    assert seen["settings"].full and seen["settings"].base_path == "/x" and seen["layers"] == ["bronze", "gold"]
    monkeypatch.setattr(cards, "run", lambda *a: 1 / 0)
    assert cards.main([]) == 1
