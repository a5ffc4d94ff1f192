import copy

import pytest

from spindrift.errors import ConfigurationError, SpecError
from spindrift.settings import filled, reload
from spindrift.spec import Format, Gate, from_file, from_mapping, is_valid, resolve_format

GOOD = {
    "name": "p",
    "version": "1",
    "extract": {"source": "a.csv"},
    "transform": {"prompt": "p.txt"},
    "evaluate": {"evaluators": [{"name": "semantic", "type": "semantic", "threshold": 0.8}]},
    "load": {"destination": "b.csv"},
}


def changed(path, value):
    out = copy.deepcopy(GOOD)
    at = out
    for key in path[:-1]:
        at = at[key]
    at[path[-1]] = value
    return out


def test_defaults():
    spec = from_mapping(GOOD)
    assert (spec.transform.model, spec.transform.temperature, spec.transform.max_tokens, spec.transform.timeout) == ("gpt-4o-mini", 0.7, None, 60.0)
    assert (spec.extract.batch_size, spec.load.mode, spec.evaluate.quality_gate) == (100, "append", Gate.ALL)
    assert spec.evaluate.evaluators[0].weight == 1.0
    with pytest.raises(AttributeError):
        spec.name = "q"


@pytest.mark.parametrize(
    ("path", "value"),
    [
        (("evaluate", "evaluators", 0, "threshold"), 1.5),
        (("evaluate", "evaluators", 0, "weight"), 0),
        (("evaluate", "evaluators"), []),
        (("evaluate", "quality_gate"), "most"),
        (("evaluate", "batch_threshold"), -0.1),
        (("extract", "batch_size"), 0),
        (("extract", "batch_size"), 1.5),
        (("transform", "temperature"), 2.1),
        (("transform", "timeout"), "soon"),
        (("load", "destination"), 7),
        (("load",), None),
    ],
)
def test_out_of_bounds(path, value):
    with pytest.raises(SpecError):
        from_mapping(changed(path, value))


@pytest.mark.parametrize("missing", ["name", "version", "extract", "transform", "evaluate", "load"])
def test_missing(missing):
    given = {k: v for k, v in GOOD.items() if k != missing}
    with pytest.raises(SpecError, match=missing):
        from_mapping(given)


def test_unknown_keys_are_left_out():
    assert from_mapping({**GOOD, "colour": "red"}).name == "p"


def test_files(tmp_path):
    import yaml

    good = tmp_path / "good.yaml"
    good.write_text(yaml.safe_dump(GOOD))
    assert is_valid(good) and from_file(good) == from_mapping(GOOD)
    for name, text in (("bad.yaml", "a: [1"), ("empty.yaml", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ConfigurationError):
            from_file(tmp_path / name)
        assert is_valid(tmp_path / name) is False
    assert is_valid(tmp_path / "none.yaml") is False
    with pytest.raises(ConfigurationError):
        from_file(tmp_path / "none.yaml")


def test_formats():
    assert resolve_format(None, "x/A.JSONL", "source") == Format.JSONL
    assert resolve_format("csv", "x", "source") == Format.CSV
    with pytest.raises(ConfigurationError, match="Cannot determine source type"):
        resolve_format(None, "x.txt", "source")


def test_settings(monkeypatch):
    assert filled({"a": "${KEY}", "b": ["${p:KEY}", "x ${KEY}"]}, {"KEY": "1", "p:KEY": "2"}) == {"a": "1", "b": ["2", "x ${KEY}"]}
    with pytest.raises(ConfigurationError):
        filled("${NONE}", {})
    monkeypatch.setenv("SPINDRIFT_MAX_CONCURRENT_RECORDS", "3")
    assert reload().max_concurrent_records == 3
    monkeypatch.delenv("SPINDRIFT_MAX_CONCURRENT_RECORDS")
    assert reload().max_concurrent_records == 10


def test_cli(tmp_path, capsys):
    import yaml

    from spindrift.cli import main

    (tmp_path / "p.yaml").write_text(yaml.safe_dump(GOOD))
    assert main(["validate", str(tmp_path / "p.yaml")]) == 0
    assert "1 evaluators" in capsys.readouterr().out
    assert main(["validate", str(tmp_path / "q.yaml")]) == 1
    assert main(["list", str(tmp_path)]) == 0
    assert main(["version"]) == 0
