import json

import pytest

from palisade.settings import CONFIG_FILES, DEFAULT_IGNORES, IGNORE_FILES, ScanConfig, load_config


def test_defaults(tmp_path):
    config = load_config(tmp_path)
    assert config.ignore_paths == DEFAULT_IGNORES
    assert config.fail_threshold == "high" and config.min_entropy is None
    assert len(config.rules) == 25


def test_files_are_merged_in_order(tmp_path):
    (tmp_path / CONFIG_FILES[0]).write_text(json.dumps({
        "ignorePaths": ["vendor/**", "dist/**"], "disabledRules": ["AIS-004"],
        "severityOverrides": {"SEC-005": "critical"}, "minEntropy": 3.5, "failThreshold": "critical",
    }))
    (tmp_path / IGNORE_FILES[0]).write_text("# comment\n  *.log \n\nvendor/**\n")
    (tmp_path / IGNORE_FILES[1]).write_text("tmp/\r\n")
    config = load_config(tmp_path)
    assert config.ignore_paths == (*DEFAULT_IGNORES, "vendor/**", "*.log", "tmp/")
    assert config.disabled_rules == ("AIS-004",) and config.min_entropy == 3.5
    assert config.fail_threshold == "critical"
    assert {r.rule_id: r.severity for r in config.rules}["SEC-005"] == "critical"


def test_broken_json_falls_through(tmp_path):
    (tmp_path / CONFIG_FILES[0]).write_text("{broken")
    (tmp_path / CONFIG_FILES[1]).write_text('{"disabledRules": ["MCP-001"], "ignorePaths": "x"}')
    config = load_config(tmp_path)
    assert config.disabled_rules == ("MCP-001",) and config.ignore_paths == DEFAULT_IGNORES


def test_tests_can_be_included():
    config = ScanConfig(ignore_paths=("dist/**", "tests/", "*.spec.ts", "fixtures/**"))
    assert config.including_tests().ignore_paths == ("dist/**",)


def test_unknown_severity_is_an_error():
    with pytest.raises(ValueError):
        ScanConfig(fail_threshold="severe")
    with pytest.raises(ValueError):
        ScanConfig(severity_overrides={"SEC-001": "urgent"})
