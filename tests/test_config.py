from __future__ import annotations

import json

from fleetlens.config import Limits, Settings, limits_frame, load_settings


def test_defaults():
    settings = Settings()
    assert (settings.cycle_seconds, settings.drift_window) == (5, 30)
    assert (settings.gap_seconds, settings.spike_window) == (20, 20)
    temperature = settings.limit("temperature_c")
    assert (temperature.lo, temperature.hi, temperature.baseline) == (-10.0, 60.0, 22.0)
    assert (temperature.spike_sigma, temperature.drift_delta) == (4.0, 3.0)
    assert settings.limit("vibration_mm_s") is not None
    assert settings.limit("unknown") is None
    assert settings.tail_rows == 201


def test_load_json_and_yaml(tmp_path):
    doc = {
        "cycle_seconds": 7,
        "drift_window": 10,
        "gap_seconds": 30,
        "spike_window": 5,
        "thresholds": {
            "m": {"valid_range": [0, 1], "baseline": 0.5, "spike_sigma": 3, "drift_delta": 0.1}
        },
    }
    for name in ("s.json", "s.yaml"):  # JSON is YAML
        path = tmp_path / name
        path.write_text(json.dumps(doc))
        settings = load_settings(path)
        assert settings.cycle_seconds == 7 and settings.gap_seconds == 30.0
        assert settings.limits == (Limits("m", 0.0, 1.0, 0.5, 3.0, 0.1),)


def test_limits_frame(spark):
    rows = limits_frame(spark, Settings().limits).collect()
    assert len(rows) == 8 and {r.metric for r in rows} >= {"co2_ppm", "speed_rpm"}
