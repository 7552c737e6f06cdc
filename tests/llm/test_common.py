import time

from quillspark.llm import common


def test_a_model_dropped_while_it_is_built_is_still_returned(monkeypatch):
    def build():
        time.sleep(0.01)
        return "model"

    monkeypatch.setattr(common, "trim", common._resident.clear)  # what the idle thread does, at the worst moment
    assert common.resident("key", build) == "model" and common._resident == {}
    monkeypatch.undo()
    assert common.resident("key", build) == "model" and common.resident("key", lambda: "other") == "model"
    common._resident.clear()
