"""Who proposes column roles: anything with ask(); a stand-in with set answers, and one that goes by rules. No network is used."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from typing import Protocol


class ProposerError(RuntimeError):
    """A proposer gave no usable answer; code is the service's, if it gave one; wait is how long it asks to wait."""

    def __init__(self, message: str, code: int | None = None, wait: float | None = None):
        super().__init__(message)
        self.code, self.wait = code, wait


class Proposer(Protocol):
    def ask(self, system: str, prompt: str, schema: dict) -> dict: ...


class Mock:
    """Answers from a dict, a list of them in turn, or a function of the prompt; keeps what it was asked."""

    def __init__(self, answer: dict | list | Callable):
        self.answer, self.asked = answer, []

    def ask(self, system: str, prompt: str, schema: dict) -> dict:
        self.asked.append((system, prompt, schema))
        if callable(self.answer):
            return self.answer(prompt)
        return self.answer.pop(0) if isinstance(self.answer, list) else self.answer

    def check(self) -> str:
        return "a stand-in: nothing is sent"


class Falling:
    """Asks models in turn: the next one after an error, and again after a rate limit's wait (three times at most, 35 s each)."""

    def __init__(self, ask_one: Callable[[str, str, str, dict], dict], models: list[str], sleep: Callable[[float], None] = time.sleep, waits: int = 3, most: float = 35.0):
        self.ask_one, self.models, self.sleep, self.waits, self.most = ask_one, models, sleep, waits, most

    def ask(self, system: str, prompt: str, schema: dict) -> dict:
        said = []
        for model in self.models:
            for turn in range(self.waits + 1):
                try:
                    return self.ask_one(model, system, prompt, schema)
                except ProposerError as e:
                    said.append(f"{model}: {e}")
                    if e.code == 429 and turn < self.waits and (e.wait or 1.0) <= self.most:
                        self.sleep(e.wait or 1.0)
                        continue
                    if e.code in (401, 403):
                        raise
                    break
        raise ProposerError("no model answered: " + "; ".join(said))


class ByRules:
    """Proposes from names and kinds in the digest alone: templates are values, unique texts ids, the rest annotations."""

    SAMPLE = re.compile(r"(?i)^(sample|subject|patient|visit|time|batch|plate|group|run|order)")

    def ask(self, system: str, prompt: str, schema: dict) -> dict:
        import json

        d = json.loads(prompt)
        groups = [{"name": t["template"], "columns": [t["template"]], "role": "value", "label": t["template"]} for t in d.get("templates", [])]
        taken = False
        for c in d.get("columns", []):
            role = "feature_annotation"
            if c["kind"] == "empty":
                role = "ignore"
            elif not taken and c["kind"] == "text" and c.get("unique_ratio") == 1.0:
                role, taken = "feature_id", True
            elif self.SAMPLE.match(c["name"]):
                role = "sample_metadata"
            elif c["kind"] == "numeric" and d.get("layout_hint") == "samples_in_columns":
                role = "value"
            groups.append({"name": c["name"], "columns": [c["name"]], "role": role, "label": c["name"]})
        return {"layout": d.get("layout_hint") or "samples_in_columns", "groups": groups}
