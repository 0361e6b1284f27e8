"""A registry of driver-side metrics, and reports of it."""

from __future__ import annotations

import html
import json
import time
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Metrics:
    name: str
    values: dict = field(default_factory=dict)

    def add(self, key: str, value: float = 1) -> None:
        self.values[key] = self.values.get(key, 0) + value

    def set(self, key: str, value) -> None:
        self.values[key] = value

    def set_entry(self, key: str, i: int, value) -> None:
        entries = self.values.setdefault(key, [])
        entries.extend([0] * (i + 1 - len(entries)))
        entries[i] = value

    @contextmanager
    def timed(self, key: str):
        start = time.perf_counter()
        try:
            yield
        finally:
            took = self.values.setdefault(key, {"count": 0, "total": 0.0, "least": float("inf"), "most": 0.0})
            s = time.perf_counter() - start
            took.update(count=took["count"] + 1, total=took["total"] + s, least=min(took["least"], s), most=max(took["most"], s))

    def report(self, kind: str = "console", path: str | None = None) -> None:
        """Hands the values to a reporter: console, file (text), json or html at a path, or null (none)."""
        if kind == "null":
            return
        text = {"console": self.as_text, "file": self.as_text, "json": self.as_json, "html": self.as_html}[kind]()
        if kind == "console":
            print(text)
            return
        with open(path, "w") as out:
            out.write(text)

    def as_text(self) -> str:
        return "\n".join([f"[{self.name}]", *(f"{k} = {v}" for k, v in self.values.items())])

    def as_json(self) -> str:
        return json.dumps({"name": self.name, "values": self.values})

    def as_html(self) -> str:
        cells = "".join(f"<tr><td>{html.escape(str(k))}</td><td>{html.escape(str(v))}</td></tr>" for k, v in self.values.items())
        return f"<h1>{html.escape(self.name)}</h1><table>{cells}</table>"
