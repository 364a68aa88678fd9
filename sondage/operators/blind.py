"""Blind filter: JSON texts without what would give an experiment away, and counts of what was taken out."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Keys that are dropped, marks of private content, marks of commands, and the patterns of names.
PRIVATE_KEYS = {
    "scenario_metadata", "injection_summary", "distinguishing_evidence", "golden", "golden.rca.json", "golden.anomaly.json", "case_id", "scenario_id",
}
PRIVATE_MARKS = ("scenario-runs", "scenario_metadata", "injection_summary", "distinguishing_evidence", "golden.rca", "golden.anomaly")
COMMAND_MARKS = ("command=", "sudo ")
RESOURCE = re.compile(r"\b(?:scenario|case)-[a-z0-9][a-z0-9_.-]*", re.I | re.A)
CODE = re.compile(r"\bF[0-9]{2}[-_][A-Z][A-Z0-9]*\b", re.I | re.A)
ACTION = re.compile(r"\b(?:memhog|inject(?:ion)?|cleanup)\b", re.I | re.A)
WITHHELD = "[experiment annotation withheld]"
#: Texts deeper than so many levels are not entered as JSON.
DEPTH = 64

SURROGATES = re.compile("[\ud800-\udfff]")
KIND = StructType().add("clean", "string").add("removed_fields", "long").add("redacted_strings", "long").add("opaque_identifiers", "long")


class _Number(str):
    """A number as it was written, so that no digit is lost."""


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _parsed(text: str) -> object:
    return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)


class _Filter:
    """One text's pass; each part comes back as JSON text, with sorted keys and no white space."""

    def __init__(self) -> None:
        self.removed = self.redacted = self.opaque = 0

    def _pseudonym(self, m: re.Match) -> str:
        self.opaque += 1
        return "opaque-" + hashlib.sha256(m[0].encode()).hexdigest()[:24]

    def text(self, s: str) -> str:
        s = SURROGATES.sub("�", s)
        low = s.lower()
        told = any(m in low for m in COMMAND_MARKS) and any(p.search(s) for p in (CODE, ACTION, RESOURCE))
        if told or any(m in low for m in PRIVATE_MARKS):
            self.redacted += 1
            return WITHHELD
        return CODE.sub(self._pseudonym, RESOURCE.sub(self._pseudonym, s))

    def json(self, v: object, depth: int = 0) -> str:
        if isinstance(v, dict):
            open_ = {k: x for k, x in v.items() if k.lower() not in PRIVATE_KEYS}
            self.removed += len(v) - len(open_)
            parts = {self.text(k): self.json(x, depth + 1) for k, x in open_.items()}
            return "{" + ",".join(f"{_quoted(k)}:{parts[k]}" for k in sorted(parts)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(self.json(x, depth + 1) for x in v) + "]"
        if isinstance(v, _Number):
            return str(v)
        return _quoted(self._entered(v, depth)) if isinstance(v, str) else json.dumps(v)

    def _entered(self, s: str, depth: int) -> str:
        """A text, filtered as the JSON it holds if it holds an object or a list."""
        if depth < DEPTH and s.strip()[:1] in ("{", "["):
            try:
                inner = _parsed(s.strip())
            except ValueError:
                return self.text(s)
            return self.json(inner, depth + 1)
        return self.text(s)


def _quoted(s: str) -> str:
    return json.dumps(s, ensure_ascii=False)


def filtered(text: str | None) -> tuple[str | None, int, int, int]:
    f = _Filter()
    try:
        return (f.json(_parsed(text)) if text is not None else None), f.removed, f.redacted, f.opaque
    except (ValueError, RecursionError):
        return None, 0, 0, 0


@F.pandas_udf(KIND)
def _filtered(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([filtered(t) for t in texts], columns=KIND.names)


def blind_json(c: Column) -> Column:
    """Struct of ``clean`` and three counts for a JSON text.

    Private keys go with all below them, at any depth; texts that hold JSON are entered down to 64 levels; texts that tell of an
    experiment are withheld; names of scenarios and cases become tokens that are equal for equal names. ``clean`` has sorted keys and no
    white space, numbers as they were written; of two keys that become equal the later stays. What is null, no single JSON value, or nested deeper than
    Python's stack is withheld as a whole: ``clean`` is null and the counts are 0.
    """
    return _filtered(c)
