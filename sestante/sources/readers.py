"""Small inputs that configure a run: manifest, questions, attacks, prompts, lookups and file lists. All are read on the driver."""

from __future__ import annotations

import json
import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tiers import TIERS
from .files import CONTROL

QUESTION = "id string, question string, tier string, expect string, expected_sources array<string>, expected_answer string, forbidden array<string>, corpus string, source string, notes string"
ATTACK = "id string, category string, tier string, attack string, must_not string, result string, notes string"


def _yaml(path: str):
    try:
        import yaml
    except ModuleNotFoundError as missing:
        raise RuntimeError("reading YAML needs a YAML library") from missing
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """``(filename, tier, lang)`` of ``manifest.yaml``; a missing file raises, and all faulty entries raise in one error."""
    path = f"{root}/manifest.yaml"
    if not os.path.exists(path):
        raise FileNotFoundError(f"{path}: without it no document has a tier, and none is read")
    raw = _yaml(path)
    items = raw.get("documents") if isinstance(raw, dict) else None
    if not isinstance(items, list):
        raise ValueError(f"{path}: a list under 'documents' is expected")
    faults, good = [], {}
    for item in items:
        entry = item if isinstance(item, dict) else {}
        name, tier, lang = (entry.get(k) for k in ("filename", "tier", "lang"))
        checks = (
            (isinstance(item, dict), "is no mapping"), (isinstance(name, str) and bool(name), "has no filename"), (tier in TIERS, f"has tier {tier!r}"),
            (isinstance(lang, str) and re.fullmatch("[a-z]{2}", lang) is not None, f"has language {lang!r}"), (name not in good, "is listed twice"),
        )
        fault = next((why for ok, why in checks if not ok), None)
        if fault:
            faults.append(f"{name if isinstance(name, str) and name else repr(item)} {fault}")
        else:
            good[name] = (name, tier, lang)
    if faults:
        raise ValueError(f"{path}: " + "; ".join(faults))
    return spark.createDataFrame(list(good.values()), "filename string, tier string, lang string")


def _rows(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    raw = _yaml(path) if os.path.exists(path) else []
    items = raw.get(key) if isinstance(raw, dict) else raw
    text = lambda v: v if v is None or isinstance(v, (str, list)) else str(v)
    return spark.createDataFrame([tuple(text(i.get(n)) for n in names) for i in items or []], schema)


def read_questions(spark: SparkSession, path: str, corpus: str = "all") -> DataFrame:
    """Questions of a YAML list (also under ``questions``); a missing file gives none. Those tagged for another corpus than ``corpus`` are left out."""
    rows = _rows(spark, path, "questions", QUESTION)
    return rows if corpus == "all" else rows.where(F.coalesce("corpus", F.lit(corpus)) == corpus)


def read_attacks(spark: SparkSession, path: str) -> DataFrame:
    """Attacks of a YAML list."""
    return _rows(spark, path, "attacks", ATTACK)


def read_traps(spark: SparkSession, path: str) -> DataFrame:
    """Trap questions: those of the ``data`` corpus."""
    return read_questions(spark, path, "data")


def read_prompt(folder: str, name: str, lang: str = "it") -> str:
    """The prompt of a language, or the Italian one."""
    path = Path(folder, f"{name}.{lang}.md")
    return (path if path.exists() else Path(folder, f"{name}.it.md")).read_text(encoding="utf-8")


def without_comments(prompt: str) -> str:
    return re.sub(r"(?s)<!--.*?-->", "", prompt)


def read_lookup(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``(user_id, <value>)`` of a JSON object; a missing, broken or other file is an empty lookup."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        raw = {}
    pairs = [(str(k), None if v is None else str(v)) for k, v in raw.items()] if isinstance(raw, dict) else []
    return spark.createDataFrame(pairs, f"user_id string, {value} string")


def corpus_root(real: str, fallback: str) -> str:
    """The real folder if it holds a document, else the other one."""
    for folder, folders, names in os.walk(real):
        folders[:] = [f for f in folders if not f.startswith(".")]
        if any(not n.startswith(".") and not (os.path.samefile(folder, real) and n in CONTROL) for n in names):
            return real
    return fallback


def git_files(root: str, staged: bool = False) -> list[str]:
    """Staged files, or tracked and new ones that are not ignored; all files of the tree where git does not answer."""
    command = ["git", "-C", root, "diff", "--cached", "--name-only", "--diff-filter=ACM", "-z"] if staged else ["git", "-C", root, "ls-files", "--cached", "--others", "--exclude-standard", "-z"]
    try:
        out = subprocess.run(command, capture_output=True, check=True, timeout=60).stdout
    except (OSError, subprocess.SubprocessError):
        return [] if staged else sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file())
    return sorted(p for p in out.decode("utf-8", "replace").split("\0") if p)
