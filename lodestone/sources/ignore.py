"""Ignore files in the manner of git: nested files, negation, anchored and directory-only patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass


def _regex(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while i + 1 < len(pattern) and pattern[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


@dataclass(frozen=True)
class Rule:
    base: str  # the folder of the ignore file, "" for the root, else with a slash at its end
    match: re.Pattern
    negated: bool
    folders_only: bool


def parse(text: str, base: str = "") -> list[Rule]:
    rules = []
    for line in text.splitlines():
        if line.endswith(" ") and not line.endswith("\\ "):
            line = line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        if line.startswith(("\\#", "\\!")):
            line = line[1:]
        folders_only = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        body = _regex(line.lstrip("/"))
        rules.append(Rule(base, re.compile(body if anchored else f"(?:.*/)?{body}"), negated, folders_only))
    return rules


def ignored(path: str, rules: list[Rule], is_folder: bool = False) -> bool:
    """Whether a path relative to the root is ignored: the last rule that matches it, or a folder above it, decides; what lies in an ignored folder cannot be taken back."""
    parts = path.split("/")
    for k in range(1, len(parts) + 1):
        here, folder = "/".join(parts[:k]), k < len(parts) or is_folder
        verdict = False
        for r in rules:
            if here.startswith(r.base) and (folder or not r.folders_only) and r.match.fullmatch(here[len(r.base) :]):
                verdict = not r.negated
        if verdict:
            return True
    return False
