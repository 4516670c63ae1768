"""Prompt-injection scan and secret redaction of text columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.text import once

# Code points that do not show.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2800, 0x3164, 0xFEFF, 0xFFA0]
# Letters that look like Latin ones (small and capital), and three signs.
LOOKALIKES = {"a": "аАαΑ", "b": "вВ", "c": "сС", "e": "еЕεΕ", "h": "нН", "i": "іІιΙ", "j": "јЈ", "k": "κΚ", "m": "мМ", "n": "Ν", "o": "оОοΟ", "p": "рРρΡ", "s": "ѕЅ", "t": "тТτΤ", "u": "υΥ", "v": "ν", "x": "хХ", "y": "уУ"}
SIGNS = {"d": "∂", "p": "∏", "s": "∑"}
# Line prefixes that assign a role; each hit counts ROLE_WEIGHT.
ROLES = ["system:", "assistant:", "user:", "human:", "<|system|>", "<|assistant|>", "<|user|>", "<|im_start|>", "<|im_end|>", "[system]", "[inst]", "[/inst]", "<<sys>>", "<</sys>>", "### system", "### assistant", "### instruction", "<s>", "</s>", "[begin]"]
ROLE_WEIGHT = 80
# Phrases in the order in which they are reported, each with its weight in hundredths.
STRONG = [
    ("ignore previous instructions", 90), ("ignore all instructions", 90), ("ignore all previous", 80), ("ignore the above", 70),
    ("ignore everything above", 80), ("disregard previous instructions", 90), ("disregard all instructions", 90), ("disregard the above", 70),
    ("forget your instructions", 90), ("forget everything above", 80), ("forget all previous", 80), ("override your instructions", 90),
    ("bypass your instructions", 90), ("bypass all safety", 95), ("bypass all restrictions", 95), ("jailbreak", 70), ("do anything now", 80),
    ("developer mode", 60), ("god mode", 70),
]
MEDIUM = [
    ("new instructions:", 60), ("updated instructions:", 60), ("revised instructions:", 60), ("you are now", 50), ("you must now", 50),
    ("act as if", 40), ("pretend you are", 50), ("from now on you", 50), ("do not follow your", 60), ("do not follow the", 50),
    ("instead of answering", 50), ("instead of following", 50), ("your new role is", 60), ("your new task is", 50), ("respond as", 40),
    ("answer as", 40), ("behave as", 40), ("simulate being", 50), ("roleplay as", 40), ("act like", 40), ("you will now", 50), ("you shall now", 50),
    ("starting now", 30), ("effective immediately", 40),
]
WEAK = [
    ("previous message", 20), ("above message", 20), ("ignore that", 20), ("never mind", 10), ("scratch that", 10),
]
PHRASES = STRONG + MEDIUM + WEAK
THRESHOLD = 0.5
_CLASS = "".join(f"\\x{{{c:X}}}" for c in INVISIBLE)
INVISIBLE_PATTERN = rf"[{_CLASS}\x00-\x08\x0B-\x1F\x7F-\x9F]"
LOOKALIKE_PATTERN = "[" + "".join(LOOKALIKES.values()) + "]"
#: A role marker after blanks at a line's start; what role_hits counts is among what this finds.
_ROLE_PATTERN = r"(?m)^\s*(?:" + "|".join("".join(f"\\{c}" if c in "|[]" else c for c in r) for r in ROLES) + ")"
_FROM = "".join(LOOKALIKES.values()) + "".join(SIGNS.values())
_TO = "".join(k * len(v) for k, v in LOOKALIKES.items()) + "".join(SIGNS)


def invisible_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(INVISIBLE_PATTERN))


def lookalike_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LOOKALIKE_PATTERN))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalized(text: Column, composed: bool = True) -> Column:
    """Compatibility form, without control and invisible characters, lookalikes mapped, lower case.

    ``composed`` sends texts through the one step Spark lacks; without it, texts
    must be ASCII or in that form already, and no Python runs.
    """
    t = _nfkc(text) if composed else text
    return F.lower(F.translate(F.regexp_replace(t, INVISIBLE_PATTERN, ""), _FROM, _TO))


def role_lines(norm: Column) -> Column:
    """The lines of a normalized text without their indents."""
    return F.transform(F.split(norm, "\n"), lambda l: F.regexp_replace(l, r"^\s+", ""))  # noqa: E741


def role_hits(lines: Column) -> Column:
    """Per role marker, struct(name, n): the lines that start with it."""
    return F.transform(F.array(*map(F.lit, ROLES)), lambda r: F.struct(r.alias("name"), F.size(F.filter(lines, lambda l: F.startswith(l, r))).alias("n")))  # noqa: E741


def with_scan(rows: DataFrame, text: str = "text", threshold: float = THRESHOLD, composed: bool = True, out: str = "scan") -> DataFrame:
    """rows with a struct(is_suspicious, confidence, matched_patterns); a null text is clean."""
    t = F.coalesce(F.col(text), F.lit(""))
    known = F.array(*[F.struct(F.lit(p).alias("name"), F.lit(w).alias("w")) for p, w in PHRASES])

    def found(norm: Column) -> Column:
        # most texts hold no role marker: one pass over the text says so
        roles = F.filter(role_hits(role_lines(norm)), lambda r: r["n"] > 0)
        none = F.array().cast("array<struct<name:string,n:int>>")
        return F.struct(F.when(norm.rlike(_ROLE_PATTERN), roles).otherwise(none).alias("roles"), F.filter(known, lambda p: F.contains(norm, p["name"])).alias("phrases"))

    rows = rows.withColumns({"_found": once(normalized(t, composed), found), "_hidden": invisible_count(t), "_alike": lookalike_count(t)})
    rows = rows.withColumns({"_roles": F.col("_found.roles"), "_phrases": F.col("_found.phrases")})
    total = lambda a, f: F.aggregate(a, F.lit(0), lambda s, x: s + f(x))
    score = F.least(F.col("_hidden") * 10, F.lit(30)) + F.when(F.col("_alike") >= 2, F.least(F.col("_alike") * 5, F.lit(30))).otherwise(0)
    score = F.least(score + total("_roles", lambda x: x["n"] * ROLE_WEIGHT) + total("_phrases", lambda x: x["w"]), F.lit(100))
    rows = rows.withColumn("_score", score)
    signs = F.array_compact(F.array(F.when(F.col("_hidden") > 0, F.lit("invisible_characters")), F.when(F.col("_alike") >= 2, F.lit("homoglyphs"))))
    names = F.concat(signs, F.transform("_roles", lambda x: x["name"]), F.transform("_phrases", lambda x: x["name"]))
    found = F.struct((F.col("_score") >= round(threshold * 100)).alias("is_suspicious"), (F.col("_score") / 100.0).alias("confidence"), names.alias("matched_patterns"))
    return rows.withColumn(out, found).drop("_found", "_hidden", "_alike", "_roles", "_phrases", "_score")


REDACTED = "[REDACTED]"
#: What is redacted: credentials in URLs, cloud key ids, host tokens, private keys, bearer and assigned secrets. (name, pattern, replacement)
REDACTIONS = [
    ("url_password", r"([a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@]+:)[^\s@/]+@", r"$1" + REDACTED + "@"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", REDACTED),
    ("aws_key_id", r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", REDACTED),
    ("github_token", r"\b(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b", REDACTED),
    ("api_token", r"\b(sk|pk|rk)[-_](live|test|proj|ant)?[-_]?[A-Za-z0-9_-]{20,}\b", REDACTED),
    ("bearer", r"([Bb]earer )[A-Za-z0-9._~+/-]{16,}=*", r"$1" + REDACTED),
    ("assigned", r"((password|passwd|secret|token|api_key|apikey)[\"']? ?[:=] ?[\"'])[^\"'\s]{8,}([\"'])", r"$1" + REDACTED + "$3"),
]


#: Every text that one of the patterns matches holds one of these.
_REDACTED_HOLD = r"://|PRIVATE KEY|A[KS]IA|gh[pousr]_|[spr]k[-_]|earer |password|passwd|secret|token|api_?key"


def redact(text: Column) -> tuple[Column, Column]:
    """(the text with secrets replaced, how many were): one pattern after the other, each on what the one before left."""

    def replaced(done: Column, pattern: str, new: str) -> Column:
        return once(done, lambda x: F.struct(F.regexp_replace(x["text"], pattern, new).alias("text"), (x["n"] + F.regexp_count(x["text"], F.lit(pattern))).alias("n")))

    def all_of(t: Column) -> Column:
        done = F.struct(t.alias("text"), F.lit(0).alias("n"))
        for _, pattern, new in REDACTIONS:
            done = replaced(done, pattern, new)
        return done

    t = F.coalesce(text, F.lit(""))
    done = F.when(t.rlike(_REDACTED_HOLD), once(t, all_of)).otherwise(F.struct(t.alias("text"), F.lit(0).alias("n")))
    return done["text"], done["n"]
