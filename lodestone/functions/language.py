"""Language of a file from its name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by language, case-sensitive.
EXTENSIONS = {
    "rust": "rs",
    "python": "py pyi",
    "javascript": "js mjs cjs",
    "typescript": "ts mts cts tsx jsx",
    "go": "go",
    "c": "c h",
    "cpp": "cpp cc cxx hpp hxx hh",
    "java": "java",
    "ruby": "rb",
    "shell": "sh bash zsh fish",
    "markdown": "md mdx",
    "toml": "toml",
    "yaml": "yml yaml",
    "json": "json",
    "html": "html htm",
    "css": "css scss less",
    "sql": "sql",
}
BY_EXTENSION = {e: language for language, known in EXTENSIONS.items() for e in known.split()}
#: Languages with definitions that become chunks; those whose files are configuration.
PARSED = ("rust", "python", "javascript", "typescript", "go", "c", "cpp", "java", "ruby")
CONFIGURATION = ("env", "toml", "yaml", "json")
LANGUAGES = (*EXTENSIONS, "env", "unknown")


def detect(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    if dot and stem and ext in BY_EXTENSION:
        return BY_EXTENSION[ext]
    low = name.lower()
    return "env" if low == ".env" or low.startswith(".env.") or low.endswith(".env") else "unknown"


def language_of(path: Column) -> Column:
    """By extension, then, for names like .env, by name; else unknown."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)
    known = F.create_map(*chain.from_iterable((F.lit(e), F.lit(v)) for e, v in BY_EXTENSION.items()))
    low = F.lower(name)
    env = (low == ".env") | low.startswith(".env.") | low.endswith(".env")
    return F.coalesce(known[ext], F.when(env, "env").otherwise("unknown"))
