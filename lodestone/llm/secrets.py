"""Secret scans (DataFrame functions only).

Base patterns give the spans of three kinds: assignments, access keys and long
hex runs. The method adds entropy spans: a candidate is a run of key characters
with a letter and a digit; a window slides over it, one character in and one
out, with the counts of its character class and the running sum of c log2 c,
from which the window's Shannon entropy follows. A candidate whose best window
reaches the threshold of its class (hex or base64) is a span, unless the
allow-list knows it (samples, alphabets, UUIDs, integrity digests). The
allow-list only silences entropy spans, never base ones.

Positions come from splitting: the text between matches and the matches
themselves, taken in turn, add up to every match's start. Offsets are code
points, end exclusive. The work is linear in a text's length and in that of a
candidate: counts are one character each in a string, and a long candidate is
scanned in pieces that overlap by a window. A null text counts as empty (redaction
leaves it null); a text without a match has no spans; rows, repeated or not, are
scanned one by one and nothing is shuffled, so ties and groups of copies need no
rule; an empty table gives no rows. Other columns of docs are left alone, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds, in their order, with patterns and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Characters of a candidate that are scanned at once, and matches that are added to a text's at once.
PIECE, BATCH = 1000, 256
#: Bits a window of WINDOW characters must reach, by class.
THRESHOLD = {"entropy_hex": 3.0, "entropy_base64": 3.8}
ALLOWED = r"(?i)(example|sample|dummy|placeholder|changeme|lorem|test_?key|x{6}|0123456789|123456789|abcdefgh)|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^sha(256|384|512)-"
MARK = "[SECRET]"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _once(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _folded(items: Column, kind: str, step) -> Column:
    """What step(acc, item) adds to acc.out, an array of the type given, while it moves acc.at along; in batches, so that appending stays cheap."""
    none = F.array().cast(kind)

    def batches(all_: Column) -> Column:
        def batch(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(all_, k * BATCH + 1, F.lit(BATCH)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return _once(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], p["out"]).alias("out")))

        count = F.floor((F.size(all_) + BATCH - 1) / BATCH).cast("int")
        return F.aggregate(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), F.struct(F.lit(0).alias("at"), none.alias("out")), batch)

    return _once(items, batches)


def _matches(text: Column, pattern: str, kind: Column | int, keep, group: int = 0) -> Column:
    """Spans of the matches m of pattern (m: whole match, g: the group tested by keep)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    walk = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"), tested.alias("g"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), (kind(x["m"]) if callable(kind) else F.lit(kind)).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["g"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), _folded(walk, _SPAN, step)["out"]).otherwise(F.array().cast(_SPAN))


def _peak(piece: Column, window: int) -> Column:
    """The highest entropy of any window of one piece; counts are updated, not recomputed.

    Counts are letters in a string, A for none, at the place of the symbol's code
    beyond 42 (the first that can stand in a candidate is +).
    """
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    term = lambda c: F.element_at(f, c + 1)
    zero = F.struct(F.lit("A" * 80).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    count = lambda n, symbol: F.ascii(F.substr(n, symbol, F.lit(1))) - 65
    put = lambda n, symbol, c: F.overlay(n, F.chr(c + 65), symbol, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        # the old symbol leaves before the new one, which may be the same, enters
        had = count(acc["n"], x["old"])
        left = F.when(x["old"] > 0, F.struct(put(acc["n"], x["old"], had - 1).alias("n"), (acc["s"] - term(had) + term(had - 1)).alias("s"))).otherwise(F.struct(acc["n"].alias("n"), acc["s"].alias("s")))

        def entered(l: Column) -> Column:  # noqa: E741
            now = count(l["n"], x["new"])
            s = l["s"] + term(now + 1) - term(now)
            best = F.when(x["i"] >= window - 1, F.greatest(acc["best"], math.log2(window) - s / window)).otherwise(acc["best"])
            return F.struct(put(l["n"], x["new"], now + 1).alias("n"), s.alias("s"), best.alias("best"))

        return _once(left, entered)

    symbols = F.transform(F.split(piece, ""), lambda c: F.ascii(c) - 42)
    steps = lambda cs: F.transform(cs, lambda c, i: F.struct(i.alias("i"), c.alias("new"), F.when(i >= window, F.element_at(cs, F.greatest(i - window, F.lit(0)) + 1)).otherwise(F.lit(0)).alias("old")))
    return F.aggregate(_once(symbols, steps), zero, step)["best"]


def peak_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any window of the candidate; every window lies in one of the pieces."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(candidate) - window + 1, F.lit(1)), F.lit(PIECE))
    return F.array_max(F.transform(starts, lambda a: _peak(F.substr(candidate, a, F.lit(PIECE + window - 1)), window)))


def is_secret_like(candidate: Column) -> Column:
    hexed = candidate.rlike("^[0-9a-fA-F]+$")
    mixed = candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]")
    least = F.when(hexed, THRESHOLD["entropy_hex"]).otherwise(THRESHOLD["entropy_base64"])
    return mixed & ~candidate.rlike(ALLOWED) & F.when(mixed, peak_entropy(candidate) >= least).otherwise(False)


def spans(text: Column) -> tuple[Column, Column]:
    """Base spans, by start, and added ones: arrays of (start, kind number, end)."""
    t = F.coalesce(text, F.lit(""))
    base = F.concat(
        _matches(t, ASSIGN, 0, lambda g: F.length(g) >= ASSIGN_LEAST, group=1),
        _matches(t, ACCESS, 1, lambda g: F.lit(True)),
        _matches(t, HEX, 2, lambda g: F.lit(True)),
    )
    kind = lambda m: F.when(m.rlike("^[0-9a-fA-F]+$"), 3).otherwise(4)
    return F.array_sort(base), _matches(t, CANDIDATE, kind, is_secret_like)


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans and all spans."""
    base, added = spans(F.col("text"))
    rows = docs.select("doc_id", base.alias("_base"), added.alias("_added"))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_written(F.col("_base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("_base", "_added"))).alias("spans"))


def redact_secrets(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """docs with every span, overlapping ones merged, replaced by mark in text; n_chars, if there, follows."""
    text = F.col("row.text")
    base, added = spans(text)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("spans", F.array_sort(F.concat(base, added)))

    def step(acc: Column, s: Column) -> Column:
        # acc.at is one more than the place reached, so that 0 says that nothing was
        at = F.greatest(acc["at"] - 1, F.lit(0))
        fresh = F.struct((s["end"] + 1).alias("at"), F.concat(acc["out"], F.array(F.substr(text, at + 1, s["start"] - at), F.lit(mark))).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"] + 1).alias("at"), acc["out"].alias("out"))
        return F.when((acc["at"] == 0) | (s["start"] >= at), fresh).otherwise(inside)

    whole = _once(_folded(F.col("spans"), "array<string>", step), lambda r: F.concat(F.array_join(r["out"], ""), F.substr(text, r["at"], F.length(text))))
    rows = rows.select("row", F.when(F.size("spans") > 0, whole).otherwise(text).alias("new"))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("new").cast(docs.schema["n_chars"].dataType), F.col("row.n_chars"))
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
