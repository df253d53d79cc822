"""Secret scans: patterns, and sliding-window entropy of candidate strings.

Spans are (start, kind, end) in code points, end exclusive.  Base kinds are
assignments, access keys and hexadecimal runs.  The method adds ``entropy``
spans: a candidate is a whole run of 20 or more characters of
``[A-Za-z0-9+/_=-]`` with a digit in it.  A window of 20 characters slides over
it; the counts of its characters, and the sum of c*log2(c) over them, are
updated by the one character that enters and the one that leaves.  The run is a
secret if some window's Shannon entropy reaches the bound of its character
class (hexadecimal, alphanumeric, or base-64 with signs), unless it matches the
allow list or overlaps a base span.  c*log2(c) is held in millionths as whole
numbers, so sums are exact.

With ``joined`` (the form of the query and the pipeline) base spans and placeholders don't clear a
run: the text between them is judged part by part, each like a run of its own,
and if a part is a secret the whole run gets an entropy span, which may overlap
base spans.

Only DataFrame functions are used.  Java's regular expressions give the matches
and the text between them; a match starts after all that came before.

Defined results: a null or empty text has no spans; repeated rows give repeated
results; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order, each with its pattern.  A run of at least n characters
#: is the same as a maximal run that passes the length test.  An assignment's value
#: (group 2) is tested after matching, as a failing match still takes up its text.
ASSIGN = (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Bits per character from which a window of a class counts as a secret.
BOUNDS = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.6), ("", 3.9))
#: Candidates that are no secrets: decimal numbers, UUIDs, one word repeated or
#: numbered, paths of plain words, and placeholders.
ALLOW = (r"^[0-9_=+/-]+$",
         r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
         r"^[A-Za-z]+[0-9]{1,6}$",
         r"^/?(?:[A-Za-z]+[/_-])+[A-Za-z]*[0-9]{0,4}[/_=-]*$",
         r"(?i)example|placeholder|xxxx|1234567|abcdef")
#: The same without placeholders, for whole runs, and for parts of runs, at whose ends
#: signs don't count.
WHOLE = ALLOW[:-1]
ENDS = tuple(p.replace("^", "^[+/_=-]*(?:", 1)[:-1] + ")[+/_=-]*$" for p in WHOLE)
_SCALE = 1_000_000
_F = [0 if c == 0 else round(c * math.log2(c) * _SCALE) for c in range(WINDOW + 1)]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def matches(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans (with the text of ``group``) of the leftmost, non-overlapping matches
    of ``pattern``; those whose group is shorter than ``least`` are dropped."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap"))), values,
                      lambda x, v: F.struct(x["hit"].alias("hit"), x["gap"].alias("gap"), v.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
    fold = F.aggregate(F.filter(rows, lambda r: r["hit"].isNotNull()), start, lambda acc, r: F.struct(
        (acc["at"] + r["gap"] + F.length(r["hit"])).alias("at"),
        F.concat(acc["spans"], F.array(F.struct((acc["at"] + r["gap"]).alias("start"), F.lit(kind).alias("kind"),
                                                (acc["at"] + r["gap"] + F.length(r["hit"])).alias("end"), r["value"].alias("text")))).alias("spans")),
        lambda acc: acc["spans"])
    if least:
        fold = F.filter(fold, lambda s: F.length(s["text"]) >= least)
    return F.when(text.rlike(pattern), fold).otherwise(F.array().cast(_SPAN))


def least_sum(candidate: Column, window: int = WINDOW) -> Column:
    """The least sum of c*log2(c) (in millionths) over the candidate's windows;
    entropy is log2(window) - sum / window."""
    table = F.array(*[F.lit(v).cast("long") for v in _F])

    def over(letters: Column) -> Column:
        return _let(F.array_distinct(letters), lambda kinds: _let(
            F.transform(letters, lambda x: (F.array_position(kinds, x) - 1).cast("int")), lambda code: fold(kinds, code)))

    def fold(kinds: Column, code: Column) -> Column:
        first = F.transform(kinds, lambda _, k: F.size(F.filter(F.slice(code, 1, window), lambda c: c == k)))
        return _let(first, lambda counts: _let(F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + table[c]), lambda s0: F.aggregate(
            F.when(F.size(code) > window, F.sequence(F.lit(window), F.size(code) - 1)).otherwise(F.array().cast("array<int>")),
            F.struct(counts.alias("counts"), s0.alias("sum"), s0.alias("least")),
            lambda acc, i: _let(F.struct(code[i].alias("come"), code[i - window].alias("go")), lambda step: _let(
                F.when(step["come"] == step["go"], acc["sum"]).otherwise(
                    acc["sum"] + table[acc["counts"][step["come"]] + 1] - table[acc["counts"][step["come"]]]
                    + table[acc["counts"][step["go"]] - 1] - table[acc["counts"][step["go"]]]),
                lambda total: F.struct(
                    F.transform(acc["counts"], lambda c, k: c + (k == step["come"]).cast("int") - (k == step["go"]).cast("int")).alias("counts"),
                    total.alias("sum"), F.least(acc["least"], total).alias("least")))),
            lambda acc: acc["least"])))

    return _let(F.split(candidate, ""), lambda raw: _let(F.filter(raw, lambda x: x != ""), over))


def secret_candidate(candidate: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | candidate.rlike(pattern)
    bound = F.lit(None).cast("long")
    for pattern, bits in reversed(BOUNDS):
        most = F.lit(math.floor(WINDOW * (math.log2(WINDOW) - bits) * _SCALE)).cast("long")
        bound = F.when(candidate.rlike(pattern), most).otherwise(bound) if pattern else most
    return F.when(allowed, F.lit(False)).otherwise(least_sum(candidate) <= bound)


def secret_part(run: Column, base: Column) -> Column:
    """Whether a part of the candidate ``run`` outside the ``base`` spans and
    placeholders is a secret.  Signs at the ends of a part don't keep it from the
    allow list."""
    blank = F.aggregate(base, run["text"], lambda out, b: F.when(
        (b["start"] < run["end"]) & (run["start"] < b["end"]),
        _let(F.struct((F.greatest(b["start"], run["start"]) - run["start"]).alias("from"), (F.least(b["end"], run["end"]) - run["start"]).alias("to")),
             lambda cut: F.concat(F.substring(out, F.lit(1), cut["from"]), F.repeat(F.lit(" "), cut["to"] - cut["from"]),
                                  F.substring(out, cut["to"] + 1, F.length(out)))))
        .otherwise(out))
    parts = F.split(F.regexp_replace(blank, ALLOW[-1], " "), " ")
    return F.exists(parts, lambda p: (F.length(p) >= WINDOW) & p.rlike("[0-9]") & F.when(p == run["text"], secret_candidate(p, WHOLE)).otherwise(secret_candidate(p, ENDS)))


def scan(docs: DataFrame, joined: bool = False) -> DataFrame:
    """``docs`` with ``spans``: array of (start, kind, end), by start, then kind
    (``KINDS``).  ``joined``: also secrets in runs that hold a base span or a
    placeholder."""
    kept = docs.select(*[c for c in docs.columns if c not in ("spans", "_base", "_candidates", "_text")])
    text = F.col("_text")
    based = (kept.withColumn("_text", F.coalesce("text", F.lit("")))
             .withColumn("_base", F.concat(matches(text, ASSIGN, 0, 2, MIN_VALUE), matches(text, ACCESS, 1), matches(text, HEX, 2)))
             .withColumn("_candidates", matches(text, CANDIDATE, 3)))
    clear = F.filter("_candidates", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    wanted = F.filter("_candidates", lambda c: secret_part(c, F.col("_base"))) if joined else F.filter(clear, lambda c: secret_candidate(c["text"]))
    found = based.withColumn("_candidates", wanted)
    spans = F.array_sort(F.transform(F.concat("_base", "_candidates"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.withColumn("spans", spans).drop("_base", "_candidates", "_text")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    fold = F.aggregate(spans, start, lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, fold).otherwise(text)
