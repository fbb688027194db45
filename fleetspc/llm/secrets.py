"""Secret scans over every historical version, with a ledger of what was scanned.

A blob is the content of a version, addressed by its SHA-256. The ledger holds one row per blob
and rule version with the spans found, also if there are none, so a later scan reads only the
blobs that are new, or that a new rule version has not seen. Findings are joined back to all
paths that ever held the blob.

A ledger is a folder of parquet files to which each scan appends one committed batch; a scan that
dies adds nothing, and a blob scanned twice by chance gives the same row, which counts once.

NULL text is empty and has no secrets. Versions may repeat; each row gets its findings. Columns
other than the text pass through; those named blob or spans are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspc.llm.frames import text_or_empty
from fleetspc.sources.workspace import exists

SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, rule string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern whose match counts if its group has at least `least` characters.

    `hints` are lower-case strings of which a text has one, in any case, if the pattern matches.
    """

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Patterns and lengths of the three base kinds, in the order in which ties are listed.
ASSIGN = Rule(
    "assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    12, group=2, any_case=True, hints=("passw", "secret", "token", "apikey", "api_key"),
)
ACCESS = Rule("access", 1, r"AKIA[A-Z0-9]+", 18, hints=("akia",))
HEX = Rule("hex", 1, r"[0-9a-f]+", 16)
BASE_RULES = (ASSIGN, ACCESS, HEX)

# The header line of a private key in text form.
PRIVATE_KEY = Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", 1, hints=("-----begin ",))
RULES = (*BASE_RULES, PRIVATE_KEY)


def compiled(rule: Rule) -> re.Pattern:
    # A run of a character class that is too short fails whole, so the length may join the pattern.
    pattern = rule.pattern
    if pattern == HEX.pattern:
        pattern = pattern.removesuffix("+") + "{%d,}" % rule.least
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def scan_text(text: str, rules: Sequence[tuple[Rule, re.Pattern]]) -> dict[str, list[tuple[int, int]]]:
    """Spans per rule name: matches from left to right that do not overlap, short ones dropped."""
    lower = text.lower() if any(rule.hints for rule, _ in rules) else ""
    found = {}
    for rule, pattern in rules:
        possible = not rule.hints or any(hint in lower for hint in rule.hints)
        matches = pattern.finditer(text) if possible else ()
        found[rule.name] = [m.span() for m in matches if len(m[rule.group]) >= rule.least]
    return found


def blob_id(column: str = "text") -> Column:
    return F.sha2(text_or_empty(column).cast("binary"), 256)


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule], text: str) -> DataFrame:
    """(blob, text, missing): every different content with the rule versions that have not seen it."""
    wanted = F.array(*[F.lit(rule.name) for rule in rules])
    blobs = versions.select(blob_id(text).alias("blob"), text_or_empty(text).alias("text"))
    if ledger is not None:
        names = [rule.name for rule in rules]
        seen = ledger.where(F.col("rule").isin(names)).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        missing = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        blobs = blobs.withColumn("missing", missing).where(F.size("missing") > 0)
    else:
        blobs = blobs.withColumn("missing", wanted)
    return blobs.groupBy("blob").agg(F.any_value("text").alias("text"), F.any_value("missing").alias("missing"))


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = {rule.name: (rule, compiled(rule)) for rule in rules}
        for batch in batches:
            out = [
                (blob, name, [{"start": a, "end": b} for a, b in spans])
                for blob, text, missing in zip(batch["blob"], batch["text"], batch["missing"])
                for name, spans in scan_text(text, [ready[n] for n in missing]).items()
            ]
            yield pd.DataFrame(out, columns=["blob", "rule", "spans"])

    return blobs.mapInPandas(scan, LEDGER)


def read_ledger(spark, folder: str) -> DataFrame | None:
    return spark.read.schema(LEDGER).parquet(folder) if exists(spark, folder) else None


def update_ledger(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, *, text: str = "text") -> DataFrame:
    """Scan what the ledger in `folder` lacks, append it, and return the ledger."""
    spark = versions.sparkSession
    fresh = unseen_blobs(versions, read_ledger(spark, folder), rules, text)
    scan_blobs(fresh, rules).write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def find_secrets(versions: DataFrame, folder: str, rules: Sequence[Rule] = RULES, *, text: str = "text") -> DataFrame:
    """Every version with `blob` and `spans`, structs (start, kind, end) in order, by code points.

    `folder` is the ledger's, in storage that all executors share. Spans are ordered by start, then
    by the order of the rules.
    """
    ledger = update_ledger(versions, folder, rules, text=text)
    number = F.create_map(*[F.lit(x) for i, rule in enumerate(rules) for x in (rule.name, i)])
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    found = ledger.where(F.col("rule").isin([rule.name for rule in rules]) & (F.size("spans") > 0))
    spans = found.select("blob", number[F.col("rule")].alias("number"), F.inline("spans"))
    ordered = F.array_sort(F.collect_set(F.struct("start", "number", "end")))
    named = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), F.get(kinds, s["number"]).alias("kind"), s["end"].alias("end")))
    by_blob = spans.groupBy("blob").agg(named.alias("spans"))
    keyed = versions.drop("blob", "spans").withColumn("blob", blob_id(text)).drop(text)
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return keyed.join(by_blob, "blob", "left").withColumn("spans", F.coalesce("spans", none))
