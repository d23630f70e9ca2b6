"""URL filters: host and path rules, and patterns, found by their rarest literal token.

Every rule becomes a regular expression over ``host + path`` (or the whole url), and
is filed under the one of its literal tokens that the fewest urls of the table hold
(counted over all urls). A url's tokens fetch the rules filed under them; only those
run their regular expression.

Defined cases: a null url, an empty one and one without ``://`` have empty host and
path, fit no rule and get the default verdict unless a pattern blocks them; repeated
urls give repeated rows; a url of any length is read whole; of rules that fit, the one
with the longest host and path wins, block before allow on a tie; an empty table gives
an empty result with the same columns.
"""

from __future__ import annotations

import dataclasses
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.batches import map_chunks

ALLOW, BLOCK = "allow", "block"


@dataclasses.dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains if the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclasses.dataclass(frozen=True)
class Pattern:
    """A regular expression over host + path, and a word that each of its matches holds
    as a whole token (letters and digits between other characters)."""

    regex: str
    literal: str
    verdict: str = BLOCK


#: The rules of the registered query.
HOST_RULES = (HostRule("org", "/", ALLOW), HostRule("example.org", "/es/", BLOCK),
              HostRule("example.org", "/en/1", BLOCK), HostRule("com", "/fr/", ALLOW),
              HostRule("com", "/de/", BLOCK))

#: The method's verdict where no host rule fits: patterns of unwanted hosts and paths.
PATTERNS = tuple(Pattern(rf"^(?:[^/]*[.\-])?{a}-{b}(?:[.\-][^/]*)?(?:/|$)", a) for a, b in (
    ("cheap", "pills"), ("spam", "farm"), ("casino", "online"), ("online", "casino"), ("adult", "video"),
    ("payday", "loans"), ("free", "porn"), ("link", "farm"))) + tuple(
    Pattern(rf"^[^/]*/(?:[^/]*/)*{word}(?:[/.\-_]|$)", word) for word in ("porn", "casino", "viagra", "xxx"))


def tokens(text: str) -> set[str]:
    """Runs of letters and digits, lower-cased."""
    return set("".join(c if c.isalnum() else " " for c in text.lower()).split())


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path): empty where there is no ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:end]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def _literals(rule: HostRule | Pattern) -> set[str]:
    """Tokens that every url which the rule fits holds whole. The path's last token may go
    on in the url, unless the path ends with another character."""
    if isinstance(rule, Pattern):
        return {rule.literal}
    path = rule.path
    while path and path[-1].isalnum():
        path = path[:-1]
    return tokens(rule.host) | tokens(path)


def _regex(rule: HostRule | Pattern) -> str:
    if isinstance(rule, Pattern):
        return rule.regex
    return rf"\A(?:[^/]*\.)?{re.escape(rule.host)}{re.escape(rule.path) if rule.path else '(?:/|$)'}"


class RuleIndex:
    """Rules filed under their rarest literal token; those without one are always tried."""

    def __init__(self, rules: tuple, counts: dict[str, int]):
        self.under: dict[str, list] = {}
        self.always: list = []
        for rule in rules:
            entry = (rule, re.compile(_regex(rule), re.DOTALL))
            own = _literals(rule)
            if own:
                self.under.setdefault(min(own, key=lambda t: (counts.get(t, 0), t)), []).append(entry)
            else:
                self.always.append(entry)

    def fitting(self, host: str, path: str) -> list:
        whole = host + path
        found = list(self.always)
        for t in tokens(whole):
            found += self.under.get(t, ())
        return [rule for rule, regex in found if regex.search(whole)]


def token_counts(df: DataFrame, rules: tuple, url_col: str) -> dict[str, int]:
    """How many urls of the table hold each literal token of the rules: as many numbers as
    the rules have tokens."""
    wanted = sorted(set().union(*map(_literals, rules))) if rules else []
    if not wanted:
        return {}
    own = F.split(F.lower(F.col(f"`{url_col}`")), r"[^\p{L}\p{N}]+")
    row = df.agg(*[F.count_if(F.array_contains(own, t)).alias(f"t{i}") for i, t in enumerate(wanted)]).first()
    return dict(zip(wanted, row, strict=True))


def judge_urls(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple = HOST_RULES,
               patterns: tuple = PATTERNS, default: str = ALLOW) -> DataFrame:
    """One row per row of ``df``: id, host, path, rule (host and path, or null) and verdict."""
    counts = token_counts(df, (*rules, *patterns), url_col)
    kind = df.schema[id_col].dataType.simpleString()
    index: list = []  # built once in each worker

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not index:
            index.append((RuleIndex(rules, counts), RuleIndex(patterns, counts)))
        hosts, others = index[0]
        out: list[tuple] = []
        for raw in batch.column("text").to_pylist():
            host, path = split_url(None if raw is None else raw.decode("utf-8", "replace"))
            best = max(hosts.fitting(host, path), key=lambda r: (len(r.name), r.verdict == BLOCK, r.name), default=None)
            if best is not None:
                out.append((host, path, best.name, best.verdict))
            else:
                hit = others.fitting(host, path) if host else []
                out.append((host, path, None, max((p.verdict for p in hit), default=default)))
        cols = [pa.array(c, pa.string()) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *cols], [id_col, "host", "path", "rule", "verdict"])

    only = df.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`").cast("binary").alias("text"))
    return map_chunks(only, run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string", "text")
