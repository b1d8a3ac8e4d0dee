"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

A host rule fits its host and all subdomains if the path starts with the
rule's; the longest fitting rule decides.  All other urls are judged by
pattern rules: the literal tokens that every match must hold are read off the
pattern, a rule is filed under the one that is rarest among the urls, the
tokens of a url fetch candidate rules, and only those run their regular
expression.  A pattern without such a token runs on every url.

Defined cases: a null url or one without ``://`` has an empty host and path and
no tokens from them, and is allowed unless a pattern blocks it; urls that
repeat are judged alike; a url may be of any length; of several patterns that
match the first in the list decides; an empty table gives an empty result.
Only the id and url columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as _ops
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is searched for in the url with A-Z in lower case; its word boundaries are those of ASCII words."""

    verdict: str
    pattern: str


HOST_RULES = (
    HostRule(ALLOW, "com", "/"),
    HostRule(BLOCK, "example.com", "/en/"),
    HostRule(ALLOW, "www.example.com", "/en/"),
    HostRule(BLOCK, "net", "/es/"),
    HostRule(BLOCK, "net", "/fr/"),
)
PATTERN_RULES = (
    PatternRule(BLOCK, r"\bcheap-pills\b"),
    PatternRule(BLOCK, r"\bonline-(?:casino|poker)\b"),
    PatternRule(BLOCK, r"//[^/]*\bcasino\b"),
    PatternRule(BLOCK, r"//[^/]*\b(?:free-)?porn\b"),
    PatternRule(BLOCK, r"\bfree-torrents?-download\b"),
    PatternRule(BLOCK, r"/wp-login\.php"),
    PatternRule(BLOCK, r"/cgi-bin/ads?\b"),
    PatternRule(BLOCK, r"//ads\."),
)
_TOKEN = re.compile("[a-z0-9]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


_TOKEN_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_EDGE, _UNKNOWN = "edge", "unknown"


def _outline(parsed) -> list[str]:
    """What a match holds, in order: token characters, edges of tokens, and what can not be told."""
    out: list[str] = []
    for op, value in parsed:
        if op is _ops.LITERAL:
            out.append(chr(value) if chr(value) in _TOKEN_CHARS else _EDGE)
        elif op is _ops.AT:
            out.append(_UNKNOWN if value is _ops.AT_NON_BOUNDARY else _EDGE)
        elif op is _ops.SUBPATTERN:
            _, add, remove, inner = value
            out += [_UNKNOWN] if add or remove else _outline(inner)
        elif op is _ops.ATOMIC_GROUP:
            out += _outline(value)
        elif op is _ops.IN and value[0][0] is not _ops.NEGATE and all(k is _ops.LITERAL and chr(v) not in _TOKEN_CHARS for k, v in value):
            out.append(_EDGE)
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT, _ops.POSSESSIVE_REPEAT):
            ends = _outline(value[2])[-1:] == [_EDGE] and out[-1:] == [_EDGE]  # an edge comes next even if it is left out
            out += [_UNKNOWN, _EDGE] if ends else [_UNKNOWN]
        elif op not in (_ops.ASSERT, _ops.ASSERT_NOT):  # those take no room
            out.append(_UNKNOWN)
    return out


def required_tokens(pattern: str) -> tuple[str, ...]:
    """The literals that every match of the pattern holds as whole tokens of the url."""
    outline = [_UNKNOWN, *_outline(_parser.parse(pattern, re.ASCII)), _UNKNOWN]
    found, start = set(), 0
    for i, x in enumerate(outline):
        if x in (_EDGE, _UNKNOWN):
            if i > start + 1 and outline[start] == x == _EDGE:
                found.add("".join(outline[start + 1 : i]))
            start = i
    return tuple(sorted(found))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :], re.DOTALL)[0]
    return host.translate(_LOWER), path


class HostIndex:
    def __init__(self, rules: tuple[HostRule, ...]):
        self.by_host: dict[str, list[HostRule]] = {}
        for r in sorted(rules, key=lambda r: -len(r.path)):
            self.by_host.setdefault(r.host, []).append(r)

    def decide(self, host: str, path: str) -> HostRule | None:
        best = None
        at = 0
        while True:  # the host, then every parent domain
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r.path) and (best is None or len(r.host) + len(r.path) > len(best.host) + len(best.path)):
                    best = r
            at = host.find(".", at) + 1
            if not at:
                return best


class PatternIndex:
    """Rules by their rarest token; the first matching rule in list order decides."""

    def __init__(self, rules: tuple[PatternRule, ...], counts: dict[str, int]):
        self.rules = [(r.verdict, re.compile(r.pattern, re.ASCII)) for r in rules]
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, r in enumerate(rules):
            tokens = required_tokens(r.pattern)
            own = self.by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []) if tokens else self.always
            own.append(i)

    def decide(self, url: str | None) -> str | None:
        if url is None:
            return None
        low = url.translate(_LOWER)
        for i in sorted({i for t in set(_TOKEN.findall(low)) for i in self.by_token.get(t, ())}.union(self.always)):
            verdict, pattern = self.rules[i]
            if pattern.search(low):
                return verdict
        return None


def token_counts(urls: DataFrame, url_col: str, rules: tuple[PatternRule, ...]) -> dict[str, int]:
    """How many urls hold each literal token of the rules; one row per literal comes back."""
    literals = sorted({t for r in rules for t in required_tokens(r.pattern)})
    if not literals:
        return {}
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(url_col)), F.lit("[a-z0-9]+"), F.lit(0)))
    held = F.array_intersect(tokens, F.array(*(F.lit(t) for t in literals)))
    rows = urls.select(F.explode(held).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def judge(urls: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: tuple[HostRule, ...] = HOST_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES, default: str = ALLOW) -> DataFrame:
    """Per row: id, host, path, rule (null if no host rule fits), verdict."""
    hosts, patterns = HostIndex(host_rules), PatternIndex(pattern_rules, token_counts(urls, url_col, pattern_rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                host, path = split_url(url)
                rule = hosts.decide(host, path)
                rows.append((host, path, rule and rule.host + rule.path, rule.verdict if rule else patterns.decide(url) or default))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.string()) for c in cols)], ["id", "host", "path", "rule", "verdict"])

    kind = urls.schema[id_col].dataType.simpleString()
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages)
