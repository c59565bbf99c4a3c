"""URL filter rules, indexed by their rarest literal token; native columns only.

A rule is (host, path, verdict): it fits its host and all subdomains where the URL's path starts with the rule's. It becomes a
regular expression over host + path. The rule is filed under that one of its complete literal tokens which the
fewest rules hold (ties: the longest, then the least); a rule without a complete token is filed under ''. A URL's own tokens
fetch candidates, and only those run their expressions. The longest fitting rule decides.

Up to INLINE_RULES rules, the index travels inside the plan as one constant, and each row is judged where it is read: no join, no
shuffle. Beyond that, URLs meet a table of rules in an equi-join on the token, distinct URLs only.

Null URLs and URLs without '://' have an empty host and path; they fit no rule with a host and take the default verdict. Repeated rows stay. An
empty table gives an empty result; the other columns of the input are kept, except those named like a result column, which are replaced.
"""

from __future__ import annotations

import json
import re
import string
from collections import Counter
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that the plan carries as a constant at most: some 2 MB.
INLINE_RULES = 10_000
_RULE = "struct<token:string,pattern:string,rule:string,verdict:string,size:int>"
_TOKEN = re.compile(r"[a-z0-9]+")


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def _lower(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(url, F.lit("")).contains("://")
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    host = F.when(found, _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")
    path = F.when(found, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)).otherwise("")
    return host, path


def url_tokens(host: Column, path: Column) -> Column:
    """Runs of letters and digits of ASCII, lower-cased, each once, and '' for the rules without a token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(_lower(F.concat(host, path)), F.lit(r"[a-z0-9]+"), F.lit(0))))


def _literals(rule: UrlRule) -> set[str]:
    """Tokens that are complete in every URL which the rule fits: a host's ends are bounded, a path's end is open."""
    found = set(_TOKEN.findall(rule.host.lower()))
    path = rule.path.lower()
    return found | {m[0] for m in _TOKEN.finditer(path) if m.end() < len(path)}


def compile_rules(rules: Sequence[UrlRule]) -> list[dict]:
    """The rules with their index token, pattern and length; one entry for each distinct host and path, the first given wins."""
    first: dict[tuple[str, str], UrlRule] = {}
    for r in rules:
        if not r.host or (r.path and r.path[0] != "/"):
            raise ValueError(f"a rule needs a host, and a path from its slash on: {r}")
        first.setdefault((r.host.lower(), r.path), UrlRule(r.host.lower(), r.path, r.verdict))
    held = Counter(t for r in first.values() for t in _literals(r))
    out = []
    for r in first.values():
        token = min(_literals(r), key=lambda t: (held[t], -len(t), t), default="")
        # The host ends where the path begins: \x00 stands between them.
        pattern = "(?s)^(?:.*\\.)?" + _quoted(r.host) + "\x00" + _quoted(r.path)
        out.append({"token": token, "pattern": pattern, "rule": r.text, "verdict": r.verdict, "size": len(r.text)})
    return out


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/\x80-\U0010ffff])", r"\\\1", text)


def _best(candidates: Column, subject: Column) -> Column:
    """The longest candidate whose expression fits; among equally long ones the greatest rule text."""
    fitting = F.filter(candidates, lambda c: F.regexp_like(subject, c["pattern"]))
    return F.array_max(F.transform(fitting, lambda c: F.struct(c["size"].alias("size"), c["rule"].alias("rule"), c["verdict"].alias("verdict"))))


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule], default: str = "allow", url_col: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """pages with host, path, rule and verdict. inline: most rules that the plan carries; more go through a join."""
    spark, found = pages.sparkSession, compile_rules(rules)
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", url_col.lower())]
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*kept, F.col(url_col), host.alias("host"), path.alias("path"))
    subject = F.concat("host", F.lit("\x00"), "path")
    if len(found) <= inline:
        # A hash table as a constant: slot -> rules. Tokens of a URL look into their slots only.
        slots: list[list[dict]] = [[] for _ in range(max(1, 2 * len(found)))]
        tokens = sorted({r["token"] for r in found})
        places = dict(zip(tokens, _slots(spark, tokens, len(slots)), strict=True))
        for r in found:
            slots[places[r["token"]]].append(r)
        index = F.from_json(F.lit(json.dumps(slots)), f"array<array<{_RULE}>>")
        fetch = lambda t: F.filter(F.element_at(index, F.pmod(F.hash(t), F.lit(len(slots))) + 1), lambda c: c["token"] == t)
        judged = rows.withColumn("__best__", _best(F.flatten(F.transform(url_tokens(F.col("host"), F.col("path")), fetch)), subject))
    else:
        table = spark.createDataFrame([tuple(r.values()) for r in found], "token string, pattern string, rule string, verdict string, size int")
        urls = rows.select("host", "path").distinct().withColumn("token", F.explode(url_tokens(F.col("host"), F.col("path"))))
        hits = urls.join(table, "token").where(F.regexp_like(subject, F.col("pattern")))
        best = hits.groupBy("host", "path").agg(F.max(F.struct("size", "rule", "verdict")).alias("__best__"))
        judged = rows.join(best, ["host", "path"], "left")
    out = judged.select(*kept, F.col(url_col), "host", "path", F.col("__best__.rule").alias("rule"), F.coalesce("__best__.verdict", F.lit(default)).alias("verdict"))
    return out


def _slots(spark, tokens: list[str], count: int) -> list[int]:
    """Slots by the engine's own hash, so that the plan's lookups agree with the table."""
    if not tokens:
        return []
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, t string").select("i", F.pmod(F.hash("t"), F.lit(count)).alias("slot")).collect()
    return [r["slot"] for r in sorted(rows, key=lambda r: r["i"])]
