"""URL rules as one bit-parallel automaton.

A rule is a glob over ``host + path``: ``*`` stands for any run without "/", ``**`` for any run, all else for itself.
All rules are laid side by side in a bit vector of 64-bit words, one bit per literal. With D the set of live bits, a
byte c turns D into ``((D << 1) & B[c]) | (D & S[c])``: B[c] has the literals that equal c, S[c] the literals that are
followed by a star that may take c. One pass over a URL thus runs all rules at once; a batch of URLs is advanced
together, byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchframe.llm.text import bytes_of

#: Marks for the start and the end of a string: no bytes, as every byte may stand in a URL.
_START, _END, _SYMBOLS = 256, 257, 258
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name`` is what a match reports; among matching rules the one with the greatest ``weight`` wins, then the first."""

    name: str
    verdict: str
    globs: tuple[str, ...]
    weight: int


def host_rule(verdict: str, place: str) -> Rule:
    """A rule ``host/path`` for the host and all its subdomains and every path that starts with the rule's."""
    return Rule(place, verdict, (f"{place}**", f"*.{place}**"), len(place))


#: Fixed values of the contract.
HOST_RULES = tuple(host_rule(v, p) for v, p in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")))
#: Rules for every other URL; what no rule matches is allowed.
GLOB_RULES = tuple(
    Rule(g, "block", (g,), len(g.replace("*", "")))
    for g in ("spam*/**", "*.spam*/**", "*-farm.*/**", "*casino*/**", "ads.*/**", "*.ads.*/**", "tracker.*/**", "**/wp-login**", "**/cgi-bin/**", "**.exe", "**.apk")
)


class Automaton:
    """Multiword Shift-And masks of all globs of ``rules``."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        literals: list[int] = []
        loops: dict[int, str] = {}
        starts, self.accepts = [], []
        for r, rule in enumerate(self.rules):
            for glob in rule.globs:
                starts.append(len(literals))
                literals.append(_START)
                at, raw = 0, glob.encode()
                while at < len(raw):
                    if raw[at : at + 1] == b"*":
                        wide = raw[at : at + 2] == b"**"
                        loops[len(literals) - 1] = "any" if wide or loops.get(len(literals) - 1) == "any" else "part"
                        at += 2 if wide else 1
                    else:
                        literals.append(raw[at])
                        at += 1
                literals.append(_END)
                self.accepts.append((len(literals) - 1, r))
        self.words = max(1, -(-len(literals) // 64))
        self.literal = np.zeros((_SYMBOLS, self.words), np.uint64)
        self.loop = np.zeros((_SYMBOLS, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        bit = lambda i: (i // 64, np.uint64(1 << (i % 64)))
        for i, c in enumerate(literals):
            w, b = bit(i)
            self.literal[c, w] |= b
        for i, kind in loops.items():
            w, b = bit(i)
            self.loop[:, w] |= b
            self.loop[_END, w] &= ~b
            if kind == "part":
                self.loop[ord("/"), w] &= ~b
        for i in starts:
            w, b = bit(i)
            self.start[w] |= b

    def best(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Index of the winning rule per string, -1 where none matches."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], offsets[:-1][order]
        live = np.repeat(self.start[None, :], n, axis=0)
        final = np.zeros_like(live)
        for j in range(int(size[0]) + 1 if n else 0):
            going, done = int(np.searchsorted(-size, -j, side="left")), int(np.searchsorted(-size, -j, side="right"))
            if done > going:  # strings of j bytes take the end mark
                final[going:done] = self._step(live[going:done], np.full(done - going, _END))
            live = live[:going] if going else live[:0]
            if going:
                live = self._step(live, data[begin[:going] + j])
        winner = np.full(n, -1)
        weight = np.full(n, -1)
        for i, r in sorted(self.accepts, key=lambda x: x[1]):
            hit = (final[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) == 1
            hit &= weight < self.rules[r].weight
            winner[hit], weight[hit] = r, self.rules[r].weight
        out = np.full(n, -1)
        out[order] = winner
        return out

    def _step(self, live: np.ndarray, c: np.ndarray) -> np.ndarray:
        moved = live << np.uint64(1)
        moved[:, 1:] |= live[:, :-1] >> np.uint64(63)
        return (moved & self.literal[c]) | (live & self.loop[c])


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; empty for null and for URLs without "://"."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, url: str = "url", host_rules: Sequence[Rule] = HOST_RULES, glob_rules: Sequence[Rule] = GLOB_RULES, default: str = "allow") -> DataFrame:
    """``pages`` with columns host, path, rule, pattern, verdict (columns of these names are replaced).

    ``rule`` is the winning host rule, ``pattern`` the glob rule that decides where no host rule does. Null URLs and URLs
    without "://" have an empty host and path; they match only rules that match the empty string, hence ``default``.
    Every row gives one row.
    """
    new = ["host", "path", "rule", "pattern", "verdict"]
    pages = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    kept = [c for c in pages.columns if c not in new]
    pages = pages.select(*kept, "host", "path")
    host_rules, glob_rules = list(host_rules), list(glob_rules)
    schema = StructType([*pages.schema.fields]).add("rule", "string").add("pattern", "string").add("verdict", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = Automaton(host_rules), Automaton(glob_rules)
        for b in batches:
            hosts, paths = (b.column(len(kept) + k).to_pylist() for k in range(2))
            data, offsets = bytes_of(pa.array([h + p for h, p in zip(hosts, paths, strict=True)], pa.large_string()))
            by_host, by_glob = first.best(data, offsets), second.best(data, offsets)
            out = []
            for i, j in zip(by_host.tolist(), by_glob.tolist(), strict=True):
                rule = host_rules[i] if i >= 0 else None
                glob = glob_rules[j] if rule is None and j >= 0 else None
                out.append((rule and rule.name, glob and glob.name, (rule or glob).verdict if rule or glob else default))
            cols = [pa.array(x, pa.string()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=schema.names)

    return pages.mapInArrow(run, schema)


#: DuckDB twin of the contract's query over ``pages``.
ORACLE = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(place, verdict, rule_host, rule_path) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'),
         ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), judged AS (
  SELECT p.*, (SELECT max_by(struct_pack(place := place, verdict := verdict), length(place)) FROM rules
               WHERE (p.host = rule_host OR suffix(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS won,
         p.host || p.path AS whole
  FROM parts p
)
SELECT page_id, host, path, won.place AS rule,
       CASE WHEN won IS NOT NULL THEN won.verdict
            WHEN regexp_full_match(whole, '([^/]*\\.)?spam[^/]*/.*', 's') OR regexp_full_match(whole, '[^/]*-farm\\.[^/]*/.*', 's')
              OR regexp_full_match(whole, '[^/]*casino[^/]*/.*', 's') OR regexp_full_match(whole, '([^/]*\\.)?ads\\.[^/]*/.*', 's')
              OR regexp_full_match(whole, 'tracker\\.[^/]*/.*', 's') OR contains(whole, '/wp-login') OR contains(whole, '/cgi-bin/')
              OR suffix(whole, '.exe') OR suffix(whole, '.apk') THEN 'block'
            ELSE 'allow' END AS verdict
FROM judged
"""
