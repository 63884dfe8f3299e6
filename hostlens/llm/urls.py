"""URL filters: host and path rules, then a weighted vocabulary of strict and soft terms.

A rule names a host and a path; it fits its host and all subdomains if the url's path starts with the rule's, and the
longest rule that fits decides. Hosts are looked up label by label, so the cost does not depend on the number of rules.
Where no rule fits, an Aho-Corasick automaton finds all terms of the vocabulary in the lower-cased host and path at
once. A term counts where no letter or digit touches it; one strict term rejects the url, and so do `SOFT_HITS`
distinct soft ones. A url is judged by itself, in the task that reads it: nothing is shuffled.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule, holds no term and is
allowed; urls of any length are read whole; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import UPPER, free_name, table

# The rules of the query, and its vocabulary.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
STRICT = ("porn", "xxx", "hentai", "escort", "warez", "phishing", "malware")
SOFT = ("casino", "win", "free", "bets", "bet", "poker", "ads", "track", "adult", "sexy", "loan", "pills", "cheap", "bonus", "jackpot", "spam")
SOFT_HITS = 2
LOWER = str.maketrans(UPPER, UPPER.lower())


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(LOWER), path


class Rules:
    def __init__(self, rules: tuple[tuple[str, str, str], ...] = RULES):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((host + path, path, verdict))
        self.labels = max((host.count(".") + 1 for host in self.by_host), default=0)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, as host and path in one, and its verdict.

        No more of a host's last labels are looked at than the longest rule has."""
        best: tuple[str, str] | None = None
        dot = len(host)
        for _ in range(self.labels):
            dot = host.rfind(".", 0, dot)
            for rule, start, verdict in self.by_host.get(host[dot + 1 :], ()):
                if path.startswith(start) and (best is None or len(rule) >= len(best[0])):
                    best = (rule, verdict)
            if dot < 0:
                break
        return best


class Vocabulary:
    def __init__(self, strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for weight, terms in ((1, soft), (2, strict)):
            for t in terms:
                self.automaton.add_word(t, (weight, t))
        self.automaton.make_automaton()

    @staticmethod
    def _bound(c: str) -> bool:
        return not ("a" <= c <= "z" or "0" <= c <= "9")

    def hits(self, host: str, path: str) -> tuple[int, int]:
        """Distinct strict and distinct soft terms with boundaries on both sides."""
        text = f" {host}{path.translate(LOWER)} "
        found: tuple[set, set] = (set(), set())
        for end, (weight, term) in self.automaton.iter(text):
            if self._bound(text[end - len(term)]) and self._bound(text[end + 1]):
                found[weight - 1].add(term)
        return len(found[1]), len(found[0])


@lru_cache(maxsize=8)
def _built(rules: tuple, strict: tuple, soft: tuple) -> tuple[Rules, Vocabulary]:
    return Rules(rules), Vocabulary(strict, soft)


def vocabulary(terms: DataFrame, most: int = 100_000) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table (term, weight): a weight of SOFT_HITS or more is strict. `most` bounds the table,
    which every task holds; a larger one is refused."""
    rows = terms.filter("term IS NOT NULL AND term <> ''").select(F.lower("term").alias("term"), "weight").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of more than {most} terms")
    strict = {r.term for r in rows if r.weight >= SOFT_HITS}
    return tuple(sorted(strict)), tuple(sorted({r.term for r in rows} - strict))


def judged(pages: DataFrame, rules: tuple = RULES, strict: tuple = STRICT, soft: tuple = SOFT, soft_hits: int = SOFT_HITS) -> DataFrame:
    """pages (url and any other columns) with host, path, rule, strict_terms, soft_terms and verdict.

    An added column whose name is taken gets an underscore.
    """
    ship(pages.sparkSession)
    counted = ("strict_terms", "soft_terms")
    added = {n: free_name(pages, n) for n in ("host", "path", "rule", *counted, "verdict")}
    kept = pages.schema.fields
    kinds = T.StructType([*kept, *[T.StructField(to, T.IntegerType() if n in counted else T.StringType()) for n, to in added.items()]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rule, words = _built(rules, strict, soft)
        for b in batches:
            out: list[list] = [[] for _ in added]
            for url in b.column("url").to_pylist():
                host, path = parts(url)
                rule = by_rule.find(host, path)
                bad, odd = words.hits(host, path)
                verdict = rule[1] if rule else "block" if bad or odd >= soft_hits else "allow"
                for column, value in zip(out, (host, path, rule[0] if rule else None, bad, odd, verdict), strict=True):
                    column.append(value)
            arrays = [pa.array(v, pa.int32() if n in counted else pa.string()) for n, v in zip(added, out, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *arrays], [*[f.name for f in kept], *added.values()])

    return pages.mapInArrow(judge, kinds)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    fits = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in RULES)

    def has(term: str) -> str:
        return f"regexp_matches(t, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"

    strict, soft = " OR ".join(map(has, STRICT)), " + ".join(f"{has(t)}::INT" for t in SOFT)
    return rf"""
WITH rules AS ({fits}), u AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '(?s)^[^?#]*') ELSE '' END AS rest FROM pages
), s AS (
  SELECT r, page_id, translate(regexp_extract(rest, '(?s)^[^/]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '(?s)/.*$') AS path FROM u
), b AS (
  SELECT r, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM s JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
), j AS (
  SELECT s.*, rule, v, host || translate(path, '{UPPER}', '{UPPER.lower()}') AS t FROM s LEFT JOIN b USING (r)
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  coalesce(v, CASE WHEN {strict} OR {soft} >= {SOFT_HITS} THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""


OP9_SQL = _sql()
