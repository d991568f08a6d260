"""URL filters: allow and block rules, and a weighted vocabulary found by one Aho-Corasick pass.

A term of the vocabulary has a weight. A url is rejected when the distinct terms in it weigh ``limit`` or more: a strict
term does alone, of soft ones it takes two, of weak ones three, or one beside a soft one. A term counts where no letter
or digit, of any alphabet, stands right before or after it; A-Z count as small letters; escapes are not decoded. A rule
fits its host and all subdomains when the url's path starts with the rule's path; the longest rule that fits wins over
the vocabulary (of equally long ones, the first by code point).

Nulls: a null url, and one without ``://``, has an empty host and path, so no rule fits; a null url is allowed. Very
long urls are searched whole. Rows are judged one by one, so repeated rows get equal results. An empty table gives an
empty result, an empty vocabulary rejects nothing. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_text

#: Weights of the kinds of terms, and the weight at which a url is rejected.
KINDS, LIMIT = {"strict": 5, "soft": 3, "weak": 2}, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(path: str | Path = Path(__file__).with_name("url_terms.tsv")) -> dict[str, int]:
    """Terms and weights of a file of lines: category, kind and terms with spaces between. Read on the driver."""
    lines = (line.split("\t") for line in Path(path).read_text(encoding="utf-8").splitlines() if line.strip())
    return {term: KINDS[kind] for _, kind, terms in lines for term in terms.split()}


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    empty = F.lit("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), empty), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), empty)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, nulls if none fits. rules: (verdict, host/path), a short list."""
    none = F.lit(None).cast("string")
    name, verdict = none, none
    for said, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        own_host, _, own_path = rule.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith("/" + own_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def counting(terms: Mapping[str, int], limit: int) -> Callable:
    """Of each url, the distinct terms that reject alone and those that don't, and what all of them weigh."""

    def make() -> Callable:
        machine, small = ahocorasick.Automaton(), str.maketrans(UPPER, LOWER)
        for term, weight in terms.items():
            machine.add_word(term.translate(small), (term.translate(small), weight))
        if len(machine):
            machine.make_automaton()

        def one(url: bytes | None) -> tuple[int, int, int]:
            url, found = (url or b"").decode().translate(small), {}
            for end, (term, weight) in machine.iter(url) if len(machine) else ():
                start = end + 1 - len(term)
                if not (start and url[start - 1].isalnum() or end + 1 < len(url) and url[end + 1].isalnum()):
                    found[term] = weight
            strict = sum(w >= limit for w in found.values())
            return strict, len(found) - strict, sum(found.values())

        return lambda urls: list(zip(*map(one, urls)))

    return make


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], terms: Mapping[str, int] | None = None, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, the numbers of distinct terms that reject alone (n_strict) and of others
    (n_soft), and the weight of all, for each row. ``terms`` with their weights are the file's by default."""
    host, path = host_and_path(F.col("url").cast("string"))
    # the parts of a url are found natively; Python only counts terms
    split = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    found = map_text(split, "url", ["page_id", "host", "path"], "n_strict long, n_soft long, weight long", counting(vocabulary() if terms is None else terms, limit))
    name, said = first_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("weight") >= limit, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), "n_strict", "n_soft", "weight")
