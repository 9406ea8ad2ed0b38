"""Categories and weaknesses of free text by ordered rules, which are data.

A rule has branches, a branch has groups, a group has terms. A rule holds if any of its branches
does, a branch if each of its groups does, a group if any of its terms is in the lower-cased text.
The first rule that holds wins. All terms of all rules are looked for in one pass over a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.views import table

#: Terms of a rule table at most: the automaton goes to every worker. More is an error, not a cut.
MAX_TERMS = 200_000
DEFAULT = ("security-defect", ())
_FOUND = "category string, weaknesses array<string>, rule int"


class Rule(NamedTuple):
    """A category, its weaknesses and the branches of groups of terms that call for it."""

    category: str
    weaknesses: tuple[str, ...]
    branches: tuple[tuple[tuple[str, ...], ...], ...]


#: A small rule set of this library's own; any other may be given.
RULES = (
    Rule("hard-coded-credential", ("CWE-798",), (((("hard-coded", "hardcoded", "embedded")), ("password", "credential", "secret", "api key")), (("default password",),))),
    Rule("unsafe-deserialization", ("CWE-502",), ((("deserial", "unpickle", "object graph"), ("untrusted", "attacker", "remote")),)),
    Rule("sql-injection", ("CWE-89",), ((("sql injection",),), (("sql", "query string"), ("concatenat", "interpolat"), ("user input", "request", "parameter")))),
    Rule("command-injection", ("CWE-78",), ((("shell", "subprocess", "command line"), ("inject", "metacharacter", "unescaped")),)),
    Rule("cross-site-scripting", ("CWE-79",), ((("xss", "cross-site scripting"),), (("html", "markup"), ("unescaped", "unsanitized")))),
    Rule("resource-exhaustion", ("CWE-400",), ((("unbounded", "no limit", "quadratic"), ("memory", "loop", "recursion", "allocation")),)),
)


def rules_of(table_of_rules: DataFrame) -> list[Rule]:
    """Rules of a table (priority, category, weaknesses, branch, group, term), a row a term, in the order of priority.

    Rows with a null or empty term are left out; a rule without any other row never holds. More than
    MAX_TERMS rows are an error.
    """
    rows = table_of_rules.where("term IS NOT NULL AND term <> ''").select("priority", "category", "weaknesses", "branch", "group", "term").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a rule table has at most {MAX_TERMS} terms")
    rules: dict = {}
    for r in sorted(rows, key=lambda r: (r.priority, r.branch, r.group, r.term)):
        _, _, branches = rules.setdefault(r.priority, (r.category, tuple(r.weaknesses or ()), {}))
        branches.setdefault(r.branch, {}).setdefault(r.group, []).append(r.term)
    return [Rule(c, w, tuple(tuple(tuple(t) for t in groups.values()) for groups in branches.values())) for c, w, branches in rules.values()]


def _automaton(rules: Sequence[Rule]) -> tuple[ahocorasick.Automaton, list[str]]:
    terms = sorted({t.lower() for r in rules for b in r.branches for g in b for t in g if t})
    if len(terms) > MAX_TERMS:
        raise ValueError(f"a rule table has at most {MAX_TERMS} terms")
    found = ahocorasick.Automaton()
    for n, t in enumerate(terms):
        found.add_word(t, n)
    if terms:
        found.make_automaton()
    return found, terms


def first_rule(held: set[int], rules: Sequence[tuple[tuple[frozenset[int], ...], ...]]) -> int:
    """The place of the first rule whose terms are held, or -1."""
    for n, branches in enumerate(rules):
        if any(all(not held.isdisjoint(g) for g in groups) for groups in branches):
            return n
    return -1


def classified(texts: Sequence[str | Column], rules: Iterable[Rule] = RULES, default: tuple[str, Sequence[str]] = DEFAULT) -> Column:
    """A struct (category, weaknesses, rule) of the texts put together with spaces; rule is the winner's place, -1 for the default.

    Null texts are empty, terms are lower-cased, empty terms and groups never hold. Whole texts are
    looked through, of any length; equal texts get equal results.
    """
    rules = list(rules)
    _, terms = _automaton(rules)
    number = {t: n for n, t in enumerate(terms)}
    coded = [tuple(tuple(frozenset(number[t.lower()] for t in g if t) for g in b) for b in r.branches if b) for r in rules]
    labels = [(r.category, list(r.weaknesses), n) for n, r in enumerate(rules)] + [(default[0], list(default[1]), -1)]

    @F.pandas_udf(_FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, known = _automaton(rules)
        for batch in batches:
            places = (first_rule({n for _, n in automaton.iter(t.lower())} if known else set(), coded) for t in batch)
            yield pd.DataFrame([labels[p] for p in places], columns=["category", "weaknesses", "rule"])

    return found(F.concat_ws(" ", *[F.coalesce(F.col(t) if isinstance(t, str) else t, F.lit("")) for t in texts]))


#: Rules over the words of the corpus, so that all kinds of rules meet texts that they hold in.
CORPUS_RULES = (
    Rule("two-branches", ("CWE-20", "CWE-74"), ((("schen", "keit"), ("ieren", "lich"), ("zu ",)), (("tion", "ment"), ("pour", "que"), ("é",)))),
    Rule("one-branch", ("CWE-200",), ((("the ", "and "), ("tion", "ing "), ("ther",)),)),
    Rule("inside-another", ("CWE-79",), ((("en",), ("then", "hen ")),)),
    Rule("one-word", (), ((("ie",),),)),
)


def text_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of all documents, by text and source."""
    k = F.col("k")
    docs = table(spark, sf_dir, "documents").select("doc_id", classified(["text", "source"], CORPUS_RULES).alias("k"))
    return docs.select("doc_id", k["category"].alias("category"), F.array_join(k["weaknesses"], ",").alias("cwes"), k["rule"].cast("long").alias("rule"))


def _sql(rule: Rule) -> str:
    return " OR ".join("(" + " AND ".join("(" + " OR ".join(f"contains(t, '{t}')" for t in g) + ")" for g in b) + ")" for b in rule.branches)


_PLACE = "CASE " + " ".join(f"WHEN {_sql(r)} THEN {n}" for n, r in enumerate(CORPUS_RULES)) + " ELSE -1 END"
_LABELS = ", ".join(f"({n}, '{r.category}', '{','.join(r.weaknesses)}')" for n, r in enumerate(CORPUS_RULES)) + f", (-1, '{DEFAULT[0]}', '')"
QUERIES = {f.__name__: f for f in (text_taxonomy,)}
ORACLES = {
    "text_taxonomy": f"WITH d AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || coalesce(source, '')) AS t FROM documents), p AS (SELECT doc_id, {_PLACE} AS rule FROM d) SELECT doc_id, category, cwes, CAST(rule AS BIGINT) AS rule FROM p JOIN (VALUES {_LABELS}) l(n, category, cwes) ON n = rule",
}
