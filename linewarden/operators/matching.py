"""Every match of every rule in a line, with byte offsets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.arrays import let_sql, running_totals_sql
from linewarden.functions.dialect import sql_literal
from linewarden.functions.severity import RANKS
from linewarden.rules import Rule, anchor_bits

_HITS = "array<struct<rule:int,found:array<string>>>"
#: What :func:`line_matches` gives.
MATCHES = "array<struct<rule:int,column:int,evidence:string>>"


def _gate(rule: Rule, bits: dict[str, int]) -> list[str]:
    """SQL conditions without which the rule has no match in the line."""
    conditions = []
    if rule.anchors:
        conditions.append(f"(met & {sum(bits[name] for name in set(rule.anchors))}L) <> 0")
    if rule.skips_lock_files:
        conditions.append("NOT url_skipped")
    if rule.language:
        conditions.append(f"language = {sql_literal(rule.language)}")
    if rule.needs:
        conditions.append(f"contains(text, {sql_literal(rule.needs)})")
    return conditions


def _under_anchors(blocks: list[tuple[int, str]]) -> str:
    """The (anchors, block) that the line's anchors lead to, found by halves.

    A line has few of the anchors, and each condition is interpreted: most blocks are passed over
    together.
    """
    if len(blocks) == 1:
        return blocks[0][1]
    halves = []
    for half in (blocks[:len(blocks) // 2], blocks[len(blocks) // 2:]):
        anchors = 0
        for mask, _ in half:
            anchors |= mask
        halves.append(f"IF((met & {anchors}L) <> 0, {_under_anchors(half)}, CAST(array() AS {_HITS}))")
    return f"concat({', '.join(halves)})"


def _hits(rules: tuple[Rule, ...]) -> str:
    """Array of (rule position, matches) of the rules whose anchors the line has.

    Rules with the same gate are under one condition.
    """
    bits, met = anchor_bits(rules, "text")
    blocks, anchored = [], []
    by_gate = sorted(enumerate(rules), key=lambda item: _gate(item[1], bits))
    for gate, members in groupby(by_gate, key=lambda item: _gate(item[1], bits)):
        members = list(members)
        first = members[0][0]
        structs = ", ".join(
            f"named_struct('rule', {i}, 'found', "
            f"regexp_extract_all(text, {sql_literal(rule.java)}, 0))"
            for i, rule in members
        )
        block = f"array({structs})"
        if gate:
            block = f"CASE WHEN {' AND '.join(gate)} THEN {block} ELSE CAST(array() AS {_HITS}) END"
        anchors = sum(bits[name] for name in set(rules[first].anchors))
        if anchors:
            anchored.append((anchors, block))
        else:
            blocks.append(block)
    if anchored:
        blocks.append(_under_anchors(anchored))
    # As the argument of a higher-order function the rules are evaluated one by one; dozens
    # of regular expressions generated into one method would be too long for the JIT.
    return let_sql(met, "met", _HITS, f"filter(concat({', '.join(blocks)}), hit -> size(hit.found) > 0)")


@lru_cache(maxsize=64)
def line_matches(rules: tuple[Rule, ...]) -> str:
    """SQL for the array of (rule, column, evidence) of a line called ``text``.

    Matches are non-overlapping and leftmost per rule; rules may overlap each other.  The column
    is the byte offset in the line: the pieces between the matches are cut out with the same
    pattern, and lengths of pieces and matches are added up.  The rules also ask for
    ``url_skipped`` and ``language`` of the file.
    """
    if not rules:
        return f"CAST(array() AS {MATCHES})"
    branches = " ".join(
        f"WHEN {i} THEN split(text, {sql_literal(rule.java)}, -1)" for i, rule in enumerate(rules)
    )
    steps = let_sql(f"CASE hit.rule {branches} END", "pieces", "array<bigint>", (
        "transform(hit.found, (f, i) -> CAST(octet_length(get(pieces, i)) + "
        "IF(i > 0, octet_length(get(hit.found, i - 1)), 0) AS BIGINT))"
    ))
    placed = let_sql(running_totals_sql(steps), "places", MATCHES, (
        "transform(hit.found, (f, i) -> named_struct('rule', hit.rule, "
        "'column', CAST(get(places, i) AS INT), 'evidence', f))"
    ))
    matches = f"flatten(transform({_hits(rules)}, hit -> {placed}))"
    # takes out the runs that a rule's linear form has passed over
    whole = " ".join(
        f"WHEN {i} THEN m.evidence RLIKE {sql_literal(rule.java_whole)}"
        for i, rule in enumerate(rules) if rule.linear
    )
    return f"filter({matches}, m -> CASE m.rule {whole} ELSE true END)" if whole else matches


def match_all(lines: DataFrame, rules, keep: list[str]) -> DataFrame:
    """``keep``, line, rule (position in ``rules``), column, evidence for every match."""
    kept = [*keep, *[c for c in ("line",) if c not in keep]]
    return lines.select(*kept, F.expr(f"inline({line_matches(tuple(rules))})"))


@dataclass(frozen=True)
class PlacedRule:
    """A rule with the places of its analyzer and of itself in the report order.

    The places do not depend on which other rules run, so finding ids do not either.
    """

    analyzer_ord: int
    rule_ord: int
    rule: Rule


def described(placed: list[PlacedRule]) -> str:
    """SQL for what a finding of each rule says, by position."""
    return (
        "array("
        + ", ".join(
            f"named_struct('analyzer_ord', {p.analyzer_ord}, 'rule_ord', {p.rule_ord}, "
            f"'analyzer', {sql_literal(p.rule.analyzer)}, 'rule_id', {sql_literal(p.rule.rule_id)}, "
            f"'severity', '{p.rule.severity}', 'severity_rank', {RANKS[p.rule.severity]}, "
            f"'title', {sql_literal(p.rule.title)}, 'title_takes_match', {p.rule.title_takes_match}, "
            f"'description', {sql_literal(p.rule.description)}, 'remediation', "
            + (sql_literal(p.rule.remediation) if p.rule.remediation else "CAST(NULL AS STRING)")
            + ")"
            for p in placed
        )
        + ")"
    )
