"""Places of pattern matches in a text, and texts with such places replaced, as SQL expressions.

They are written as SQL text, which is parsed in one go: expressions of this
size made call by call take longer to make than to run.
"""

from __future__ import annotations

NONE = "cast(array() AS array<struct<start:int,end:int>>)"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, computed once for each row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def group_spans(column: str, pattern: str, length: str = "char_length(v)") -> str:
    """start and end (code points from 0, end exclusive) of group 2 of every match; group 1 is all that stands before it in a match.

    ``length`` says how much of the group's text ``v`` counts; nothing at 0.
    """
    p = literal(pattern)
    found = f"named_struct('w', w, 'gaps', split({column}, {p}, -1), 'leads', regexp_extract_all({column}, {p}, 1), 'values', regexp_extract_all({column}, {p}, 2))"
    start = "acc.at + char_length(get(r.gaps, i)) + char_length(get(r.leads, i))"
    n = let("get(r.values, i)", "v", length)
    new = let(f"named_struct('start', {start}, 'n', cast({n} AS int))", "x", f"CASE WHEN x.n > 0 THEN array(named_struct('start', x.start, 'end', x.start + x.n)) ELSE {NONE} END")
    step = f"named_struct('at', acc.at + char_length(get(r.gaps, i)) + char_length(get(r.w, i)), 'spans', concat(acc.spans, {new}))"
    fold = f"aggregate(sequence(0, size(w) - 1), named_struct('at', 0, 'spans', {NONE}), (acc, i) -> {step}, acc -> acc.spans)"
    return let(f"regexp_extract_all({column}, {p}, 0)", "w", f"CASE WHEN size(w) = 0 THEN {NONE} ELSE {let(found, 'r', fold)} END")


def united(spans: str) -> str:
    """Disjoint spans in order that cover what the given ones cover."""
    last = "try_element_at(acc, -1)"
    grown = f"concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', {last}.start, 'end', greatest({last}.end, x.end))))"
    step = f"CASE WHEN size(acc) > 0 AND x.start <= {last}.end THEN {grown} ELSE concat(acc, array(x)) END"
    return f"aggregate(array_sort({spans}), {NONE}, (acc, x) -> {step})"


def replaced(column: str, spans: str, by: str) -> str:
    """The text with each of some disjoint spans, in order, replaced."""
    step = f"named_struct('at', x.end, 'out', concat(acc.out, substring({column}, acc.at + 1, x.start - acc.at), {literal(by)}))"
    return f"aggregate({spans}, named_struct('at', 0, 'out', ''), (acc, x) -> {step}, acc -> concat(acc.out, substring({column}, acc.at + 1)))"
