"""Function signatures and call sites of JavaScript and TypeScript sources.

A tokenizer and two scans over its tokens: no syntax tree, so broken sources
still give what can be told from their tokens. Recognised: function
declarations; variables bound to a function or an arrow function; class
methods; object methods; calls of an identifier or of a member, with or
without type arguments (``f<T>(x)``). Not recognised: computed and private
names, optional calls (which are no plain calls).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from riftscan.functions.workers import importable


class Token(NamedTuple):
    kind: str  # id, num, str, re, op
    text: str
    line: int


WORD = re.compile(r"[A-Za-z_$ª-￿][\w$ª-￿]*")
NUMBER = re.compile(r"(?:0[xob][0-9a-f_]+|[0-9][0-9_]*\.?[0-9_]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?)n?", re.I)
OPERATOR = re.compile(r"\.\.\.|=>|\?\.(?![0-9])|===|!==|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\*\*|[-+*/%&|^<>=!?:;,.(){}\[\]~@#]=?")
REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\\\]\n]|\\.)*\])+/[a-z]*")
BEFORE_VALUE = set("return typeof instanceof in of new delete void throw case do else yield await default".split())
STATEMENTS = set("if for while switch catch with return typeof await yield throw new delete void in of instanceof do else case function class super import async".split())
TYPE_PARTS = {".", ",", "|", "&", "=>", "..."}
MODIFIERS = set("static async get set public private protected readonly abstract override declare".split())


def tokens(source: str) -> list[Token]:
    out: list[Token] = []
    scan(source.removeprefix("﻿"), 1, out)
    return out


def scan(text: str, line: int, out: list[Token]) -> int:
    """Append the tokens of ``text``; the line on which it ends."""
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == "\n":
            line += 1
            at += 1
        elif c.isspace():
            at += 1
        elif text.startswith("//", at) or (c == "#" and at == 0 and text.startswith("#!")):
            end = text.find("\n", at)
            at = n if end < 0 else end
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = n if end < 0 else end + 2
            line += text.count("\n", at, end)
            at = end
        elif c in "\"'":
            end = at + 1
            while end < n and text[end] not in (c, "\n"):
                end += 2 if text[end] == "\\" else 1
            out.append(Token("str", text[at : end + 1], line))
            line += text.count("\n", at, min(end, n))
            at = end + 1 if end < n and text[end] == c else end
        elif c == "`":
            out.append(Token("str", "`", line))
            at += 1
            while at < n and text[at] != "`":
                if text[at] == "\\":
                    line += text.startswith("\n", at + 1)
                    at += 2
                elif text.startswith("${", at):
                    depth, end = 1, at + 2
                    while end < n and depth:
                        depth += {"{": 1, "}": -1}.get(text[end], 0)
                        end += 1
                    out.append(Token("op", "(", line))
                    line = scan(text[at + 2 : end - 1], line, out)
                    out.append(Token("op", ")", line))
                    out.append(Token("str", "`", line))
                    at = end
                else:
                    line += text[at] == "\n"
                    at += 1
            at += 1
        elif m := WORD.match(text, at):
            out.append(Token("id", m[0], line))
            at = m.end()
        elif c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit()):
            m = NUMBER.match(text, at)
            out.append(Token("num", m[0], line))
            at = m.end()
        elif c == "/" and value_may_start(out) and (m := REGEX.match(text, at)):
            out.append(Token("re", m[0], line))
            at = m.end()
        elif m := OPERATOR.match(text, at):
            out.append(Token("op", m[0], line))
            at = m.end()
        else:
            at += 1
    return line


def value_may_start(out: list[Token]) -> bool:
    if not out:
        return True
    last = out[-1]
    if last.kind == "id":
        return last.text in BEFORE_VALUE
    return last.kind == "op" and last.text not in (")", "]", "}")


def pairs_of(toks: list[Token]) -> dict[int, int]:
    """Index of the closing bracket of each opening one, and the other way round."""
    out, stack = {}, []
    for k, t in enumerate(toks):
        if t.kind == "op" and t.text in "([{":
            stack.append(k)
        elif t.kind == "op" and t.text in ")]}" and stack:
            o = stack.pop()
            out[o], out[k] = k, o
    return out


def param_names(toks: list[Token], pairs: dict[int, int], first: int, last: int) -> list[str]:
    """Parameters between two brackets, one text for each."""
    groups, k, group = [], first + 1, []
    angle = 0
    while k < last:
        t = toks[k]
        if t.text == "," and not angle:
            groups.append(group)
            group = []
            k += 1
            continue
        if group and t.text in ("<", ">"):
            angle = max(0, angle + (1 if t.text == "<" else -1))
        group.append(k)
        k = pairs[k] + 1 if t.text in ("(", "[", "{") and k in pairs else k + 1
    if group:
        groups.append(group)
    out = []
    for g in groups:
        while len(g) > 1 and toks[g[0]].text == "@":  # a decorator, with or without arguments
            g = g[2:]
            if g and toks[g[0]].text == "(":
                g = g[1:]
        if not g:
            continue
        head = toks[g[0]]
        default = any(toks[k].text == "=" for k in g)
        if head.text == "...":
            out.append("..." + (toks[g[1]].text if len(g) > 1 and toks[g[1]].kind == "id" else "rest"))
        elif head.text in ("{", "["):
            out.append("default" if default else head.text + ("}" if head.text == "{" else "]"))
        elif head.kind == "id" and head.text in ("public", "private", "protected", "readonly") and len(g) > 1 and toks[g[1]].kind == "id":
            out.append("unknown")
        elif head.kind == "id":
            out.append(head.text)
        else:
            out.append("unknown")
    return out


def after_type(toks: list[Token], pairs: dict[int, int], k: int, stops: tuple[str, ...]) -> int:
    """Skip a type annotation that may start at ``k``; the index of the first stop."""
    if k < len(toks) and toks[k].text == ":":
        k += 1
        start = k
        while k < len(toks) and (toks[k].text not in stops or (toks[k].text == "{" and k == start)) and toks[k].text != ";":
            k = pairs[k] + 1 if toks[k].text in ("(", "[", "{") and k in pairs else k + 1
    return k


class Signature(NamedTuple):
    name: str
    params: list[str]
    start_line: int
    end_line: int


def function_at(toks: list[Token], pairs: dict[int, int], k: int) -> tuple[list[str], int] | None:
    """Parameters and last token of a function or arrow function that starts at ``k``."""
    n = len(toks)
    if k < n and toks[k].text == "async":
        k += 1
    if k >= n:
        return None
    if toks[k].text == "function":
        k += 1
        if k < n and toks[k].text == "*":
            k += 1
        if k < n and toks[k].kind == "id":
            k += 1
        k = skip_angles(toks, k)
        if k in pairs and toks[k].text == "(":
            body = after_type(toks, pairs, pairs[k] + 1, ("{",))
            if body < n and toks[body].text == "{":
                return param_names(toks, pairs, k, pairs[k]), pairs.get(body, n - 1)
        return None
    k = skip_angles(toks, k)
    if k in pairs and toks[k].text == "(":
        arrow = after_type(toks, pairs, pairs[k] + 1, ("=>",))
        if arrow < n and toks[arrow].text == "=>":
            return param_names(toks, pairs, k, pairs[k]), end_of_body(toks, pairs, arrow + 1)
    elif k + 1 < n and toks[k].kind == "id" and toks[k + 1].text == "=>":
        return [toks[k].text], end_of_body(toks, pairs, k + 2)
    return None


def skip_angles(toks: list[Token], k: int) -> int:
    if k < len(toks) and toks[k].text == "<":
        depth = 0
        while k < len(toks):
            depth += {"<": 1, ">": -1}.get(toks[k].text, 0)
            k += 1
            if not depth:
                break
    return k


def end_of_body(toks: list[Token], pairs: dict[int, int], k: int) -> int:
    if k < len(toks) and toks[k].text == "{" and k in pairs:
        return pairs[k]
    while k < len(toks) and toks[k].text not in (";", ",", ")", "]", "}"):
        if toks[k].text in ("(", "[", "{") and k in pairs:
            k = pairs[k]
        if k + 1 < len(toks) and toks[k + 1].line > toks[k].line and toks[k + 1].kind == "id" and toks[k].kind != "op":
            return k
        k += 1
    return min(k, len(toks)) - 1


def braces(toks: list[Token], pairs: dict[int, int]) -> dict[int, tuple[str, str]]:
    """What each opening brace opens: ('class', name), ('object', '') or ('block', '')."""
    out: dict[int, tuple[str, str]] = {}
    for k, t in enumerate(toks):
        if t.kind == "id" and t.text == "class" and not (k and toks[k - 1].text in (".", "?.")):
            name = toks[k + 1].text if k + 1 < len(toks) and toks[k + 1].kind == "id" and toks[k + 1].text not in ("extends", "implements") else ""
            j = k + 1
            while j < len(toks) and toks[j].text not in ("{", ";"):
                j = pairs[j] + 1 if toks[j].text in ("(", "[") and j in pairs else j + 1
            if j < len(toks) and toks[j].text == "{":
                out[j] = "class", name
        elif t.text == "{" and t.kind == "op" and k not in out:
            last = toks[k - 1] if k else None
            value = last is not None and ((last.kind == "id" and last.text in ("return", "default", "in", "of", "typeof", "yield", "await")) or (last.kind == "op" and last.text not in (")", "}", ";", "{", "=>", "]", ">")))
            out[k] = ("object" if value else "block"), ""
    return out


def methods(toks: list[Token], pairs: dict[int, int], kinds: dict[int, tuple[str, str]]) -> dict[int, tuple[str, int, int, int]]:
    """Name token of each class or object method: (full name, first token, opening bracket, last token)."""
    out = {}
    for k, (kind, name) in kinds.items():
        if kind == "block" or k not in pairs:
            continue
        j, fresh = k + 1, True
        while j < pairs[k]:
            t = toks[j]
            if fresh:
                first, m = j, j
                while m < pairs[k] and ((toks[m].text in MODIFIERS and toks[m + 1].text not in ("(", "=", ":", ",", "}", ";", "<")) or toks[m].text == "*"):
                    m += 1
                p = skip_angles(toks, m + 1) if toks[m].kind == "id" else m + 1
                if toks[m].kind == "id" and p in pairs and toks[p].text == "(":
                    body = after_type(toks, pairs, pairs[p] + 1, ("{",))
                    if body < len(toks) and toks[body].text == "{" and body in pairs:
                        out[m] = (f"{name}.{toks[m].text}" if kind == "class" and name else toks[m].text), first, p, pairs[body]
                        j = pairs[body] + 1
                        fresh = True
                        if kind == "object":
                            fresh = False
                        continue
            fresh = t.text in (",",) if kind == "object" else t.text == ";"
            if kind == "class" and t.text in ("(", "[", "{") and j in pairs:
                j = pairs[j]
                fresh = toks[j].text == "}"
            elif t.text in ("(", "[", "{") and j in pairs:
                j = pairs[j]
            elif kind == "class" and j + 1 < pairs[k] and toks[j + 1].line > t.line and t.kind in ("num", "str"):
                fresh = True
            j += 1
    return out


def signatures(source: str) -> list[Signature]:
    """Signatures in the order in which they start."""
    toks = tokens(source)
    pairs = pairs_of(toks)
    found: list[tuple[int, Signature]] = []
    for k, t in enumerate(toks):
        if t.kind != "id":
            continue
        last = toks[k - 1] if k else None
        if t.text == "function" and (last is None or last.text in (";", "{", "}", ")", "export", "default", "async", "else", "do") or (last.kind != "op" and last.line < t.line and last.text not in BEFORE_VALUE)):
            if last is not None and last.text == "async" and k > 1 and toks[k - 2].text in ("=", "(", ",", ":", "=>", "return", "?"):
                continue
            j = k + 1 + (k + 1 < len(toks) and toks[k + 1].text == "*")
            made = function_at(toks, pairs, k)
            if made and j < len(toks) and toks[j].kind == "id":
                start = toks[k - 1].line if last is not None and last.text == "async" else t.line
                found.append((k, Signature(toks[j].text, made[0], start, toks[made[1]].line)))
        elif t.text in ("const", "let", "var"):
            j = k + 1
            while j < len(toks):
                name = toks[j]
                at = after_type(toks, pairs, j + 1, ("=", ",", ")"))
                if name.kind == "id" and at < len(toks) and toks[at].text == "=":
                    made = function_at(toks, pairs, at + 1)
                    if made:
                        found.append((j, Signature(name.text, made[0], name.line, toks[made[1]].line)))
                j = at
                while j < len(toks) and toks[j].text not in (",", ";", ")", "}"):
                    j = pairs[j] if toks[j].text in ("(", "[", "{") and j in pairs else j
                    if j + 1 < len(toks) and toks[j + 1].line > toks[j].line and toks[j + 1].kind == "id" and (toks[j].kind != "op" or toks[j].text in (")", "]", "}")):
                        j = len(toks)  # a new statement begins on a new line
                        break
                    j += 1
                if j >= len(toks) or toks[j].text != ",":
                    break
                j += 1
    for m, (name, first, p, end) in methods(toks, pairs, braces(toks, pairs)).items():
        found.append((m, Signature(name, param_names(toks, pairs, p, pairs[p]), toks[first].line, toks[end].line)))
    return [s for _, s in sorted(found, key=lambda x: x[0])]


def type_arguments(toks: list[Token]) -> dict[int, int]:
    """Index of the closing '>' of each '<' that follows a name and holds nothing but what types are made of."""
    out, opened = {}, []  # -1 stands for a bracket
    for k, t in enumerate(toks):
        if t.kind != "op":
            continue
        if t.text in "([{":
            opened.append(-1)
        elif t.text in ")]}":
            while opened and opened.pop() >= 0:
                pass
        elif t.text == "<" and k and toks[k - 1].kind == "id":
            opened.append(k)
        elif t.text == ">" and opened and opened[-1] >= 0:
            out[opened.pop()] = k
        elif t.text not in TYPE_PARTS:
            while opened and opened[-1] >= 0:
                opened.pop()
    return out


def call_sites(source: str) -> list[tuple[str, int]]:
    """(called function, line on which the call starts)."""
    toks = tokens(source)
    pairs = pairs_of(toks)
    defined = set(methods(toks, pairs, braces(toks, pairs)))
    typed = type_arguments(toks)
    out = []
    for k, t in enumerate(toks[:-1]):
        at = typed.get(k + 1, k) + 1
        if t.kind != "id" or at >= len(toks) or toks[at].text != "(" or toks[at].kind != "op" or k in defined:
            continue
        last = toks[k - 1] if k else None
        member = last is not None and last.text == "."
        if last is not None and last.text in ("?.", "#", "function", "new", "class"):
            continue
        if last is not None and last.text == "*" and k > 1 and toks[k - 2].text == "function":
            continue
        if t.text in STATEMENTS and not member:
            continue
        start, optional = k, False
        while start and toks[start - 1].text in (".", "?."):
            optional |= toks[start - 1].text == "?."
            start -= 2
            while start > 0 and toks[start].text in (")", "]") and start in pairs:
                start = pairs[start]
                if start and (toks[start - 1].kind in ("id", "str") and toks[start - 1].text not in STATEMENTS or toks[start - 1].text in (")", "]")):
                    start -= 1
                else:
                    break
            if start < 0:
                start = 0
                break
        if optional or (start and toks[start - 1].text == "new" and ")" not in {x.text for x in toks[start:k]}):
            continue
        out.append((t.text, toks[start].line))
    return out


@udtf(returnType="name string, params array<string>, start_line int, end_line int, seq int")
class JsSignatures:
    """Table function over a source; one that can't be read gives no rows."""

    def eval(self, source: str) -> Iterator[tuple]:
        try:
            found = signatures(source or "")
        except (IndexError, KeyError, RecursionError):
            return
        for k, s in enumerate(found):
            yield s.name, s.params, s.start_line, s.end_line, k


@udtf(returnType="called_function string, line int")
class JsCallSites:
    """Table function over a source; one that can't be read gives no rows."""

    def eval(self, source: str) -> Iterator[tuple]:
        try:
            found = call_sites(source or "")
        except (IndexError, KeyError, RecursionError):
            return
        yield from found


def register(spark: SparkSession) -> None:
    """Make both functions known to SQL as js_signatures and js_call_sites."""
    importable(spark)
    spark.udtf.register("js_signatures", JsSignatures)
    spark.udtf.register("js_call_sites", JsCallSites)
