"""Source context: snippets, token windows and lexical atoms of repository files."""

from __future__ import annotations

import hashlib
import re
import unicodedata

MAX_TERMS, MAX_DEPTH, MAX_STRING = 256, 128, 4 << 20
CONTROL = frozenset("catch do else for if switch synchronized try while".split())


def vhash(algorithm: str, *fields: str | None) -> str:
    """The framed SHA-256 of ``exprs.vhash`` for single values."""
    h = hashlib.sha256()
    for f in (algorithm, *fields):
        if f is None:
            h.update(b"\xff\xff\xff\xff")
        else:
            raw = f.encode("utf-8")
            h.update(len(raw).to_bytes(4, "big") + raw)
    return h.hexdigest()


def snippet(lines: list[str], start: int, end: int | None, radius: int) -> str | None:
    """Lines around a region, joined; null where the region starts past the end."""
    if start > len(lines):
        return None
    last = min(max(end or start, start), len(lines))
    return "\n".join(lines[max(start - radius, 1) - 1 : min(last + radius, len(lines))])


_TERM = re.compile(r"[_0-9A-Za-z\u0080-\U0010ffff]+|[^\s]")
_BLANK = re.compile(r"[\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def terms(text: str):
    """(line, term) of each identifier run or other sign of a text."""
    for number, line in enumerate(text.split("\n"), 1):
        at = 0
        while at < len(line):
            c = line[at]
            if _BLANK.match(c):
                at += 1
                continue
            end = at + 1
            if _word(c):
                while end < len(line) and _word(line[end]):
                    end += 1
            yield number, unicodedata.normalize("NFC", line[at:end])
            at = end


def _word(c: str) -> bool:
    return c == "_" or c >= "\u0080" or c.isalnum()


def token_window(text: str, start: int, end: int, limit: int = MAX_TERMS) -> tuple[str | None, str | None]:
    """(hash, refusal code) of up to ``limit`` terms around a region, as many before as after where there are."""
    before: list[str] = []
    inside: list[str] = []
    after: list[str] = []
    for line, term in terms(text):
        if len(term) > MAX_STRING:
            return None, "CANON0012"
        if line < start:
            before.append(term)
            if len(before) > 2 * limit:
                del before[:-limit]
        elif line <= end:
            if len(inside) == limit:
                return None, "CANON0011"
            inside.append(term)
        else:
            after.append(term)
            if len(after) == limit:
                break
    before = before[-limit:]
    left = limit - len(inside)
    want_before, want_after = left // 2, left - left // 2
    if len(before) < want_before:
        want_before, want_after = len(before), want_after + want_before - len(before)
    if len(after) < want_after:
        want_before, want_after = min(len(before), want_before + want_after - len(after)), len(after)
    chosen = before[len(before) - want_before :] + inside + after[:want_after]
    return (vhash("token-window/v1", *chosen) if chosen else None), None


_LEX = re.compile(
    r"""(?P<nl>\n)|(?P<space>[^\S\n]+)|(?P<line>//[^\n]*)|(?P<block>/\*(?s:.*?)\*/)|(?P<open>/\*)"""
    r"""|(?P<str>"(?s:\\.|[^"\\])*"|'(?s:\\.|[^'\\])*')|(?P<bad>["'])|(?P<word>[$_0-9A-Za-z\u0080-\U0010ffff]+)|(?P<sign>.)"""
)


def _hash_terms(domain: str, items: list[str]) -> str:
    return vhash("trusted-lexical-context/v1", domain, str(len(items)), *items)


def _method_like(header: list[str]) -> bool:
    if "(" not in header or ")" not in header:
        return False
    first = next((t for t in header if t[0] in "_$" or t[0].isalpha() or t[0] >= "\u0080"), None)
    return first is not None and first not in CONTROL


def lexical_atoms(text: str) -> list[tuple[str | None, str | None]]:
    """(hash, refusal) for each line: its exact one-line statement under the nearest method-like scope's header."""
    n = text.count("\n") + 1
    out: list[tuple[str | None, str | None]] = [(None, "no-statement")] * n
    scopes: list[str | None] = []
    header: list[str] = []
    overflowed = False
    line, current = 1, 0
    statement: list[str] = []
    early, brace = None, False

    def finish(stop: str | None = None) -> None:
        if not current:
            return
        if early or stop:
            out[current - 1] = (None, early or stop)
        elif brace:
            out[current - 1] = (None, "brace-on-line")
        elif statement:
            top = scopes[-1] if scopes else None
            if top is None:
                out[current - 1] = (None, "no-scope")
            else:
                out[current - 1] = (vhash("trusted-lexical-context/v1", top, _hash_terms("exact-statement", statement)), None)

    for m in _LEX.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "nl":
            line += 1
            continue
        if kind in ("space", "line"):
            continue
        if kind == "block":
            line += token.count("\n")
            continue
        if kind in ("open", "bad"):
            if current and current < line:
                finish()
            for i in range(line, n + 1):
                out[i - 1] = (None, "unterminated")
            return out
        began = line
        line += token.count("\n")
        token = unicodedata.normalize("NFC", token)
        if began != current:
            finish()
            current, statement, early, brace = began, [], None, False
        if early is None:
            if line != began:
                early = "not-single-line"
            elif token in "{}" and kind == "sign":
                brace = True
            elif len(statement) == MAX_TERMS:
                early = "too-many-terms"
            else:
                statement.append(token)
        if token == "{":
            if len(scopes) == MAX_DEPTH:
                finish("scope-too-deep")
                for i in range(current + 1, n + 1):
                    out[i - 1] = (None, "scope-too-deep")
                return out
            inherited = scopes[-1] if scopes else None
            scopes.append(_hash_terms("scope-header", header) if not overflowed and _method_like(header) else inherited)
            header, overflowed = [], False
        elif token == "}":
            if scopes:
                scopes.pop()
            header, overflowed = [], False
        elif token == ";":
            header, overflowed = [], False
        elif not overflowed:
            if len(header) == MAX_TERMS:
                header, overflowed = [], True
            else:
                header.append(token)
    finish()
    return out
