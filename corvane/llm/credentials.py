"""Credentials in source and configuration files: found by lexical tokens, blanked out in place.

A file is read as lexical tokens (names, string literals, comments and bare configuration values). A literal is a
credential if it is assigned or passed to a credential-named identifier, or has the form of an issued token, the
password of a URL or a private key block, and is not a placeholder, reference, path, checksum, identifier or label.
Redaction replaces only the characters of the literal, so delimiters, escapes and line structure stay.

Defined results: NULL or empty content has no findings; content that claims base64 but can't be decoded is read as it
stands, and bytes that are no UTF-8 come back as they were; extra columns pass through ``redact_files`` untouched.

Beside literals at credential names, line patterns take what no name announces: issued forms, passwords in addresses,
command options and key blocks.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import ship_package

#: Words that name a credential when they end an identifier, in several languages.
NAMES = (
    "password", "passwd", "passwort", "passphrase", "passcode", "pwd", "pass", "secret", "secrets", "token", "bearer", "credential", "credentials", "creds",
    "apikey", "authtoken", "accesstoken", "secretkey", "privatekey", "accesskey", "signingkey", "encryptionkey", "authorization",
    "pw", "login", "logon", "identified", "clave", "contrasena", "contraseña", "contrasenha", "senha", "motdepasse", "mdp", "kennwort", "geheimnis", "wachtwoord", "parola", "haslo", "heslo", "parol",
    "пароль", "密码", "密碼", "口令", "パスワード", "暗証番号", "비밀번호", "รหัสผ่าน", "पासवर्ड",
)
#: Words before "key" that make it a credential's name.
KEY_OF = ("api", "access", "secret", "signing", "sign", "encryption", "encrypt", "private", "auth", "master", "service", "account", "shared", "storage", "client", "license", "deploy", "webhook", "session", "cipher", "hmac", "aes", "jwt")
#: Words that make a name speak about a credential instead of holding it.
ABOUT = ("public", "pub", "sha", "sha1", "sha256", "checksum", "digest", "fingerprint", "hash", "id", "ids", "name", "names", "label", "labels", "path", "file", "dir", "url", "uri", "length", "count", "max", "min", "ttl", "type", "hint", "title", "prompt", "regex", "pattern", "field", "header", "env", "var", "ref", "placeholder", "size", "limit", "policy", "expiry", "version")

#: Lines worth reading token by token, judged by a linear-time automaton over all lines of a batch: they name a credential
#: or have the form of one, and hold a value of mixed characters or leave it to the next lines.
_HINT = (
    r"(?i)passw|sshpass|passphr|passcode|pwd|[_\-.]pass|\bpass\b|\bpw\b|secret|token|key|credential|creds|auth|bearer|clave|contrase|senha|mot_?de_?passe|mdp|kennwort|geheimnis|wachtwoord|parol|haslo|heslo|пароль|密码|密碼|口令|パスワード|暗証番号|비밀번호|รหัสผ่าน|पासवर्ड"
    r"|login|logon|identified|curl|://[^\s/\"'@:]*:[^\s/\"'@]+@|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|[sr]k_live_|sk_test_|AIza|eyJ|npm_|pypi-|hf_|SG\.|sk-|shpat_|dop_v1_|ya29\."
)
_VALUE = r"[0-9][^\s\"'`()\[\]{},;]*\pL|\pL[^\s\"'`()\[\]{},;]*[0-9]|[A-Za-z0-9+/_-]{20}|\pL[!#$%^&*?+~@]+\pL|[(\[{=:,\\+|>]\s*$|name:|key:|PRIVATE KEY|variable |[\"'](?:[\pL0-9]+ ){3}|(?i)phrase"
#: The forms of issued tokens.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[\w-]{16,}|xox[abeprs]-[A-Za-z0-9-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{30,}"
    r"|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|hf_[A-Za-z0-9]{24,}|SG\.[\w-]{16,}\.[\w-]{16,}|sk-[A-Za-z0-9_-]{24,}|shpat_[a-f0-9]{24,}|dop_v1_[a-f0-9]{32,}|ya29\.[\w-]{20,})"
)
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINES = re.compile(r"(?:(?:\\[nrt]|[\s\"'+,]|//|#|\*)*[A-Za-z0-9+/=]{16,}(?![A-Za-z0-9_.(]))*")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,30}://([^\s/\"'@:?#<>]{0,200}):([^\s/\"'@]{1,500})@[A-Za-z0-9\[]")
_PARAM = re.compile(r"[?&;,\s\"']((?:[A-Za-z]{1,40}[_-]){0,6}[A-Za-z]{1,40})=([^&;\s\"'<>,)]+)")
_SCHEME = re.compile(r"\b(?:Bearer|Basic|token|Token|ApiKey|apikey)\s+([^\s\"'<>,;]{8,})")
_TOKEN = re.compile(
    r"(?P<str>[bBrRfFuU]{0,2}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`))"
    r"|(?P<name>[^\W\d][\w]*(?:[-.][^\W\d]\w*)*)|(?P<num>\d[\w.]*)|(?P<nl>\n)|(?P<op>[^\s\w])",
    re.DOTALL,
)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zßñçéè]+|[^\W\d_A-Za-z]+|\d+")
#: Words that begin a placeholder if only words, or a short number, follow them.
_STAND_INS = "your|my|insert|enter|put|replace|change|todo|tbd|fixme|example|sample|dummy|fake|placeholder|redacted|removed|masked|hidden|secret|password|none|null|nil|undefined|test"
_PLACEHOLDER = re.compile(
    rf"^(?:{_STAND_INS})(?:(?:[-_. ]|(?-i:(?=[A-Z])))[-_. A-Za-z]*\d{{0,3}}[.!]?)?$"
    r"|change-?_?me|placeholder|redacted|your[_-]|_here\b|example-only|^<.*>$|^\$|^%|^\{\{|\$\{|\{\{|%\(|^\(.*\)$|^[xX*.•#?_-]+$|x{6,}|X{6,}|\*{3,}|\.\.\.|EXAMPLE",
    re.IGNORECASE,
)
#: A phrase of words set apart by single blanks, none of them a sentence's mark.
_PHRASE = re.compile(r"[^\W_]+(?:[ ][^\W_]+){2,}[!#*]?")
_UUID = re.compile(r"^\{?[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\}?$")
_PLAIN = re.compile(
    r"^(?:[\w.-]*\.(?:py|js|ts|go|json|ya?ml|xml|txt|bin|pem|crt|key|sql|cfg|ini|toml|env|html?|css|md|log|sh)|[~./][\w./~-]*|[a-z0-9_.-]+(?:/[a-z0-9_.-]+)+|v?\d+(?:\.\d+)+\w*|\d{4}-\d\d-\d\d.*"
    r"|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*_?\d{0,3}|[a-z]+(?:[_-][a-z]+)*[_-]?\d{1,3}|[A-Z][a-z]+(?:[A-Z][a-z]+)*\d{0,2}|[\w.-]+:\d{2,5}|[a-z]+://[^\s@]*|arn:.*|[a-z]+(?:[.:-][a-z]+)+)$"
)
_CONFIG = re.compile(r"(?:^|/)(?:[^/]*dockerfile[^/]*|\.env[^/]*|[^/]*\.env[^/]*|\.npmrc|\.netrc|\.pypirc|\.pgpass|credentials|makefile)$|\.(?:ya?ml|properties|ini|cfg|conf|toml|env|sh|bash|npmrc|dockerfile|local|prod|dev|txt|md|tf|tfvars|netrc)$", re.IGNORECASE)
_BARE = re.compile(r"(?m)^[ \t]*(?:(?:#|//|--|;|\*|/\*+|export|ENV|ARG|set|-|<!--)[ \t]*)*[\"']?(?:[^\s\"'=:]*:)?((?:[\w-]+\.)*[\w-]+)[\"']?[ \t]*(?:=|:(?!//)|[ \t](?=[^\s=:]+[ \t]*$))[ \t]*([^\s\"'`,;(){}\[\]<>]+)[ \t]*(?:#.*|-->|\*/)?\r?$")
_XML = re.compile(r"<((?:[\w-]+[:.])*[\w-]+)(?:\s[^<>]*)?>([^<>\s]+)</")
_DEFAULT = re.compile(r"\$\{([A-Za-z_][\w.]*)\s*:[-=?]?([^\s{}\"']+)\}")
_OPTION = re.compile(r"(?<![\w-])--?([A-Za-z][\w-]*)[ =]+[\"']?([^\s\"'`\\]+)")
_PAIR = re.compile(r"(?:-u|--user)[ =]+[\"']?[^\s\"':]+:([^\s\"']+)")
_SPOKEN = re.compile(r"\b(?:login|logon|passw(?:or)?d|passphrase|credentials?|creds|pwd)\b", re.IGNORECASE)
_SAID = re.compile(r"(?:^|[\s:=/(\"'])([A-Za-z][A-Za-z0-9]{0,60}[_.!%#*?-]?[A-Za-z]{0,60}\d(?:[\w!%#*?.-]{0,200}[\w!%#*?])?)(?=[\s,;)\"']|$)")


def names_credential(name: str, cache: dict[str, bool] = {}) -> bool:  # noqa: B006
    """Whether an identifier, in any letter case and joining style, names a credential that it holds."""
    known = cache.get(name)
    if known is None:
        words = [w.lower() for w in _WORDS.findall(re.split(r"[.:]", name.lstrip("-"))[-1])]  # what stands ahead of a dot is a place
        while words and words[-1].isdigit():
            words.pop()
        joined = "".join(words)
        known = bool(words) and not (set(words[-1:]) | set(words[:1])) & set(ABOUT) and (
            words[-1] in NAMES
            or joined.endswith(("password", "passwd", "passphrase", "apikey", "secretkey", "authtoken", "accesstoken", "motdepasse"))
            or (words[-1] in ("key", "keys", "api", "auth") and len(words) > 1 and (words[-2] in KEY_OF or words[-2] in NAMES))
            or (words[-1] == "key" and words[0] == "x")
            or words[-1] in ("setbasicauth", "basicauth") or joined.endswith("basicauth") or joined == "auth"
        )
        if len(cache) < 200_000:
            cache[name] = known
    return known


def usable(value: str, name: str = "") -> bool:
    """Whether a literal can be a live credential: mixed characters, no placeholder, reference, path or plain name.

    A phrase of words counts for names that speak of one, or of four words or more with a digit among them.
    """
    n = len(value)
    if n < 7 or _PLACEHOLDER.search(value) or _UUID.match(value):
        return False
    if any(c.isspace() for c in value):
        words = value.count(" ") + 1
        return n >= 16 and _PHRASE.fullmatch(value) is not None and ("phrase" in name.lower() or (words > 3 and any(c.isdigit() for c in value) and value[0].islower()))
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    if not letters:
        return False
    if not digits:
        kinds = any(c.islower() for c in value) + any(c.isupper() for c in value) + any(not c.isalnum() and c not in "_-./:" for c in value)
        return n >= 12 and kinds >= 2 and not _PLAIN.match(value) and len(set(value)) >= 9 and (n >= 20 or kinds == 3) or (n >= 8 and kinds == 3 and re.search(r"[^\W\d_][!#$%^&*?+~@]+[^\W\d_]", value) is not None and len(set(value)) >= 7)
    if _PLAIN.match(value) and not re.fullmatch(r"[0-9a-f]{24,}|[0-9A-F]{24,}", value) and not (n >= 24 and re.search(r"[A-Z]", value) and re.search(r"[a-z]", value)):
        return False
    return len(set(value)) >= 5


#: Lines for which a bracket that never closes is followed, unless it holds a value in pieces.
NEAR = 8


def _body(text: str, start: int, end: int) -> tuple[int, int]:
    """The span inside a literal's prefix and quotes."""
    while text[start] not in "\"'`":
        start += 1
    q = 3 if text.startswith(text[start] * 3, start) and end - start >= 6 else 1
    return start + q, end - q


def _reach(text: str, start: int, end: int, unclosed: dict) -> int:
    """Where tokens of a line may end: behind the line, or behind a string of several lines that it opens.

    ``unclosed`` keeps the marks that nothing closes any more, so they are looked for but once.
    """
    reach = end
    for mark in ("\"\"\"", "'''", "`"):
        if mark in unclosed and unclosed[mark] <= start or text.count(mark, start, end) % 2 == 0:
            continue
        close = text.find(mark, end)
        if close < 0:
            unclosed[mark] = min(unclosed.get(mark, end), end)
        else:
            reach = max(reach, close + len(mark))
    return min(len(text), reach + 1)


def _lexical(text: str, start: int, end: int, found: dict[int, tuple[int, str]], unclosed: dict[int, int]) -> None:
    """Literals assigned or passed to credential names among the tokens from start, until the statement or bracket closes.

    A bracket that never closes holds a value in pieces, or else counts for ``NEAR`` lines only. ``unclosed`` has the depths
    at line ends behind which none closes, so a text with many such brackets is followed to its end but once.
    """
    holder, depth, pieces, lines, whole = "", 0, [], 0, True
    opened: list[str] = []
    limit = _reach(text, start, end, unclosed)  # slides along with the lines
    passed: dict[int, int] = {}
    near = False  # whether the first piece stands within ``NEAR`` lines

    def settle() -> None:
        """Judge the literals gathered for the current holder: as one value in pieces, else the first usable one."""
        if len(pieces) > 1 and whole and usable("".join(text[a:b] for a, b in pieces), holder):
            for i, (a, b) in enumerate(pieces):
                found.setdefault(a, (b, "rest" if i else "pieces"))
            return
        for a, b in pieces:
            if usable(text[a:b], holder):
                found.setdefault(a, (b, "literal"))
                return

    last, at = "", start
    while m := _TOKEN.search(text, at, limit):
        kind, s, at = m.lastgroup, m.group(), m.end()
        if kind == "nl":
            lines += 1
            if m.start() >= end and not holder:
                break
            if holder and lines > NEAR and not (whole and near):
                if near and lines == NEAR + 1 and any(usable(text[a:b]) for a, b in pieces):
                    break
                if depth >= unclosed.get(at, depth + 1):
                    return
                if depth > 0:
                    passed[at] = depth
            if holder and not (depth > 0 or last in ("=", "(", "[", "+", ",", ":", "\\", "{", "&", ".")):
                settle()
                holder, pieces, depth, whole = "", [], 0, True
                if m.start() >= end:
                    break
            if at > end:
                close = text.find("\n", at)
                limit = max(limit, _reach(text, at, close if close >= 0 else len(text), unclosed))
            continue
        if kind == "str":
            a, b = _body(text, m.start(), m.end())
            inner = text[a:b]
            if m.start() < end and len(inner) < 60 and names_credential(inner) and not usable(inner):
                if holder and pieces:
                    settle()
                holder, pieces, depth, whole = inner, [], 0, True
            elif holder:
                near = near or lines <= NEAR
                pieces.append((a, b))
        elif kind == "name":
            if m.start() < end and names_credential(s):
                if holder and pieces:
                    settle()
                    pieces = []
                holder, depth, whole = s, 0, True
        elif kind == "op":
            if pieces and (s not in "+([,])&.\\;}" or (s == "," and depth > 0 and opened[-1:] != ["["])):
                if whole and near and lines > NEAR and len(pieces) > 1:
                    break
                whole = False  # the literals aren't one value in pieces
            if s in "([{":
                opened.append(s)
            elif s in ")]}" and opened:
                opened.pop()
            if s in "([":
                depth += 1
            elif s in ")]":
                depth -= 1
                if depth < 0 and s == "]":  # a name as subscript
                    depth = 0
                elif depth < 0 and holder:
                    settle()
                    holder, pieces, depth, whole = "", [], 0, True
            elif s in ";}" or (s == "," and depth <= 0 and pieces) or (s == "{" and last == "="):
                if holder:
                    settle()
                holder, pieces, depth, whole = "", [], 0, True
            if m.start() >= end and not holder:
                break
        last = s
    else:
        if holder and depth > 0 and lines > NEAR and not (whole and near):
            unclosed.update(passed)
            return
    if holder:
        settle()


def candidate_lines(texts: list[str]) -> dict[int, list[int]]:
    """The numbers (from 0) of the lines worth reading, by position of the text; other texts are left out."""
    lines = pc.split_pattern(pa.array([_printable(t) for t in texts], pa.large_string()), "\n")
    flat = lines.flatten()
    keep = pc.and_(pc.match_substring_regex(flat, _HINT), pc.match_substring_regex(flat, _VALUE))
    hits = np.flatnonzero(keep.to_numpy(zero_copy_only=False))
    offsets = lines.offsets.to_numpy()
    owner = np.searchsorted(offsets, hits, side="right") - 1
    out: dict[int, list[int]] = {}
    for k, line in zip(owner.tolist(), (hits - offsets[owner]).tolist(), strict=True):
        out.setdefault(k, []).append(line)
    return out


def spans(text: str, path: str = "", candidates: list[int] | None = None) -> list[tuple[int, int, str]]:
    """Every credential literal of a text as (start, end, kind), in order, none within another."""
    if candidates is None:
        candidates = candidate_lines([text]).get(0, [])
    if not candidates:
        return []
    found: dict[int, tuple[int, str]] = {}
    config = bool(_CONFIG.search(path))
    starts, at = [], 0
    for line in text.split("\n"):
        starts.append(at)
        at += len(line) + 1
    starts.append(at)
    unclosed: dict[int, int] = {}
    for k in candidates:
        start, end = starts[k], starts[k + 1] - 1
        _line(text, start, end, text[start:end], config, path, found, unclosed)
    out: list[tuple[int, int, str]] = []
    for a in sorted(found):
        b, kind = found[a]
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


def _line(text: str, start: int, end: int, line: str, config: bool, path: str, found: dict[int, tuple[int, str]], unclosed: dict[int, int]) -> None:
    if "PRIVATE KEY" in line:
        for m in _KEY_BLOCK.finditer(line):
            close = text.find("-----END", start + m.end())
            if close < 0:  # a block that nothing closes ends with its last line of key material
                close = _KEY_LINES.match(text, start + m.end()).end()
            body = text[start + m.end() : close]
            if len(re.findall(r"[A-Za-z0-9+/]", body.replace("\\n", ""))) >= 40 and "PRIVATE KEY" not in body and len(set(body)) > 12 and "..." not in body:
                found[start + m.start()] = (close, "key")
        if not re.search(r"(?i)passphrase|password", line):
            return
    for m in _ISSUED.finditer(line):
        if not _PLACEHOLDER.search(m.group()):
            found.setdefault(start + m.start(), (start + m.end(), "issued"))
    if "://" in line:
        for m in _URL.finditer(line):
            if usable(m.group(2)) or (len(m.group(2)) >= 5 and m.group(1) and re.search(r"\d", m.group(2)) and re.search(r"[A-Za-z]", m.group(2)) and not _PLACEHOLDER.search(m.group(2))):
                found.setdefault(start + m.start(2), (start + m.end(2), "url"))
    if "=" in line:
        for m in _PARAM.finditer(line):
            if names_credential(m.group(1)) and usable(m.group(2).rstrip("/>`")):
                found.setdefault(start + m.start(2), (start + m.end(2), "parameter"))
    for m in _SCHEME.finditer(line):
        value = m.group(1).rstrip("`)")
        if usable(value):
            found.setdefault(start + m.start(1), (start + m.start(1) + len(value), "header"))
    for m in _DEFAULT.finditer(line):
        if names_credential(m.group(1)) and usable(m.group(2)):
            found.setdefault(start + m.start(2), (start + m.end(2), "fallback"))
    if "<" in line:
        for m in _XML.finditer(line):
            if names_credential(m.group(1)) and usable(m.group(2)):
                found.setdefault(start + m.start(2), (start + m.end(2), "element"))
    if "-" in line:
        for m in _OPTION.finditer(line):
            if (m.group(1) in ("p", "a") or names_credential(m.group(1))) and usable(m.group(2)):
                found.setdefault(start + m.start(2), (start + m.end(2), "option"))
    stripped = line.lstrip(" \t")
    for m in _PAIR.finditer(line):
        if usable(m.group(1)):
            found.setdefault(start + m.start(1), (start + m.end(1), "option"))
    comment = stripped.startswith(("#", "//", "--", "*", "/*", ";", "<!--"))
    if (comment or config) and _SPOKEN.search(line):
        for m in _SAID.finditer(line, _SPOKEN.search(line).end()):
            if usable(m.group(1)) and re.search(r"[!%#*?_.-]", m.group(1)):
                found.setdefault(start + m.start(1), (start + m.end(1), "spoken"))
    if config or stripped.startswith(("#", "//", "--", "*", "/*", ";", "<!--")):
        for m in _BARE.finditer(line):
            if names_credential(m.group(1)) and usable(m.group(2)):
                found.setdefault(start + m.start(2), (start + m.end(2), "setting"))
        pair = re.match(r"[ \t]*-?[ \t]*(?:name|key):[ \t]*[\"']?([\w.-]+)[\"']?[ \t]*\r?$", line)
        if pair and names_credential(pair.group(1)):
            after = re.compile(r"\n[ \t]*value:[ \t]*[\"']?([^\s\"']+)").match(text, end)
            if after and usable(after.group(1)):
                found.setdefault(after.start(1), (after.end(1), "setting"))
        block = re.match(r"[ \t]*-?[ \t]*[\"']?([\w.-]+)[\"']?[ \t]*:[ \t]*[|>][-+]?[ \t]*\r?$", line)
        if block and names_credential(block.group(1)):
            after = re.compile(r"\n[ \t]+([^\s\"':]+)[ \t]*(?=\r?\n|$)").match(text, end)
            if after and usable(after.group(1)):
                found.setdefault(after.start(1), (after.end(1), "setting"))
    if path.endswith((".tf", ".tfvars")) and (m := re.match(r"\s*variable\s+\"([^\"]+)\"", line)) and names_credential(m.group(1)):
        close = re.compile(r"\n(?:\}|variable\b)|\Z").search(text, end).start()
        after = re.compile(r"\bdefault\s*=\s*\"([^\"]*)\"").search(text, end, close)
        if after and usable(after.group(1)):
            found.setdefault(after.start(1), (after.end(1), "fallback"))
    if any(q in line for q in "\"'`") or line.rstrip().endswith(("(", "=", "[", "\\", "{", ":")):
        _lexical(text, start, end, found, unclosed)


def decoded(content: str | None, encoding: str | None) -> str:
    """The text of a file; base64 content is decoded (its line breaks are ignored). Bytes that are no UTF-8 stand as
    surrogates, so ``encoded`` gives them back."""
    if not content:
        return ""
    if encoding == "base64":
        try:
            return base64.b64decode(content).decode("utf-8", "surrogateescape")
        except (binascii.Error, ValueError):
            return content
    return content


def encoded(text: str) -> str:
    """The base64 form, with line breaks, of a text that ``decoded`` gave."""
    return base64.encodebytes(text.encode("utf-8", "surrogateescape")).decode()


def _printable(text: str) -> str:
    """The text with surrogates, which Arrow doesn't take, replaced one by one."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode() if any("\ud800" <= c <= "\udfff" for c in text) else text


MASK = "REDACTED"


def redact(text: str, path: str = "", candidates: list[int] | None = None) -> str:
    """The text with the characters of every credential replaced; line breaks inside (key blocks) stay."""
    out, at = [], 0
    for a, b, kind in spans(text, path, candidates):
        out.append(text[at:a])
        if kind == "key":
            head = _KEY_BLOCK.match(text, a).end()
            out.append(text[a:head] + re.sub(r"(?:(?!\\[nrt])[^\s\"'\\])+", MASK, text[head:b]))
        else:
            out.append("" if kind == "rest" else MASK)
        at = b
    out.append(text[at:])
    return "".join(out)


def find_credentials(files: DataFrame, tag: str) -> DataFrame:
    """(tbl, file_id, line_no, kind): the lines on which credentials begin; ``files`` has file_id, path, content, encoding.

    A narrow map without shuffle; a file repeated in the input gives its lines again, so callers deduplicate if keys repeat.
    """
    ship_package(files.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines, kinds = [], [], []
            keys, paths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [decoded(c, e) for c, e in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            for k, candidates in candidate_lines(texts).items():
                text, file_id, at, line = texts[k], keys[k], 0, 0
                for a, _, kind in spans(text, paths[k] or "", candidates):
                    if kind == "rest":
                        continue
                    line += text.count("\n", at, a)
                    at = a
                    ids.append(file_id)
                    lines.append(line + 1)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(lines, pa.int64()), pa.array(kinds, pa.string())], names=["tbl", "file_id", "line_no", "kind"])

    narrow = files.select(F.col("file_id").cast("bigint"), F.col("path").cast("string"), F.col("content").cast("string"), F.col("encoding").cast("string"))
    return narrow.where(F.col("content") != "").mapInArrow(scan, "tbl string, file_id bigint, line_no bigint, kind string")


def redact_files(files: DataFrame) -> DataFrame:
    """The files with credentials in ``content`` blanked out; base64 content is decoded, redacted and encoded again.

    All other columns pass through. NULL and empty contents stay as they are.
    """
    ship_package(files.sparkSession)
    at, enc, path = files.columns.index("content"), files.columns.index("encoding"), files.columns.index("path")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, encodings, paths = batch.column(at).to_pylist(), batch.column(enc).to_pylist(), batch.column(path).to_pylist()
            texts = [decoded(c, e) for c, e in zip(new, encodings, strict=True)]
            for k, candidates in candidate_lines(texts).items():
                clean = redact(texts[k], paths[k] or "", candidates)
                if clean != texts[k]:
                    new[k] = encoded(clean) if encodings[k] == "base64" and texts[k] is not new[k] else clean
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return files.mapInArrow(rewrite, files.schema)
