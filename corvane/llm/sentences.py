"""Sentence units of documents in any script.

Blocks come first: a fenced code block, a heading, a list item with its mark and a ``Q:`` or ``A:`` line are one unit
each; what remains are paragraphs, in which a line break is only a blank. Inside a paragraph the sentence-break rules of
the Unicode standard apply by character property, read from the property tables of ``regex`` at import: the terminators of
all scripts (Sentence_Terminal), full stops that are doubtful (Sentence_Break=ATerm), marks that continue a sentence
(SContinue), closing marks that belong to the sentence before, and no break ahead of a lower-case letter after a full stop.
They are tailored by abbreviations of each language, by quotations and brackets within a larger sentence, by texts without
capitals, by missing blanks after a full stop, and by Thai, where a blank between Thai letters is the break.

A word of more than ``LONGEST`` characters is no abbreviation. ``he left. she stayed.`` is one sentence by the standard.

Offsets count code points. Defined results: NULL, empty and blank texts have no units.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import ship_package

#: Abbreviations that never end a sentence, by language (in lower case, without their last stop).
NEVER = {
    "en": "dr prof mr mrs messrs st sgt capt col gen lt rev hon pres gov sen rep vs cf e.g i.e eg ie viz al approx resp incl excl ed eds trans dept est",
    "de": "dr prof hr hrn fr frl dipl ing z d u v b h a o s vgl bzw evtl ggf inkl exkl sog tel str bsp usf zzgl ca mind max min allg z.b d.h u.a o.ä s.o s.u v.a i.d.r",
    "fr": "m mm mme mmes mlle mlles dr pr me cf p ex p.ex c.-à-d env av bd boul art chap éd ibid",
    "es": "sr sra srta sres sras dr dra d dña ud uds p ej p.ej aprox pág págs cap art ee núm av gral ing lic prof",
    "it": "sig sigra dott prof ing avv es p.es ecc art cap pag",
    "pt": "sr sra dr dra prof ex p.ex pág cap art av",
    "nl": "dhr mevr dr prof bijv d.w.z o.a m.b.t nl ca",
    "ru": "т е д п г-н г-жа им см ср рис стр табл гл ул др проф акад т.е т.к т.д т.п напр руб тыс млн млрд",
    "hi": "डॉ श्री प्रो कु",
    "ar": "د أ م ص",
    "pl": "np dr prof inż tzn tj m.in ul",
    "sv": "dr prof t.ex bl.a dvs osv",
}
#: Abbreviations that end a sentence only ahead of one that begins anew.
MAYBE = frozenset("etc usw u.s.w ecc etcétera a.m p.m u.s u.k u.n u.s.a uu inc ltd co corp gmbh bros jr sr plc llc г гг в вв bc ad b.c a.d no.s".split())
#: Abbreviations that don't end a sentence ahead of a number.
NUMBERED = frozenset("no nos nr nrn num núm nº n fig figs abb tab sec secs vol vols p pp pg ch chap kap abs art eq eqs ref refs ver v rev рис стр гл табл п № c cap pág page seite band bd lit ziff step item".split())
#: Time zones and the like that follow a.m. and p.m.
ZONES = frozenset("UTC GMT EST EDT CST CDT MST MDT PST PDT CET CEST BST IST JST utc gmt est edt cst pst cet cest bst ist jst".split())
#: German months, which follow an ordinal number with a stop.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Words that often begin a sentence, for texts without capitals and after doubtful abbreviations.
STARTERS = frozenset("the a an every both we if older you set it open use stop wait did at see never this that these those there he she they in on when while then however but and so our your each all some no yes what why how who where which dr prof .net der die das ein eine wenn danach zwischen wer le la les un une entre quand ensuite qui el los las luego cuando quién".split())
_NEVER = frozenset(x for words in NEVER.values() for x in words.split())

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)")
_FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t ]|$)")
_BULLET = re.compile(r"[ \t]*[-*+•‣·][ \t ]+\S")
_NUMBERED_ITEM = re.compile(r"[ \t]*(\d{1,4})[.)][ \t ]+\S")
_DIALOGUE = re.compile(r"[ \t]*[QA][ \t ]*[:：]")
_PLANES = "".join(map(chr, range(0x20000)))
#: Characters by property: what ends a sentence (with the ellipsis, which the standard leaves open), what doubtfully does, what continues it.
_TERMS = frozenset(regex.findall(r"\p{Sentence_Terminal}", _PLANES)) | {"…"}
_DOUBTFUL = frozenset(regex.findall(r"\p{Sentence_Break=ATerm}", _PLANES)) | {"…"}
_CONTINUES = frozenset(regex.findall(r"[\p{Sentence_Break=SContinue}--[\p{Pd}]]", _PLANES, flags=regex.V1)) | {";", "，"}
#: Brackets: an opening mark and the closing mark next to it in the standard.
_BRACKETS = {a: b for a, b in zip(_PLANES, _PLANES[1:], strict=False) if unicodedata.category(a) == "Ps" and unicodedata.category(b) == "Pe"}
_RUN = re.compile(f"[{re.escape(''.join(sorted(_TERMS)))}]+")
_SKIP = re.compile(r"`[^`\n]*(?:\n[^`\n]+)?`|(?:https?|ftp)://[^\s<>\"«»“”]*[^\s<>\"«»“”.,;:!?)\]]|(?<![\w.+-])[\w.+-]{1,64}@[\w-]{1,64}\.[\w.]{1,64}\w")
_PAIRS = {a: b for a, b in _BRACKETS.items() if a not in "{‚„"} | {"[": "]", "（": "）", "«": "»", "“": "”"}
_CLOSERS = frozenset(_PAIRS.values())
_OPENS = {b: a for a, b in _PAIRS.items()}
_MARKS = re.compile(f"[{re.escape(''.join(sorted(_CLOSERS | set(_PAIRS) | set('„'))))}\"]")
LONGEST = 64
_OPENERS = "\"'“„‚‘«「『(（[【《¿¡`*_"
_DENSE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_THAI = re.compile(r"[ก-ฺเ-๛]")
_THAI_GAP = re.compile(r"(?<=[ก-ฺเ-๛])[ \t \r\n]+(?=[ก-ฺเ-๛])")
_WORD_STOPS = frozenset("\"“”„«»(（[")
_WORD_AFTER = re.compile(r"\.?[^\W_]+")


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of the blocks, end exclusive: whole blocks are units, the others are paragraphs."""
    out: list[tuple[int, int, bool]] = []
    at, n = 0, len(text)
    kind, begin = "", 0  # the open block: "" none, "p" paragraph, "i" list item

    def close(end: int) -> None:
        nonlocal kind
        if kind:
            out.append((begin, end, kind == "i"))
        kind = ""

    while at < n:
        m = _LINE.match(text, at)
        line, start, at = m.group(), at, m.end()
        if not line.strip():
            close(start)
            continue
        fence = _FENCE.match(line)
        if fence and "`" not in line[fence.end() :]:
            close(start)
            mark = fence.group(1)
            end = n
            while at < n:
                m = _LINE.match(text, at)
                at = m.end()
                body = m.group().strip()
                if len(body) >= len(mark) and body == mark[0] * len(body):
                    end = at
                    break
            out.append((start, end, True))
            continue
        number = _NUMBERED_ITEM.match(line)
        if _HEADING.match(line) or _DIALOGUE.match(line):
            close(start)
            out.append((start, at, True))
        elif _BULLET.match(line) or (number and (kind != "p" or number.group(1) == "1")):
            close(start)
            kind, begin = "i", start
        elif not kind:
            kind, begin = "p", start
    close(n)
    return out


def _enclosed(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans to pass over (code, addresses), and spans of matched quotation marks and brackets (positions of both marks)."""
    skip = [m.span() for m in _SKIP.finditer(text, start, end)]
    spans, stack, straight, k = [], [], -1, 0
    held: Counter = Counter()  # the marks in the stack
    for m in _MARKS.finditer(text, start, end):
        i, ch = m.start(), m.group()
        while k < len(skip) and skip[k][1] <= i:
            k += 1
        if k < len(skip) and skip[k][0] <= i:
            continue
        if ch == '"':
            if straight < 0:
                straight = i
            else:
                spans.append((straight, i))
                straight = -1
        elif ch == "“" and stack and stack[-1][0] == "„":
            held["„"] -= 1
            spans.append((stack.pop()[1], i))
        elif ch in _PAIRS or ch == "„":
            stack.append((ch, i))
            held[ch] += 1
        elif held[_OPENS[ch]] or (ch == "”" and held["„"]):
            while True:  # marks above the one that is closed stay open
                opener, begin = stack.pop()
                held[opener] -= 1
                if _PAIRS.get(opener) == ch or (opener == "„" and ch == "”"):
                    spans.append((begin, i))
                    break
    return skip, sorted(spans)


def _ends(text: str, start: int, end: int) -> list[int]:
    """Ends (exclusive) of the sentences of a paragraph, but for its own end."""
    skip, spans = _enclosed(text, start, end)
    body = text[start:end]
    lower = not any(c.isupper() for c in body) and sum(c.islower() for c in body) >= 12
    closing = {b: a for a, b in spans}
    out: list[int] = []
    unit, k, first = start, 0, 0
    for m in _RUN.finditer(text, start, end):
        s, e = m.span()
        while k < len(skip) and skip[k][1] <= s:
            k += 1
        if k < len(skip) and skip[k][0] <= s < skip[k][1]:
            continue
        if s < unit:
            continue
        # closing marks right behind belong to the sentence; blanks only ahead of a guillemet
        after, opened = e, -1
        while after < end:
            probe = after
            if text[probe] in "   " and probe + 1 < end and text[probe + 1] == "»":
                probe += 1
            if probe in closing and closing[probe] < s:
                opened = closing[probe]
                after = probe + 1
            elif text[probe] in "'’”*_" and probe == after and probe not in closing and (probe + 1 >= end or text[probe + 1].isspace()):
                after = probe + 1
            else:
                break
        if after < end and text[after] in _TERMS:
            continue  # the run goes on behind the marks
        while first < len(spans) and spans[first][0] < unit:
            first += 1
        inside, i = False, first
        while i < len(spans) and spans[i][0] < s and not inside:
            inside = spans[i][1] > s and spans[i][1] >= after
            i += 1
        if inside:
            continue  # within a quotation or bracket that is still open
        rest = after
        while rest < end and text[rest].isspace():
            rest += 1
        if rest >= end:
            break
        if _breaks(text, start, unit, s, e, after, opened, rest, end, lower):
            out.append(after)
            unit = rest
    return out


def _breaks(text: str, start: int, unit: int, s: int, e: int, after: int, opened: int, rest: int, end: int, lower: bool) -> bool:
    run, nxt, spaced = text[s:e], text[rest], rest > after
    newline = spaced and ("\n" in text[after:rest] or "\r" in text[after:rest])
    dense = bool(_CJK.match(nxt)) or nxt in "「『“《"
    strong = any(c not in _DOUBTFUL for c in run)
    dots = not strong and (len(run) > 1 or "…" in run)
    if opened >= 0:
        if nxt in _CONTINUES or nxt in "—–-" or nxt.islower() and not lower:
            return False
        if not spaced and (nxt.isalnum() or _DENSE.match(nxt)):
            return opened <= unit and bool(_CJK.match(nxt)) and not re.match(r"[とってのをがはにで]", nxt)
        return spaced or not nxt.isalnum()
    if dots:
        if s > start and text[s - 1].isspace():
            return False
        if not spaced:
            return nxt.isupper() and text[s - 1].islower()
        if nxt.islower():
            return False
        return newline or not dense
    if strong:
        return nxt not in _CONTINUES
    # a full stop
    begin, low = s, max(start, s - LONGEST - 1)
    while begin > low and text[begin - 1] not in _WORD_STOPS and not text[begin - 1].isspace():
        begin -= 1
    word = text[begin:s]
    bare = word.lstrip("([{\"'“„«").lower() if len(word) <= LONGEST else ""
    if not word:
        return False
    if not spaced:
        if text[e - 1] != "." or "." in word or "_" in word or "/" in word or "`" in word:
            return nxt == "`" and word[-1:].isalpha() and "." not in word
        if len(word) >= 2 and word[-1].isalpha() and nxt.isupper() and (rest + 1 >= end or not text[rest + 1].isupper()) and (word[-1].islower() or _DENSE.match(word[-1]) or not word[-1].isascii()):
            return bare not in _NEVER
        if word[-1:].isupper() and len(word) == 2 and nxt.isupper() and word.isupper() and rest + 1 < end and text[rest + 1].islower():
            return True
        if nxt == "." and rest + 1 < end and text[rest + 1].isupper():
            return True
        if nxt in "\"“„«`(" and word[-1].isalpha() and len(word) > 2:
            return bare not in _NEVER
        if word[-1].isdigit() and nxt.isupper() and rest + 1 < end and text[rest + 1].islower():
            return True
        return bool(_DENSE.match(word[-1])) and bool(_DENSE.match(nxt))
    if nxt in _CONTINUES:
        return False
    follow = _WORD_AFTER.match(text, rest)
    following = follow.group() if follow else ""
    if len(bare) == 1 and bare.isalpha() and (word[-1].isupper() or lower or bare in _NEVER):
        return bare == "г" and nxt.isupper() and not lower
    if bare == "ms" and word[-2:-1] == "M":
        return False
    if bare in MAYBE:
        if bare in ("a.m", "p.m") and following in ZONES:
            return False
        if nxt.islower():
            return lower and following in STARTERS
        if bare in ("u.s", "u.k", "u.n", "u.s.a", "inc", "ltd", "co", "corp", "gmbh", "jr", "plc", "llc", "bros"):
            return following.lower() in STARTERS or not nxt.isalnum()
        return True
    if bare in NUMBERED and (nxt.isdigit() or (bare == "n" and nxt == "°")):
        return False
    if bare in _NEVER and not (bare in ("min", "max", "al", "est", "ed", "me", "m", "d", "a", "o", "s", "u", "v", "b", "h", "nl", "str", "in", "es", "ex", "ej") and len(bare) > 2 and nxt.isupper()):
        return False
    if "." in bare and re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]{1,2}", bare):
        return nxt.isupper() and following.lower() in STARTERS
    if bare.isdigit() and len(bare) <= 2 and (following.lower() in MONTHS or re.search(r"(?:^|\s)(?:am|vom|zum|bis|ab|seit|dem|den|der|im|jede|jeder|jedes)\s+\d+$", text[max(start, s - 14) : s], re.IGNORECASE)):
        return False
    if nxt.islower():
        return lower or bool(_DENSE.match(word[-1])) or (word[-1].isalpha() and unicodedata.category(word[-1]) in ("Lo", "Mn", "Mc"))
    return True


def _symbol_ends(text: str, start: int, end: int) -> list[int]:
    """Ends behind a symbol that stands for a sentence's mark: it follows a blank and a new line or capital follows it."""
    return [m.end(1) for m in re.finditer(r"[  ]([☀-➿⭐✅\U0001f300-\U0001faff]️?)(?=[ \t ]*[\r\n]|[ \t ]+[^\W\d_a-z])", text[start:end])]


def units(text: str) -> list[tuple[int, int]]:
    """(start, end) of every unit, end exclusive and behind the last character that is not white space."""
    out: list[tuple[int, int]] = []
    for start, end, whole in blocks(text):
        cuts = [end]
        if not whole:
            found = set(_ends(text, start, end)) | {start + x for x in _symbol_ends(text, start, end)}
            if _THAI.search(text, start, end):
                found |= {start + m.start() for m in _THAI_GAP.finditer(text[start:end])}
            cuts = sorted(found | {end})
        a = start
        for b in cuts:
            piece = text[a:b]
            core = piece.strip()
            if core:
                lead = len(piece) - len(piece.lstrip())
                out.append((a + lead, a + lead + len(core)))
            a = b
    return out


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit_no, start_char, end_char): the units of every document. A narrow map without shuffle.

    Keys are taken as unique: a document given twice gives its units twice.
    """
    ship_package(documents.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, starts, ends = [], [], [], []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, (a, b) in enumerate(units(body or "")):
                    ids.append(doc)
                    numbers.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(numbers, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "unit_no", "start_char", "end_char"])

    narrow = documents.select(F.col(key), F.col(text).cast("string").alias(text)).where(F.col(text) != "")
    return narrow.mapInArrow(split, f"{key} {dict(narrow.dtypes)[key]}, unit_no int, start_char int, end_char int")
