"""Personal data, also where it is disguised: identifiers in the text as it stands, then in a normalised text whose spans
are mapped back to the source.

The base finds e-mail addresses, IP addresses, card numbers and phone numbers by pattern. The method adds what
disguises hide: a chain of transducers rewrites the text (homoglyphs and full-width or other decimal digits to ASCII,
invisible characters to nothing, "(at)", "[dot]" and their like to @ and full stops, runs of spelled digits to digits, four
groups of them with dot words between to an address, "plus" before a telephone number to +, and the words for @ and
full stop around what is an address as a whole, each spelled or not), and every rewriting keeps where each piece came from. The same patterns run over the result; a hit counts unless its source
span lies in a base span. One that goes beyond a base span (of which a disguised letter hid the rest, say) stands beside
it, and masking covers the union. Base spans always stay.

All offsets are code points of the source text, the end exclusive. Scans take time in proportion to the text: no
pattern starts anew inside a run that it has seen.

Edge cases. A null or empty text has no spans; the digest of no spans is that of the empty string. Whole texts are
scanned, however long. Repeated rows, ties and null ids are rows like others; an empty table gives an empty result.
Columns other than id and text are not read. Ids are whole numbers, or texts of such; others are an error.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import portions

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local@domain: each @ decides for the run of local characters before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        local = at - done - len(text[done:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if local else None
        done = at + 1
        if found:
            yield at - local, 0, found.end()
            done = found.end()
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def identifiers(text: str) -> list[Span]:
    """The base spans of a text, in order of start, then kind."""
    out = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(y := x.lstrip("0")) <= 3 and int(y or "0") <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass
class Mapped:
    """A text and, for pieces of it, where they come from: piece i starts at at[i]; its source is src[i]. A piece that
    was copied keeps its length, a rewritten one stands for a source span as a whole."""

    text: str
    at: list[int]
    src: list[tuple[int, int, bool]]

    @classmethod
    def plain(cls, text: str) -> Mapped:
        return cls(text, [0], [(0, len(text), True)])

    def source(self, start: int, end: int) -> tuple[int, int]:
        i = bisect.bisect_right(self.at, start) - 1
        a, b, copied = self.src[i]
        first = a + start - self.at[i] if copied else a
        i = bisect.bisect_right(self.at, end - 1) - 1
        a, b, copied = self.src[i]
        return first, a + end - self.at[i] if copied else b

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace spans of this text; edits are in order and apart."""
        if not edits:
            return self
        out, at, src, size, done = [], [], [], 0, 0

        def put(piece: str, source: tuple[int, int, bool]) -> None:
            nonlocal size
            if piece:
                out.append(piece)
                at.append(size)
                src.append(source)
                size += len(piece)

        def copy(a: int, b: int) -> None:
            while a < b:
                i = bisect.bisect_right(self.at, a) - 1
                to = min(b, self.at[i + 1] if i + 1 < len(self.at) else len(self.text))
                s, e, copied = self.src[i]
                put(self.text[a:to], (s + a - self.at[i], s + to - self.at[i], True) if copied else (s, e, False))
                a = to

        for a, b, new in edits:
            copy(done, a)
            put(new, (*self.source(a, b), False))
            done = b
        copy(done, len(self.text))
        return Mapped("".join(out), at, src)


# Letters of other scripts that look like ASCII letters, in pairs.
LOOKALIKES = "аaеeоoрpсcуyхxіiјjѕsһhԁdԛqԝwАAВBЕEКKМMНHОOРPСCТTХXЅSІIЈJαaοoνvρpιiυuΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXıiﾠ ․.。.．.﹒.＠@﹫@＋+"
# Digit words of English, French, German and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Last labels of domains in common use, the country codes among them.
ENDINGS = frozenset(
    "com org net edu gov mil int io info biz name pro app dev online site shop store tech xyz cloud blog mobi club "
    "ac ad ae af ag ai al am ao ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr "
    "ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz "
    "na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
# Words of English, German, French and Spanish that are no part of an address with spelled separators.
FUNCTION_WORDS = frozenset(
    "a an the this that these those and or but nor if then than so as at by do be am is are was were been it its he him his she her they them their we us our you your i me my no not in on of off to for from with into onto out up down over under about all any each "
    "some such what which who whom when where how why there here now just only very der die das den dem des ein eine einen und oder aber nicht ist sind war im am zum zur von mit bei auf aus nach le les un une et ou mais est sont du au aux dans sur pour par avec el los las una y o pero son del al en con por para".split()
)
# Words before a plain "at" that make what follows a place.
PLACED = FUNCTION_WORDS | frozenset(
    "available located found find see visit look looks looked looking live lives lived meet meets met seen read published hosted online order buy sold contact reach reached arrive arrived arrives stay stayed work works worked working job stop stopped start started aim aimed point points pointed stare stared smile smiled "
    "laugh laughed shop site website page hosting posted listed shown more details information info archived accessed store stored download downloaded register registered sign subscribe join team people developer engineer researcher editor author professor students staff office home based held begins ends good bad".split()
)
# Words for @ and for the full stop.
AT_WORDS, DOT_WORDS = ("at", "arobase", "arroba", "klammeraffe"), ("dot", "point", "punkt", "punto")


def _digit_map() -> dict[int, str]:
    out = {ord(a): b for a, b in zip(LOOKALIKES[::2], LOOKALIKES[1::2], strict=True)}
    for zero in (0x0660, 0x06F0, 0x0966, 0xFF10):  # Arabic-Indic, Persian, Devanagari and full-width digits
        out |= {zero + d: str(d) for d in range(10)}
    for a in range(26):
        out |= {0xFF21 + a: chr(65 + a), 0xFF41 + a: chr(97 + a)}
    return out


_GLYPHS = _digit_map()
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _GLYPHS) + "­​-‏⁠﻿]")
_HIDDEN = re.compile("[­​-‏⁠﻿]+")
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<![^\W\d_])(?:{_WORDS}|[0-9])(?:[\x20,-]{{1,2}}(?:{_WORDS}|[0-9])(?![^\W\d_])){{5,}}")
_PIECE = re.compile(rf"(?i){_WORDS}|[0-9]")
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_AT_BRACKETS = re.compile(rf"(?i)\x20?[\[({{<]\x20?(?:{_AT}|@)\x20?[\])}}>]\x20?")
_DOT_BRACKETS = re.compile(rf"(?i)\x20?[\[({{<]\x20?(?:{_DOT}|\.)\x20?[\])}}>]\x20?")
_STOP = rf"(?:\.|\x20(?:{_DOT})\x20)"
_AT_PLACE = re.compile(rf"(?i)(?<=[a-z0-9])(?:@|\x20({_AT})\x20)(?=[a-z0-9])")
_NAME_BEFORE = re.compile(rf"(?i)((?:[a-z0-9_%+.-]+\x20(?:{_DOT})\x20){{0,3}})([a-z0-9._%+-]*[a-z0-9])\Z")
_LABELS = re.compile(rf"(?i)[a-z0-9-]{{1,63}}+(?:{_STOP}[a-z0-9-]{{1,63}}+){{1,8}}+")
_BARE_DOT = re.compile(rf"(?i)\x20(?:{_DOT})\x20")
_SPLIT = re.compile(rf"(?i){_STOP}")
_UNIT = rf"(?:(?:{_WORDS})(?![^\W\d_])|[0-9])"
_GROUP = rf"{_UNIT}(?:(?:[\x20,-]{{1,2}}|(?<=[0-9])(?=[0-9])){_UNIT}){{0,2}}"
_SPELLED_IP = re.compile(rf"(?i)(?<![^\W_]){_GROUP}(?:(?:\.|[\x20,-]{{1,2}}(?:{_DOT})[\x20,-]{{1,2}}){_GROUP}){{3}}(?![^\W_])")
_IP_PIECE = re.compile(rf"(?i){_WORDS}|[0-9]|{_DOT}|\.")
_PLUS = re.compile(r"(?i)(?<![^\W_])plus[\x20,-]{1,2}(?=([0-9][\x20().0-9-]+[0-9]))")
_NUMBER = re.compile(r"[0-9]{1,3}(?:[\x20.][0-9]{3})+|[0-9]+\.[0-9]+")  # a count or a decimal number, no telephone number
_HINTS = tuple(f" {w} " for w in (*AT_WORDS, *DOT_WORDS))


def address_edits(text: str) -> list[tuple[int, int, str]]:
    """Rewritings of the words for @ and full stop, each spelled or not, of what is an address as a whole."""
    edits: list[tuple[int, int, str]] = []
    done = 0
    for m in _AT_PLACE.finditer(text):
        if m.start() < done or not (found := _LABELS.match(text, m.end())):
            continue
        name = _NAME_BEFORE.search(text[max(done, m.start() - 64) : m.start()])
        if not name:
            continue
        word, local = (m[1] or "").lower(), name[2].lower()
        plain = word == "at" and local.isalpha()  # nothing but the word "at" says that it is an address
        stops = list(_SPLIT.finditer(text, found.start(), found.end()))
        labels = [x.lower() for x in _SPLIT.split(found[0])]
        while len(labels) > 1 and not likely(labels, stops, plain, local):
            labels.pop()
            stops.pop()
        if len(labels) < 2:
            continue
        if word:
            edits += before_name(text, m.start(), name)
            edits.append((m.start(), m.end(), "@"))
        edits += [(x.start(), x.end(), ".") for x in stops if x[0] != "."]
        done = stops[-1].end() + len(labels[-1])
    return edits


def likely(labels: list[str], stops: list[re.Match], plain: bool, local: str) -> bool:
    last = labels[-1]
    if len(last) < 2 or not last.isalpha() or "" in labels or any(x[0] == "-" or x[-1] == "-" for x in labels):
        return False
    spelled = stops[-1][0] != "."
    whole = any(x[0] == "." for x in stops[:-1])  # what comes before is an address by itself
    if spelled and last in FUNCTION_WORDS and (plain or whole or last not in ENDINGS):
        return False
    if plain:
        return last in ENDINGS and local not in PLACED and labels[0] != "www" and FUNCTION_WORDS.isdisjoint(labels[:-1])
    return not (spelled and len(labels) == 2 and labels[0] in FUNCTION_WORDS)


def before_name(text: str, at: int, name: re.Match) -> list[tuple[int, int, str]]:
    """Rewritings of spelled full stops in the local part, back to the first word that is part of no address."""
    out: list[tuple[int, int, str]] = []
    first = at - len(name[0])
    for d in reversed(list(_BARE_DOT.finditer(text, first, at))):
        if text[first : d.start()].split(" ")[-1].lower() in PLACED:
            break
        out.insert(0, (d.start(), d.end(), "."))
    return out


def normalise(text: str) -> Mapped | None:
    """The text without disguises, or None if nothing in it looks like one."""
    out = Mapped.plain(text)
    if not text.isascii() and _ODD.search(text):
        glyphs = text.translate(_GLYPHS)  # one character for one: offsets stay
        out = Mapped.plain(glyphs).rewrite([(m.start(), m.end(), "") for m in _HIDDEN.finditer(glyphs)])
    low = out.text.lower()
    if any(b in low for b in "[({<") and (_AT_BRACKETS.search(low) or _DOT_BRACKETS.search(low)):
        out = out.rewrite([(m.start(), m.end(), "@") for m in _AT_BRACKETS.finditer(out.text)])
        out = out.rewrite([(m.start(), m.end(), ".") for m in _DOT_BRACKETS.finditer(out.text)])
    edits = []
    for m in _SPELLED_IP.finditer(out.text):
        if not m[0].replace(".", "").isdigit():
            pieces = (x.lower() for x in _IP_PIECE.findall(m[0]))
            edits.append((m.start(), m.end(), "".join("." if x in DOT_WORDS else DIGIT_WORDS.get(x, x) for x in pieces)))
    out = out.rewrite(edits)
    edits = []
    for m in _SPELLED.finditer(out.text):
        if not m[0].replace(" ", "").replace("-", "").replace(",", "").isdigit():
            edits.append((m.start(), m.end(), "".join(DIGIT_WORDS.get(x.lower(), x) for x in _PIECE.findall(m[0]))))
    out = out.rewrite(edits)
    low = out.text.lower()
    if "plus" in low:
        edits = []
        for m in _PLUS.finditer(out.text):
            if 9 <= len(_NOT_DIGIT.sub("", m[1])) <= 15 and not _NUMBER.fullmatch(m[1]):
                edits.append((m.start(), m.end(), "+"))
        out = out.rewrite(edits)
        low = out.text.lower()
    if any(h in low for h in _HINTS):
        out = out.rewrite(address_edits(out.text))
    return None if out.text == text else out


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    base = identifiers(text)
    mapped = normalise(text)
    more: set[Span] = set()
    if mapped:
        outer = sorted((s, e) for s, _, e in base)
        starts, reach, far = [s for s, _ in outer], [], 0
        for _, e in outer:
            far = max(far, e)
            reach.append(far)
        for s, kind, e in identifiers(mapped.text):
            a, b = mapped.source(s, e)
            i = bisect.bisect_right(starts, a) - 1
            if i < 0 or reach[i] < b:
                more.add((a, kind, b))
    return base, sorted([*base, *more])


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in portions(batches, "text"):
        columns: list[list] = [[] for _ in names[1:]]
        for text in batch.column("text"):
            base, every = find(text.as_py() or "")
            counts = [sum(1 for s in base if s[1] == k) for k in range(4)]
            row = (*counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), len(every))
            for c, x in zip(columns, row, strict=True):
                c.append(x)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_scan, SCHEMA)
    return out.withColumnRenamed("id", id_col)


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap go as one, of the longest one's kind."""
    if not text:
        return text
    out, done = [], 0
    group: list[Span] = []

    def close() -> None:
        nonlocal done
        if group:
            a, b = group[0][0], max(e for _, _, e in group)
            kind = max(group, key=lambda x: (x[2] - x[0], -x[1]))[1]
            out.extend([text[done:a], f"[{KINDS[kind]}]"])
            done = b
            group.clear()

    for span in find(text)[1]:
        if group and span[0] >= max(e for _, _, e in group):
            close()
        group.append(span)
    close()
    return "".join([*out, text[done:]])
