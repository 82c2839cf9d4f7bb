"""Sentence boundaries across languages and scripts.

The rules are those of the standard sentence-break property, in their order: SB5 (marks and format characters belong to
what they follow), SB6 (ATerm x Numeric), SB7 (Upper or Lower, ATerm x Upper), SB8 (ATerm Close* Sp* x no letter or
terminator* Lower), SB8a (SATerm Close* Sp* x SContinue or SATerm), SB9 and SB10 (closers and blanks stay with
the terminator), SB11 (then break), SB998 (no break elsewhere). They are tailored as the standard allows:

* SB4: a paragraph, heading, list item or fence separates; a line break inside a paragraph is a blank;
* SB8: digits end the look-ahead, a name with an underscore or inner capital starts a sentence, and in paragraphs without any
  capital lower case says nothing;
* SB8a: a dash before a capital or a quotation opens, and does not continue;
* SB11: without a blank only terminators of scripts written without blanks break;
* abbreviations are suppressed by the paragraph's language; a quotation stays in the sentence that carries it, and
  a sentence in brackets after a full one is its own;
* Thai, Lao, Khmer and Burmese end sentences with a space.

A paragraph's language is that of its script or, in Latin script, of its function words; where it has none, that of the whole text,
then of the label; if all tell nothing the abbreviations of all languages count.

Null, empty and blank texts give no unit. Offsets count code points. CRLF is a
line break like LF. A fence that is never closed hides nothing: its lines are text. Whole texts are processed, in one pass per text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations after which a sentence goes on. Fixed values, by language. A capital means that the word must be written with one, unless its paragraph has none.
NEVER_LAST = {
    "en": "Mr Mrs Ms Mx Dr Drs Prof St Ste Messrs Mmes Rev Hon Gen Col Capt Cpt Cmdr Lt Sgt Cpl Pvt Maj Adm Sen Rep Gov Pres Amb Supt Det Insp Fr Sr Br viz cf e.g i.e vs approx ca esp incl resp i.a op.cit loc.cit ibid Mt Ft Ave",
    "de": "Hr Hrn Fr Frl Dr Prof Dipl Ing Mag Hptm Lt St bzw z.b d.h u.a z.t i.d.r o.ä i.a m.e s.o s.u u.u v.a ca vgl bzgl ggf gegebenenf inkl exkl evtl sog abb tab bspw insb einschl ausschl zzgl abzgl max. min. geb gest jew lt mind allg ugs hrsg verf",
    "fr": "M MM Mme Mmes Mlle Mlles Dr Drs Pr Me Mgr Vve St Ste env p.ex cf c.-à-d éd adj av bd boul",
    "es": "Sr Sra Sres Sras Srta Srtas Dr Dra Dres Dras Prof Profa D Dña Dn Exmo Exma Excmo Excma Ilmo Ilma Rvdo Gral Cnel Cap Lic Ing Arq Mons Pbro p.ej d.ª ud uds vd vds aprox avda cf",
    "pt": "Sr Sra Srs Sras Srta Dr Dra Drs Dras Prof Profa Exmo Exma Ilmo Ilma Eng Arq Gen Cel Cap Ten Maj D Pe Dom p.ex aprox av cf",
    "it": "Sig Sigg Sig.ra Dott Dott.ssa Prof Prof.ssa Avv Ing Arch Geom Rag On Sen Mons Rev Gen Col Cap p.es ecc. cfr ca es",
    "nl": "Dhr Mevr Mw Dr Drs Ir Ing Mr Prof Ds St bijv bv d.w.z o.a m.b.t i.v.m t.a.v ca vgl incl excl resp zgn evt",
    "pl": "Dr Prof Mgr Inż Hab dr prof mgr inż hab lek gen płk ppłk mjr kpt por św ks ul al pl np tzn tj m.in ok wg por. zob ww tzw",
    "tr": "Dr Prof Doç Yrd Av Sn Alb Gen Org Hz bkz örn vb. vs. çev haz yay mah cad sok",
    "sv": "Dr Prof Hr t.ex bl.a d.v.s dvs s.k m.a.o jfr ca resp inkl exkl ung",
    "da": "Dr Prof Hr Fr f.eks bl.a d.v.s jf ca inkl ekskl pga vedr",
    "cs": "Dr Prof Ing Mgr Bc MUDr JUDr PhDr RNDr Doc např tzv tj resp popř cca srov ul nám",
    "ro": "Dl Dna Dr Prof Ing Av Gen Col dvs. de ex cf aprox str",
    "ru": "т.е т.к т.н см ср стр рис напр проф акад доц д-р гр ул пр пл пер гл илл им г-н г-жа тел проч. обл р-н",
    "uk": "т.зв див пор стор рис напр проф акад доц вул просп пл гл ім",
    "bg": "т.нар вж стр фиг напр проф акад доц ул бул гл им",
    "el": "Κ Κα Κος Κκ Δρ κ κα κος κκ δρ π.χ δηλ βλ πρβλ καθ αρ λ.χ",
    "hi": "डॉ श्री श्रीमती प्रो पं कु सु",
    "ar": "د أ م ص",
    "he": "ד״ר פרופ׳ גב׳",
}
#: Abbreviations that go on before a number. Fixed values, by language.
BEFORE_NUMBER = {
    "en": "no nos nr fig figs sect sec p pp l ll vol vols ch chap eq eqs art tab ex pt par para ver v ed Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": "nr nrn s bd bde kap abs art abb tab z zeile vers Jan Feb Apr Aug Sept Okt Nov Dez",
    "fr": "n° no nos fig figs p pp l vol chap art tabl al éq janv févr avr juil sept oct nov déc",
    "es": "n° nº núm núms pág págs p pp fig figs cap vol art tabla ec ene feb mar abr jun jul ago sept oct nov dic",
    "pt": "n° nº núm pág págs p pp fig figs cap vol art tab jan fev mar abr jun jul ago set out nov dez",
    "it": "n nn num pag pagg p pp fig figg cap vol art tab gen feb mar apr giu lug ago set ott nov dic",
    "nl": "nr nrs blz p pp fig figs hfst art tab jan feb mrt apr jun jul aug sep okt nov dec",
    "pl": "nr s str rys tab rozdz art ust poz r",
    "tr": "no s sf şek tab böl md cilt",
    "sv": "nr s sid fig tab kap art st",
    "da": "nr s fig tab kap art stk",
    "cs": "č s str obr tab kap čl odst",
    "ro": "nr p pag fig tab cap art alin",
    "ru": "стр с рис гл табл п пп ст т № илл разд",
    "uk": "стор с рис гл табл п ст т",
    "bg": "стр с фиг гл табл т чл ал",
    "el": "σελ σ εικ κεφ αρ πιν παρ",
    "hi": "पृ सं क्र",
}
#: Abbreviations that end a sentence unless lower case or a number follows. Fixed values, by language.
MAY_BE_LAST = {
    "en": "etc al Corp Inc Ltd Co LLC Plc a.m p.m min max Jr Sr est dept Bros Esq Ph.D M.D B.A M.A b.c a.d",
    "de": "usw etc u.s.w u.a.m u.ä o.ä max min Co St.",
    "fr": "etc max min Cie",
    "es": "etc max min máx mín a.m p.m Cía",
    "pt": "etc max min máx mín Cia Ltda",
    "it": "ecc etc max min",
    "nl": "enz etc max min",
    "pl": "itd itp r w godz min",
    "tr": "vb vs",
    "sv": "m.m osv etc",
    "da": "m.m osv etc",
    "cs": "atd apod",
    "ro": "etc ș.a",
    "ru": "др г гг т.д т.п пр в вв тыс млн руб",
    "uk": "ін р рр тощо",
    "bg": "др г",
    "el": "κ.λπ κ.ά κλπ",
}
#: Of these, the ones that mostly end their sentence in paragraphs without capitals. Fixed values.
_MOSTLY = frozenset("etc usw enz ecc osv itd atd т.д т.п".split())
#: Words by which a sentence starts rather than a name goes on, after initials such as those of a country. Fixed values.
STARTERS = frozenset("the a an this that these those it he she they we you i in on at by for from with as if when while but and or however also there then after before since what why who how no not his her its our their".split())
#: Month names after an ordinal number with a full stop. Fixed values.
MONTHS = frozenset("januar jänner februar feber märz april mai juni juli august september oktober november dezember".split())
#: Function words that tell languages of Latin script apart. Fixed values.
FUNCTION_WORDS = {
    "en": "the a an as on in of and to is are was were at into still again that it with for not this by from be which has have but they he she his its or if when we you",
    "de": "der die das und ist sind war nicht ein eine einen mit von zu den dem des auf für wird werden bis noch im am er sie es wir wenn danach oder",
    "fr": "le la les et est sont des une du dans que qui pas pour par sur avec au aux il elle nous vous ne ensuite puis cette ce ou",
    "es": "el los las y es son una del que no en por para con se su al está están como más pero luego cada usted este esta o",
    "pt": "o os as e é são uma do da dos das que não em por para com se seu ao está como mais mas ele ela um",
    "it": "il lo gli e è sono una di del della dei che non in per con si su al come più ma questo questa un",
    "nl": "de het een en is zijn van niet in op voor met dat die te aan door als maar ook wordt werd",
    "pl": "i w na jest są nie się do z że to od po za jak ale był była o przez dla oraz",
    "tr": "ve bir bu için ile da de değil var olarak daha çok gibi ama ne o her kadar sonra",
    "sv": "och är en ett det som på inte av för med till den de att har var om men",
    "da": "og er en et det som på ikke af for med til den de at har var om men",
    "cs": "a je jsou se v na že to s z do pro ale jak by byl byla nebo po",
    "ro": "și este sunt un o de la în cu pe nu din că pentru care mai dar sau",
}
_FUNCTION: dict[str, list[str]] = {}
for _k, _v in FUNCTION_WORDS.items():
    for _w in _v.split():
        _FUNCTION.setdefault(_w, []).append(_k)


class _Suppressions:
    """The abbreviations of one language or of all: lower-case forms, with those that must be capital apart."""

    def __init__(self, languages):
        pick = lambda table: [w.rstrip(".") for k in languages for w in table.get(k, "").split()]
        self.never, self.number, self.maybe = (frozenset(w.lower() for w in pick(t)) for t in (NEVER_LAST, BEFORE_NUMBER, MAY_BE_LAST))
        every = [w for t in (NEVER_LAST, BEFORE_NUMBER, MAY_BE_LAST) for w in pick(t)]
        self.capital = frozenset(w.lower() for w in every) - frozenset(w for w in every if w == w.lower())


_BY_LANGUAGE = {k: _Suppressions([k]) for k in NEVER_LAST}
_NONE, _ALL = _Suppressions([]), _Suppressions(list(NEVER_LAST))
#: First and last code point of the letters of scripts, with the language taken for each; Latin has none. Fixed values.
_SCRIPTS = [
    (0x0041, 0x024F, ""), (0x0370, 0x03FF, "el"), (0x0400, 0x052F, "ru"), (0x0590, 0x05FF, "he"), (0x0600, 0x06FF, "ar"), (0x0900, 0x097F, "hi"), (0x0E00, 0x0E7F, "th"),
    (0x1200, 0x137F, "am"), (0x1E00, 0x1EFF, ""), (0x1F00, 0x1FFF, "el"), (0x3040, 0x30FF, "ja"), (0x4E00, 0x9FFF, "zh"), (0xAC00, 0xD7A3, "ko"),
]
_FIRST = [a for a, _, _ in _SCRIPTS]
#: Words that are no part of a name with digits, underscores or dots inside.
_WORDS = regex.compile(r"(?<![\w.])[\p{L}\p{M}]+(?!\w)")


def _language_of(text: str, start: int, end: int) -> str | None:
    """By the script of most words or, if that is Latin, by function words; None if neither tells."""
    words = _WORDS.findall(text, start, end)
    other = [w for w in words if w[0] > "\u024f"]
    if 2 * len(other) > len(words):
        scripts: dict[str, int] = {}
        for w in other:
            at = bisect_right(_FIRST, ord(w[0])) - 1
            script = _SCRIPTS[at][2] if ord(w[0]) <= _SCRIPTS[at][1] else ""
            scripts[script] = scripts.get(script, 0) + 1
        return max(scripts, key=scripts.get) or None
    votes: dict[str, int] = {}
    for w in words:
        for k in _FUNCTION.get(w.lower(), ()):
            votes[k] = votes.get(k, 0) + 1
    if not votes:
        return None
    n = max(votes.values())
    best = [k for k, v in votes.items() if v == n]
    return best[0] if len(best) == 1 else None


class _Language:
    """Finds the suppressions of a paragraph when first asked for."""

    def __init__(self, text: str, label: str | None):
        self.text, self.label = text, (label or "").strip().lower()[:2]
        self._whole: list[str | None] = []

    def of(self, start: int, end: int) -> _Suppressions:
        found = _language_of(self.text, start, end)
        if found is None:
            if not self._whole:
                self._whole.append(_language_of(self.text, 0, len(self.text)))
            found = self._whole[0] if self._whole[0] in FUNCTION_WORDS else None
        if found is None and self.label in FUNCTION_WORDS:
            found = self.label
        return _ALL if found is None else _BY_LANGUAGE.get(found, _NONE)


_LINE = regex.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_FENCE = regex.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
_HEADING = regex.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = regex.compile(r"[ \t]*(?:[-*+•‣◦]|\(?\d{1,4}[.)])[ \t]+(?=\S)")
_RULE = regex.compile(r"[ \t]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|={3,})$")

_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "«": "»", "‹": "›", "“": "”", "„": "“", "‘": "’", "‚": "‘"}
_BRACKETS = frozenset("([{（［【")
_OPENERS = "".join(_PAIRS) + '"'
_CLOSERS = frozenset([*_PAIRS.values(), '"'])
_MARK = regex.compile(r"[\"()\[\]{}（）［］「」『』《》〈〉【】«»‹›“”„]")
#: Terminators of all scripts, the ellipsis, the Greek question mark in both codings and the bar used for a danda.
_END = regex.compile(r"(?:[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…]|(?<=\p{Greek});|(?<=\p{Devanagari}[ \t]?)\|)+")
_WIDE = regex.compile(r"[。｡！？．︒⋯]")
_STEM = regex.compile(r"(?:[\p{L}\p{M}]+\.)*[\p{L}\p{M}\d°ª]+\Z")
_LEADING = regex.compile(r"[\s\-—–]*")
#: SContinue and what else joins: closing brackets, percent and equals signs. Dashes that open were passed before.
_CONTINUES = regex.compile(r"[\p{Sentence_Break=SContinue}\p{Sentence_Break=STerm}--[—–-]]|[;；)\]}%=]", regex.V1)
_APART = regex.compile(r"(?<![\p{L}\p{M}])(\p{L}{1,2})\.\s*\Z")
_EXTEND = regex.compile(r"[\p{Sentence_Break=Extend}\p{Sentence_Break=Format}]")
_NEXT_APART = regex.compile(r"(?:\p{L}|\p{Ll}{2})\.")
_AFTER_DIGIT = regex.compile(r"\d\s*\Z")
_INITIALS = regex.compile(r"\p{Lu}(?:\.\p{Lu})+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
_UPPER = regex.compile(r"\p{Lu}")
_LOWER = regex.compile(r"\p{Ll}")
_NO_CASE = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_THAI = regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")
_THAI_GAP = regex.compile(r"(?<=[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\"”»’)\]])[ \t 　]+(?=[^\s\p{N}\p{Latin}])")


def sentences(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of every unit, in order, without white space around it. ``lang``: a label, used where the text does not tell."""
    if not text or text.isspace():
        return []
    out: list[tuple[int, int]] = []
    language = _Language(text, lang)
    for start, end, scan in _blocks(text):
        lowercased = not _UPPER.search(text, start, end) and bool(_LOWER.search(text, start, end))
        _split(_Paragraph(text, start, end, lowercased, language), scan, out)
    return out


class _Paragraph:
    """What the rules look at: the text, where the paragraph ends, whether it has no capitals, and its language's suppressions."""

    __slots__ = ("text", "start", "end", "lowercased", "language", "_suppressions")

    def __init__(self, text: str, start: int, end: int, lowercased: bool, language: _Language):
        self.text, self.start, self.end, self.lowercased, self.language, self._suppressions = text, start, end, lowercased, language, None

    @property
    def suppressions(self) -> _Suppressions:
        if self._suppressions is None:
            self._suppressions = self.language.of(self.start, self.end)
        return self._suppressions


def _fenced(text: str) -> list[tuple[int, int]]:
    """The closed fences, from the opening line to the end of the closing one."""
    if "```" not in text and "~~~" not in text:
        return []
    marks = []  # (start, end, fence, whether it may close)
    for m in _LINE.finditer(text):
        if m.start() < m.end() and (opened := _FENCE.match(line := m.group().rstrip("\r\n"))):
            marks.append((*m.span(), opened.group(1), not line[opened.end() :].strip(" \t")))
    out, at = [], 0
    while at < len(marks):
        start, _, fence, _ = marks[at]
        close = next((k for k in range(at + 1, len(marks)) if marks[k][3] and marks[k][2].startswith(fence)), None)
        if close is None:
            at += 1
            continue
        out.append((start, marks[close][1]))
        at = close + 1
    return out


def _blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """``(start, end, scan)`` of headings, items and paragraphs; ``scan``: where its words begin, the end for one that is not split."""
    fences, next_fence = _fenced(text), 0
    open_at = scan = end = -1
    for m in _LINE.finditer(text):
        a, b = m.span()
        if a == b:
            break
        while next_fence < len(fences) and a >= fences[next_fence][1]:
            next_fence += 1
        line = m.group().rstrip("\r\n")
        # A fence line without its partner only separates.
        fenced = next_fence < len(fences) and a >= fences[next_fence][0] or bool(_FENCE.match(line))
        item = None if fenced else _ITEM.match(line)
        heading = not fenced and _HEADING.match(line)
        blank = not line.strip()
        if (fenced or blank or heading or item or _RULE.match(line)) and open_at >= 0:
            yield open_at, end, scan
            open_at = -1
        if fenced:
            continue
        if heading:
            yield a, a + len(line), a + len(line)
        elif not blank and not _RULE.match(line):
            if open_at < 0:
                open_at = a
                scan = a + item.end() if item else a
            end = a + len(line)
    if open_at >= 0:
        yield open_at, end, scan


def _spans(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost pairs of quotes and brackets; what has no partner is left out."""
    stack: list[tuple[str, int]] = []
    awaited: Counter = Counter()
    found: list[tuple[int, int]] = []
    for m in _MARK.finditer(text, start, end):
        c, i = m.group(), m.start()
        at = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c) if awaited[c] else None
        if c == '"' and at is None or c != '"' and c in _PAIRS and not (c == "“" and at is not None and at == len(stack) - 1):
            stack.append(('"' if c == '"' else _PAIRS[c], i))
            awaited[stack[-1][0]] += 1
        elif at is not None:
            found.append((stack[at][1], i + 1))
            awaited.subtract(x for x, _ in stack[at:])
            del stack[at:]
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
    return outer


def _split(p: _Paragraph, scan: int, out: list[tuple[int, int]]) -> None:
    text, start, end = p.text, p.start, p.end
    cuts: list[int] = []
    if scan < end:
        spans = _spans(text, scan, end)
        events = [(m.end(), 0, m.start()) for m in _END.finditer(text, scan, end)]
        events += [(b, 1, a) for a, b in spans]
        if _THAI.search(text, scan, end):
            events += [(m.start(), 2, m.end()) for m in _THAI_GAP.finditer(text, scan, end)]
        events.sort()
        first, k = scan, 0
        for at, kind, other in events:
            while k < len(spans) and spans[k][1] < at:
                k += 1
            if kind != 1 and k < len(spans) and spans[k][0] < at < spans[k][1] + (kind == 0):
                continue
            if kind == 0:
                cut = _after_terminator(p, other, at)
            elif kind == 1:
                cut = _after_span(p, other, at, first)
            else:
                cut = at
            if cut is not None and cut < end:
                cuts.append(cut)
                first = cut
    previous = start
    for cut in [*sorted(set(cuts)), end]:
        a, b = previous, cut
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b and (_WORD.search(text, a, b) or not out or cut != end):
            out.append((a, b))
        elif a < b and out:
            out[-1] = (out[-1][0], b) if out[-1][0] >= start else out[-1]
        previous = cut


def _next(text: str, at: int, end: int) -> tuple[int, bool]:
    """Where the next thing that is not blank is, and whether blanks lie before it."""
    i = at
    while i < end and text[i].isspace():
        i += 1
    return i, i > at


def _opens(p: _Paragraph, i: int) -> bool | None:
    """SB8 and SB8a at ``i``, past closers and blanks: False where the sentence goes on, True where a capital starts one, None if case tells nothing."""
    text, end = p.text, p.end
    dash = text[i] in "—–"
    while i < end and (text[i] in _OPENERS or text[i] in "¿¡—–" or text[i].isspace()):
        i += 1
    if i >= end:
        return True
    c = text[i]
    if _CONTINUES.match(c):  # SB8a; what opens was passed above
        return False
    if c.islower():  # SB8
        word = _WORD.match(text, i, end).group()
        if "_" in word or any(x.isupper() for x in word):
            return True
        return False if dash else None if p.lowercased else False
    if c.isupper() or c.istitle():
        return True
    return None


def _after_terminator(p: _Paragraph, a: int, at: int) -> int | None:
    """Where the sentence ends that may end with the terminators ``text[a:at]``; None if it goes on. The rules in their order."""
    text, end = p.text, p.end
    marks = text[a:at]
    while at < end and (text[at] in _CLOSERS and text[at] not in '"“' or text[at] > "\x7f" and _EXTEND.match(text[at])):  # SB5, SB9
        at += 1
    i, gap = _next(text, at, end)  # SB10
    if i >= end:
        return at
    c = text[i]
    ellipsis = "…" in marks or ".." in marks
    if not gap:
        # SB6, SB7 and SB998: without a blank only terminators of scripts written without blanks end a sentence.
        if ellipsis or not (_WIDE.search(marks) or marks[-1] in "!?" and _NO_CASE.match(c) or ord(marks[-1]) > 0x52F and marks[-1] not in "…"):
            return None
        return at if c not in "，、；：，;:)）」』”" else None
    opens = _opens(p, i)
    if opens is False:
        return None
    if ellipsis:
        if _NO_CASE.match(c) and a > 0 and _NO_CASE.match(text[a - 1]) and not gap:
            return None
        spaced = a > 0 and text[a - 1].isspace()
        return None if spaced and (opens is None or c.isdigit()) else at
    if marks == ".":
        stem = _STEM.search(text, max(0, a - 24), a)
        if stem and _goes_on(p, stem.group(), stem.start(), i, opens):
            return None
    return at  # SB11


def _goes_on(p: _Paragraph, stem: str, begin: int, i: int, opens: bool | None) -> bool:
    """Whether the full stop after ``stem`` belongs to an abbreviation or ordinal inside a sentence."""
    text, end = p.text, p.end
    if begin > 0 and (text[begin - 1] in "/\\_@" or text[begin - 1] == "." and len(stem) > 1):
        return False
    low = stem.lower()
    number = text[i].isdigit()
    # Letters written apart count together: z. B., т. д.
    apart = _APART.search(text[max(0, begin - 6) : begin]) if len(stem) <= 2 else None
    if apart and stem.isupper() and apart.group(1).isupper():
        apart = None  # initials of a name
    if apart:
        low = f"{apart.group(1).lower()}.{low}"
    if low in _ALL.never or low in _ALL.number or low in _ALL.maybe or apart and stem.lower() in _ALL.never:
        s = p.suppressions
        # A word that only abbreviates with a capital is a plain word without.
        plain = stem[0].islower() and low in s.capital and not p.lowercased
        if not plain:
            if low in s.never or apart and stem.lower() in s.never and low not in s.maybe:
                return True
            if low in s.maybe:
                if number:
                    return low not in _MOSTLY
                return p.lowercased and opens is None and low not in _MOSTLY
            if low in s.number and number:
                return True
    if stem.isdigit():
        following = _WORD.match(text, i, end)
        word = following.group().lower() if following else ""
        return word in MONTHS or p.lowercased and opens is None and not number and (begin == 0 or text[begin - 1].isspace())
    if _INITIALS.fullmatch(stem) and not number:
        # Initials of a country or a name: a word that starts sentences ends them.
        following = _WORD.match(text, i, end)
        return opens is True and bool(following) and following.group().lower() not in STARTERS
    if len(stem) == 1 and stem.isalpha() and not number and (begin == 0 or not text[begin - 1].isdigit()):
        if stem.isupper():
            return opens is True
        # The first of letters written apart, as in d. h.
        if _NEXT_APART.match(text, i, end) and not _AFTER_DIGIT.search(text[max(0, begin - 4) : begin]):
            return True
        if p.lowercased and text[i].isalpha():
            return stem.isascii() and not _AFTER_DIGIT.search(text[max(0, begin - 4) : begin])
    return False


def _after_span(p: _Paragraph, a: int, at: int, first: int) -> int | None:
    """Where the sentence ends that may end with the quotation or brackets ``text[a:at]``."""
    text, end = p.text, p.end
    inner = text[a + 1 : at - 1].rstrip()
    if not inner or not _END.search(inner[-1:]) and not _END.fullmatch(inner[-2:]):
        return None
    i, gap = _next(text, at, end)
    if i >= end:
        return at
    if _END.match(text, i):
        return None
    leads = _LEADING.match(text, first, a).end() == a
    if text[a] in _BRACKETS:
        # A sentence in brackets of its own, or one that ends the sentence before.
        if leads:
            return None if text[i] in ",;:，、；：" else at
        return None
    opens = _opens(p, i)
    if opens is False:
        return None
    before = a
    while before > first and text[before - 1].isspace():
        before -= 1
    introduced = before > first and text[before - 1] in ":：,"
    if introduced:
        return None if not gap and not _NO_CASE.match(text[i]) and not text[i].isupper() else at
    if opens is True and gap:
        return at
    return None


def sentence_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """``doc_id, sent_start, sent_end``, a row per unit; repeated rows of a document give their units once.

    Texts are split where they are read: the only shuffle is that of the offsets, and
    only for telling repeated rows. ``lang``: a column of language labels, which may be wrong or null.
    """
    label = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    held = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), label.alias("lang")).filter("text is not null")
    return held.mapInArrow(_units, "doc_id bigint, sent_start bigint, sent_end bigint").distinct()


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, starts, ends = [], [], []
        for doc, text, lang in zip(*(c.to_pylist() for c in b.columns)):
            for a, z in sentences(text, lang):
                ids.append(doc)
                starts.append(a)
                ends.append(z)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "sent_start", "sent_end"])
