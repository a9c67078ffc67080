"""Template residue, filler text, error pages and script or sign-in notices in place of content."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"[^\W\d]\w*(?:[.:|\- ]+\w+)*"
#: Grammar of an open field per delimiter. Each must stand free, as a value would.
FIELDS = {
    "double brace": rf"\{{\{{\s*[#/^&>]?\s*{_NAME}\s*(?:\([^()\n]*\))?\s*\}}\}}",
    "block tag": r"\{%-?\s*\w[^%\n]{0,80}%\}",
    "dollar brace": rf"\$\{{\s*{_NAME}\s*\}}",
    "hash brace": rf"#\{{\s*{_NAME}\s*\}}",
    "number brace": r"(?<![\w}\]$\\^])\{\d{0,2}\}(?![\w{\[^])",
    "double percent": r"%%\s*\w[\w .]*%%",
    "single percent": r"(?<![\w%])%[A-Z][A-Z_]{2,}%(?![\w%])",
    "double at": r"@@\s*\w[\w .]*@@",
    "double angle": rf"<<\s*{_NAME}\s*>>",
    "asp tag": r"<%=?\s*\w[^%\n]{0,80}%>",
    "double square": r"\[\[\s*[^\W\d][\w. ]*\]\]",
    "dunder": r"(?<![\w.])__[A-Z][A-Z0-9_]*?__(?!\w|\(|\.\w)",
    "dollar name": r"(?<![\w$])\$[a-z]\w*\$(?![\w$])",
    "merge field": r"«\s*\w[\w. ]*»|\*\|\s*\w[\w. ]*\|\*",
    "request in brackets": r"(?i)[\[<(]\s*(?:todo|tbd|fixme|insert|enter|fill in|your|add|replace|choose|bitte|hier|name de[rs]|eintragen|einfügen|einsetzen|ihre?n?\b|platzhalter|placeholder)[^\[\]<>()\n]{0,60}[\])>]",
    "date pattern": r"\[\s*(?:DATE|NAME|TITLE|DATUM|TITEL|COMPANY|FIRMA|AUTHOR|LOCATION|ORT|TT\.MM\.JJJJ|DD[/.]MM[/.]YYYY|YYYY-MM-DD)\s*\]",
    "title in brackets": r"\[(?:[A-ZÄÖÜ][\wäöüß]*\.? )*(?:Name|Names|No|Nr|Number|Nummer|Date|Datum|Address|Adresse|Title|Titel|Company|Firma|Amount|Betrag|Email|E-Mail|Phone|Telefon|Street|City|Ort|Signature|Unterschrift)\.?\](?!\()",
    "repeated mark": r"(?<![\w.])(?:(?:TBD|TODO|XXX+|FIXME|N\.N\.)[ ,;]+){1,}(?:TBD|TODO|XXX+|FIXME|N\.N\.)(?!\w)",
    "masked value": r"(?<![\w.])(?:XX+[.,:/-]XX+|\?\?\?+|_{4,})(?![\w])",
}
#: Sentences of filler text.
FILLER = (
    r"lorem ipsum dolor(?: sit amet)?", r"dies ist ein (?:blindtext|platzhalter\w*|beispieltext)", r"(?:hier steht|das ist) (?:ein |der )?(?:blindtext|platzhaltertext|beispieltext)", r"er hat keinen inhalt und füllt nur den platz",
    r"this is (?:a |an |some )?(?:placeholder|dummy|sample|filler) (?:paragraph|text|copy|content)", r"(?:text|copy) will be (?:removed|replaced) before (?:release|launch|publication)",
    r"(?:your|ihre?) (?:sub)?(?:headline|heading|title|text|content|überschrift|titel) (?:goes )?(?:here|hier)", r"replace this (?:paragraph|text|sentence) with", r"(?:click|tap) (?:here )?to (?:add|edit) (?:text|title|content|subtitle)", r"ersetzen sie diesen (?:text|absatz)", r"(?:text\b[ .]*){4,}", r"(?:more|add|insert) text here", r"the quick brown fox jumps over the lazy dog", r"(?:x{3,}\b[\s,.]*){3,}", r"(?:(?:asdf|qwer|qwertz?y?|yxcv|zxcv|jkl|test|foo|bar|bla|blah|xyz|abc)\w{0,3}\b[\s,.]*){4,}",
)
#: Words of the pseudo-Latin filler; a run of RUN of them is filler, whatever their order.
LATIN = "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
RUN = 6
#: How messages of servers and programs begin that stand where the content should.
ERRORS = (
    r"(?:error |http |fehler )?(?:4\d\d|5\d\d)\b[\s:.,–—-]*(?:not found|bad gateway|bad request|forbidden|unauthori[sz]ed|internal (?:server )?error|gateway time-?out|service (?:temporarily )?unavailable|too many requests|gone|request time-?out|nicht gefunden|zugriff verweigert|interner serverfehler|method not allowed|\w+ error)",
    r"error[: ]+\d{3}\b", r"(?:fehler|http)[: ]+[45]\d\d\b", r"(?:page|file|document|report) not found\b", r"not found[.:]? the requested", r"the requested (?:page|url|resource|document)\b", r"(?:die )?(?:angeforderte )?seite (?:wurde )?nicht gefunden", r"diese seite (?:existiert|ist) nicht", r"access (?:is )?denied\b", r"permission denied[.!]? ", r"zugriff verweigert", r"forbidden[.:!]", r"you (?:do not|don't) have (?:permission|access)\b", r"sie (?:sind nicht berechtigt|haben keine berechtigung)",
    r"internal server error", r"interner (?:server)?fehler", r"bad gateway", r"gateway time-?out", r"(?:the )?service (?:is )?(?:temporarily |currently )?unavailable", r"service temporarily", r"too many requests", r"zu viele anfragen", r"traceback \(most recent call last\)", r"(?:fatal|parse|syntax|uncaught|unhandled|runtime|null ?pointer|stack overflow)[ \w:]*(?:error|exception)\b", r"exception in thread", r"warning: \w+\(\)", r"(?:error|fehler)[:!] (?:could not|cannot|can't|unable|failed|no |the |unexpected|konnte|keine|verbindung|beim)", r"(?:error|fehler)!? ?(?:establishing|connecting|loading|beim laden)", r"could not connect to", r"(?:connection|request|operation|session) (?:was |has )?(?:refused|reset|timed out|expired)", r"upstream (?:closed|connect)", r"(?:oops|ups|hoppla|sorry)[!,.]", r"something went wrong", r"(?:ein|da ist ein|es ist ein) (?:unerwarteter |interner )?fehler (?:ist )?(?:aufgetreten|passiert)", r"etwas ist schief", r"an (?:unexpected |internal )?error (?:has )?occurred", r"(?:der|die|das) (?:dienst|server|seite|bericht|inhalt) (?:ist )?(?:zurzeit|derzeit|vorübergehend|momentan|konnte nicht|kann nicht)", r"(?:this|the) (?:page|site|report|content|note) (?:could not|cannot|can't|can ?not|isn't|is not|failed to)(?: be)? (?:displayed|loaded|found|available|working|load)", r"(?:unable|failed) to (?:load|connect|fetch|render|display)", r"(?:the )?server (?:encountered|returned|is not responding|antwortet nicht)", r"(?:this|the) (?:content|page|item|report|note|link) (?:is|has been|was) (?:no longer available|moved|removed|deleted|expired)", r"(?:dieser?|dieses) (?:inhalt|seite|bericht|dokument) (?:ist|wurde|steht) (?:nicht mehr|entfernt|gelöscht|verschoben)", r"segmentation fault", r"null reference", r"(?:unknown|undefined) (?:variable|index|function|column)\b", r"you have an error in your sql syntax",
)
#: Notices that scripts, cookies or a sign-in are needed, or that a guard stands before the page.
NOTICES = (
    r"(?:please |bitte )?(?:enable|activate|turn on|aktivieren sie|schalten sie) (?:your )?(?:javascript|scripts?|scripting|cookies)", r"you(?:'ll| will)? need to (?:enable|turn on|activate) (?:javascript|scripts?|cookies)", r"(?:javascript|scripting|scripts?|cookies)(?: and (?:cookies|javascript|scripts))? (?:is|are|ist|sind|must be|muss|müssen|seems? to be) (?:currently )?(?:disabled|required|deaktiviert|erforderlich|blocked|ausgeschaltet|enabled|aktiviert|turned off|not enabled|switched off)",
    r"(?:this|the) (?:page|site|app|application|dashboard|viewer|report) (?:requires|needs) (?:javascript|scripts?|cookies|you to)", r"your browser (?:has|does not|doesn't|blocks)", r"ihr browser (?:hat|unterstützt|blockiert)", r"we(?:'|’)?re sorry but .{0,60}(?:without javascript|javascript enabled)", r"(?:für|um) .{0,60}javascript (?:muss|aktiviert|erforderlich|benötigt)", r"für .{0,60} muss javascript", r"(?:dieser?|diese|die) (?:seite|bericht|anwendung|anzeige) (?:benötigt|erfordert|braucht) (?:javascript|skripte|cookies)", r"<noscript", r"(?:bitte )?(?:melden sie sich|loggen sie sich)\b", r"(?:anmeldung|login) erforderlich", r"sie müssen (?:sich anmelden|angemeldet|eingeloggt)", r"ihre sitzung ist abgelaufen", r"bitte (?:erneut )?anmelden", r"(?:please )?(?:sign|log) ?in (?:again )?to (?:continue|view|read|see|access|proceed)", r"you (?:must|need to) (?:be (?:signed|logged) in|sign in|log in)", r"(?:sign-?in|login|authentication) (?:is )?required", r"your session has (?:expired|timed out|ended)", r"checking (?:if the site connection|your browser)", r"(?:verify|prove) (?:that )?you(?:'re| are) (?:a )?(?:human|not a robot)", r"(?:bestätigen|beweisen) sie,? dass sie (?:kein|ein)", r"turn it on and reload", r"(?:reload|aktualisieren)\b.{0,30}(?:javascript|seite)", r"this (?:content|report|note|page) is only (?:available|visible) to (?:signed|logged|members|subscribers)", r"nur für angemeldete", r"(?:einen moment|just a moment)[ .…]+",
)
#: Lines that belong to any page: menus, footers, titles, dividers.
FURNITURE = r"(?:[\w .#/-]{1,20}(?: \| [\w .#/-]{1,20}){1,8}|(?:#{1,6} .{0,60}|[-=*_ ]+)|.{0,40}\b(?:loading|lädt|wird geladen)\W*)"
#: A page is the message when no more than so many characters, or this share of the page, is other text.
REST, SHARE = 160, 0.2
#: How a trace begins, the lines it goes on with, and the line of its exception, which ends it.
TRACE = r"(?:traceback \(most recent call last\)|exception in thread|(?:unhandled|uncaught) exception)"
FRAME = r"(?:file \"[^\"]*\", line \d+|at [\w.$<>/]+ ?\(|at .{1,120}:\d+(?::\d+)?\)?$|\.\.\. \d+ (?:more|common)|caused by: |[~^ ]+$|\[previous line repeated|during handling of the above exception|the above exception was the direct cause)"
RAISED = r"(?:[a-z_]\w*\.)*[A-Z]\w*(?::\s.*)?"
#: Lines that don't carry on the paragraph above them: items, tables, headings, times.
APART = r"(?:[-*+•|#>=]|\d+[.)]\s|\d{1,4}[-:./]\d)"

#: What must stand in a text for a field, a filler phrase or a filler run to be possible: cheap tests before the patterns.
_FIELD_MARKS = ("{{", "{%", "${", "#{", "%%", "@@", "<<", "<%", "[[", "__", "«", "*|", "XX", "???", "TBD", "TODO", "FIXME", "N.N")
_FIELD_OPENERS, _FIELD_OPENED = "{%$[<(", re.compile(r"\{\d{0,2}\}|%[A-Z]|\$[a-z]|[\[<(]\s*[^\W\d]{2}")
_MAY_FILL = ("lorem", "blindtext", "platzhalter", "beispieltext", "keinen inhalt", "placeholder", "dummy", "sample", "filler", "will be re", "headline", "heading", "title", "titel", "überschrift", "your text", "your content", "subtext", "subcontent", "ihr text", "ihre text", "ihr content", "ihre content", "replace this", "to add ", "to edit ", "ersetzen sie", "text here", "quick brown", "xxx")
#: Words of LATIN that are words of other languages, too: a run needs another one.
COMMON = frozenset("do in ad id ex et sit sed est eu ea ut non sunt culpa minim anim".split())
_RARE = frozenset(LATIN.split()) - COMMON
_KEYBOARD = ("asd", "qwe", "yxc", "zxc", "jkl", "tes", "foo", "bar", "bla", "xyz", "abc")

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_SPAN = re.compile(r"`[^`\n]+`")
_TAGS = re.compile(r"<(?!<)/?(?:!doctype|html|body|head|title|h\d|p|br|hr|div|span|center|a|b|i|pre|code|meta|link|style|script)\b[^<>]*>", re.I)
_FIELD = re.compile("|".join(f"(?:{p})" if "(?i)" not in p else f"(?i:{p.replace('(?i)', '')})" for p in FIELDS.values()))
_FILL = re.compile(rf"(?:^|(?<=[.!?:;\s>]))(?:{'|'.join(FILLER)})")  # this and the next on lower-cased text
_LATIN = re.compile(rf"\b(?:(?:{'|'.join(LATIN.split())})\b[\s,.;:]*){{{RUN},}}")
_ERROR = re.compile(rf"\W*(?:{'|'.join(ERRORS)})", re.I)
_NOTICE = re.compile(rf"\W*(?:{'|'.join(NOTICES)})", re.I)
_FURNITURE = re.compile(FURNITURE, re.I)
_TRACE = re.compile(rf"\W*{TRACE}", re.I)
_FRAME = re.compile(FRAME, re.I)
_RAISED = re.compile(RAISED)
_APART = re.compile(APART)
_WORD = re.compile(r"\w+")
_QUOTED = re.compile(r"[\"“„‚‘»']\s*$")
#: An indented block of code, introduced by a colon.
_INDENTED = re.compile(r"(?<=:)[ \t]*\n(?:[ \t]*\n)+(?:(?: {4}|\t).*(?:\n|\Z)|[ \t]*\n(?= {4}|\t))+")
#: Sentences that speak about fields or filler, whatever stands around.
TALK = re.compile(r"(?i)\b(?:stands? for|steht für|stehen für|syntax|written as|renders?|replaced by|replaces|ersetzt|placeholders? (?:is|are|was|were)|template began|formula|regex|expands? to|escapes?|escaped|script sets)\b")
#: What stands right before a field or filler phrase that is spoken of: the name of such a thing, or an example.
ABOUT = re.compile(r"(?i)\b(?:(?:field|variable|placeholder|template|token|key|tag|marker|pattern|topic|expression|shell|feld|platzhalter|vorlage|ausdruck)\w*(?: (?:named|called|like|namens|wie))?|such as|e\.g\.|z\. ?b\.|for example|zum beispiel|writes?|wrote|schreibt?)[,:]? *$")
#: A line that opens with a message; on lower-cased text.
_MESSAGE = re.compile(rf"^[^\w\n]*(?:{'|'.join((*ERRORS, *NOTICES))})", re.M)


def _sentence(text: str, start: int, end: int) -> tuple[int, int]:
    a = max(text.rfind(c, 0, start) for c in ("\n", ". ", "! ", "? "))
    b = min((p for c in ("\n", ". ", "! ", "? ") if (p := text.find(c, end)) >= 0), default=len(text))
    return a + 1, b


def _spoken_of(text: str, start: int, end: int) -> bool:
    """Whether what stands at start:end is quoted, an example, or the subject of its sentence."""
    a, b = _sentence(text, start, end)
    return bool(_QUOTED.search(text, max(0, start - 2), start) or ABOUT.search(text, a, start) or TALK.search(text[a:start] + " " + text[end:b]))


def _message(bare: str) -> str | None:
    """error or notice if the page is such a message, with hardly any other text."""
    page = bare
    if "<" in bare:
        page = _TAGS.sub("\n", bare.replace("<noscript>", "\n<noscript "))
    if "&" in page:
        page = html.unescape(page)
    if not _MESSAGE.search(page.lower()):
        return None
    kind, rest, told, title = None, 0, 0, True
    # inside: a paragraph or a trace that belongs to a message; code: the line of source below a frame
    inside, code, opens = None, False, True
    for raw in page.split("\n"):
        line = raw.strip()
        if not line:
            inside, opens = None, True
            continue
        found = "error" if _ERROR.match(line) else "notice" if _NOTICE.match(line) else None
        frame = _FRAME.match(line)
        if inside == "trace" and not (frame or _TRACE.match(line)):
            indented = raw[:1] in " \t"
            more = indented or code or bool(_RAISED.fullmatch(line))
            code = False
            if not indented and _RAISED.fullmatch(line):
                inside = None
        else:
            more = inside == "trace" or (inside == "paragraph" and not _APART.match(line)) or bool(kind and frame and "above exception" in line.lower())
            code = bool(frame)
        if found:
            kind = kind or found
            inside = "trace" if _TRACE.match(line) else inside or ("paragraph" if opens else None)
        elif not more:
            inside = None
        if found or more:
            told += len(line)
        elif not (_FURNITURE.fullmatch(line) or (title and len(line) <= 60 and not line.endswith((".", "!", "?")))):
            rest += len(line)
        title = opens = False
    return kind if kind and rest <= max(REST, SHARE * (rest + told)) else None


def kind_of(text: str | None) -> str | None:
    """field, filler, error or notice: what stands in place of content, or None.

    Code blocks (fenced, or indented below a colon) and code spans are passed over. A field or filler
    phrase counts unless it is quoted, named as a field or example right before, or its sentence
    speaks about such things. An error or notice counts when it opens a line and, beside it and
    page furniture (title, menu, footer), hardly any other text stands. The rest of a paragraph that
    a message opens belongs to it, and the frames of a trace up to the line of its exception.
    """
    if not text or not text.strip():
        return None
    bare = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    if "```" in bare or "~~~" in bare:
        bare = _FENCE.sub(" ", bare)
    if "`" in bare:
        bare = _SPAN.sub(" ", bare)
    shown = _INDENTED.sub("\n", bare) if ":" in bare else bare
    if any(k in shown for k in _FIELD_MARKS) or (any(c in shown for c in _FIELD_OPENERS) and _FIELD_OPENED.search(shown)):
        for m in _FIELD.finditer(shown):
            if not _spoken_of(shown, m.start(), m.end()):
                return "field"
    low = shown.lower()
    latin = not _RARE.isdisjoint(_WORD.findall(low))
    fill = any(k in low for k in _MAY_FILL) or low.count("text") >= 4 or sum([low.count(k) for k in _KEYBOARD]) >= 4
    for rx in [r for r, may in ((_LATIN, latin), (_FILL, fill)) if may]:
        for m in rx.finditer(low):
            if (rx is _FILL or not COMMON.issuperset(_WORD.findall(m.group()))) and not _spoken_of(low, m.start(), m.end()):
                return "filler"
    return _message(bare)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds = [kind_of(t) for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array(kinds, pa.string())], names=["doc_id", "kind"])


def residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind) of the documents with residue in place of content; see ``kind_of``.

    Null and empty texts and null ids give no row; the whole text is read, however long. One pass
    per row, no shuffle. Repeated rows give repeated results.
    """
    rows = documents.filter(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_batches, "doc_id bigint, kind string").filter("kind is not null").select(F.col("doc_id").alias(doc_id), "kind")


def without_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents without those that ``residue`` finds; null and empty texts stay."""
    return documents.join(residue(documents, doc_id, text).select(doc_id).distinct(), doc_id, "left_anti")
