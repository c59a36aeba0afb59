"""Which lines of a page's text belong to the report, and which to the site's furniture (problem 7).

A page is a sequence of lines. For HTML, a streaming parser (`html_lines`) emits
one line per block of text with the number of tags it came from; text whose
markup is gone already has one tag, the line break, to each line. Each line has a
text-to-tag ratio: the characters of its running text over its tags. Lines whose
wording alone says what they are (prompts, notices, bylines, menus: `wording`)
are settled first, as are lines that recur throughout the source's pages (counted by
the operator of problem 4); running prose likewise. The ratios of what remains are smoothed
by a Gaussian over the neighbouring lines and split in two clusters; a short line
amid prose (a subheading) lies in the upper one, one amid short lines (an entry of
a list of other stories) in the lower one.

Fixed word lists below are in the languages of the pages at hand; a line they
don't know is left to its neighbourhood.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import xxhash

BLANK, REPORT, FURNITURE = 0, 1, 2
#: kinds before smoothing
_NONE, _PROSE, _ITEM, _FURN, _HEADER, _POINTER, _OPEN = range(7)

# Wording of site furniture.
HEADERS = frozenset("""related stories|related articles|related news|related|trending now|trending|most read|most popular|popular now|editor's picks|editors' picks|editor’s picks
you might like|you may like|you may also like|recommended|recommended for you|more from this desk|more stories|more from this author|also on this site|latest stories|latest news|in other news|what to read next|top stories|read next|don't miss
mga kaugnay na balita|kaugnay na balita|pinakabasa|pinakabago|iba pang balita|labing gibasa|may kalabutan nga balita|mga may kalabutan nga balita|laing balita|kaaduan a nabasa|dagiti nainaig a damag|nainaig a damag|dadduma pay a damag
lo más leído|lo mas leido|noticias relacionadas|te puede interesar|también te puede interesar|más noticias""".replace("\n", "|").split("|"))  # fmt: skip
MENU = frozenset("""home|menu|search|nation|metro|regions|region|life|lifestyle|video|videos|audio|games|puzzles|e-paper|epaper|weather|world desk|world|careers|jobs|about|about us|contact|contact us|login|log in|sign in|sign up|register|archive|archives|views|opinion|money|business|screens|sports|news|local|politics|tech|technology|health|culture|arts|travel|food|style|subscribe|newsletters|newsletter|podcasts|podcast|photos|gallery|help|faq|terms|privacy|sitemap|more|share|print|mail|email|copy link|facebook|twitter|instagram|youtube|tiktok|viber|next|previous|back|top|back to top|skip to content|close|loading|inicio|buscar|iniciar sesión|balita|palakasan|isport|skip""".split("|"))
_MENU_WORDS = frozenset(w for m in MENU for w in re.split(r"[\s-]+", m))
_NAME = r"[^\W\d_][\w.'’\-]*"
_RULES = [
    r"^(?:\(c\)|©|copyright\b)|all rights reserved|\bterms - privacy\b|\bpublishing group$|printed on recycled|reservados todos|todos los derechos",
    r"without (?:the )?(?:prior )?(?:written )?(?:consent|permission)|walang pahintulot|sin (?:el )?permiso|awan ti palubos|walay pagtugot|bawal kopyahin|prohibida la reproducci|maiparit ti panangkopia|gidili ang pagkopya",
    r"^views in this section|^the views expressed|do not reflect those of|^this site is protected|privacy page and terms|is a member of the\b.*\b(?:circle|network|association|council)$|^terms of (?:use|service)|^privacy (?:policy|notice)",
    r"^(?:please )?(?:share|tweet|email|print|save|bookmark) (?:this|the|on|it|to|with|via|article|story)\b|^print\s{2,}|\bcopy link$|^ibahagi|^ipaambit|^iburay|^comparte?\b|^compartir",
    r"^(?:follow|like) .{2,40}(?:wherever|on |for )|^sundan ang|^sunda ang|^suroten|^síguenos|^sigue a|^siga a|saan ka man nagbabasa|bisan asa ka|dondequiera que",
    r"^(?:subscribe|mag-subscribe|suscr[ií]b|sign up|register) .{3,}|^get .{3,50}(?:newsletter|brief|inbox|alerts?)\b|in your inbox|^recibe|en tu correo|araw-araw na balita$|^support (?:independent|our|local)|become a member|^donate|read without ads",
    r"^(?:click|tap|press) (?:here|the|to)\b|^join .{2,40}(?:community|channel|group)|^sumali sa|^apil sa|^makikadua iti|^[uú]nete|^download (?:our|the)\b|when we publish$|^i-click|^pindutin",
    r"^(?:send us|share) (?:a|your) (?:tip|story|photo)|^report (?:an? )?(?:error|typo|correction)|^av[ií]sanos|un error en este texto|^i-report|^itudo|^may mali ba|^isumbong",
    r"^be the first to comment|^(?:leave|post|add|write) (?:a |your )?(?:comment|reply)|^\d+ comments?$|^comments?(?: \(\d+\))?$|^mag-iwan ng komento|^deja (?:un|tu) comentario|^pagbilin og komento|^mangibati iti komento|save my name|for the next time i comment|^log in to comment",
    r"^(?:you may also |you can )?listen to this|^audio version|^(?:story|article) continues|^continue reading|^read (?:more|the full story|full story)$|^ituloy ti agbasa|^ipagpatuloy ang pagbabasa|^padayon sa pagbasa|^sigue leyendo|^contin[uú]a leyendo|^scroll (?:down )?to continue",
    r"^our standards\b|^how we (?:report|work)|^about (?:us|the author)\b|^editorial policy|^corrections?(?: policy)?$|^(?:la nota|el art[ií]culo|la historia) (?:sigue|contin[uú]a)\b",
    r"^(?:pakaammo|abiso|anunsiyo|reklamo)$|,\s*(?:(?:staff|senior|special|contributing) )?(?:reporter|writer|correspondent|contributor|editor|reportero|correspondal|corresponsal)s?$",
    r"^(?:advertisement|advertising|advertorial|ads?|sponsored(?: content)?|promoted|patalastas|publicidad|anuncio|pahibalo|paanunsio|paid content)$",
    r"^\d{1,2} ?min(?:ute)?s? read$|^last updated\b|^updated (?:at|on)\b|^posted (?:at|on|by)\b|^published (?:at|on)\b",
    r"-?\d{1,3}\s?°|^(?:high|low) tide\b|^sunrise\b|^index \d|\b(?:usd|php|eur) \d|^(?:mon|tues|wednes|thurs|fri|satur|sun)day,? (?:january|february|march|april|may|june|july|august|september|october|november|december) \d{1,2}(?:, \d{4})?$",
    r"^(?:tags?|topics?|filed under|keywords?|labels|categories|mga paksa|etiquetas|temas)\b\s*[:|]?\s*\S",
]


def _alternatives(rule: str) -> list[str]:
    """The alternatives of a pattern, those within groups left together."""
    out, depth = [""], 0
    for c in re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", rule):
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


_ALL = [a for r in _RULES for a in _alternatives(r)]
# those bound to a line's beginning are tried there only
_FIRST = re.compile("|".join(a for a in _ALL if a.startswith("^")))
_ANYWHERE = re.compile("|".join(a for a in _ALL if not a.startswith("^")))


def _furniture(low: str) -> bool:
    return bool(_FIRST.match(low) or _ANYWHERE.search(low))


_BYLINE = re.compile(rf"^(?:(?:words|text|story|report|reporting|written|analysis|photos?) )?(?:by|ni|nina|por|ti|sinulat ni|gisulat ni|insurat ni)\s+{_NAME}(?:\s+{_NAME}){{0,3}}(?:\s*(?:,|\||and|at|y|ug|ken)\s*{_NAME}(?:\s+{_NAME}){{0,3}})?$")
_CREDIT = re.compile(rf"^{_NAME}(?:\s+{_NAME}){{1,3}}\s+\|\s+{_NAME}(?:\s+{_NAME}){{0,3}}$")
_CONSENT = re.compile(r"\b(?:we|our|us|vendors?|partners?|advertisers|third parties|accept|agree|reject|consent|settings|privacy|the editors)\b")
_POINT = re.compile(r"^(?:read(?: more| also| next)?|also see|see also|also read|related(?: story| stories)?|basahin(?: rin| din)?|basaha(?: usab)?|basaen|lee? (?:también|además)|lea también|watch|panoorin|more|next|up next|don't miss|just in|breaking|exclusive)\s*[:|–—]\s*\S|^(?:»|›|>>|>|→|▸)\s*\S")
_NUMBERED = re.compile(r"^\d{1,2}[.)]\s+\S")
_BULLET = re.compile(r"^[-*•–·]\s+\S")
_LABEL = re.compile(r"[^:\n]{2,40}:\s")
_COUNTED = re.compile(r"\d[\d,.]*\s+[^\W\d_]+(?=,)")
_LAST_COUNTED = re.compile(r"\d[\d,.]*\s+[^\W\d_]+$")
_NUMBER = re.compile(r"\d[\d,.:]*")
_SEP = re.compile(r"\s*[|/·•›»>]\s*|\s{2,}|\s+-\s+")
_SEPARATORS = ("|", "/", "·", "•", "›", "»", ">", " - ")
_DECOR = re.compile(r"(?:\s*(?:\(\d{1,4}\)|[»›!]))+$")
_END = re.compile(r"[.!?…][\"”’'»)\]]*$")
_SIGNOFF = re.compile(r"\s*(?:-30-|-\s?end\s?-|###|—\s?[A-Z][\w.\-' ñÑ]{1,40}|\([A-Z][\w.\-' ñÑ]{1,40}\)|/[a-z]{2,4}|\bPR\b)\s*$")
_WORD = re.compile(r"[^\W\d_]+")
#: Words that hold sentences together in the languages at hand; tag lists have none.
FUNCTION = frozenset("""the of and to in for on at by with from that this it is was were are be been has have had will would who which not but as or an a its their his her they he she we you i after before over under than then said says when while still
ang ng mga sa na ay at si ni kay nina para kung hindi pa po ito nang dahil upang kaysa may ani ayon kung ngunit subalit ba rin din lang niya nila kami ako siya
ang sa nga og ug si ni kang kay kini dili wala apan aron alang gikan niadtong ka mi nila kami nganong gihapon dihang
ti iti dagiti a nga ni idiay idi ken para no saan ngem tapno kadagiti kas daytoy pay laeng apay gapu uray
el la los las de del en y que un una por para con se su no es al lo como más pero sin sobre según desde tras este esta""".split())  # fmt: skip
_memo: dict[str, int] = {}


def labelled(s: str) -> bool:
    """ "Place: 3 teachers, 4 nurses": a label, then counts of things, the last at the end."""
    head = _LABEL.match(s)
    last = head and s[-1:].isalpha() and _LAST_COUNTED.search(s, head.end())
    return bool(last and _COUNTED.search(s, head.end(), last.start()))


def _tags(words: list[str], text: str) -> bool:
    """A bare list of tags: no capital, no word that a sentence needs."""
    return len(words) >= 3 and text == text.lower() and not any(w in FUNCTION for w in words)


_BRACKETED = re.compile(r"^\[[^\[\]{}]{12,}\]$")
_ODD = str.maketrans({0xA0: " ", 0x202F: " ", 0x2007: " ", 0x3000: " ", 0x200B: "", 0x200C: "", 0x200D: "", 0xFEFF: "", 0xAD: ""})


def _kind(text: str) -> int:
    s = (text if text.isascii() else text.translate(_ODD)).strip()
    low = s.lower()
    if not any(c.isalpha() for c in s):
        return _NONE
    core = _DECOR.sub("", low).rstrip() if low[-1] in ")»›!" else low
    plain = core.rstrip(".:")
    if plain in HEADERS:
        return _HEADER
    if plain in MENU:
        return _FURN
    words = _WORD.findall(low)
    n = len(words)
    long = n >= 24
    if _consent(low) and _CONSENT.search(low) and not low.startswith(('"', "“", "«")) and ("agree" in low or "accept" in low or "ok to" in low or "settings" in low or "polic" in low or n < 16):
        return _FURN
    if n <= 16 and _furniture(plain):
        return _FURN
    if n <= 9 and not (_END.search(low) and not _END.search(core[:-1]) and n > 6) and (_BYLINE.match(plain) or _CREDIT.match(plain)):
        return _FURN
    if _POINT.match(low) and not long or (_BRACKETED.match(s) and n >= (5 if s.isupper() else 3)):
        return _POINTER
    parts = [p for p in _SEP.split(core) if p] if "  " in core or any(c in core for c in _SEPARATORS) else [core]
    if len(parts) >= 3 and sum(p in MENU for p in parts) * 2 >= len(parts):
        return _FURN
    if n >= 4 and all(w in _MENU_WORDS for w in words) and not _END.search(s):
        return _FURN
    if low.startswith("#") and all(w.startswith("#") for w in low.split()):
        return _FURN
    if _BULLET.match(s):
        return _ITEM
    if _END.search(s[-8:]) or _SIGNOFF.search(s[-48:]):
        return _PROSE if n >= 4 or s[:1] in "\"“«" else _OPEN
    if len(parts) >= 3 and not long and all(len(p.split()) <= 3 for p in parts) and "," not in core:
        return _FURN
    if _tags(words, s):
        return _FURN
    if long or (n >= 6 and labelled(s)):
        return _PROSE
    if n <= 14 and len(_NUMBER.findall(s)) >= 3 and sum(w in FUNCTION for w in words) <= 2:
        return _FURN  # a ticker of prices, tides, scores
    return _OPEN


# what a long line must not begin with to pass for running prose at a glance
_HEAD = re.compile(r"[^:|]{0,24}[:|]|\W*[-*•–·»›>\[{<#]|\s*\d{1,2}[.)]\s")


def _consent(low: str) -> bool:
    return "cookie" in low or "tracker" in low or "usage data" in low or "small files on your device" in low or "your privacy matters" in low or "similar tools" in low


def kind(text: str) -> int:
    """The kind of a line by its wording; short lines, which recur, are remembered."""
    if len(text) > 130:
        if text[-1] in ".!?\"" and text.count(" ") > 16 and "  " not in text and not _HEAD.match(text) and not _consent(text.lower()):
            return _PROSE
        return _kind(text)
    k = _memo.get(text)
    if k is None:
        if len(_memo) > 300_000:
            _memo.clear()
        k = _memo[text] = _kind(text)
    return k


_LETTERS = re.compile(r"[\W\d_]+")
#: Letters at a line's beginning that a `line_id` tells apart at a glance.
HEAD = 6


def letters(text: str) -> str:
    """Letters only, in lower case: what makes two lines the same, here as in `keys.letters_only`."""
    k = _LETTERS.sub("", text.lower())
    return k if k.isascii() else "".join(c for c in k if c.isalpha())


def _hash(k: str) -> int:
    return xxhash.xxh64_intdigest(k.encode("utf-8", "surrogatepass"), 42)


class Recurring:
    """The lines that recur throughout a source's pages, by `repeated_lines.line_ids`; strong: in so many pages that they can't be the reports' own."""

    def __init__(self, ids: dict[int, bool]):
        self.ids = {k & 0xFFFFFFFFFFFFFFFF: v for k, v in ids.items()}
        self.heads = frozenset(k & 0xFFFF for k in self.ids)

    def head(self, text: str) -> int:
        """The low bits of a line's id, from its first letters."""
        k = letters(text[:40])[:HEAD]
        if len(k) < HEAD and len(text) > 40:
            k = letters(text)[:HEAD]
        return _hash(k) & 0xFFFF

    def of(self, text: str) -> bool | None:
        """True for strong, False for weak, None for a line that doesn't recur."""
        if self.head(text) not in self.heads:
            return None
        k = letters(text)
        return self.ids.get((_hash(k) & ~0xFFFF) | (_hash(k[:HEAD]) & 0xFFFF)) if k else None


_GAUSS = [math.exp(-d * d / 2) for d in range(4)]


def _smooth(values: list[float]) -> list[float]:
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for j in range(max(0, i - 3), min(n, i + 4)):
            g = _GAUSS[abs(i - j)]
            total += g * values[j]
            weight += g
        out.append(total / weight)
    return out


def _threshold(values: list[float]) -> float:
    """Between the two clusters of the values (2-means), within fixed bounds."""
    lo, hi = min(values), max(values)
    for _ in range(8):
        cut = (lo + hi) / 2
        a, b = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not b:
            break
        lo, hi = sum(a) / len(a), sum(b) / len(b)
    return min(max((lo + hi) / 2, 45.0), 62.0)


def label(lines: list[str], title: str | None = None, tags: list[int] | None = None, kinds: list[int] | None = None, recurring: Recurring | None = None) -> list[int]:
    """BLANK, REPORT or FURNITURE for each line. tags: the tags that each line came from, counted by the parser if not given; kinds: of the lines, if known;
    recurring: the lines that recur throughout the source's pages, which are furniture whatever they say; sentences must recur strongly for that."""
    kinds = [kind(x) for x in lines] if kinds is None else list(kinds)
    if recurring and recurring.ids:
        known = [recurring.of(x) if k in (_OPEN, _ITEM, _PROSE) else None for x, k in zip(lines, kinds)]
        # a report has prose of its own: where all of it recurs, the story has been taken in again and again
        own_prose = any(k == _PROSE and not s for k, s in zip(kinds, known))
        for i, strong in enumerate(known):
            k = kinds[i]
            if strong is not None and (k != _PROSE or (strong and own_prose)):
                after = [j for j in kinds[i + 1 : i + 6] if j != _NONE][:2]
                kinds[i] = _HEADER if k == _OPEN and len(after) == 2 and set(after) <= {_OPEN, _POINTER} else _FURN
    own = (title or "").strip().lower()
    out = [BLANK if k == _NONE else FURNITURE if k in (_FURN, _HEADER, _POINTER) else REPORT for k in kinds]
    if _OPEN not in kinds:
        return out
    widget, rest = False, []
    for i, k in enumerate(kinds):
        if k == _HEADER:
            widget = True
        elif k in (_PROSE, _ITEM):
            widget = False
            rest.append(i)
        elif k == _OPEN:
            s = lines[i].strip()
            if widget or (_NUMBERED.match(s) and len(s) < 160):
                out[i] = FURNITURE
                kinds[i] = _POINTER
            else:
                rest.append(i)
    if not any(kinds[i] == _OPEN for i in rest):
        return out
    # running text per tag: a line that is no prose has none of its own but its words
    if tags is None:
        tags = [tag_count(x) if "<" in x else 1 for x in lines]
    ratio = [min(max(len(lines[i]), 120), 200) / tags[i] if kinds[i] == _PROSE else 120.0 if kinds[i] == _ITEM else min(len(lines[i]), 60) / 2 for i in rest]
    smooth = _smooth(ratio)
    cut = _threshold(smooth)
    last_prose = max((p for p, i in enumerate(rest) if kinds[i] in (_PROSE, _ITEM)), default=-1)
    # without any prose the longest line, if it has the words of one, is all there is of the report: its cut-off beginning
    longest = max(rest, key=lambda i: len(lines[i])) if last_prose < 0 else -1
    if longest >= 0 and len(_WORD.findall(lines[longest])) >= 4 and lines[longest].strip().lower() != own:
        out[longest] = REPORT
    for p, i in enumerate(rest):
        if kinds[i] != _OPEN or i == longest and out[i] == REPORT:
            continue
        if lines[i].strip().lower() == own:
            out[i] = REPORT
        elif p > last_prose:  # nothing of the report follows: its cut-off end, under a subheading perhaps, else furniture
            out[i] = REPORT if 0 < p <= last_prose + 2 else FURNITURE
        else:
            out[i] = REPORT if smooth[p] >= cut else FURNITURE
    return out


_BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 td tr table section article header footer nav aside main figure figcaption blockquote form body html title head pre dd dt".split())
_SKIP = frozenset("script style noscript template svg".split())
_AWAY = frozenset("nav footer aside form".split())


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.tags: list[int] = []
        self.away: list[bool] = []
        self._text, self._n, self._skip, self._depth, self.seen = [], 1, 0, 0, 1

    def _flush(self):
        text = re.sub(r"\s+", " ", "".join(self._text)).strip()
        if text:
            self.lines.append(text)
            self.tags.append(max(1, self._n))
            self.away.append(self._depth > 0)
        self._text, self._n = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._flush()
        self._n += 1
        self.seen += 1
        self._skip += tag in _SKIP
        self._depth += tag in _AWAY

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self._flush()
        self._skip = max(0, self._skip - (tag in _SKIP))
        self._depth = max(0, self._depth - (tag in _AWAY))

    def handle_data(self, data):
        if not self._skip:
            self._text.append(data)


def tag_count(line: str) -> int:
    """The tags of a line of text, its break included, from the parser's events."""
    p = _Lines()
    try:
        p.feed(line)
    except Exception:  # noqa: BLE001 - a broken-off tag is none
        pass
    return max(1, p.seen)


def html_lines(html: str) -> tuple[list[str], list[int], list[bool]]:
    """(lines, tags per line, whether each stands in a menu, sidebar, footer or form) of a page, broken-off ones included, by streaming parser events."""
    p = _Lines()
    try:
        p.feed(html)
        p.close()
    except Exception:  # noqa: BLE001 - what was read before the parser gave up still counts
        pass
    p._flush()
    return p.lines, p.tags, p.away


def html_body(html: str | None, title: str | None = None) -> str:
    """The report's lines of an HTML page; "" for NULL or a page without any."""
    lines, tags, away = html_lines(html or "")
    marks = label(lines, title, tags)
    return "\n".join(x for x, m, a in zip(lines, marks, away) if m == REPORT and not a)
