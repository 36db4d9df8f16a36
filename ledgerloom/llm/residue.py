"""Template residue, filler, error pages and script notices in texts.

A regularised linear classifier over hashed n-grams, shapes, length and title features scores every
segment of a text.  It is trained on weak labels from response states and phrases, and validated on
sources it hasn't seen.  A text is found where a segment scores above the threshold; quoted words are
taken out first, since a speech may quote such things.  No phrase is matched when a text is scored:
the phrases give labels to the bounded sample the classifier is fitted on, and nothing else.

Texts are cut, hashed and scored a batch at a time with NumPy over their bytes.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spread

#: At most about so many documents, chosen by the hash of their key, are read to fit the classifier.
FIT_DOCUMENTS = 12_000
#: Hashed dimensions; the weights of that many features are all that workers receive (1 MB).
DIMENSIONS = 1 << 18
#: The highest threshold whose F1 on unseen sources lies within 0.005 of the best (four folds of sf0.1).
THRESHOLD = 0.4
_MASK = np.uint64(DIMENSIONS - 1)
#: Words of a window, and how far the next one starts behind it.
_LONG, _STEP = 60, 30
#: Tokens behind a template's mark that belong to its surroundings.
_NEAR = 8
#: Bytes of text that are worked on at once.
_CHUNK = 1 << 20
#: Windows whose features are made at once when the classifier is fitted, so that the driver holds little.
_ROWS = 5_000

_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«\s[^»\n]*\s»|‹\s[^›\n]*\s›")
_QUOTE = re.compile("[\"“„«‹]")

# Weak labels. Each list is a cue by itself.
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_MARKS = re.compile(r"[{}\[\]<>@%$#_«»&|\\]|:\w[\w. -]*:|\b(?:NaN|NULL|undefined|None)\b")
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[ ._-][A-Za-z0-9]+)*"
_PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*{_NAME}\s*\}}\}}\}}?|[$#]\{{\s*{_NAME}\s*\}}|\{{%\s*{_NAME}\s*%\}}|<%=?\s*{_NAME}\s*%>|<#\s*{_NAME}\s*#>|\[\[\s*{_NAME}\s*\]\]"
    rf"|@@\s*{_NAME}\s*@@|%\({_NAME}\)[sd]|\b__{_NAME}__\b|\[(?:INSERT|TODO:?|ADD|ENTER|FILL)\s+{_NAME}\]|\[{_NAME} HERE\]|&lt;{_NAME}&gt;|«{_NAME}»"
    r"|(?<![\w%])%[A-Za-z]+(?:[._ -][A-Za-z]+)*%(?!\w)|(?<![\w$])\$[A-Za-z]+(?:[._ -][A-Za-z]+)*\$(?!\w)|(?<![\w:]):[A-Za-z]+(?:[._ -][A-Za-z]+)*:(?!\w)"
    r"|<[a-z]+(?:[._ -][a-z]+)+>|<(?!/?(?:html|head|title|body|h\d|p|noscript|br|hr|div|span|b|i|a|li|ul)\b)[A-Za-z]+(?:[._ -][A-Za-z]+)*>|(?<!\w)\{(?!as )[A-Za-z]+(?:[._ -][A-Za-z]+)*\}"
    r"|\[object Object\]|#REF!|#N/A|#VALUE!|#NAME\?|#DIV/0!|(?<![\w%])%[sd](?![\w%])|\{\d\}|\bNaN\b|\bNULL\b|\bundefined\b(?! (?:term|word|notion|concept))"
)
# The next three are matched against lower case; without one of the words the first can't match.
_NOTICE_WORDS = ("script", "skript", "js", "browser")
_NOTICE = re.compile(
    r"<noscript|\bnoscript\b|\bscripts? blocker\b|checking your browser|browser is not supported|"
    r"\b(?:javascript|js|scripts?|scripting|skripte?)\b.*\b(?:enable[ds]?|disabled|required?s?|requires|turn(?:ed)? (?:it )?on|switch(?:ed)? on|activ\w*|allowed|needed|abgeschaltet|erlaubt|benötigt|einschalten|schalten|ein|deaktiviert|autorisés|nécessaires?|désactivé|necesarios?|permitid\w+|your settings|must be|continue)\b|"
    r"\b(?:enable|activate|turn on|switch on|requires?|needs?|run|allow|without|with|aktivieren|erfordert|benötigt|schalten|activez|activer|nécessite|exécution|autoriser|avec|active|activar|habilite|requiere|necesita|permitir|must|in order to continue|müssen)\b.*\b(?:javascript|js|scripts?|scripting|skripte?)\b"
)
_ERROR = re.compile(
    r"\b(?:error|erreur|fehler|code|código|http(?: status)?|status)\W{0,4}(?:4\d\d|5\d\d)\b|\b(?:4\d\d|5\d\d)\b\W{0,3}\b(?:not found|forbidden|bad gateway|gateway time|service unavailable|internal server|too many|gone|unauthorized|bad request|error)|"
    r"^\W*(?:401|403|404|408|410|429|500|502|503|504)\W*(?:-|–|$)|"
    r"(?:could not|cannot|can't|failed to|unable to) (?:be )?(?:found|load(?:ed)?|display(?:ed)?|reach(?:ed)?|service|open(?:ed)?)|can't seem to find|not be found|timed out\b|no longer available|does not exist|has been moved or deleted|down for maintenance|"
    r"session (?:has )?(?:expired|timed out)|access denied|do not have permission|rate limit exceeded|too many requests|retry after \d|try again (?:later|in a few)|check the (?:link|address)|sign in again|"
    r"upstream connect error|reset reason|database connection failed|expects parameter|application error|java\.lang\.|exception:|\bat render|stack trace|something went wrong|contact support|^\W*oops|^\W*warning:|\b(?:incident|request|ticket|reference|référence|réf|kennung|incidencia|vorgang)\W+(?:id\W+)?[0-9a-f]{8}\b|"
    r"internal server error|service unavailable|bad gateway|gateway timeout|\bnot found\b|page not found|"
    r"konnte nicht (?:geladen|gefunden|angezeigt)|nicht gefunden|existiert nicht|nicht (?:mehr )?verfügbar|überlastet|gewartet|wartung|zugriff verweigert|keine berechtigung|versuchen sie es|zurück zur startseite|sitzung ist abgelaufen|"
    r"introuvable|n'existe pas|n'est plus disponible|en maintenance|accès refusé|service indisponible|ne répond pas|session a expiré|réessayez|retour à l'accueil|n'a pas pu être|"
    r"no se (?:encuentra|encontró|pudo)|mantenimiento|no responde|inténtelo|no existe|ha caducado|acceso denegado|volver al inicio|ya no está disponible|"
    r"\"(?:error|status)\"\s*:|<title>|</?h1>"
)
_FILLER = re.compile(
    r"^lorem ipsum|\b(?:body copy|dummy (?:content|text)|sample text|placeholder,? do not publish|text to follow|to be (?:added|supplied)|goes (?:here|in this block)|will appear here|not yet entered|pending editorial|replace this paragraph|type your speech|content pending)\b|"
    r"^blindtext|blindtext für|^text folgt|nachgereicht|noch einzutragen|hier eingefügt|absatz ersetzen|hier steht|platzhalter|"
    r"reste à saisir|sera inséré|remplissage|insérer ici|texte à venir|remplacer ce paragraphe|"
    r"se insertará|por cargar|texto pendiente|escriba aquí|texto de relleno|sustituya este párrafo|reemplace este"
)
#: Every alternative of the three patterns above holds one of these, so a text without any is settled by one pass.
_STEMS = (
    "error", "erreur", "fehler", "code", "código", "http", "status", "not found", "forbidden", "gateway", "unavailable", "internal server", "too many", "gone", "unauthorized", "bad request",
    "401", "403", "404", "408", "410", "429", "500", "502", "503", "504", "could not", "cannot", "can't", "failed to", "unable to", "not be found", "timed out", "no longer", "not exist", "moved or deleted",
    "maintenance", "session", "denied", "permission", "rate limit", "retry", "try again", "check the", "sign in", "upstream", "reset reason", "connection failed", "expects parameter", "java", "exception",
    "render", "stack trace", "went wrong", "support", "oops", "warning", "inciden", "request", "ticket", "referen", "réf", "kennung", "vorgang", "konnte nicht", "nicht gefunden", "existiert nicht", "verfügbar",
    "überlastet", "gewartet", "wartung", "verweigert", "berechtigung", "versuchen sie", "startseite", "abgelaufen", "introuvable", "existe", "disponible", "refusé", "répond pas", "expiré", "réessayez", "retour à",
    "n'a pas pu", "no se ", "mantenimiento", "no responde", "inténtelo", "caducado", "denegado", "volver al", "<title", "h1>", "lorem", "body copy", "dummy", "sample text", "placeholder", "to follow", "to be added",
    "to be supplied", "goes here", "goes in", "appear here", "not yet", "pending", "replace this", "type your", "blindtext", "text folgt", "nachgereicht", "einzutragen", "eingefügt", "ersetzen", "hier steht",
    "platzhalter", "à saisir", "inséré", "remplissage", "insérer", "à venir", "remplacer", "insertará", "por cargar", "texto", "escriba", "sustituya", "reemplace", *_NOTICE_WORDS,
)
#: Common words of the four languages; running text of six words or more has some of them.
_COMMON = frozenset(
    "the of and to in a is that it for on with as was at by be this are or not we i you he they have has from will must but their our who an "
    "der die das und in zu den ist nicht von mit sich des ein eine dem auf für es im an wir ich sie er als auch wird hat sind dass aber um "
    "le la les de des du et un une en que qui dans pour ce il est pas sur au nous je vous elle on ne se par plus avec mais "
    "el los las y por con no su para al lo del nos yo es como más pero sus ha ser una uno se".split()
)
#: Verbs by which speakers report what somebody, or a page, said.
_REPORTED = re.compile(
    r"\b(?:said|says|told|tells|heard|hears|showed|answered|answers|replied|replies|called|calls|complained|wrote|writes|quoted|quote|declared|announced|claimed|insisted|explained|so-called|"
    r"sagte|sagten|sagt|hieß|heißt|meldete|meldeten|meldet|nannte|nennt|zeigte|antwortete|antwortet|hörten|hörte|schrieb|schreibt|erklärte|berichtete|behauptete|sogenannte\w*|"
    r"dit|disait|disaient|affichait|répondait|répondit|annonçait|appelle|appelait|montrait|montra|écrivait|déclarait|expliquait|félicite|entendu|entendait|soi-disant|"
    r"dijo|dice|decía|mostró|mostraba|respondió|respondía|contestó|contestaba|llama|llamó|escribió|anunció|declaró|explicó|oyó|oyeron|supuesto)\b"
)


def quotes_removed(text: str) -> str:
    """A text without what stands in quotation marks; JSON and HTML, whose quotes are syntax, stay as they are."""
    if not _QUOTE.search(text):
        return text
    return text if re.match(r"\s*[{\[<]", text) and re.search(r"\"\s*:|</", text) else _QUOTED.sub(" ", text)


def _repeated(words: list[str]) -> float:
    """Share of words that repeat the one or two before them."""
    if len(words) < 4:
        return 0.0
    return sum(w in words[max(0, i - 2) : i] for i, w in enumerate(words)) / len(words)


@lru_cache(maxsize=1)
def _stems() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for stem in _STEMS:
        found.add_word(stem, stem)
    found.make_automaton()
    return found


def cue(segment: str) -> str:
    """The kind of cue in a segment: a template's mark, filler, a phrase of pages, such a phrase in reported speech or in a question, or none."""
    if _MARKS.search(segment) and _PLACEHOLDER.search(segment):
        return "mark"
    raw = _WORDS.findall(segment)
    letters = [w.lower() for w in raw]
    if len(letters) >= 5 and _repeated(letters) > 0.7 or len(letters) >= 3 and len(set(letters)) == 1:
        return "filler"
    if len(raw) >= 6 and _COMMON.isdisjoint(letters) and sum(w[0].islower() for w in raw) >= 0.8 * len(raw):
        return "filler"  # words without any grammar
    low = segment.lower()
    if next(_stems().iter(low), None) is None:
        return ""
    notice = any(k in low for k in _NOTICE_WORDS) and _NOTICE.search(low)
    if notice or _ERROR.search(low) or _FILLER.search(low):
        return "asked" if segment.endswith("?") else "reported" if _REPORTED.search(low) else "phrase"
    return ""


_LABELS = {"mark": 1, "filler": 1, "phrase": 1, "reported": 0, "asked": 0, "": 0}


def weak_label(segment: str) -> int:
    """1 for residue, 0 for speech."""
    return _LABELS[cue(segment)]


# Tokens. Kinds of bytes: blank, line end, lower and upper letters, digits, stops, underscores and other marks.
_BLANK, _LINE, _LOWER, _UPPER, _DIGIT, _STOP, _UNDER, _MARK = range(8)


def _kinds() -> np.ndarray:
    table = np.full(256, _MARK, np.uint8)
    table[:33] = _BLANK
    table[10] = _LINE
    table[ord("a") : ord("z") + 1] = _LOWER
    table[ord("A") : ord("Z") + 1] = _UPPER
    table[ord("0") : ord("9") + 1] = _DIGIT
    for c in ".,;:!?":
        table[ord(c)] = _STOP
    table[ord("_")] = _UNDER
    table[128:] = _LOWER
    return table


_KIND = _kinds()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_LOUD = np.isin(np.arange(256), [ord(c) for c in "{}<>@#$%[]&\\|"])
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_U = np.uint64


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _U(_BASE)), np.full(size, _U(_BACK))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


def _named(name: str) -> np.uint64:
    return _U(int.from_bytes(name.encode()[:8].ljust(8, b"."), "little") * _BASE % (1 << 64))


_RARE = np.array([_named(f"rare {case}") for case in ("low", "one", "all", "mix")])
_SHAPES = np.array([_named(f"word {case}") for case in ("low", "one", "all", "mix")])
_START, _END = _named("start"), _named("end")


@dataclass
class Cut:
    """Texts cut into tokens and windows: a window is a segment, or a part of a long one, and covers the tokens from `first` up to `last`."""

    folded: np.ndarray  # hash of each token in lower case
    kind: np.ndarray
    case: np.ndarray  # 0 lower, 1 first letter, 2 all, 3 other letters upper
    length: np.ndarray  # in bytes; 9 for a number that may be a response state
    glued: np.ndarray  # nothing stands before it
    opens: np.ndarray  # first of its segment
    again: np.ndarray  # a word that repeats one of the two words before it
    closing: np.ndarray  # last byte
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    last: np.ndarray
    outer: tuple[np.ndarray, np.ndarray]  # the tokens of the segment it lies in, where it is the surroundings of something
    owner: np.ndarray
    data: bytes

    def text(self, window: int) -> str:
        return self._text(self.first[window], self.last[window])

    def label(self, window: int) -> int:
        """The weak label of a window; what surrounds a mark in reported speech or a question is no residue."""
        kind = cue(self.text(window))
        first, last = self.outer[0][window], self.outer[1][window]
        if kind == "phrase" and (first < self.first[window] or last > self.last[window]):
            kind = cue(self._text(first, last))
        return _LABELS[kind]

    def inner(self) -> np.ndarray:
        """Which windows are the surroundings of something inside a segment."""
        return (self.outer[0] < self.first) | (self.outer[1] > self.last)

    def _text(self, first: int, last: int) -> str:
        return self.data[self.low[first] : self.high[last - 1]].decode("utf-8", "replace")


def cut(texts: list[str], whole: bool = False) -> Cut:
    """Tokens and windows of texts; with `whole` each text with any token is one window."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = b"\n".join(parts) + b"\n"
    size = 1 << max(12, len(data).bit_length())
    b = np.frombuffer(data, np.uint8)
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    text_ends = np.cumsum(sizes)
    kind, folded, ends = _KIND[b], _FOLD[b], _ENDS[b]
    two = np.flatnonzero(b == 0xC2)  # blanks and marks of Latin-1
    for at in (two, two + 1):
        kind[at] = np.where(b[two + 1] == 0xA0, _BLANK, _MARK)
    three = np.flatnonzero(b == 0xE2)  # general punctuation and symbols
    dots = (b[three + 1] == 0x80) & (b[three + 2] == 0xA6)
    for i in range(3):
        kind[three + i] = np.where(dots, _STOP, _MARK)
        ends[three[dots] + i] = True
    accented = np.flatnonzero(b == 0xC3)
    upper = accented[(b[accented + 1] >= 0x80) & (b[accented + 1] <= 0x9E) & (b[accented + 1] != 0x97)]
    kind[upper], kind[upper + 1] = _UPPER, _UPPER
    folded[upper + 1] += 32
    letter = (kind == _LOWER) | (kind == _UPPER)
    straight = np.flatnonzero(b[1:-1] == 0x27) + 1 if len(b) > 2 else np.zeros(0, np.int64)
    straight = straight[letter[straight - 1] & letter[straight + 1]]
    curly = three[(b[three + 1] == 0x80) & (b[three + 2] == 0x99)]
    curly = curly[(curly > 0) & letter[curly - 1] & letter[np.minimum(curly + 3, len(b) - 1)]]
    for at in (straight, curly, curly + 1, curly + 2):
        kind[at], letter[at] = _LOWER, True
    group = np.where(letter, _LOWER, kind)
    solid = kind >= _LOWER
    change = np.empty(len(b), bool)
    change[0] = True
    np.not_equal(group[1:], group[:-1], out=change[1:])
    starts = np.flatnonzero(change & solid)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Cut(none.astype(_U), *(none,) * 11, (none, none), none, data)
    after = np.append(np.flatnonzero(change), len(b))
    stops = after[np.searchsorted(after, starts, "right")]
    # A hash of each token from running sums: the same wherever it stands.
    up, down = _powers(size)
    sums = np.empty(len(b) + 1, _U)
    sums[0] = 0
    np.cumsum((folded.astype(_U) + _U(1)) * down[: len(b)], out=sums[1:])
    hashed = _mix((sums[stops] - sums[starts]) * up[starts])
    tokens = group[starts].astype(np.int64)
    uppers = np.concatenate(([0], np.cumsum(kind == _UPPER)))
    n_upper, length = uppers[stops] - uppers[starts], stops - starts
    case = np.where(n_upper == 0, 0, np.where((n_upper == length) & (length > 1), 2, np.where((kind[starts] == _UPPER) & (n_upper <= 2), 1, 3)))
    case = np.where((case == 1) & (n_upper == 2) & (b[starts] != 0xC3), 3, case)
    state = (tokens == _DIGIT) & (length == 3) & ((b[starts] == ord("4")) | (b[starts] == ord("5")))  # as response states are written
    lines = np.concatenate(([0], np.cumsum(kind == _LINE)))
    glued = np.zeros(len(starts), bool)
    glued[1:] = starts[1:] == stops[:-1]
    broken = np.ones(len(starts), bool)
    broken[1:] = lines[starts[1:]] > lines[stops[:-1]]
    ended = np.concatenate(([0], np.cumsum(ends)))
    final = (ended[stops] > ended[starts]) & (tokens == _STOP)
    closed = final.copy()
    closed[1:] |= (tokens[1:] == _MARK) & glued[1:] & final[:-1]
    opens = broken.copy()
    opens[1:] |= closed[:-1] & ~glued[1:]
    owner_of = np.searchsorted(text_ends, starts, "right")
    # Words that repeat one of the two words before them in the text.
    words = np.flatnonzero(tokens == _LOWER)
    again = np.zeros(len(starts), bool)
    for back in (1, 2):
        if len(words) > back:
            same = (hashed[words[back:]] == hashed[words[:-back]]) & (owner_of[words[back:]] == owner_of[words[:-back]])
            again[words[back:][same]] = True
    # Windows.
    if whole:
        first = np.flatnonzero(np.concatenate(([True], owner_of[1:] != owner_of[:-1])))
        last = np.append(first[1:], len(starts))
        outer = first, last
    else:
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(starts))
        first, last = _windows(begin, end)
        # A run of very short segments is a window more, so that a word repeated line by line shows.
        short = (stops[end - 1] - starts[begin]) < 12
        of = owner_of[begin]
        fresh = np.ones(len(begin), bool)
        fresh[1:] = ~(short[1:] & short[:-1] & (of[1:] == of[:-1]))
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(begin))
        many = tail - head > 3
        more = _windows(begin[head[many]], end[tail[many] - 1])
        # The surroundings of a template's mark or a response state are a window too, so that a long sentence doesn't drown them.
        loud = (tokens == _UNDER) | ((tokens == _MARK) & (_LOUD[b[stops - 1]] | (b[starts] == 0xC2) & np.isin(b[stops - 1], (0xAB, 0xBB))))
        at = np.flatnonzero(loud | state)
        at = at[np.append(True, np.diff(at) > _NEAR)] if len(at) else at
        nth = np.searchsorted(begin, at, "right") - 1
        narrow = end[nth] - begin[nth] > _NEAR + 2
        ahead = np.where(state[at], _NEAR // 2, _NEAR + 2)
        around = np.maximum(at - _NEAR // 2, begin[nth])[narrow], np.minimum(at + ahead, end[nth])[narrow]
        first, last = np.concatenate((first, more[0])), np.concatenate((last, more[1]))
        outer = np.concatenate((first, begin[nth][narrow])), np.concatenate((last, end[nth][narrow]))
        first, last = np.concatenate((first, around[0])), np.concatenate((last, around[1]))
    return Cut(hashed, tokens, case, np.where(state, 9, length), glued, opens, again, b[stops - 1], starts, stops, first, last, outer, owner_of[first], data)


def _windows(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of `_LONG` tokens, each `_STEP` behind the one before it; what has no more tokens is one window."""
    count = np.maximum(1, -(-(end - begin) // _STEP) - 1)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(begin, count) + nth * _STEP
    return first, np.minimum(first + _LONG, np.repeat(end, count))


def segments(text: str) -> list[str]:
    """The windows of a whole text without quoted words: sentences and lines, of very long ones overlapping parts."""
    found = cut([_prepared(text)])
    return [found.text(i) for i in np.flatnonzero(~found.inner())]


def labelled(texts: list[str]) -> tuple[Cut, list[int | None]]:
    """The windows of texts and their weak labels; null where the surroundings of a mark say the same in fewer words."""
    found = cut([_prepared(t) for t in texts])
    labels: list[int | None] = [found.label(i) for i in range(len(found.first))]
    inner = found.inner()
    said = {int(found.outer[0][i]) for i in np.flatnonzero(inner) if labels[i]}
    for i in np.flatnonzero(~inner):
        if labels[i] and int(found.first[i]) in said:
            labels[i] = None
    return found, labels


def _prepared(text: str) -> str:
    return "\n".join(map(quotes_removed, text.split("\n"))) if _QUOTE.search(text) else text


def vocabulary(parts: list[str], least: int = 3, frequent: int = 200) -> bytes:
    """For each hashed word 1 where it occurs at least `least` times and 2 for the most frequent. Other words, mostly names, count as one word."""
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(parts), _ROWS):
        found = cut(parts[at : at + _ROWS], whole=True)
        counts += np.bincount((found.folded[found.kind == _LOWER] & _MASK).astype(np.int64), minlength=DIMENSIONS)
    flags = (counts >= least).astype(np.uint8)
    often = np.argsort(-counts, kind="stable")[:frequent]
    flags[often[counts[often] >= least]] = 2
    return flags.tobytes()


#: The slot of no feature; its weight is always 0.
_NONE = DIMENSIONS
_PER_TOKEN = 5


def features(found: Cut, place: np.ndarray, count: np.ndarray, known: bytes, blind: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Slots of hashed features, a row for each token and one for each window.

    For tokens: words, pairs of words, cased words and n-grams of the shape around marks.  Words that
    aren't known are told apart by their case only; `blind` takes every capitalised word for such.
    For windows: length, repetition, share of frequent words, place, title and end.
    """
    flags = np.frombuffer(known, np.uint8)
    word = found.kind == _LOWER
    seen = flags[(found.folded & _MASK).astype(np.int64)]
    rare = word & (seen == 0)
    if blind:
        rare |= word & (found.case > 0)
    ids = np.where(rare, _RARE[found.case], found.folded)
    digits = found.kind == _DIGIT
    ids[digits] = _mix(np.where(found.length[digits] == 9, 9, np.minimum(found.length[digits], 5)).astype(_U) + _named("number"))
    opens = found.opens
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[opens] = _START
    slots = np.full((len(ids), _PER_TOKEN), _NONE, np.int64)
    slots[:, 0] = (ids & _MASK).astype(np.int64)
    slots[:, 1] = (_mix(before * _U(0x100000001B3) ^ ids) & _MASK).astype(np.int64)
    closes = np.append(opens[1:], True) if len(opens) else opens
    slots[closes, 2] = (_mix(ids[closes] * _U(0x100000001B3) ^ _END) & _MASK).astype(np.int64)
    loud = word & (found.case > 1)
    slots[loud, 2] = (_mix(ids[loud] + found.case[loud].astype(_U) * _U(_BASE)) & _MASK).astype(np.int64)
    # Shapes: a mark with its neighbours, whether they touch, and two tokens further.
    shape = np.where(word, _SHAPES[found.case], ids)
    mark = ((found.kind >= _UNDER) | ((found.kind == _STOP) & (found.closing == ord(":"))))
    touch = found.glued.astype(_U) + _U(1)
    if len(ids):
        left, right, next_touch = np.roll(shape, 1), np.roll(shape, -1), np.roll(touch, -1)
        left[opens], right[closes], next_touch[closes] = _START, _END, 1
        near = mark | np.append(mark[1:], False) & ~closes | np.insert(mark[:-1], 0, False) & ~opens
        triple = _mix(_mix(left * touch ^ shape) * (next_touch + _U(7)) ^ right)
        slots[near, 3] = (triple[near] & _MASK).astype(np.int64)
        back, ahead = np.roll(triple, 1), np.roll(triple, -1)
        back[opens], ahead[closes] = _START, _END  # a text reads the same whatever stands beside it
        wide = _mix(back * _U(31) ^ ahead)
        slots[near, 4] = (wide[near] & _MASK).astype(np.int64)
    # Windows.
    first, last = found.first, found.last
    total = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[last] - c[first]
    n, words = last - first, np.maximum(1, total(word))
    chars = found.high[last - 1] - found.low[first] if len(first) else n
    size = np.ceil(np.log2(np.maximum(1, n))).astype(np.int64)
    few = words < 8
    facts = (
        size, np.ceil(np.log2(np.maximum(1, chars))).astype(np.int64), np.where(words < 4, 0, 4 * total(found.again) // words) * 16 + np.minimum(size, 4),
        (5 * total(word & (seen == 2)) // words) * 16 + np.minimum(size, 5), (4 * total(rare & (found.case == 0)) // words) * 16 + np.minimum(size, 5), 4 * total(digits) // np.maximum(1, n),
        total(word & (found.case == 2)) == words, (count == 1) * 1, ((place == 0) & few) * 1, ((place == count - 1) & (count > 1)) * 1,
        found.closing[last - 1].astype(np.int64) if len(first) else n,
    )
    table = np.stack([(_mix(np.asarray(v, np.int64).astype(_U) + _named(f"f{i}")) & _MASK).astype(np.int64) for i, v in enumerate(facts)], axis=1)
    return slots, table


@dataclass
class Classifier:
    """Weights of a logistic regression and the words it knows."""

    weights: np.ndarray
    bias: float
    known: bytes

    def dumps(self) -> bytes:
        """The classifier as bytes, to be kept and read again by `loads`, so that a later run needn't fit it."""
        buffer = io.BytesIO()
        np.savez_compressed(buffer, weights=self.weights, bias=np.float64(self.bias), known=np.frombuffer(self.known, np.uint8))
        return buffer.getvalue()

    @staticmethod
    def loads(kept: bytes) -> Classifier:
        with np.load(io.BytesIO(kept)) as file:
            return Classifier(file["weights"], float(file["bias"]), file["known"].tobytes())

    def windows(self, found: Cut, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The score of each window."""
        if not len(found.first):
            return np.zeros(0)
        slots, table = features(found, place, count, self.known)
        weights = np.append(self.weights, 0).astype(np.float64)
        total = lambda x: (c := np.concatenate(([0], np.cumsum(x))))[found.last] - c[found.first]
        sums = total(weights[slots].sum(axis=1)) + weights[table].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -30, 30)))

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """For each text, the score of the window that looks most like residue; 0 without any."""
        result = np.zeros(len(texts))
        batch: list[int] = []
        held = 0
        for at, text in enumerate(texts):
            if text:
                batch.append(at)
                held += len(text)
            if batch and (held > _CHUNK or at == len(texts) - 1):
                found = cut([_prepared(texts[i]) for i in batch])
                places, counts = numbered(found.owner)
                np.maximum.at(result, np.array(batch)[found.owner], self.windows(found, places, counts))
                batch, held = [], 0
        return result


def numbered(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each window in its text, and how many the text has."""
    counts = np.bincount(owner) if len(owner) else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    places = np.empty(len(owner), np.int64)
    places[order] = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner[order]]
    return places, counts[owner] if len(owner) else counts


def fit(slots: np.ndarray, sizes: np.ndarray, labels: np.ndarray, known: bytes, *, epochs: int = 6, rate: float = 0.1, l2: float = 1e-6, batch: int = 512) -> Classifier:
    """Logistic regression by AdaGrad with L2 on the touched weights; classes count alike up to six times; the same rows give the same weights.

    `slots` holds the rows one behind the other, `sizes` their lengths.
    """
    w, seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    bias, bias_seen = -3.0, 1e-6
    positives = max(1, int(labels.sum()))
    heavy = min(6.0, (len(labels) - positives) / positives)
    order = np.random.RandomState(7)
    starts = np.cumsum(sizes) - sizes
    for _ in range(epochs if 0 < labels.sum() < len(labels) else 0):
        mixed = order.permutation(len(labels))
        for at in range(0, len(mixed), batch):
            chosen = mixed[at : at + batch]
            n = sizes[chosen]
            cuts = np.cumsum(n) - n
            places = slots[np.arange(n.sum()) + np.repeat(starts[chosen] - cuts, n)]
            p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[places], cuts) + bias, -30, 30)))
            error = (p - labels[chosen]) * np.where(labels[chosen] > 0, heavy, 1.0) / len(chosen)
            touched, back = np.unique(places, return_inverse=True)
            gradient = np.bincount(back, weights=np.repeat(error, n)) + l2 * w[touched]
            seen[touched] += gradient**2
            w[touched] -= rate * gradient / np.sqrt(seen[touched])
            bias_seen += error.sum() ** 2
            bias -= rate * 0.1 * error.sum() / np.sqrt(bias_seen)
    return Classifier(w.astype(np.float32), float(bias), known)


def labelled_sample(documents: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", most: int = FIT_DOCUMENTS) -> pa.Table:
    """The windows of at most about `most` documents: (source, place, count, segment, label), sorted.

    A text with any positive window gives its positive windows only: what surrounds them may be more of the same.
    """
    total = documents.count()
    share = min(1.0, most / max(1, total))
    picked = documents.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s")).where("t is not null")
    picked = picked.where(F.pmod(F.xxhash64(F.lit("fit"), "k"), F.lit(1_000_000)) < F.lit(round(share * 1_000_000)))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts, sources = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, len(texts), 100):
                found, labels = labelled(texts[at : at + 100])
                places, counts = numbered(found.owner)
                positive = {int(found.owner[i]) for i, y in enumerate(labels) if y}
                kept = [i for i, y in enumerate(labels) if y or y == 0 and int(found.owner[i]) not in positive]
                rows += [(sources[at + int(found.owner[i])], int(places[i]), int(counts[i]), found.text(i), labels[i]) for i in kept]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["source", "place", "count", "segment", "label"])

    found = spread(picked).mapInArrow(label, "source string, place bigint, count bigint, segment string, label bigint")
    return found.distinct().toArrow().sort_by([(c, "ascending") for c in ("segment", "source", "place", "count")])


def train(sample: pa.Table) -> Classifier:
    _, places, counts, parts, labels = sample.columns
    places, counts, labels = places.to_numpy(), counts.to_numpy(), labels.to_numpy()
    parts = parts.to_pylist()
    known = vocabulary(parts)
    everything = np.arange(len(parts))
    # Short speech once more with its names hidden, so that names of other texts don't tell.
    short = everything[np.fromiter((len(p) < 60 for p in parts), bool, len(parts)) & (labels == 0)]
    rows, sizes, said = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blind, chosen in ((False, everything), (True, short)):
        for at in range(0, len(chosen), _ROWS):
            some = chosen[at : at + _ROWS]
            found = cut([parts[i] for i in some], whole=True)
            if not len(found.first):
                continue
            own = some[found.owner]
            slots, table = features(found, places[own], counts[own], known, blind)
            flat = np.concatenate((slots.ravel(), table.ravel())).astype(np.int32)
            of = np.concatenate((np.repeat(np.arange(len(own)), (found.last - found.first) * _PER_TOKEN), np.repeat(np.arange(len(own)), table.shape[1])))
            keep = flat != _NONE
            flat, of = flat[keep], of[keep]
            rows.append(flat[np.argsort(of, kind="stable")])
            sizes.append(np.bincount(of, minlength=len(own)))
            said.append(labels[own])
    return fit(np.concatenate(rows), np.concatenate(sizes), np.concatenate(said), known)


def residue_scores(documents: DataFrame, classifier: Classifier, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every document; null and blank texts score 0."""
    weights, bias, known = classifier.weights, classifier.bias, classifier.known

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(weights, bias, known)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.documents(batch.column(1).to_pylist()))], [key, "score"])

    picked = documents.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return spread(picked).mapInArrow(score, f"`{key}` {dict(picked.dtypes)[key]}, score double")


def residue(documents: DataFrame, *, key: str = "doc_id", threshold: float = THRESHOLD, classifier: Classifier | None = None, **options) -> DataFrame:
    """The distinct keys of documents with residue; anti-join with it to exclude them.

    A `classifier` fitted before saves the fit.

    Cases: null and blank texts are no residue; whole texts are read, whatever their length; rows with
    a null key give no rows; repeated rows count once; without residue in the sample nothing is found;
    an empty table gives no rows; other columns are never read.
    """
    classifier = classifier or train(labelled_sample(documents, key=key, **options))
    return residue_scores(documents, classifier, key=key).where(F.col(key).isNotNull() & (F.col("score") >= threshold)).select(key).distinct()


def validation(documents: DataFrame, *, folds: int = 4, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(fold, sources, segments, positives, precision, recall) on sources that the classifier of the fold hasn't seen.

    Measured against the weak labels, with the features and the fit that `residue` uses.
    """
    sample = labelled_sample(documents, **options)
    names = sorted(set(sample.column("source").to_pylist()))
    rows = []
    for fold in range(folds):
        unseen = names[fold::folds]
        mask = pc.is_in(sample.column("source"), pa.array(unseen, pa.string()))
        held = sample.filter(mask)
        true = held.column("label").to_numpy() > 0
        said = held_out_scores(sample.filter(pc.invert(mask)), held) >= threshold
        both = int((said & true).sum())
        rows.append((fold, ", ".join(unseen), len(true), int(true.sum()), both / max(1, int(said.sum())), both / max(1, int(true.sum()))))
    schema = "fold int, sources string, segments bigint, positives bigint, precision double, recall double"
    return documents.sparkSession.createDataFrame(rows, schema)


def held_out_scores(fitted: pa.Table, held: pa.Table) -> np.ndarray:
    """The scores that a classifier of the windows of `fitted` gives to those of `held`."""
    model = train(fitted)
    found = cut(held.column("segment").to_pylist(), whole=True)
    scores = np.zeros(held.num_rows)
    scores[found.owner] = model.windows(found, held.column("place").to_numpy()[found.owner], held.column("count").to_numpy()[found.owner])
    return scores
