"""Free-entered values to the entries of a canonical list.

A multi-pattern automaton over canonical names and aliases finds embedded mentions, of which the
longest that don't overlap win; values without one go to a token-set similarity.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import bounded_rows

UNMATCHED = "unmatched"
#: The list is held by every worker, so its size must be proven.
MOST_ENTRIES = 200_000

#: Least likeness of two words, and least lead over the second best entry. Misspellings of four letters
#: in ten still pass; unrelated names differ in about six.
ALIKE, MARGIN = 0.6, 0.02
#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans(
    "абвгдеіјкмнорсԁһѕтухӏԛԝАВЕЅІЈКМНОРСТУХαβεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıØøłŁ",
    "a6brдeijkmнopcdhstyxlqwABESIJKMHOPCTYXabeikvoptuxABEZHIKMNOPTYXiOolL".replace("6", "б").replace("д", "d").replace("н", "h"),
)
#: Digits written for letters inside words.
_DIGITS = str.maketrans("013457", "oleast")
#: Legal forms and additions that name no owner.
_NOISE = frozenset(
    "the of and by for a an org www http https com net io example models model huggingface github "
    "inc incorporated llc ltd limited gmbh bv b v sa s pty plc corp corporation co company ag kg oy ab srl "
    "team dev internal official verified hosted community via gateway formerly beta mirror account user prod staging".split()
)
#: Kinds of organisations that are spelled in more than one way.
_SAME_KIND = {"laboratories": "labs", "laboratory": "labs", "lab": "labs", "robotix": "robotics", "rsch": "research", "resrch": "research", "technology": "technologies", "work": "works", "system": "systems"}


def words(text: str) -> list[str]:
    """The lower-case words of a text: scripts, accents and digits for letters folded, joined words split."""
    text = unicodedata.normalize("NFKC", text).translate(_LOOKALIKES)
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z])|(?<=[a-z]{2})(?=[A-Z]{2,}$)", " ", text).lower()
    found = re.findall(r"[^\W_]+", text)
    return [w.translate(_DIGITS) if len(re.findall(r"[a-z]", w)) >= 2 and re.search(r"\d", w) else w for w in found]


@lru_cache(maxsize=200_000)
def edits(a: str, b: str, most: int = 3) -> int:
    """Edits from a to b, a swap of neighbours being one; `most` + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


class Letters:
    """Texts that can be asked, all at once, which of them may lie within some edits of another text.

    Letters that one text has more of than the other each need an edit, whatever their order.  So what
    is left out is too far, and only the rest is measured.  Letters share 64 counters, which can only
    let more through.
    """

    def __init__(self, texts: list[str]):
        self.by_length: dict[int, tuple[list[str], np.ndarray]] = {}
        for size, group in groupby(sorted(set(texts), key=lambda t: (len(t), t)), key=len):
            same = list(group)
            self.by_length[size] = same, np.stack([self._counts(t) for t in same])

    @staticmethod
    def _counts(text: str) -> np.ndarray:
        return np.bincount(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64) & 63, minlength=64).astype(np.int16)

    def near(self, text: str, most: Callable[[int], int]) -> Iterator[tuple[str, int]]:
        """(text, edits) of all that lie within `most` edits, which depends on the longer of both lengths."""
        own = self._counts(text)
        for size, (same, counts) in self.by_length.items():
            bound = most(max(size, len(text)))
            if abs(size - len(text)) > bound:
                continue
            missing = max(size, len(text)) - np.minimum(counts, own).sum(axis=1)
            for i in np.flatnonzero(missing <= bound):
                if (far := edits(same[i], text, bound)) <= bound:
                    yield same[i], far


class Canon:
    """The canonical list, ready to match: one for each worker."""

    def __init__(self, entries: list[tuple[str, str, list[str] | None]]):
        self.forms: list[tuple[tuple[str, ...], str]] = []
        owners: dict[str, set[str]] = defaultdict(set)
        kinds: Counter[str] = Counter()
        for entry, name, aliases in entries:
            own = words(name)
            if len(own) > 1:
                kinds[own[-1]] += 1
            for form in {tuple(words(x)) for x in (entry, name, *(aliases or [])) if x} - {()}:
                self.forms.append((form, entry))
                owners[" ".join(form)].add(entry)
                owners["".join(form)].add(entry)
        self.kinds = {k for k, n in kinds.items() if n > 1}
        self.kind_of = {entry: w[-1] for entry, name, _ in entries if len(w := words(name)) > 1}
        self.automaton = ahocorasick.Automaton()
        for text, of in owners.items():
            if len(of) == 1:  # a form of several entries names none of them
                self.automaton.add_word(f" {text} ", (len(text.split()), len(text), next(iter(of))))
        if owners:
            self.automaton.make_automaton()
        # A form can only be alike by one of its words, by its start or as a whole; each has an index.
        self.by_word: dict[str, list[int]] = defaultdict(list)
        self.by_whole: dict[str, list[int]] = defaultdict(list)
        for i, (form, _) in enumerate(self.forms):
            self.by_whole["".join(form)].append(i)
            for w in set(form) - self.kinds:
                self.by_word[w].append(i)
        self.wholes = sorted((" ".join(form), i) for i, (form, _) in enumerate(self.forms))
        self.words = Letters([w for w in self.by_word if len(w) >= 5])
        self.joined = Letters(list(self.by_whole))
        self.likes: dict[str, dict[str, float]] = {}

    def _likes(self, x: str) -> dict[str, float]:
        """The words of forms that a word is like, by the likeness their edits leave."""
        if x not in self.likes:
            if len(self.likes) > 200_000:
                self.likes.clear()
            most = lambda longer: int(longer * (1 - ALIKE) + 1e-9)  # noqa: E731  more edits than this are less than ALIKE
            self.likes[x] = {w: 1 - far / max(len(w), len(x)) for w, far in self.words.near(x, most)} if len(x) >= 4 else {}
        return self.likes[x]

    def _candidates(self, kept: list[str]) -> set[int]:
        """The forms that can have a score: all others have 0."""
        text = " ".join(kept)
        found = {i for x in kept for w in (x, *self._likes(x)) for i in self.by_word.get(w, ())}
        if len(text) >= 5:
            at = bisect_left(self.wholes, (text, -1))
            while at < len(self.wholes) and self.wholes[at][0].startswith(text):
                found.add(self.wholes[at][1])
                at += 1
        return found | {i for whole, _ in self.joined.near("".join(kept), lambda _: 2) for i in self.by_whole[whole]}

    def _kind(self, word: str) -> str | None:
        """The kind of organisation a word stands for: spelled out, cut short or misspelled."""
        word = _SAME_KIND.get(word, word)
        if word in self.kinds:
            return word
        if len(word) >= 3:
            starts = [k for k in self.kinds if k.startswith(word)]
            if len(starts) == 1:
                return starts[0]
            close = [k for k in self.kinds if len(k) > 4 and edits(word, k, 2) <= (1 if len(k) < 8 else 2)]
            if len(close) == 1:
                return close[0]
        return None

    def _mention(self, found: list[str]) -> str | None:
        """The entry of the longest mention; "" where what stands beside it names another kind; null without one."""
        if not len(self.automaton):
            return None
        text = f" {' '.join(found)} "
        hits = sorted(((end - size - 1, end, entry) for end, (_, size, entry) in self.automaton.iter(text)), key=lambda h: (h[0] - h[1], h[0]))
        taken: list[tuple[int, int, str]] = []
        for start, end, entry in hits:  # the blanks around a mention may be shared
            if all(end <= s or start >= e for s, e, _ in taken):
                taken.append((start, end, entry))
        if not taken:
            return None
        inside = {w for s, e, _ in taken for w in text[s:e].split()}
        entry = taken[0][2]
        own = self.kind_of.get(entry)
        for w in found:
            if w not in inside and w not in _NOISE and own and not own.startswith(w) and self._kind(w) not in (None, own):
                return ""
        return entry

    def _similar(self, found: list[str]) -> str | None:
        """The entry whose words are the most alike, each paired with a word of the value; null where two are equally alike."""
        kept = [w for w in found if w not in _NOISE] or found
        best: dict[str, float] = {}
        for i in self._candidates(kept):
            form, entry = self.forms[i]
            if (score := self._score(kept, form)) > best.get(entry, 0.0):
                best[entry] = score
        order = sorted(best.items(), key=lambda x: (-x[1], x[0]))
        if not order or len(order) > 1 and order[0][1] - order[1][1] < MARGIN:
            return None
        return order[0][0]

    def _score(self, kept: list[str], form: tuple[str, ...]) -> float:
        """0 to 1: how alike the word sets are; 0 where a word that tells names apart has no partner."""
        text, whole = " ".join(kept), " ".join(form)
        if 5 <= len(text) < len(whole) and whole.startswith(text):  # cut short
            return 0.7 + 0.3 * len(text) / len(whole)
        if len(kept) != len(form) and len(whole) > 6:  # words joined or torn apart
            far = edits(text.replace(" ", ""), whole.replace(" ", ""), 2)
            if far <= (1 if len(whole) < 12 else 2):
                return 0.99 - 0.03 * far
        free = list(kept)
        total, stems = 0.0, 0
        for w in form:
            like, partner = max(((self._alike(w, x), x) for x in free), default=(0.0, ""))
            if like < ALIKE:
                return 0.0
            stems += w not in self.kinds
            free.remove(partner)
            total += like
        if not stems or any(self._kind(x) for x in free) or sum(map(len, free)) > 3:
            return 0.0
        return total / len(form)

    def _alike(self, w: str, x: str) -> float:
        if w == x:
            return 1.0
        if w in self.kinds:
            return 0.95 if self._kind(x) == w else 0.9 if len(x) >= 2 and w.startswith(x) else 0.0
        return self._likes(x).get(w, 0.0)

    def match(self, value: str | None) -> str | None:
        """The entry a value means, "unmatched", or null for null and blank."""
        if value is None or not value.strip():
            return None
        found = words(value)
        if not found:
            return UNMATCHED
        said = self._mention(found)
        if said is None:
            said = self._similar(found)
        return said or UNMATCHED


def matched(values: DataFrame, canon: DataFrame, *, key: str = "listing_id", value: str = "owned_by", entry: str = "id", name: str = "name", aliases: str = "aliases", result: str = "author_id") -> DataFrame:
    """Distinct (key, result) of each row whose value is neither null nor blank.

    `result` is the entry of `canon` that the value means, or "unmatched".  A mention inside a longer
    text counts; two mentions of the same length, the first.  A name of another kind of organisation
    beside a mention ("X Labs" where only "X Robotics" is listed) contradicts it.

    Cases: rows with a null key give no rows; a value without letters or digits is unmatched; a form
    that two entries share names neither; entries with a null id or name are ignored, null aliases
    too; an empty list leaves all unmatched; a key with several different values has several rows;
    other columns are never read.  More than MOST_ENTRIES entries raise an error.

    Each worker builds the automaton once and looks at each different value of a batch once, so
    nothing is joined and no value's popularity matters.
    """
    rows = bounded_rows(canon.select(F.col(entry).cast("string"), F.col(name).cast("string"), aliases), MOST_ENTRIES)
    entries = [(r[0], r[1], [a for a in (r[2] or []) if a]) for r in rows if r[0] and r[1]]
    entries = sorted(entries)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Canon(entries)
        seen: dict[str, str | None] = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for t in set(texts):
                if t not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen[t] = known.match(t)
            found = pa.array([seen[t] if t in seen else known.match(t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], [key, result])

    picked = values.select(F.col(key), F.col(value)).where(F.col(key).isNotNull() & (F.trim(value) != ""))
    kind = dict(values.select(F.col(key)).dtypes)[key]
    return picked.mapInArrow(read, f"`{key}` {kind}, `{result}` string").where(F.col(result).isNotNull()).distinct()
