"""Linking variant spellings of people and organisations."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.operators.groups import connected_components
from anchorline.session import materialize

# Titles and suffixes, which say nothing about who is meant; joining words; legal forms (each line one form).
TITLES = "dr doctor prof professor mr mrs ms miss mx sir dame rev hon eng ing dipl mag jr sr ii iii iv phd md esq".split()
FILLERS = "the and of for und et y de la le".split()
LEGAL = {w: ws.split()[0] for ws in (
    "incorporated inc incorp", "limited ltd lim", "company co comp coy", "corporation corp corpn", "llc", "gmbh", "plc", "ag", "sa", "srl", "bv", "nv", "oy", "ab", "kg", "llp", "lp", "pty", "sarl", "spa",
) for w in ws.split()}
# Words that say what an organisation does, for tables too small to learn them from. Short forms are never listed.
SEED = (
    "associates brothers chemicals instruments transport engineering technologies publishing services logistics department stores textiles foods manufacturing electrical laboratories international furniture design group holdings "
    "industries systems solutions partners products energy construction trading supplies bank insurance management consulting software pharmaceuticals motors media agency"
).split()
# Given names and the nicknames they go by, each line one name.
GIVEN = {w: ws.split()[0] for ws in (
    "abigail abby abbie gail", "alexander alex alec sandy sasha xander", "anthony tony ant", "benjamin ben benny benji", "charles charlie chuck chas chip", "christopher chris topher kit", "deborah deb debbie debby", "edward ed eddie ted teddy ned",
    "elizabeth liz lizzie beth betty eliza betsy libby", "frederick fred freddie freddy", "gregory greg gregg", "james jim jimmy jamie", "jennifer jen jenny jenn", "josephine jo josie", "katherine kate katie kathy kat kitty catherine", "lawrence larry laurie",
    "margaret maggie meg peggy marge greta", "matthew matt matty", "michael mike mick mickey micky", "nicholas nick nicky nico", "patricia pat patty trish tricia", "penelope penny nell", "rebecca becky becca", "richard rick dick rich ricky richie",
    "robert bob rob bobby robbie bert", "samuel sam sammy", "susannah sue susie susan suzy anna", "theodora theo dora thea", "victoria vicky vicki tori vic", "william bill will billy willy liam", "john jack johnny", "joseph joe joey", "thomas tom tommy",
    "daniel dan danny", "david dave davy", "andrew andy drew", "george georgie", "henry harry hank", "stephen steve steven", "peter pete", "philip phil", "kenneth ken kenny", "ronald ron ronnie", "timothy tim", "barbara barb", "dorothy dot dottie", "helen nellie", "martha marty",
    "mary molly polly", "sarah sally sadie", "ann annie nan", "catherine cathy", "florence flo", "gerald gerry jerry", "leonard len lenny", "nathaniel nate nat", "raymond ray", "walter walt wally", "eugene gene", "francis frank", "harold hal",
) for w in ws.split()}

#: A word is learned to say what an organisation does if it is in so many spellings, and in so large a share of them, and if so
#: large a share of its spellings have a legal form. The shares bound the number of learned words by the words of a name / LEAST_SHARE.
LEAST_SPELLINGS, LEAST_SHARE, LEAST_FORMED = 20, 0.004, 0.4
#: Letters of a word whose deletes are indexed (words that agree in them and differ later still meet), and letters of a cut word that are looked up at once.
PREFIX, STEM = 12, 32


def fold(text: str) -> str:
    """Lower case without accents or compatibility forms."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L"))
    return "".join(c for c in text if not unicodedata.combining(c)).casefold()


def near(a: str, b: str) -> bool:
    """At most one letter is added, dropped, changed or swapped with its neighbour."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def near_long(a: str, b: str) -> bool:
    """Words of 8 letters or more that begin alike and differ by at most two letters added, dropped or changed."""
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 2 or a[0] != b[0]:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > 2:
            return False
    return row[-1] <= 2


def abbreviates(a: str, w: str) -> bool:
    """The letters of `a` occur in `w` in their order, the first being the first, and `a` is shorter."""
    if not 2 <= len(a) < len(w) or a[0] != w[0]:
        return False
    rest = iter(w)
    return all(c in rest for c in a)


def same_stem(a: str, w: str) -> bool:
    """Two endings of one word: at least six letters in common at the start, and at most four others in each; in long words with one slip in the first seven."""
    n = 0
    while n < min(len(a), len(w)) and a[n] == w[n]:
        n += 1
    if n >= max(6, len(a) - 4, len(w) - 4):
        return True
    return min(len(a), len(w)) >= 8 and abs(len(a) - len(w)) <= 4 and a[0] == w[0] and any(near(a[:k], w[:7]) for k in (6, 7, 8))


def deletes(token: str) -> set[str]:
    """The token and all forms with one letter left out."""
    return {token} | {token[:i] + token[i + 1 :] for i in range(len(token))} if len(token) > 2 else {token}


class Lexicon:
    """Known words and what they stand for; a token is looked up exactly, then with slips."""

    def __init__(self, words: dict[str, str], least: int):
        self.words, self.least = words, least
        self.full = sorted(set(words.values()))
        self.by_letter = {i: [w for w in self.full if w[0] == i] for i in {w[0] for w in self.full}}
        self.seen: dict[object, str | None] = {}  # results of a batch of names, see `forget`

    @cached_property
    def slips(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for w in self.words:
            if len(w) >= max(4, self.least):
                for d in deletes(w):
                    out.setdefault(d, []).append(w)
        return out

    def find(self, token: str) -> str | None:
        """The word that `token` spells with at most one slip, or two in a long word; short tokens must be exact."""
        if token in self.words:
            return self.words[token]
        if len(token) >= self.least:
            for d in sorted(deletes(token)):
                for w in self.slips.get(d, ()):
                    if near(token, w):
                        return self.words[w]
        return next((w for w in self.by_letter.get(token[0], ()) if near_long(token, w)), None)

    def forget(self) -> None:
        """Drop what is remembered of tokens, so that it does not grow with the table."""
        self.seen.clear()


class Trades(Lexicon):
    """Words for what an organisation does. Rarer ones that are another ending or a short form of a more frequent one stand for it."""

    def __init__(self, words: list[str]):
        known: dict[str, str] = {}
        for w in words:  # the most frequent first
            known[w] = next((k for k in known.values() if near(w, k) or same_stem(w, k) or (len(w) >= 3 and abbreviates(w, k))), w)
        super().__init__(known, 6)

    def trade(self, token: str, dotted: bool) -> str | None:
        """The word that `token` is, misspells, cuts short or contracts.

        Cut with a dot, or a contraction (first and last letter kept, at most one vowel) or four letters without vowels, needs no further evidence."""
        at = (token, dotted)
        if at not in self.seen:
            self.seen[at] = self._trade(token, dotted)
        return self.seen[at]

    def _trade(self, token: str, dotted: bool) -> str | None:
        if (found := self.find(token)) is not None:
            return found
        alike = self.by_letter.get(token[0], ())
        if len(token) >= 5 and (hit := next((w for w in self.full if len(w) == 5 and near(token, w)), None)):
            return hit
        if len(token) >= 3:
            vowels = len(re.findall("[aeiou]", token))
            for w in alike:
                if (dotted and (w.startswith(token) or (len(token) >= 5 and any(near(token, w[:n]) for n in range(len(token) - 1, len(token) + 2))))) or same_stem(token, w):
                    return w
            for w in alike:
                if abbreviates(token, w) and vowels <= 1 and (token[-1] == w[-1] or (vowels == 0 and len(token) >= 4)):
                    return w
        return None


NAMES, FORMS, SEEDS = Lexicon(GIVEN, 3), Lexicon(LEGAL, 6), Trades(SEED)


@dataclass(frozen=True)
class Parsed:
    """A name taken apart. `own`: family names of a person, or the words an organisation has for itself; `cut`: those ending in a dot;
    `ends`: the first and last own word of a name of which one may be an unknown given name; `lead`: the first initial is the given name's."""

    kind: str
    own: tuple[str, ...]
    cut: tuple[str, ...] = ()
    given: str = ""
    initials: tuple[str, ...] = ()
    sectors: tuple[str, ...] = ()
    legal: str = ""
    ends: tuple[str, ...] = ()
    lead: bool = False

    def key(self) -> str:
        return "|".join([self.kind, " ".join(self.own), " ".join(self.cut), self.given, " ".join(self.initials), " ".join(self.sectors), self.legal, " ".join(self.ends), "1" if self.lead else ""])

    @staticmethod
    def of(key: str) -> Parsed:
        kind, own, cut, given, initials, sectors, legal, ends, lead = key.split("|")
        return Parsed(kind, tuple(own.split()), tuple(cut.split()), given, tuple(initials.split()), tuple(sectors.split()), legal, tuple(ends.split()), bool(lead))


def tokens(name: str | None) -> list[str]:
    """The words of a name, folded, each with a dot or comma that follows it."""
    if name is None:
        return []
    split = re.sub(r"(?<=[^\W\d_]{3}[a-zà-ÿ])(?=[A-ZÀ-Þ][a-zà-ÿ])", " ", unicodedata.normalize("NFC", name))  # a blank left out
    raw = re.findall(r"([^\W_]+)(\.?)\s*(,?)", fold(split).replace("'", "").replace("’", ""))
    return [t + dot + comma for t, dot, comma in raw if t not in FILLERS]


def parse(name: str | None, trades: Trades = SEEDS, short: dict[str, str] | None = None) -> Parsed | None:
    """Take a name apart; None for null names and names without letters or digits. `short` maps words of the name to those they were learned to abbreviate."""
    return parse_tokens(tokens(name), trades, short)


def _given(token: str, dotted: bool) -> str | None:
    """The given name that a token is, misspells, or cuts short (with a dot, or five letters that only one name begins with)."""
    at = (token, dotted)
    if at not in NAMES.seen:
        NAMES.seen[at] = _given_of(token, dotted)
    return NAMES.seen[at]


def _given_of(token: str, dotted: bool) -> str | None:
    if (found := NAMES.find(token)) is not None:
        return found
    if len(token) >= (3 if dotted else 5):
        hits = {w for w in NAMES.full if w.startswith(token)}
        return hits.pop() if len(hits) == 1 else None
    return None


def parse_tokens(raw: list[str], trades: Trades = SEEDS, short: dict[str, str] | None = None) -> Parsed | None:
    words = [(t.rstrip(".,"), "." in t, t.endswith(",")) for t in raw]
    if not words:
        return None
    trade = lambda t, dot: (short or {}).get(t) or trades.trade(t, dot)
    long = [(t, dot) for t, dot, _ in words if len(t) > 1]
    # A short word between two trade words joins them, however it is spelled.
    long = [x for i, x in enumerate(long) if not (0 < i < len(long) - 1 and len(x[0]) <= 4 and near(x[0], "and") and trade(*long[i - 1]) and trade(*long[i + 1]))]
    own, cut, secs, form = [], [], [], ""
    for t, dot in long:
        if (legal := FORMS.find(t)) is not None:
            form = form or legal
        elif (found := trade(t, dot)) is not None:
            secs.append(found)
        else:
            own.append(t)
            if dot:
                cut.append(t)
    if (form or secs) and own:
        return Parsed("org", tuple(sorted(own)), tuple(sorted(set(cut))), "", tuple(sorted(t for t, *_ in words if len(t) == 1)), tuple(sorted(set(secs))), form)
    people = [(t, dot) for t, dot in long if t not in TITLES] or long
    initials = tuple(t for t, *_ in words if len(t) == 1)
    at = [i for i, (t, _) in enumerate(people) if t in GIVEN] or [i for i, (t, dot) in enumerate(people) if _given(t, dot)]
    if at and len(people) > 1:
        given = _given(*people[at[0]]) or ""
        rest = people[: at[0]] + people[at[0] + 1 :]
        return Parsed("person", tuple(sorted(t for t, _ in rest)), tuple(sorted({t for t, d in rest if d})), given, initials)
    spoken = [t for t, *_ in words if t not in TITLES]
    # An initial that leads, ends or follows a comma stands for the given name; one in the middle follows a given name that is not known.
    lead = bool(initials) and (len(spoken[0]) == 1 or len(spoken[-1]) == 1 or len(people) < 2 or any(comma and len(words[i + 1][0]) == 1 for i, (_, _, comma) in enumerate(words[:-1])))
    ends = () if lead or len(people) < 2 else tuple(dict.fromkeys([people[0][0], people[-1][0]]))
    return Parsed("person" if initials else "plain", tuple(sorted(t for t, _ in people)), tuple(sorted({t for t, d in people if d})), "", initials, (), "", ends, lead)


def _word(a: str, b: str, cut_a: bool, cut_b: bool) -> float:
    """How well two words agree: 1 the same, 0.9 one slip, 0.8 one is the other cut short (with a dot, or four letters and more), 0.7 two slips in a long word, 0 not."""
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 4 and near(a, b):
        return 0.9
    if len(a) > len(b):
        a, b, cut_a = b, a, cut_b
    if len(a) < len(b) and len(a) >= (2 if cut_a else 4) and (b.startswith(a) or (cut_a and len(a) >= 5 and near(a, b[: len(a)]))):
        return 0.8
    return 0.7 if near_long(a, b) else 0.0


def _matching(cost: list[list[float]]) -> list[int]:
    """The assignment of least total cost (Hungarian method with potentials, cubic in the number of words): the column of each row."""
    n = len(cost)
    u, v, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, came, seen = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while row_of[at]:
            seen[at] = True
            step, to = float("inf"), 0
            for j in range(1, n + 1):
                if not seen[j]:
                    c = cost[row_of[at] - 1][j - 1] - u[row_of[at]] - v[j]
                    if c < least[j]:
                        least[j], came[j] = c, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(n + 1):
                if seen[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = to
        while at:
            row_of[at] = row_of[came[at]]
            at = came[at]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


def assign(a: Parsed, b: Parsed) -> float:
    """Score of the best one-to-one assignment of the own words of both; 0 unless every word has a partner.

    Words that occur in both are partners of themselves, which no better assignment undoes: whoever else they could serve can serve as well."""
    return _assign(a.own, b.own, a.cut, b.cut)


def _assign(a: tuple[str, ...], b: tuple[str, ...], cut_a: tuple[str, ...], cut_b: tuple[str, ...]) -> float:
    if len(a) != len(b) or not a:
        return 0.0
    if a == b:
        return 1.0
    grid = [[_word(x, y, x in cut_a, y in cut_b) for y in b] for x in a]
    if not all(any(r) for r in grid):
        return 0.0
    n = len(a)
    found = _matching([[1.0 - v if v else 4.0 * n for v in r] for r in grid])  # a pair that does not agree costs more than all others together
    scores = [grid[i][j] for i, j in enumerate(found)]
    return sum(scores) / n if all(scores) else 0.0


def _slurred(a: str, b: str, cut_a: bool, cut_b: bool) -> bool:
    """Words that begin alike and differ by more than `_word` allows: two slips, one in a word of three letters, or one in a word that is also cut short to four letters or more."""
    if a[0] != b[0]:
        return False
    if len(a) > len(b):
        a, b, cut_a, cut_b = b, a, cut_b, cut_a
    if len(a) < 4:
        return len(a) == 3 and near(a, b)
    if near(a, b[: len(a)]) or any(near(a, b[:n]) for n in (len(a) - 1, len(a) + 1) if cut_a):
        return True
    if len(b) - len(a) > 2:
        return False
    # Two edits: one of them undone leaves words that are near.
    return any(near(x, y) for x in deletes(a) | {a} for y in deletes(b) | {b}) and _distance(a, b) <= 2


def _distance(a: str, b: str) -> int:
    """Letters added, dropped, changed or swapped with the neighbour."""
    last2, last, row = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last2, last, row = last, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], last2[j - 2] + 1)
    return row[-1]


def contexts(p: Parsed) -> list[tuple[str, str]]:
    """For each own word: what must be equal if that word alone may be slurred, and the word: the other own words (eight letters or more), the known
    given name or the sectors, and the word's first letter."""
    if not p.given and not p.sectors:
        return []
    out = []
    for i, w in enumerate(p.own):
        rest = p.own[:i] + p.own[i + 1 :]
        if sum(map(len, rest)) >= 8:
            out.append((f"{p.kind} {p.given} {' '.join(p.sectors)}|{' '.join(rest)}|{w[0]}", w))
    return out


def slurs(word: str) -> set[str]:
    """Forms of which words share one if `_slurred` holds between them: up to two letters left out, or one of the first four."""
    one = deletes(word[:PREFIX])
    return one | {d[:i] + d[i + 1 :] for d in one for i in range(len(d))} | {f"{d} " for d in deletes(word[:4])}


def _but_one(a: Parsed, b: Parsed) -> bool:
    """All but one own word are equal, that one is slurred, and what else is known of both is the same."""
    known = {c: w for c, w in contexts(a)}
    return any(c in known and _slurred(known[c], w, known[c] in a.cut, w in b.cut) for c, w in contexts(b))


def same(a: Parsed, b: Parsed) -> int:
    """2: surely one entity; 1: one entity as far as an initial tells; 0: not.

    All own words must find a partner; one of them may be slurred if all others and the given name or sectors are equal. People need agreeing given names (short forms and slips allowed, or an
    initial) and no contradicting second initial. Organisations may lack their sector or legal form, but those both have must agree.
    """
    if a.kind != b.kind and "plain" not in (a.kind, b.kind) or "person" not in (a.kind, b.kind) and a.legal and b.legal and a.legal != b.legal:
        return 0
    if a.ends and (b.kind == "person" or b.ends) or b.ends and a.kind == "person":
        return _unknown(a, b)
    if "person" in (a.kind, b.kind) and a.kind != b.kind:
        return 0
    if a.kind == "person":
        first_a, first_b = a.given[:1] or (a.initials or ("",))[0], b.given[:1] or (b.initials or ("",))[0]
        if not first_a or first_a != first_b or (a.given and b.given and a.given != b.given):
            return 0
        second_a = a.initials if a.given else a.initials[1:]
        second_b = b.initials if b.given else b.initials[1:]
        if second_a and second_b and second_a[0] != second_b[0] or (assign(a, b) == 0.0 and not _but_one(a, b)):
            return 0
        return 2 if bool(a.given) == bool(b.given) and (a.given or second_a == second_b) else 1
    small, large = sorted((set(a.sectors), set(b.sectors)), key=len)
    return 2 if small <= large and (assign(a, b) > 0.0 or _but_one(a, b)) else 0


def _unknown(a: Parsed, b: Parsed) -> int:
    """`same` where a name may hold a given name that is not known: all words agree, or those left without the first or last one, which the other's initial stands for."""
    if a.given or b.given:
        return 0
    if a.lead or b.lead:
        if b.lead:
            a, b = b, a
        if not b.ends or (a.initials[1:] and b.initials and a.initials[1] != b.initials[0]):
            return 0
        for w in b.ends:
            if w[0] == a.initials[0]:
                rest = list(b.own)
                rest.remove(w)
                if _assign(a.own, tuple(rest), a.cut, b.cut) > 0.0:
                    return 1
        return 0
    if a.initials and b.initials and a.initials[0] != b.initials[0]:
        return 0
    return 2 if assign(a, b) > 0.0 else 0


def asks(p: Parsed) -> tuple[str, list[str]]:
    """What a name asks for: a tag, and the words of which one must have a partner under it. Words ending in a dot are only asked for if there are no others.

    The tag holds what must be equal for `same`: the number of own words, and the first letter of the given name or one sector."""
    k = len(p.own)
    words = sorted(set(p.own) - set(p.cut)) or sorted(set(p.own))
    if p.kind == "person" and not p.ends:
        return f"p{k}{p.given[:1] or (p.initials or ('',))[0]}", words
    if p.kind == "person":
        return f"q{k}", words
    return f"o{k}{p.sectors[0] if p.sectors else '*'}", words


def answers(p: Parsed) -> set[tuple[str, str]]:
    """Under which (tag, word) a name is found."""
    k, own = len(p.own), set(p.own)
    if p.kind == "person" and not p.ends:
        return {(f"p{k}{p.given[:1] or (p.initials or ('',))[0]}", w) for w in own}
    out: set[tuple[str, str]] = set()
    if p.ends:
        out |= {(f"q{k}", w) for w in own}
        for end in p.ends:
            rest = list(p.own)
            rest.remove(end)
            out |= {(f"p{k - 1}{end[0]}", w) for w in rest}
    if p.kind != "person":
        out |= {(f"o{k}{s}", w) for s in ("*", *p.sectors) for w in own}
    return out


def reach(word: str) -> set[str]:
    """The symmetric-delete neighbourhood of the first PREFIX letters: one letter left out anywhere, and of words of 8 letters and more two letters other than the first."""
    p = word[:PREFIX]
    out = deletes(p)
    if len(word) >= 8:
        out |= {x[:j] + x[j + 1 :] for x in [p[:i] + p[i + 1 :] for i in range(1, len(p))] for j in range(1, len(x))}
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs of words that may agree, both ways and each with itself: word, other. `words`: word (distinct), cut (it also occurs with a dot).

    Words differ by one letter, or two that are swapped, or two in long words (found by the symmetric-delete index and then measured), or one begins with the other."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, 2000) for x in batches for at in range(0, x.num_rows, 2000)):
            forms = [list(reach(w)) for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.list_(pa.string()))], ["word", "ks"])

    # A few words become very many keys: they are spread over all cores first.
    words = words.repartition(words.sparkSession.sparkContext.defaultParallelism, "word")
    keys = words.select("word").mapInArrow(spread, "word string, ks array<string>").select("word", F.explode("ks").alias("k")).select("word", F.xxhash64("k").alias("k"))
    # A few KB of words become many MB of keys and beginnings, which the optimizer's estimate does not see: neither side may be broadcast.
    met = keys.join(keys.select("k", F.col("word").alias("other")).hint("merge"), "k").filter("word < other").select("word", "other").distinct()
    far = F.levenshtein("word", "other", 2)
    letters = lambda c: F.array_sort(F.split(c, ""))
    long = (F.least(F.length("word"), F.length("other")) >= 8) & (F.substring("word", 1, 1) == F.substring("other", 1, 1))
    slips = met.withColumn("far", far).filter((F.col("far") >= 0) & ((F.col("far") <= 1) | long | (letters("word") == letters("other")))).select("word", "other")
    # Of a word's beginnings those are looked up that are words themselves; beyond STEM letters the whole is compared.
    stems = words.filter(F.length("word") > 2).select(F.col("word").alias("other"), F.explode(F.transform(F.sequence(F.lit(2), F.least(F.length("word") - 1, F.lit(STEM))), lambda n: F.substr("word", F.lit(1), n))).alias("stem"))
    short = words.filter("cut or length(word) >= 4").select("word", F.substring("word", 1, STEM).alias("stem"))
    begun = stems.join(short.hint("merge"), "stem").filter(F.startswith("other", "word") & (F.col("word") != F.col("other"))).select("word", "other")
    pairs = slips.union(begun).distinct()
    return pairs.union(pairs.select("other", "word")).distinct().union(words.select("word", F.col("word").alias("other")))


def learn_trades(split: DataFrame) -> list[str]:
    """Words that say what an organisation does, the most frequent first: they recur in spellings that have a legal form (see LEAST_SHARE). `split`: toks."""
    bare = F.array_distinct(F.transform("toks", lambda t: F.rtrim(t, F.lit(".,"))))
    named = split.select(bare.alias("words"))
    formed = F.arrays_overlap("words", F.array(*[F.lit(w) for w in LEGAL])).cast("int")
    n = named.count()
    found = (
        named.select(F.explode("words").alias("word"), formed.alias("f")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("f"))
        .filter((F.col("n") >= max(LEAST_SPELLINGS, LEAST_SHARE * n)) & (F.col("f") >= LEAST_FORMED) & (F.length("word") >= 3) & ~F.col("word").isin(*GIVEN, *LEGAL, *TITLES, *FILLERS))
    )
    return [r["word"] for r in found.orderBy(F.desc("n"), "word").collect()]  # at most the words of a name / LEAST_SHARE


def learn_short(split: DataFrame, trades: Trades) -> DataFrame:
    """Short forms of trade words, told by the names around them: word, full.

    A word stands for a trade if its letters occur in it in order, or up to a quarter of them differ, and some two spellings have the same other words, one with the short
    and one with the full form; of several trades the one it begins, then the one most such names speak for."""
    known = F.array(*[F.lit(w) for w in sorted(trades.words)])
    skip = F.array(*[F.lit(w) for w in sorted({*LEGAL, *TITLES})])
    bare = F.array_distinct(F.filter(F.transform("toks", lambda t: F.rtrim(t, F.lit(".,"))), lambda t: (F.length(t) > 1) & ~F.array_contains(skip, t)))
    named = split.select(bare.alias("words")).select(F.array_except("words", known).alias("own"), F.array_intersect("words", known).alias("has"))
    around = lambda a: F.xxhash64(F.array_join(F.array_sort(a), " "))
    enough = lambda a: F.length(F.array_join(a, "")) >= 8
    full = named.filter((F.size("has") > 0) & enough("own")).select(around("own").alias("c"), F.explode("has").alias("full"))
    full = full.select("c", "full", F.substring("full", 1, 1).alias("i")).distinct()
    short = named.select(F.explode("own").alias("word"), "own").filter(F.length("word").between(3, max([3, *map(len, trades.words)]) + 3))
    short = short.select("word", F.array_remove("own", F.col("word")).alias("rest")).filter(enough("rest"))
    short = short.select("word", around("rest").alias("c"), F.substring("word", 1, 1).alias("i")).distinct()
    inside = F.regexp_like("full", F.concat(F.lit("^"), F.regexp_replace("word", "(.)", "$1.*"))) & (F.length("word") < F.length("full"))
    slips = F.levenshtein("word", "full") * 4 <= F.length("full")
    met = short.join(full, ["c", "i"]).filter(inside | slips).groupBy("word", "full").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("word").agg(F.max_by("full", F.struct(F.startswith("full", "word"), "n", "full")).alias("full"))
    stands = F.create_map(*[F.lit(x) for kv in sorted(trades.words.items()) for x in kv])
    return best.select("word", stands[F.col("full")].alias("full"))


@dataclass
class Linked:
    """`members`: id, entity (the smallest id of its group) is a written table; `pairs`: id_a < id_b of each group."""

    members: DataFrame
    pairs: DataFrame = field(repr=False, default=None)


def link_names(df: DataFrame, key: str, name: str) -> Linked:
    """Group the ids of `df` whose names are spellings of one person or organisation.

    The words for what organisations do, and their short forms, are learned from the names themselves. Names are parsed once per distinct
    spelling; equal parsed names form a class, so copies cost nothing. Distinct words are brought together first (`neighbours`); then each
    class asks for its rarest word, and its neighbours, among the classes of as many words with the same given letter or sector: whatever is
    one entity must answer, as all words need a partner. Names in which one word is slurred meet under all the rest. Each pair that meets is decided by an optimal assignment of its words. Sure links are
    joined into groups; a name known by an initial only joins a group if all its links lead into that one group. Null, blank and
    letterless names belong to no group. An id with several names joins all their groups' pairs.

    members: `key`, entity (the smallest id of the group; one row per id and group). pairs: id_a < id_b of each group, with all pairs of larger groups.
    """
    spark = df.sparkSession
    named = df.select(F.col(key).alias("id"), F.col(name).alias("name")).filter("id is not null and name is not null").distinct()

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"name": f["name"], "toks": [tokens(n) for n in f["name"]]})

    spelled = named.select("name").distinct().mapInPandas(split, "name string, toks array<string>").filter("size(toks) > 0")
    spelled = materialize(spelled, "spellings")
    trades = Trades(learn_trades(spelled) or SEED)
    short = learn_short(spelled, trades)
    each = spelled.select("name", F.explode(F.array_distinct("toks")).alias("t")).select("name", F.rtrim("t", F.lit(".,")).alias("word"))
    maps = each.join(short, "word").groupBy("name").agg(F.map_from_entries(F.collect_set(F.struct("word", "full"))).alias("short"))  # a name's own words
    spelled = spelled.join(maps, "name", "left").select("name", "toks", "short")

    def take_apart(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            parsed = [parse_tokens(list(t), trades, dict(s) if s is not None else None) for t, s in zip(f["toks"], f["short"], strict=True)]
            trades.forget(), NAMES.forget()
            yield pd.DataFrame({"name": f["name"], "parsed": [p.key() for p in parsed]})

    cores = spark.sparkContext.defaultParallelism
    parsed = materialize(spelled.repartition(cores).mapInPandas(take_apart, "name string, parsed string"), "parsed")
    classes = materialize(parsed.select("parsed").distinct().select(F.monotonically_increasing_id().alias("cls"), "parsed"), "classes")

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (g.iloc[at : at + 2000] for g in frames for at in range(0, len(g), 2000)):
            ps = [Parsed.of(text) for text in f["parsed"]]
            asked = [asks(p) for p in ps]
            yield pd.DataFrame({"cls": f["cls"].to_numpy(), "tag": [t for t, _ in asked], "asked": [w for _, w in asked], "cut": [list(p.cut) for p in ps], "found": [[f"{t} {w}" for t, w in sorted(answers(p))] for p in ps],
                                "around": [[f"{c}\x1f{w}" for c, w in contexts(p)] for p in ps]})

    idx = materialize(classes.repartition(cores).mapInPandas(index, "cls bigint, tag string, asked array<string>, cut array<string>, found array<string>, around array<string>"), "name-index")
    found = idx.select("cls", F.explode("found").alias("x")).select("cls", F.substring_index("x", " ", 1).alias("tag"), F.substring_index("x", " ", -1).alias("word"))
    dots = idx.select(F.explode("cut").alias("word")).distinct().withColumn("cut", F.lit(True))
    words = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(dots, "word", "left").select("word", "n", F.coalesce("cut", F.lit(False)).alias("cut"))
    words = materialize(words, "words")
    near_words = materialize(neighbours(words.select("word", "cut")), "neighbours")
    size = near_words.join(words.select(F.col("word").alias("other"), "n"), "other").groupBy("word").agg(F.sum("n").alias("n"))
    ask = idx.select("cls", "tag", F.explode("asked").alias("word")).join(size, "word").groupBy("cls", "tag").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    met = ask.join(near_words, "word").select("cls", "tag", F.col("other").alias("word")).join(found.select("tag", "word", F.col("cls").alias("other")).hint("merge"), ["tag", "word"]).filter("cls <> other")
    # One slurred word: classes that agree in all the rest meet under the forms of that word.
    around = idx.select("cls", F.explode("around").alias("x")).select("cls", F.xxhash64(F.substring_index("x", "\x1f", 1)).alias("c"), F.substring_index("x", "\x1f", -1).alias("word"))
    around = around.join(around.groupBy("c").agg(F.min("word").alias("lo"), F.max("word").alias("hi")).filter("lo <> hi").select("c"), "c", "left_semi")

    def slur(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in (g.iloc[at : at + 2000] for g in frames for at in range(0, len(g), 2000)):
            yield pd.DataFrame([(n, c, k) for n, c, w in zip(f["cls"], f["c"], f["word"], strict=True) for k in slurs(w)], columns=["cls", "c", "form"])

    forms = materialize(around.mapInPandas(slur, "cls bigint, c bigint, form string").select("cls", F.xxhash64("c", "form").alias("c")).distinct(), "slurred")
    met = met.select("cls", "other").union(forms.join(forms.select("c", F.col("cls").alias("other")), "c").filter("cls < other").select("cls", "other"))
    met = met.select(F.least("cls", "other").alias("cls"), F.greatest("cls", "other").alias("other")).distinct()
    pairs = met.join(classes, "cls").join(classes.select(F.col("cls").alias("other"), F.col("parsed").alias("parsed2")), "other")

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ties = [same(Parsed.of(a), Parsed.of(b)) for a, b in zip(f["parsed"], f["parsed2"], strict=True)]
            yield pd.DataFrame({"a": f["cls"], "b": f["other"], "tie": ties})[lambda x: x["tie"] > 0]

    links = materialize(pairs.select("cls", "other", "parsed", "parsed2").repartition(cores).mapInPandas(decide, "a bigint, b bigint, tie int"), "links")
    group = connected_components(classes.select("cls"), links.filter("tie = 2"), "cls", "a", "b")  # cls, component
    # A class known by an initial goes to the one group with a given name that its links lead to; without such a group, to the one
    # other group of initials.
    ends = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("a", "b"), ("b", "a"))]
    weak = links.filter("tie = 1").select(F.explode(F.array(*ends)).alias("e")).select("e.*")
    part = lambda i: F.element_at(F.split("parsed", r"\|"), i)
    given = classes.select("cls", ((part(4) != "") | (part(8) != "")).alias("full"))
    known = group.join(given, "cls")
    weak = weak.join(known.filter("not full").select(F.col("cls").alias("x"), F.col("component").alias("gx")), "x")
    weak = weak.join(known.select(F.col("cls").alias("y"), F.col("component").alias("gy"), "full"), "y").filter("gx <> gy")
    full, brief = F.when(F.col("full"), F.col("gy")), F.when(~F.col("full"), F.col("gy"))
    moves = weak.groupBy("gx").agg(F.min(full).alias("f1"), F.max(full).alias("f2"), F.min(brief).alias("s1"), F.max(brief).alias("s2"))
    to = F.when(F.col("f1") == F.col("f2"), F.col("f1")).when(F.col("f1").isNull() & (F.col("s1") == F.col("s2")) & (F.col("s1") < F.col("gx")), F.col("s1"))
    moves = moves.select(F.col("gx").alias("component"), to.alias("to")).filter("to is not null")
    final = group.join(moves, "component", "left").select("cls", F.coalesce("to", "component").alias("entity"))
    members = named.join(parsed, "name").join(classes, "parsed").join(final, "cls").select("id", "entity").distinct()
    members = materialize(members, "members")
    crowd = members.groupBy("entity").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    several = members.join(crowd.filter("n > 1"), "entity", "left_semi")
    both = several.select(F.col("id").alias("id_a"), "entity").join(several.select(F.col("id").alias("id_b"), "entity"), "entity").filter("id_a < id_b")
    return Linked(members.join(crowd, "entity").select(F.col("id").alias(key), F.col("least").alias("entity")).distinct(), both.select("id_a", "id_b").distinct())
