"""The Snowball stemmer for French, from its published description."""

from __future__ import annotations

import re

VOWELS = "aeiouyâàëéêèïîôûù"
#: The suffixes of the published algorithm, step by step.
PLAIN = "ances iqUes ismes ables istes ance iqUe isme able iste eux".split()
AGENT = "atrices ateurs ations atrice ateur ation".split()
VERB_I = "issaIent issantes iraIent issante issants issions irions issais issait issant issent issiez issons irais irait irent iriez irons iront isses issez îmes îtes irai iras irez isse ies ira ît ie ir is it i".split()
VERB_E = "eraIent erions èrent erais erait eriez erons eront erai eras erez ées era iez ée és er ez é".split()
VERB_A = "assions assent assiez aIent antes asses âmes âtes ante ants asse ais ait ant ât ai as a".split()


class _Word:
    """A word with its regions; positions are fixed before any suffix goes."""

    def __init__(self, word: str):
        w = re.sub(r"qu", "qU", word)
        w = re.sub(f"(?<=[{VOWELS}])u(?=[{VOWELS}])", "U", w)
        w = re.sub(f"(?<=[{VOWELS}])i(?=[{VOWELS}])", "I", w)
        w = re.sub(f"(?<=[{VOWELS}])y|y(?=[{VOWELS}])", "Y", w)
        self.w = w
        self.r1 = self._after(0)
        self.r2 = self._after(self.r1)
        if re.match(f"[{VOWELS}]{{2}}|par|col|tap", w):
            self.rv = min(3, len(w))
        else:
            found = re.search(f"[{VOWELS}]", w[1:])
            self.rv = found.end() + 1 if found else len(w)

    def _after(self, start: int) -> int:
        found = re.search(f"[{VOWELS}][^{VOWELS}]", self.w[start:])
        return start + found.end() if found else len(self.w)

    def ends(self, suffix: str, region: int = 0) -> bool:
        return self.w.endswith(suffix) and len(self.w) - len(suffix) >= region

    def cut(self, suffix: str, by: str = "") -> None:
        self.w = self.w[: len(self.w) - len(suffix)] + by

    def drop(self, suffix: str, region: int, otherwise: str | None = None) -> bool:
        """If the word ends in ``suffix``: removes it inside ``region``, else puts ``otherwise`` in its place."""
        if not self.w.endswith(suffix):
            return False
        if self.ends(suffix, region):
            self.cut(suffix)
        elif otherwise is not None:
            self.cut(suffix, otherwise)
        return True


def _longest(x: _Word, suffixes: list[str], region: int = 0) -> str | None:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if x.ends(s, region)), None)


def _standard(x: _Word) -> tuple[bool, bool]:
    """Step 1: was a suffix removed, and was it an adverb's that leaves a verb form to look at."""
    every = [*PLAIN, *AGENT, "logies", "logie", "usions", "utions", "usion", "ution", "ences", "ence", "issements", "issement", "ements", "ement", "ités", "ité", "ives", "ifs", "ive", "if", "eaux", "aux", "euses", "euse", "amment", "emment", "ments", "ment"]
    s = _longest(x, every)
    before = x.w
    if s is None:
        return False, False
    in_r2, in_rv = x.ends(s, x.r2), x.ends(s, x.rv)
    if s in PLAIN and in_r2:
        x.cut(s)
    elif s in AGENT and in_r2:
        x.cut(s)
        x.drop("ic", x.r2, "iqU")
    elif s.startswith("logie") and in_r2:
        x.cut(s, "log")
    elif s in ("usions", "utions", "usion", "ution") and in_r2:
        x.cut(s, "u")
    elif s.startswith("ence") and in_r2:
        x.cut(s, "ent")
    elif s.startswith("issement"):
        if x.ends(s, x.r1) and len(x.w) > len(s) and x.w[-len(s) - 1] not in VOWELS:
            x.cut(s)
    elif s.startswith("ement") and in_rv:
        x.cut(s)
        if x.ends("iv", x.r2):
            x.cut("iv")
            if x.ends("at", x.r2):
                x.cut("at")
        elif x.ends("eus"):
            if x.ends("eus", x.r2):
                x.cut("eus")
            elif x.ends("eus", x.r1):
                x.cut("eus", "eux")
        elif x.ends("abl", x.r2) or x.ends("iqU", x.r2):
            x.cut("abl")
        elif x.ends("ièr", x.rv) or x.ends("Ièr", x.rv):
            x.cut("ièr", "i")
    elif s.startswith("ité") and in_r2:
        x.cut(s)
        x.drop("abil", x.r2, "abl") or x.drop("ic", x.r2, "iqU") or x.drop("iv", x.r2)
    elif s in ("ives", "ifs", "ive", "if") and in_r2:
        x.cut(s)
        if x.ends("at", x.r2):
            x.cut("at")
            x.drop("ic", x.r2, "iqU")
    elif s == "eaux":
        x.cut(s, "eau")
    elif s == "aux" and x.ends(s, x.r1):
        x.cut(s, "al")
    elif s.startswith("euse"):
        if in_r2:
            x.cut(s)
        elif x.ends(s, x.r1):
            x.cut(s, "eux")
    elif s == "amment" and in_rv:
        x.cut(s, "ant")
        return True, True
    elif s == "emment" and in_rv:
        x.cut(s, "ent")
        return True, True
    elif s in ("ments", "ment"):
        at = len(x.w) - len(s) - 1
        if at >= x.rv and x.w[at] in VOWELS:
            x.cut(s)
            return True, True
    return x.w != before, False


def _verb(x: _Word) -> bool:
    """Step 2: verb endings in i, then the others."""
    s = _longest(x, VERB_I, x.rv)
    if s is not None:
        at = len(x.w) - len(s) - 1
        if at >= x.rv and x.w[at] not in VOWELS:
            x.cut(s)
            return True
    s = _longest(x, ["ions", *VERB_E, *VERB_A], x.rv)
    if s is None:
        return False
    if s == "ions":
        if not x.ends(s, x.r2):
            return False
        x.cut(s)
    else:
        x.cut(s)
        if s in VERB_A and x.ends("e", x.rv):
            x.cut("e")
    return True


def _residual(x: _Word) -> None:
    """Step 4: what is left of endings when nothing was removed."""
    if x.w.endswith("s") and len(x.w) > 1 and x.w[-2] not in "aiouès":
        x.cut("s")
    s = _longest(x, ["ion", "ière", "Ière", "ier", "Ier", "e", "ë"], x.rv)
    if s == "ion":
        if x.ends(s, x.r2) and len(x.w) - 4 >= x.rv and x.w[-4] in "st":
            x.cut(s)
    elif s in ("ier", "ière", "Ier", "Ière"):
        x.cut(s, "i")
    elif s == "e":
        x.cut(s)
    elif s == "ë" and x.w.endswith("guë"):
        x.cut(s)


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    x = _Word(word)
    removed, adverb = _standard(x)
    if not removed or adverb:
        removed = _verb(x) or removed
    if removed:
        if x.w.endswith("Y"):
            x.cut("Y", "i")
        elif x.w.endswith("ç"):
            x.cut("ç", "c")
    else:
        _residual(x)
    if x.w.endswith(("enn", "onn", "ett", "ell", "eill")):
        x.w = x.w[:-1]
    x.w = re.sub(f"[éè]([^{VOWELS}]+)$", r"e\1", x.w)
    return x.w.lower()
