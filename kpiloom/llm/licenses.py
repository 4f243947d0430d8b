"""License scan: ordered signature rules with a keyword gate, priorities and containment.

Rules are regular expressions over the ASCII-lowered text in which any run of
separators stands for one gap: hand-written notices and clauses, web addresses, SPDX
expressions, and the ways to write each license's name with what announces one. A rule runs only on texts that
hold its keyword. Overlapping detections are settled by interval containment: one
that lies inside a detection of higher priority, or inside a longer one of the same
priority, is dropped. Base phrases are reported whatever the other rules find.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kpiloom.llm.common import text_parts, unused
from kpiloom.session import ship_package

# fixed values: the base phrases and their labels
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Ways to write names and phrases: a space is any run of separators, ``a|b`` is either,
# ``+`` joins the words of one alternative, and what ends in ``?`` may be missing.
_LICENSE = "license|licence"
_ANY_LICENSE = "license|licence|licenses|licences|licensed|licenced|licensing|licencing"
_NC, _SA = "noncommercial|non+commercial", "sharealike|share+alike"
_ND = "noderivatives|noderivs|no+derivatives|no+derivs"
_GNU = {"gpl": "general public", "lgpl": "lesser|library general public", "agpl": "affero general public"}

# license label -> ways to write its name, most specific first
NAMES = {
    "mit": ["mit", "expat", "mit x11", "x11 mit"],
    "mit-0": ["mit no attribution", "mit 0"],
    "apache-1": ["apache software? 1 0|1", f"apache software? {_LICENSE} version? 1 0|1"],
    "apache-2": ["apache software? v|version? 2 0?", "apache v2 0?", f"apache software? {_LICENSE} v|version? 2 0?", f"apache software? {_LICENSE} v2 0?", "asl 2 0", "apache2"],
    "apache": ["apache software?"],
    "gfdl": ["gfdl", "gnu? free documentation", "gnu fdl"],
    "bsd-0": ["0bsd", "zero clause bsd", "bsd zero clause"],
    "bsd-2": ["bsd 2|two clause", "2|two clause bsd", "simplified bsd", "freebsd"],
    "bsd-3": ["bsd 3|three clause", "3|three clause bsd", "modified bsd", "new bsd", "revised bsd"],
    "bsd-4": ["bsd 4|four clause", "4|four clause bsd", "original bsd"],
    "bsd": ["bsd", "bsd style"],
    "mpl-1": ["mpl v|version? 1 1|0", f"mozilla public {_LICENSE} v|version? 1 1|0"],
    "mpl-2": ["mpl v|version? 2 0?", "mplv2", f"mozilla public {_LICENSE} v|version? 2 0?"],
    "mpl": ["mpl", "mozilla public"],
    "epl-1": ["epl v|version? 1 0", f"eclipse public {_LICENSE} v|version? 1 0"],
    "epl-2": ["epl v|version? 2 0?", f"eclipse public {_LICENSE} v|version? 2 0?"],
    "epl": ["epl", "eclipse public"],
    "cddl-1": ["cddl v|version? 1? 0?", "common development and distribution"],
    "eupl-1.2": ["eupl v|version? 1? 2?", "european union public"],
    "artistic-2": ["artistic v|version? 2 0?", f"artistic {_LICENSE} v|version? 2 0?"],
    "artistic": ["artistic", "perl artistic"],
    "isc": ["isc"],
    "zlib": ["zlib libpng?"],
    "boost-1": ["boost software", f"boost software {_LICENSE} v|version? 1 0", "bsl 1 0"],
    "unlicense": ["unlicense"],
    "wtfpl": ["wtfpl", "do what the fuck you want to public"],
    "postgresql": ["postgresql"],
    "python-2": ["psf 2? 0?", "python software foundation"],
    "ofl-1.1": ["ofl 1? 1?", "sil open font", "open font"],
    "ms-pl": ["ms pl", "microsoft public"],
    "upl-1": ["upl 1 0", "universal permissive"],
    "cc0": ["cc0 1? 0?", "cc zero", "creative commons zero"],
    "cc-by-nc-nd": ["cc by nc nd", f"creative commons|cc attribution {_NC} {_ND}"],
    "cc-by-nc-sa": ["cc by nc sa", f"creative commons|cc attribution {_NC} {_SA}"],
    "cc-by-nc": ["cc by nc", f"creative commons|cc attribution {_NC}"],
    "cc-by-nd": ["cc by nd", f"creative commons|cc attribution {_ND}"],
    "cc-by-sa": ["cc by sa", f"creative commons|cc attribution {_SA}"],
    "cc-by": ["cc by", "creative commons|cc attribution"],
    "odbl-1": ["odbl", "open database"],
    "odc-by": ["odc by", "open data commons attribution"],
}
for _short, _long in _GNU.items():
    # versions that exist, and both spellings of each
    for _major, _minor in {"gpl": (("3", "0"), ("2", "0"), ("1", "0")), "lgpl": (("3", "0"), ("2", "1"), ("2", "0")), "agpl": (("3", "0"), ("1", "0"))}[_short]:
        _of = f"{_major} {_minor}?" if _minor == "0" else f"{_major} {_minor}"
        _label = f"{_short}-{_major}" if _minor == "0" else f"{_short}-{_major}.{_minor}"
        _names = [f"gnu? {_short} v|version? {_of}", f"gnu? {_short}v{_of}", f"gnu? {_short} v{_of}"]
        _names += [f"gnu {_long} {_LICENSE} gpl|lgpl|agpl? v|version? {_of}", f"gnu {_long} {_LICENSE} gpl|lgpl|agpl? v{_of}"]
        _names += [f"version {_of} of the gnu {_long} {_LICENSE}?", f"version {_of} of the gnu? {_short}"]
        _names += [f"gnu {_long} {_LICENSE} as published by the free software foundation either? version {_of} of+the+{_LICENSE.replace('|', '|of+the+')}?"]
        _later = "or+later|or+newer|or+above|or+greater|and+later|and+newer|and+above|or+any+later|or+at+your+option+any+later"
        NAMES[f"{_label}-or-later"] = [f"{n} {_later} version?" for n in _names]
        NAMES[f"{_label}-only"] = [f"{n} only" for n in _names]
        NAMES[_label] = _names
    NAMES[_short] = [f"gnu? {_short}", f"gnu {_long}"]

# What stands for a license by itself, without a word that announces one: names with a version or of one meaning.
ALONE = [
    *(k for k in NAMES if k.startswith(("gpl-", "lgpl-", "agpl-"))), "mit-0", "bsd-0", "bsd-2", "bsd-3", "bsd-4", "mpl-2", "epl-2",
    "unlicense", "wtfpl", "cc0", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa",
]
# ...and with the number of its version behind it only
NUMBERED = ["cc-by-nc", "cc-by"]
# Names of a family, which any name of one of its members outranks.
FAMILIES = ("apache", "bsd", "mpl", "epl", "artistic", "gpl", "lgpl", "agpl")

# Phrases that announce a license: pattern with the name at {}, priority, certainty.
_TERMS = "terms+and+conditions+of|terms+of|conditions+of|provisions+of"
_GIVEN = "licensed|licenced|released|distributed|available|published|provided|offered|covered|shared|redistributed|governed|relicensed|used|usable|licensing"
PHRASES = [
    (f"{_GIVEN} under|by both|either? the|a|an|any? {_TERMS}? of? the|a|an? {{}} {_LICENSE}", 40, 0.95),
    (f"{_GIVEN} under|by both|either? the|a|an|any? {_TERMS}? of? the|a|an? {{}}", 35, 0.9),
    (f"under the|a|an? {_TERMS}? the|a|an? {{}} {_LICENSE}", 30, 0.9),
    (f"under the|a|an? {_TERMS}? the|a|an? {{}}", 29, 0.8),
    (f"{{}} public? {_LICENSE}", 20, 0.75),
    ("{} licensed|licenced", 20, 0.75),
    (f"{_LICENSE} is|type|name|identifier|text|osi+approved? the? {{}}", 15, 0.6),
    (f"licensed|{_LICENSE}|licenses|licensing|choice under|of? the|either? {{}}", 14, 0.6),
]
# License names in web addresses: host and path, label by what follows.
PLACES = [
    "opensource org licenses|license", "spdx org licenses", "choosealicense com licenses", "tldrlegal com license",
]
IDENTIFIERS = {
    "mit": ["mit"], "mit-0": ["mit 0"], "apache-2": ["apache 2 0"], "apache-1": ["apache 1 1|0"], "bsd-0": ["0bsd"], "bsd-2": ["bsd 2 clause"],
    "bsd-3": ["bsd 3 clause"], "bsd-4": ["bsd 4 clause"], "mpl-2": ["mpl 2 0"], "mpl-1": ["mpl 1 1|0"], "epl-2": ["epl 2 0"], "epl-1": ["epl 1 0"],
    "cddl-1": ["cddl 1 0|1"], "eupl-1.2": ["eupl 1 2"], "artistic-2": ["artistic 2 0"], "isc": ["isc"], "zlib": ["zlib"], "boost-1": ["bsl 1 0"],
    "unlicense": ["unlicense"], "wtfpl": ["wtfpl"], "postgresql": ["postgresql"], "python-2": ["psf 2 0", "python 2 0"], "ofl-1.1": ["ofl 1 1"],
    "ms-pl": ["ms pl"], "upl-1": ["upl 1 0"], "cc0": ["cc0 1 0"], "cc-by-nc-nd": ["cc by nc nd"], "cc-by-nc-sa": ["cc by nc sa"],
    "cc-by-nc": ["cc by nc"], "cc-by-nd": ["cc by nd"], "cc-by-sa": ["cc by sa"], "cc-by": ["cc by"], "odbl-1": ["odbl 1 0"], "gfdl": ["gfdl 1 1|2|3"],
} | {
    f"{name}{suffix}": [f"{name.replace('-', ' ').replace('.', ' ')} 0{last}" if "." not in name else f"{name.replace('-', ' ').replace('.', ' ')}{last}"]
    for name in ("gpl-1", "gpl-2", "gpl-3", "lgpl-2", "lgpl-2.1", "lgpl-3", "agpl-1", "agpl-3")
    for suffix, last in (("-or-later", " or later"), ("-only", " only"), ("", ""))
}

# Notices by themselves: label, words, keyword (one of the words), priority, certainty.
NOTICES = [
    ("apache-2", "apache license version 2 0", "apache", 45, 1.0),
    ("apache-2", "apache license version 2", "apache", 44, 1.0),
    ("apache-2", "apache org licenses license 2 0", "apache", 46, 1.0),
    ("apache-1", "apache org licenses license 1 1|0", "apache", 46, 1.0),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance", 12, 0.6),
    ("gpl-2", "gnu general public license version 2", "gnu", 45, 1.0),
    ("gpl-3", "gnu general public license version 3", "gnu", 45, 1.0),
    ("lgpl-3", "gnu lesser general public license version 3", "gnu", 45, 1.0),
    ("agpl-3", "gnu affero general public license version 3", "gnu", 45, 1.0),
    ("gpl", "gnu general public license", "gnu", 9, 0.8),
    ("lgpl", "gnu lesser general public license", "gnu", 9, 0.8),
    ("lgpl", "gnu library general public license", "gnu", 9, 0.8),
    ("agpl", "gnu affero general public license", "gnu", 9, 0.8),
    ("gpl-3", "gnu org licenses gpl 3 0", "gnu", 46, 1.0),
    ("gpl-2", "gnu org licenses old+licenses? gpl 2 0", "gnu", 46, 1.0),
    ("lgpl-3", "gnu org licenses lgpl 3 0", "gnu", 46, 1.0),
    ("lgpl-2.1", "gnu org licenses old+licenses? lgpl 2 1", "gnu", 46, 1.0),
    ("agpl-3", "gnu org licenses agpl 3 0", "gnu", 46, 1.0),
    ("gpl", "gnu org licenses|copyleft gpl", "gnu", 44, 1.0),
    ("lgpl", "gnu org licenses|copyleft lgpl|lesser", "gnu", 44, 1.0),
    ("agpl", "gnu org licenses agpl", "gnu", 44, 1.0),
    ("gfdl", "gnu org licenses|copyleft fdl", "gnu", 44, 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "granted", 45, 0.95),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy", "granted", 45, 0.95),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission", 40, 0.8),
    ("bsd", "redistribution and use in source and binary forms", "redistribution", 45, 0.9),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display", "advertising", 46, 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission", 45, 0.9),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", "permission", 46, 0.95),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "liable", 45, 0.95),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", 45, 1.0),
    ("unlicense", "unlicense org", "unlicense", 44, 1.0),
    ("wtfpl", "wtfpl net", "wtfpl", 44, 1.0),
    ("zlib", "zlib net zlib license", "zlib", 44, 1.0),
    ("boost-1", "boost org license 1 0 txt", "boost", 45, 1.0),
    ("mpl-2", "mozilla org en? us? mpl 2 0", "mozilla", 45, 1.0),
    ("mpl-1", "mozilla org en? us? mpl 1 1|0", "mozilla", 45, 1.0),
    ("mpl", "mozilla org en? us? mpl", "mozilla", 44, 1.0),
    ("epl-2", "eclipse org legal epl 2 0", "eclipse", 45, 1.0),
    ("epl-2", "eclipse org legal epl v20", "eclipse", 45, 1.0),
    ("epl-1", "eclipse org legal epl v10", "eclipse", 45, 1.0),
    ("ofl-1.1", "scripts sil org ofl", "sil", 45, 1.0),
    ("python-2", "python org psf license", "python", 45, 1.0),
    ("artistic-2", "perlfoundation org artistic license 2 0", "perlfoundation", 45, 1.0),
    ("odbl-1", "opendatacommons org licenses odbl", "opendatacommons", 45, 1.0),
    ("public-domain", "dedicated to the public domain", "domain", 40, 0.9),
    ("public-domain", "in|into the public domain", "domain", 30, 0.7),
    ("proprietary", "all rights reserved", "reserved", 10, 0.4),
    ("proprietary", "proprietary and confidential", "confidential", 20, 0.7),
    ("proprietary", "unauthorized copying of this file", "unauthorized", 20, 0.7),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons", 45, 1.0),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons", 45, 1.0),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons", 44, 1.0),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons", 45, 1.0),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons", 45, 1.0),
    ("cc-by", "creativecommons org licenses by", "creativecommons", 43, 1.0),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons", 45, 1.0),
    ("cc0", "to the extent possible under law the? author|authors|person|persons has|have? waived all copyright", "waived", 45, 1.0),
    ("classpath-exception", "classpath exception 2? 0?", "classpath", 25, 0.9),
    ("llvm-exception", "llvm exception", "llvm", 25, 0.9),
]

GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_START, _END = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True


@dataclass(frozen=True)
class Rule:
    label: str
    source: bytes
    keyword: bytes
    priority: int
    certainty: float
    base: bool = False
    needs: tuple[frozenset[bytes], ...] = ()  # of each set the text must hold a word

    @property
    def pattern(self) -> re.Pattern:
        """Compiled when a text first holds the keyword. What a group takes is the detection, or else the whole match."""
        return _compiled(self.source)


@lru_cache(maxsize=None)
def _compiled(source: bytes) -> re.Pattern:
    return re.compile(source)


@dataclass(frozen=True)
class Detection:
    label: str
    start: int
    end: int
    priority: int
    certainty: float
    base: bool


def _words(way: str) -> tuple[bytes, bytes]:
    """A way to write something as a regular expression, and its longest word that cannot be missing."""
    tokens = [(t.removesuffix("?"), t.endswith("?")) for t in way.split()]
    last = max(k for k, (_, optional) in enumerate(tokens) if not optional)
    out = b""
    for k, (token, optional) in enumerate(tokens):
        either = [GAP.join(re.escape(w.encode()) for w in x.split("+")) for x in token.split("|")]
        body = either[0] if len(either) == 1 else b"(?:" + b"|".join(either) + b")"
        if optional:
            out += b"(?:" + body + GAP + b")?" if k < last else b"(?:" + GAP + body + b")?"
        else:
            out += body + (GAP if k < last else b"")
    fixed = [t for t, optional in tokens if not optional and "|" not in t and "+" not in t]
    # of equally long words the last tells most: by nc sa
    return out, max(reversed(fixed), key=len, default="").encode()


def _needs(way: str) -> tuple[frozenset[bytes], ...]:
    """For each word that cannot be missing, the words that may stand for it."""
    kept = [t for t in way.split() if not t.endswith("?")]
    return tuple(frozenset(x.split("+")[0].encode() for x in t.split("|")) for t in kept)


def _pattern(way: str) -> bytes:
    return _START + _words(way)[0] + _END


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, notices, addresses, expressions, announced names, names that stand alone."""
    out = [Rule(label, _pattern(words), max(words.split(), key=len).encode() if label != "cc-by-nc" else b"cc", 60, 1.0, True) for words, label in BASE.items()]
    out += [Rule(label, _pattern(words), key.encode(), rank, sure, needs=_needs(words)) for label, words, key, rank, sure in NOTICES]
    # a clause that names its holder in the middle
    holder = rb"[^\n]{0,120}\n?[^\n]{0,120}"
    clause = _START + _words("neither the name")[0] + holder + _words("may be used to endorse")[0] + _END
    out.append(Rule("bsd-3", clause, b"endorse", 46, 0.95, needs=_needs("neither endorse")))
    for label, ways in IDENTIFIERS.items():
        for way in ways:
            name, key = _words(way)
            own = _START + b"(" + name + b")" + _END
            needs = _needs(way)
            for place in PLACES:
                out.append(Rule(label, _START + _words(place)[0] + GAP + name + _END, key, 45, 1.0, needs=needs + _needs(place)))
            # any license of an expression
            out.append(Rule(label, _START + _words("spdx license identifier")[0] + rb"[^\n]{1,200}?" + own, key, 50, 1.0, needs=needs + _needs("spdx identifier")))
            out.append(Rule(label, _START + rb"licen[sc](?:e|es|ed|ing)" + _END + rb"[^\n;]{1,80}?(?:\b(?:or|and|with)" + GAP + rb"|/ ?)(?:the" + GAP + rb")?" + own, key, 17, 0.7, needs=needs + _needs(_ANY_LICENSE)))
            out.append(Rule(label, _START + rb"licen[sc](?:e|es|ed|ing)" + _END + rb"[^\n;a-z0-9]{1,9}" + own + GAP + rb"(?:or|and|with)" + _END, key, 17, 0.7, needs=needs + _needs(_ANY_LICENSE + " or|and|with")))
    for label, ways in NAMES.items():
        for way in ways:
            name, key = _words(way)
            for phrase, rank, sure in PHRASES:
                whole = _words(phrase.format(way))[0]
                out.append(Rule(label, _START + whole + _END, key, rank // 4 if label in FAMILIES else rank, sure, needs=_needs(phrase.format(way))))
            if label in ALONE or label in NUMBERED:
                after = GAP + rb"[1-4]" + GAP + rb"[05]" if label in NUMBERED else b""
                out.append(Rule(label, _START + name + after + _END, key, 18, 0.7, needs=_needs(way)))
    # a plus is the old way to say "or later"
    for label in ("gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3"):
        for way in NAMES[label][:3]:
            name, key = _words(way)
            out.append(Rule(f"{label}-or-later", _START + name + rb"\+", key, 51, 1.0))
    return tuple(out)


#: A text without any of these cannot match a rule: pieces of words, of which every rule needs
#: one, but for names that are common words elsewhere and count only behind ``under`` or ``by``.
_PIECES = (
    b"licens", b"licenc", b"redistribution", b"creativecommons", b"commons", b"gpl", b"bsd", b"unencumbered", b"wtfpl", b"cc0", b"mpl", b"epl",
    b"gfdl", b"mozilla", b"eclipse", b"apache", b"spdx", b"opendatacommons", b"perlfoundation", b"hereby", b"permission", b"domain", b"reserved",
    b"zlib", b"boost", b"scripts", b"psf", b"mit 0", b"mit-0", b"no attribution", b"cc zero", b"cc-zero", b"cc attribution", b"waived", b"advertising",
    b"liable", b"endorse", b"confidential", b"unauthorized", b"classpath", b"llvm", b"gnu", b"affero", b"documentation", b"fuck", b"attribution",
)
_WEAK = rb"mit|x11|expat|isc|zlib|asl|artistic|perl|bsl|psf|python|ofl|sil|open|ms|microsoft|upl|universal|odbl|odc|postgresql|eupl|european|cddl|common|do"
_AFTER = GAP + rb"(?:(?:the|a|an|both|either|any|terms|of|and|conditions|provisions)" + GAP + rb"){0,8}(?:" + _WEAK + rb")" + _END
_LEADS = tuple(re.compile(word + _AFTER) for word in (b"under", b"by", rb"licen[sc]e[ds]?"))
_CC = re.compile(rb"cc" + GAP + rb"by")


def _open(data: bytes, offsets: np.ndarray) -> np.ndarray:
    """Which of the texts in ``data`` may hold a notice."""
    out = np.zeros(len(offsets) - 1, bool)

    def mark(at: int) -> int:
        k = min(int(np.searchsorted(offsets, at, side="right")) - 1, len(out) - 1)
        out[k] = True
        return int(offsets[k + 1])

    for piece in _PIECES:
        at = data.find(piece)
        while at >= 0:
            at = data.find(piece, mark(at))
    for lead in (*_LEADS, _CC):
        m = lead.search(data)
        while m:
            m = lead.search(data, mark(m.start()))
    return out


@lru_cache(maxsize=1)
def _by_keyword() -> tuple[re.Pattern, dict[bytes, list[tuple[int, Rule]]]]:
    """The rules by keyword, and a pattern that finds words that are one."""
    table: dict[bytes, list[tuple[int, Rule]]] = {}
    for k, rule in enumerate(rules()):
        table.setdefault(rule.keyword, []).append((k, rule))
    return re.compile(_START + rb"[0-9a-z\x80-\xff]+"), table


def _keyed(lower: bytes) -> list[Rule]:
    """The rules all of whose words the text holds, in order."""
    pattern, table = _by_keyword()
    words = set(pattern.findall(lower))
    held = [x for w in words if w in table for x in table[w] if not any(n.isdisjoint(words) for n in x[1].needs)]
    return [rule for _, rule in sorted(held, key=lambda x: x[0])]


def detections(lower: bytes) -> list[Detection]:
    """What all gated rules find, in order of place; a text is given with A-Z lowered."""
    if not _open(lower, np.array([0, len(lower)]))[0]:
        return []
    found: dict[tuple, Detection] = {}
    for rule in _keyed(lower):
        for m in rule.pattern.finditer(lower):
            start, end = m.span(rule.pattern.groups)
            key = (rule.label, start, end, rule.base)
            if key not in found:
                found[key] = Detection(rule.label, start, end, rule.priority, rule.certainty, rule.base)
    return sorted(found.values(), key=lambda d: (d.start, -d.end, -d.priority, d.label))


def settle(found: list[Detection]) -> list[Detection]:
    """Drop detections inside one of higher priority, or inside a longer one of equal priority.

    Base detections stay. Priorities are settled from the highest, so a dropped
    detection suppresses nothing. Equal spans of equal priority keep the first rule's.
    """
    order = sorted((d for d in found if not d.base), key=lambda d: (-d.priority, d.start - d.end, d.start))
    # largest end of the kept detections by rank of their start, as a tree of prefix maxima:
    # a text with very many detections takes n log n steps
    rank = {at: k for k, at in enumerate(sorted({d.start for d in order}), 1)}
    furthest = [-1] * (len(rank) + 1)
    kept = [d for d in found if d.base]
    for d in order:
        k = rank[d.start]
        reach = -1
        while k:
            reach = max(reach, furthest[k])
            k &= k - 1
        if reach < d.end:
            kept.append(d)
            k = rank[d.start]
            while k < len(furthest):
                furthest[k] = max(furthest[k], d.end)
                k += k & -k
    return sorted(kept, key=lambda d: (d.start, d.end, d.label))


def base_places(lower: bytes) -> list[tuple[int, str]]:
    """Start and label of every place of a base phrase, overlapping places included."""
    out = []
    for rule in rules()[: len(BASE)]:
        if rule.keyword in lower:
            at = 0
            while m := rule.pattern.search(lower, at):
                out.append((m.start(), rule.label))
                at = m.start() + 1
    return sorted(out)


def _count(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where words start, and each text's first of them."""
    inside = _IN_WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = inside[edges]
    places = np.flatnonzero(start)
    return places, np.searchsorted(places, offsets)


def scan(text: Column) -> Column:
    """struct of n_words, base (array of word start and label) and found (settled detections).

    Spans are byte offsets in the UTF-8 text; ``first_word`` counts words from 0. A
    null text has no words and no detections.
    """
    kind = pa.struct([
        ("n_words", pa.int64()),
        ("base", pa.list_(pa.struct([("first_word", pa.int64()), ("label", pa.string())]))),
        ("found", pa.list_(pa.struct([
            ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
            ("priority", pa.int64()), ("certainty", pa.float64()),
        ]))),
    ])

    @arrow_udf(
        "struct<n_words:long,base:array<struct<first_word:long,label:string>>,"
        "found:array<struct<label:string,start:long,end:long,priority:long,certainty:double>>>"
    )
    def run(column: pa.Array) -> pa.Array:
        return pa.array(list(_scan(column)), kind)

    return run(text)


def _scan(column: pa.Array) -> Iterator[dict]:
    for _, data, offsets in text_parts(column):
        places, first = _count(data, offsets)
        body = data.tobytes().translate(_LOWER)
        gated = _open(body, offsets)
        for k in range(len(offsets) - 1):
            row = {"n_words": int(first[k + 1] - first[k]), "base": [], "found": []}
            if gated[k]:
                lower = body[offsets[k] : offsets[k + 1]]
                words = places[first[k] : first[k + 1]] - offsets[k]
                row["base"] = [
                    {"first_word": int(np.searchsorted(words, at)), "label": label} for at, label in base_places(lower)
                ]
                row["found"] = [
                    {"label": d.label, "start": d.start, "end": d.end, "priority": d.priority, "certainty": d.certainty}
                    for d in settle(detections(lower))
                ]
            yield row


def scan_documents(docs: DataFrame) -> DataFrame:
    """Append n_words, base and found to every document; columns of these names are replaced."""
    ship_package(docs.sparkSession)
    (own,) = unused(docs.columns, "scan")
    return (
        docs.withColumn(own, scan(F.col("text")))
        .withColumns({c: F.col(f"{own}.{c}") for c in ("n_words", "base", "found")})
        .drop(own)
    )
