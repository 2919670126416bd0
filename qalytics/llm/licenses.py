"""License scans: ordered signature rules over normalised words.

Method. A text becomes its words (A-Z lower-cased, runs of letters, digits and
non-ASCII characters) joined by single spaces. Signature rules are regular
expressions over that form, each with a priority and a keyword; a rule runs
only on texts that hold its keyword. Detections are word intervals; taken by
priority, then length, one that lies inside a kept one is suppressed. Both the
suppression (a tree of the farthest ends by start) and the word numbers (a
search among the blanks) take n log n steps, so long texts are no special case.
Three plain phrases are the base: all their places are counted and their labels
always stay.

Defined results. Null text is empty: no words, no labels, score 0. Tables of
one row per input row; rows that repeat an id stay separate; a null id stays
null. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalytics.llm import common as C

# Phrases of the contract and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Licence names as they read after normalisation: (label, name, keyword).
NAMES = (
    ("mit", "mit", " mit "), ("mit", "expat", "expat"), ("x11", "x11", " x11 "), ("isc", "isc", " isc "),
    ("apache", "apache", "apache"), ("apache-2.0", "apache(?: license)?(?: version| v)? ?2(?: 0)?", "apache"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache"),
    ("bsd", "bsd", "bsd"), ("bsd-2-clause", "(?:bsd 2 clause|simplified bsd|freebsd)", "bsd"),
    ("bsd-3-clause", "(?:bsd 3 clause|new bsd|modified bsd|revised bsd)", "bsd"), ("bsd-4-clause", "(?:bsd 4 clause|original bsd)", "bsd"),
    ("gpl", "(?:gnu )?general public", "general"), ("gpl-2.0", "(?:gnu )?gpl ?(?:version |v)?2(?: 0)?", "gpl"),
    ("gpl-3.0", "(?:gnu )?gpl ?(?:version |v)?3(?: 0)?", "gpl"), ("gpl", "(?:gnu )?gpl", "gpl"),
    ("lgpl", "(?:gnu )?lesser general public", "lesser"), ("lgpl", "(?:gnu )?library general public", "library"), ("lgpl", "(?:gnu )?lgpl", "lgpl"),
    ("agpl", "(?:gnu )?affero general public", "affero"), ("agpl", "(?:gnu )?agpl", "agpl"),
    ("gfdl", "(?:gnu )?free documentation", "documentation"), ("mpl", "mozilla public", "mozilla"), ("mpl-2.0", "mpl 2(?: 0)?", "mpl"),
    ("epl", "eclipse public", "eclipse"), ("cddl", "common development and distribution", "distribution"), ("cpl", "common public", "common"),
    ("artistic", "artistic", "artistic"), ("zlib", "zlib(?: libpng)?", "zlib"), ("bsl", "boost software", "boost"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "(?:wtfpl|do what the fuck you want to public)", "what the fuck|wtfpl"),
    ("psf", "python software foundation", "python"), ("php", "php", " php "), ("ruby", "ruby", " ruby "), ("openssl", "openssl", "openssl"),
    ("ofl", "(?:sil )?open font", "font"), ("eupl", "european union public", "european"), ("ms-pl", "microsoft public", "microsoft"),
    ("ms-rl", "microsoft reciprocal", "microsoft"), ("osl", "open software", "open"), ("afl", "academic free", "academic"),
    ("cecill", "cecill", "cecill"), ("postgresql", "postgresql", "postgresql"), ("odbl", "open database", "database"),
    ("odc-by", "open data commons attribution", "commons"), ("cc", "creative commons", "commons"),
    ("cc-by", "(?:cc|creative commons) (?:by|attribution)", " cc|commons"), ("cc-by-sa", "(?:cc|creative commons) (?:by sa|attribution share ?alike)", " cc|commons"),
    ("cc-by-nc", "(?:cc|creative commons) (?:by nc|attribution non ?commercial)", " cc|commons"),
    ("cc-by-nd", "(?:cc|creative commons) (?:by nd|attribution no ?deriv(?:ative)?s)", " cc|commons"),
    ("cc-by-nc-sa", "(?:cc|creative commons) (?:by nc sa|attribution non ?commercial share ?alike)", " cc|commons"),
    ("cc-by-nc-nd", "(?:cc|creative commons) (?:by nc nd|attribution non ?commercial no ?deriv(?:ative)?s)", " cc|commons"), ("cc0", "(?:cc0|creative commons zero)", " cc|commons"),
)
# Sentences around a name: (pattern, priority, anchor word that texts must hold).
FORMS = (
    ("(?:re)?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?", 90, "under"),
    ("(?:released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{name}(?: licen[sc]e)?", 85, "under"),
    ("subject to (?:the )?(?:terms of (?:the )?)?{name} licen[sc]e", 80, "subject"),
    ("(?:work|file|software|program|document) is governed by (?:the )?{name}(?: licen[sc]e)?", 80, "governed by"),
    ("(?:work|file|software|program|document) is covered by (?:the )?{name}(?: licen[sc]e)?", 80, "covered by"),
    ("spdx license identifier {name}", 95, "spdx"),
    ("{name} licen[sc]e", 50, "licen"),
)
# Signatures without a name: (label, pattern, priority, keyword).
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 100, "hereby"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", 100, "fee"),
    ("bsd", "redistributions of source code must retain the above copyright notice", 100, "redistributions"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 100, "redistribution"),
    ("bsd-3-clause", "neither the name of (?:\\S+ ){1,12}nor the names of its contributors may be used", 100, "neither"),
    ("gpl", "this program is free software you can redistribute it and or modify it", 100, "redistribute"),
    ("gpl", "either version [23] of the license or at your option any later version", 95, "option"),
    ("apache-2.0", "you may not use this file except in compliance with the license", 100, "compliance"),
    ("zlib", "altered source versions must be plainly marked as such", 100, "altered"),
    ("unlicense", "this is free and unencumbered software released into the public domain", 100, "unencumbered"),
    ("boost", "boost software license version 1 0", 100, "boost"),
    ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain", 90, "domain"),
    ("warranty", "without warranty of any kind(?: express or implied)?", 40, "warranty"),
    ("warranty", "provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)", 45, "provided"),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?", 30, "copyright"),
    ("copyright", "(?:19|20)[0-9][0-9] (?:by )?(?:\\S+ ){1,4}copyright", 20, "copyright"),
    ("reserved", "(?:all|some|no) rights reserved", 60, "rights"),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential)", 80, "proprietary"),
    ("proprietary", "may not be reproduced (?:or distributed )?without (?:the )?(?:prior )?(?:written )?permission", 80, "reproduced"),
    ("non-commercial", "for non ?commercial (?:use|purposes) only", 70, "commercial"),
    ("no-derivatives", "no derivative works", 60, "derivative"),
)
# Bytes after normalisation: letters lower-cased, digits, non-ASCII, else a blank.
_WORD = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else (b + 32 if 0x41 <= b <= 0x5A else b)
              for b in range(256))


class Rule:
    """One signature: it runs where its anchor and one of its keywords (parted
    by ``|``) occur."""

    __slots__ = ("label", "priority", "anchor", "keyword", "pattern")

    def __init__(self, label: str, pattern: str, priority: int, anchor: str, keyword: str):
        self.label, self.priority = label, priority
        self.anchor, self.keyword = anchor.encode(), tuple(keyword.encode().split(b"|"))
        self.pattern = re.compile(f" (?:{pattern})(?= )".encode())


def rules() -> list[Rule]:
    """All signatures, highest priority first: every form with every name, and
    the sentences."""
    made = [Rule(label, form.replace("{name}", name), priority + min(9, len(name) // 10), anchor, keyword)
            for label, name, keyword in NAMES for form, priority, anchor in FORMS]
    made += [Rule(label, pattern, priority, keyword.split("|")[0], keyword) for label, pattern, priority, keyword in SENTENCES]
    return sorted(made, key=lambda r: (-r.priority, r.label, r.pattern.pattern))


def outermost(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """The (start, end, label, priority) that stay: in order of priority, then
    length, then start and label, one goes if it lies inside an earlier one
    (whether that stays does not matter: what holds it then holds both). A
    Fenwick tree over the starts tells the farthest end of those not after."""
    starts = sorted({d[0] for d in found})
    place = {s: i + 1 for i, s in enumerate(starts)}
    farthest = [0] * (len(starts) + 1)
    kept = []
    for d in sorted(found, key=lambda d: (-d[3], d[0] - d[1], d[0], d[2])):
        i, end = place[d[0]], 0
        while i:
            end = max(end, farthest[i])
            i &= i - 1
        if end >= d[1]:
            continue
        kept.append(d)
        i = place[d[0]]
        while i < len(farthest):
            farthest[i] = max(farthest[i], d[1])
            i += i & -i
    return sorted(kept)


class Scanner:
    """Detections of one normalised text."""

    def __init__(self, signatures: list[Rule] | None = None):
        self.by_anchor: dict[bytes, list[Rule]] = {}
        for r in signatures if signatures is not None else rules():
            self.by_anchor.setdefault(r.anchor, []).append(r)
        self.phrases = [(f" {p} ".encode(), label) for p, label in BASE_PHRASES]

    def base(self, text: bytes) -> list[tuple[int, str]]:
        """(word, label) of every place of a base phrase, overlaps included."""
        out = []
        for phrase, label in self.phrases:
            at = text.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = text.find(phrase, at + 1)
        words = self.words(text, [at for at, _ in out])
        return [(w, label) for w, (_, label) in zip(words, out)]

    @staticmethod
    def words(text: bytes, places: list[int]) -> list[int]:
        """For each place, the blanks of ``text`` before it: a word's number."""
        if not places:
            return []
        blanks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 0x20)
        return np.searchsorted(blanks, places).tolist()

    def detections(self, text: bytes) -> list[tuple[int, int, str, int]]:
        """(first word, end word, label, priority), overlaps resolved."""
        found = []
        present: dict[tuple, bool] = {}
        for anchor, signatures in self.by_anchor.items():
            if anchor not in text:
                continue
            for r in signatures:
                if r.keyword not in present:
                    present[r.keyword] = any(k in text for k in r.keyword)
                if present[r.keyword]:
                    found += [(m.start(), m.end(), r.label, r.priority) for m in r.pattern.finditer(text)]
        kept = outermost(found)
        words = self.words(text, [at for s, e, *_ in kept for at in (s, e)])
        return [(first, end, label, p) for first, end, (_, _, label, p) in zip(words[::2], words[1::2], kept)]


RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, detections string")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    names = [f.split()[0] for f in RESULT.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
    for batch in batches:
        for part, texts in C.text_slices(batch):
            rows = []
            for i, raw in zip(part.column("doc_id").to_pylist(), texts):
                words = raw.translate(_WORD).split(b" ")
                words = [w for w in words if w]
                text = b" " + b" ".join(words) + b" "
                base = scanner.base(text)
                found = scanner.detections(text)
                own = {label for _, label in base}
                miss = 1.0
                for *_, p in found:
                    miss *= 1.0 - p / 110.0
                score = 1.0 - miss if found else (0.5 if base else 0.0)
                rows.append((i, len(words), len(base), min((w for w, _ in base), default=None), max((w for w, _ in base), default=None),
                             ",".join(sorted(own)), ",".join(sorted(own | {d[2] for d in found})), score,
                             ",".join(f"{label}:{s}:{e}" for s, e, label, _ in found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def scan(docs: DataFrame) -> DataFrame:
    """License labels per row of ``docs`` (doc_id, text); see RESULT."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, RESULT)
