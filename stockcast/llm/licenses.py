"""License scanning by ordered signature rules.

Rules are regular expressions over the lower-cased text, written per license:
its tags, titles, grants and clauses. A rule is tried only if each word of its
keyword, which every match holds, occurs somewhere in the text. Detections overlap: they are resolved in order of priority, and one
whose interval lies inside that of an accepted one is suppressed. Word phrases
are found besides the rules, and their labels always stay.

Each text is scanned by itself, in one Arrow pass without any shuffle; nothing
but the texts' bytes is held.

Defined cases: null and empty texts have no words, no labels and score 0; of
rules with one priority the longer detection goes first, then the earlier, then
the earlier rule; repeated rows get equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = np.zeros(256, np.uint8)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
INSIDE = rb"0-9a-z\x80-\xff"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# tag of a license, label, its names and versions as patterns
TAGS = (
    ("mit", "mit", r"mit(?:/x11| expat)?"), ("mit-0", "mit-0", r"mit no attribution"), ("x11", "x11", r"x11"),
    ("apache-1.1", "apache-1.1", r"apache(?: software)?(?:[ -]?license)?,?-? ?v?(?:ersion )?1\.1"),
    ("apache-2.0", "apache-2.0", r"apache(?: software)?(?: license)?,? ?-?v?(?:ersion )?2(?:\.0)?"),
    ("bsd-2-clause", "bsd-2-clause", r"(?:2-clause|simplified|freebsd) bsd|bsd[ -]2[ -]clause"),
    ("bsd-3-clause", "bsd-3-clause", r"(?:3-clause|new|modified|revised) bsd|bsd[ -]3[ -]clause"),
    ("bsd-4-clause", "bsd-4-clause", r"(?:4-clause|original) bsd|bsd[ -]4[ -]clause"),
    ("0bsd", "0bsd", r"zero[ -]clause bsd|0bsd"), ("isc", "isc", r"isc"), ("zlib", "zlib", r"zlib(?:/libpng)?"),
    ("bsl-1.0", "bsl-1.0", r"boost software(?: license)?,? ?-?v?(?:ersion )?1\.0|boost software"),
    ("unlicense", "unlicense", r"unlicense"), ("wtfpl", "wtfpl", r"wtfpl|do what the fuck you want to public"),
    ("gpl-1.0", "gpl-1.0", r"(?:gnu )?(?:gpl|general public license),? ?-?v?(?:ersion )?1(?:\.0)?"),
    ("gpl-2.0", "gpl-2.0", r"(?:gnu )?(?:gpl|general public license),? ?-?v?(?:ersion )?2(?:\.0)?"),
    ("gpl-3.0", "gpl-3.0", r"(?:gnu )?(?:gpl|general public license),? ?-?v?(?:ersion )?3(?:\.0)?"),
    ("lgpl-2.0", "lgpl-2.0", r"(?:gnu )?(?:lgpl|library general public license),? ?-?v?(?:ersion )?2(?:\.0)?"),
    ("lgpl-2.1", "lgpl-2.1", r"(?:gnu )?(?:lgpl|lesser general public license),? ?-?v?(?:ersion )?2\.1"),
    ("lgpl-3.0", "lgpl-3.0", r"(?:gnu )?(?:lgpl|lesser general public license),? ?-?v?(?:ersion )?3(?:\.0)?"),
    ("agpl-3.0", "agpl-3.0", r"(?:gnu )?(?:agpl|affero general public license),? ?-?v?(?:ersion )?3(?:\.0)?"),
    ("mpl-1.1", "mpl-1.1", r"(?:mozilla public(?: license)?|mpl),? ?-?v?(?:ersion )?1\.1"),
    ("mpl-2.0", "mpl-2.0", r"(?:mozilla public(?: license)?|mpl),? ?-?v?(?:ersion )?2\.0"),
    ("epl-1.0", "epl-1.0", r"(?:eclipse public(?: license)?|epl),? ?-?v?(?:ersion )?1\.0"),
    ("epl-2.0", "epl-2.0", r"(?:eclipse public(?: license)?|epl),? ?-?v?(?:ersion )?2\.0"),
    ("cddl-1.0", "cddl-1.0", r"(?:common development and distribution(?: license)?|cddl),? ?-?v?(?:ersion )?1\.0"),
    ("cpl-1.0", "cpl-1.0", r"common public(?: license)?,? ?-?v?(?:ersion )?1\.0"), ("eupl-1.2", "eupl-1.2", r"(?:european union public(?: licen[cs]e)?|eupl),? ?-?v?(?:ersion |\. ?)?1\.2"),
    ("artistic-1.0", "artistic-1.0", r"artistic(?: license)?,? ?-?v?(?:ersion )?1\.0"), ("artistic-2.0", "artistic-2.0", r"artistic(?: license)?,? ?-?v?(?:ersion )?2\.0"),
    ("psf-2.0", "psf", r"python software foundation|psf"), ("ofl-1.1", "ofl-1.1", r"(?:sil open font(?: license)?|ofl),? ?-?v?(?:ersion )?1\.1"),
    ("ms-pl", "ms-pl", r"microsoft public|ms-pl"), ("ms-rl", "ms-rl", r"microsoft reciprocal|ms-rl"), ("postgresql", "postgresql", r"postgresql"),
    ("cc0-1.0", "cc0-1.0", r"cc0(?: 1\.0)?(?: universal)?"), ("cc-by-4.0", "cc-by-4.0", r"(?:creative commons attribution|cc[ -]by)(?: international)?[ -]4\.0"),
    ("cc-by-3.0", "cc-by-3.0", r"(?:creative commons attribution|cc[ -]by)[ -]3\.0"), ("cc-by-sa-4.0", "cc-by-sa-4.0", r"(?:creative commons attribution[- ]sharealike|cc[ -]by-sa)[ -]4\.0"),
    ("cc-by-sa-3.0", "cc-by-sa-3.0", r"(?:creative commons attribution[- ]sharealike|cc[ -]by-sa)[ -]3\.0"), ("cc-by-nc-4.0", "cc-by-nc-4.0", r"(?:creative commons attribution[- ]noncommercial|cc[ -]by-nc)[ -]4\.0"),
    ("cc-by-nd-4.0", "cc-by-nd-4.0", r"(?:creative commons attribution[- ]noderivatives|cc[ -]by-nd)[ -]4\.0"), ("cc-by-nc-sa-4.0", "cc-by-nc-sa-4.0", r"cc[ -]by-nc-sa[ -]4\.0"),
    ("ncsa", "ncsa", r"university of illinois/ncsa(?: open source)?|ncsa"), ("openssl", "openssl", r"openssl"), ("php-3.01", "php-3.01", r"php,? ?-?v?(?:ersion )?3\.01"),
    ("ruby", "ruby", r"ruby"), ("vim", "vim", r"vim"), ("w3c", "w3c", r"w3c(?: software)?"), ("upl-1.0", "upl-1.0", r"universal permissive"), ("afl-3.0", "afl-3.0", r"academic free"),
    ("osl-3.0", "osl-3.0", r"open software"), ("ecl-2.0", "ecl-2.0", r"educational community"), ("blueoak-1.0.0", "blueoak", r"blue oak model"), ("mulanpsl-2.0", "mulan", r"mulan psl"),
    ("busl-1.1", "busl-1.1", r"business source(?: license)?,? ?-?v?(?:ersion )?1\.1|busl(?:,? ?-?v?(?:ersion )?1\.1)?"), ("sspl-1.0", "sspl-1.0", r"server side public"), ("elastic-2.0", "elastic-2.0", r"elastic(?: license)?,? ?-?v?(?:ersion )?2(?:\.0)?"),
)
# clauses and addresses written out: label, keyword (words or parts of words in every match), pattern, priority
CLAUSES = (
    ("mit", "hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", 90),
    ("mit", "opensource.org", r"https?://(?:www\.)?opensource\.org/licenses/mit\b", 85), ("mit", "mit", r"\bmit[- ]licen[cs]ed?\b", 60), ("mit", "released under", r"released under the mit licen[cs]e", 75),
    ("apache-2.0", "apache.org", r"https?://(?:www\.)?apache\.org/licenses/license-2\.0(?:\.txt|\.html)?", 85),
    ("apache-2.0", "apache license", r"licensed under the apache license, version 2\.0 \(the \"license\"\)", 90), ("apache", "apache licen", r"\bapache licen[cs]e\b", 40), ("apache", "apache", r"\bapache[- ]licensed\b", 40),
    ("bsd-2-clause", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", 70),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products", 80),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 85), ("bsd", "bsd", r"\bbsd(?:[- ]style)? licen[cs]ed?\b", 40),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted", 80),
    ("zlib", "express or implied", r"this software is provided 'as-is', without any express or implied warranty", 75), ("bsl-1.0", "boost", r"https?://(?:www\.)?boost\.org/license_1_0\.txt", 85),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 90), ("unlicense", "unlicense", r"https?://unlicense\.org", 80),
    ("public-domain", "public domain", r"\b(?:in|into|to) the public domain\b", 50), ("public-domain", "public domain", r"\bpublic domain dedication\b", 55),
    ("gpl", "general public licen", r"\bgnu general public licen[cs]e\b", 50), ("gpl", "general public licen", r"\bgeneral public licen[cs]e\b", 40), ("gpl-2.0-or-later", "either version", r"either version 2 of the license, or \(at your option\) any later version", 88),
    ("gpl-3.0-or-later", "either version", r"either version 3 of the license, or \(at your option\) any later version", 88), ("lgpl-2.1-or-later", "either version", r"either version 2\.1 of the license, or \(at your option\) any later version", 89),
    ("gpl", "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/gpl(?:\.html|\.txt)?", 60), ("lgpl", "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/lgpl(?:\.html|\.txt)?", 60), ("agpl", "gnu.org", r"https?://(?:www\.)?gnu\.org/licenses/agpl(?:\.html|\.txt)?", 60),
    ("lgpl", "lesser general", r"\bgnu lesser general public licen[cs]e\b", 55), ("lgpl", "library general", r"\bgnu library general public licen[cs]e\b", 55), ("agpl", "affero", r"\bgnu affero general public licen[cs]e\b", 56), ("agpl", "agpl", r"\bagpl\b", 35),
    ("lgpl", "lgpl", r"\blgpl\b", 34), ("gpl", "gpl", r"\bgpl\b", 30), ("mpl", "mozilla", r"\bmozilla public licen[cs]e\b", 50), ("mpl-2.0", "mozilla.org", r"https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0", 85),
    ("epl", "eclipse", r"\beclipse public licen[cs]e\b", 50), ("epl-2.0", "eclipse.org", r"https?://(?:www\.)?eclipse\.org/legal/epl-(?:v20|2\.0)(?:\.html)?", 85), ("cddl", "common development", r"\bcommon development and distribution licen[cs]e\b", 50),
    ("cc0-1.0", "creativecommons", r"https?://creativecommons\.org/publicdomain/zero/1\.0", 86), ("cc-by-4.0", "creativecommons", r"https?://creativecommons\.org/licenses/by/4\.0", 86), ("cc-by-3.0", "creativecommons", r"https?://creativecommons\.org/licenses/by/3\.0", 86),
    ("cc-by-sa-4.0", "creativecommons", r"https?://creativecommons\.org/licenses/by-sa/4\.0", 86), ("cc-by-sa-3.0", "creativecommons", r"https?://creativecommons\.org/licenses/by-sa/3\.0", 86), ("cc-by-nc-4.0", "creativecommons", r"https?://creativecommons\.org/licenses/by-nc/4\.0", 86),
    ("cc-by-nd-4.0", "creativecommons", r"https?://creativecommons\.org/licenses/by-nd/4\.0", 86), ("cc-by-nc-sa-4.0", "creativecommons", r"https?://creativecommons\.org/licenses/by-nc-sa/4\.0", 86), ("cc", "creative commons", r"\bcreative commons licen[cs]e\b", 40),
    ("artistic", "artistic", r"\bartistic licen[cs]e\b", 40), ("proprietary", "all rights reserved", r"\ball rights reserved\b", 20), ("proprietary", "proprietary", r"\bproprietary and confidential\b", 60), ("proprietary", "unauthorized", r"unauthorized (?:copying|use|distribution) .{0,60}?(?:is )?(?:strictly )?prohibited", 60),
    ("commercial", "commercial", r"\bcommercial licen[cs]e(?: agreement)?\b", 45), ("eula", "end user", r"\bend[- ]user licen[cs]e agreement\b", 60), ("copyright", "copyright", r"\bcopyright (?:(?:\(c\)|\xc2\xa9) ?)?[12][0-9]{3}\b", 15),
    ("wtfpl", "wtfpl", r"https?://(?:www\.)?wtfpl\.net", 80), ("ofl-1.1", "scripts.sil.org", r"https?://scripts\.sil\.org/ofl", 80), ("psf", "psf", r"\bpsf license agreement\b", 70), ("beerware", "beer", r"\bbeer-?ware license\b", 70), ("json", "good, not evil", r"shall be used for good, not evil", 85),
    # bodies and notices of licenses, without their address
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[cs]e, v\. ?2\.0", 90),
    ("mpl-2.0", "covered software", r"covered software is provided under this license on an (?:\"|')as is(?:\"|') basis, without warranty of any kind", 82),
    ("mpl-1.1", "contents subject mozilla", r"the contents of this file are subject to the mozilla public licen[cs]e version 1\.1", 90),
    ("epl", "accompanying eclipse", r"the accompanying program is provided under the terms of this eclipse public licen[cs]e", 82),
    ("epl-2.0", "accompanying materials eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v|version )?2\.0", 88),
    ("epl-1.0", "accompanying materials eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (?:v|version )?1\.0", 88),
    ("cddl", "contents subject development", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 82),
    ("artistic-1.0", "intent document", r"the intent of this document is to state the conditions under which a package may be copied", 82),
    ("artistic-2.0", "establishes package", r"this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed", 82),
    ("cc", "defined creative commons", r"the work \(as defined below\) is provided under the terms of this creative commons public licen[cs]e", 82),
    ("cc-by-4.0", "exercising licensed rights", r"by exercising the licensed rights \(defined below\), you accept and agree to be bound by the terms and conditions of this creative commons attribution 4\.0 international public licen[cs]e", 90),
    ("cc-by-sa-4.0", "exercising licensed rights", r"by exercising the licensed rights \(defined below\), you accept and agree to be bound by the terms and conditions of this creative commons attribution-sharealike 4\.0 international public licen[cs]e", 90),
    ("cc-by-nc-4.0", "exercising licensed rights", r"by exercising the licensed rights \(defined below\), you accept and agree to be bound by the terms and conditions of this creative commons attribution-noncommercial 4\.0 international public licen[cs]e", 90),
    ("cc0-1.0", "affirmer waives", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of affirmer's copyright", 88),
    ("lgpl", "incorporates terms conditions", r"this version of the gnu lesser general public licen[cs]e incorporates the terms and conditions of version 3 of the gnu general public licen[cs]e", 82),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", 70),
    ("bsd", "contributors express", r"this software is provided by the (?:copyright holders and contributors|regents and contributors) (?:\"|')as is(?:\"|') and any express or implied warranties", 55),
    ("bsl-1.0", "machine-executable", r"unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor", 85),
    ("ofl-1.1", "reserved font name", r"no modified version of the font software may use the reserved font name", 85),
    ("wtfpl", "fuck", r"you just do what the fuck you want to", 85),
)
# how a license is spoken of: before and after its name, and the priority
FORMS = ((r"spdx-license-identifier:\s*{tag}(?:-only|-or-later|\+)?\b", "spdx", 100), (r"licen[cs]ed under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?\b", "licen under", 78),
         (r"\b(?:{name})(?: public)? licen[cs]e\b", "licen", 65), (r"\"?licen[cs]e\"?\s*[:=]\s*\"?(?:{name}|{tag})\b", "licen", 72))


def spaced(pattern: str) -> str:
    """The pattern with any white space for each space: " ?" may be none, "[ -]" is a hyphen or white space."""
    pattern = pattern.replace("[- ]", r"(?:-|\s+)").replace("[ -]", r"(?:-|\s+)")
    return pattern.replace(" ?", r"\s*").replace(" ", r"\s+")


@cache
def rules() -> tuple[tuple[tuple[bytes, ...], re.Pattern, str, int], ...]:
    """(words of the keyword, pattern, label, priority) in order of priority; words may be parted by any white space."""
    found = [(k, p, label, n) for label, k, p, n in CLAUSES]
    found += [(k, form.format(tag=re.escape(tag), name=name), label, n) for form, k, n in FORMS for tag, label, name in TAGS]
    found = [(tuple(k.encode().split()), re.compile(spaced(p).encode(), re.S), label, n) for k, p, label, n in found]
    return tuple(sorted(found, key=lambda r: -r[3]))


@cache
def phrases(wanted: tuple[tuple[str, str], ...]) -> tuple[tuple[bytes, re.Pattern, str], ...]:
    gap = rb"[^" + INSIDE + rb"]+"
    return tuple(
        (max(words := p.encode().split(), key=len), re.compile(rb"(?<![" + INSIDE + rb"])" + gap.join(map(re.escape, words)) + rb"(?![" + INSIDE + rb"])"), label)
        for p, label in wanted
    )


def detections(low: bytes) -> list[tuple[int, int, str, int]]:
    """Accepted (start, end, label, priority) in bytes of a lower-cased text."""
    gates: dict[bytes, bool] = {}
    hits = []
    for order, (words, pattern, label, priority) in enumerate(rules()):
        for word in words:
            if word not in gates:
                gates[word] = word in low
            if not gates[word]:
                break
        else:
            hits += [(-priority, m.start() - m.end(), m.start(), order, m.end(), label) for m in pattern.finditer(low)]
    kept: list[tuple[int, int, str, int]] = []
    reach: list[tuple[int, int]] = []  # accepted intervals that no other contains, by start: ends rise too
    for priority, _, start, _, end, label in sorted(hits):
        at = position(reach, start)
        if at and reach[at - 1][1] >= end:
            continue
        kept.append((start, end, label, -priority))
        low_at = at - 1 if at and reach[at - 1][0] == start else at
        stop = low_at
        while stop < len(reach) and reach[stop][1] <= end:
            stop += 1
        reach[low_at:stop] = [(start, end)]
    return sorted(kept)


def position(reach: list[tuple[int, int]], start: int) -> int:
    """How many intervals start at or before ``start``."""
    low, high = 0, len(reach)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if reach[mid][0] <= start else (low, mid)
    return low


def scan_text(text: bytes, wanted: tuple[tuple[str, str], ...] = PHRASES) -> dict:
    """Words, phrase places, labels and score of one text."""
    low = text.lower()
    inside = WORD[np.frombuffer(low, np.uint8)]
    begins = np.flatnonzero(np.diff(inside, prepend=np.uint8(0)) == 1)
    places, base = [], set()
    for word, pattern, label in phrases(wanted):
        if word in low:
            at = [m.start() for m in pattern.finditer(low)]
            places += np.searchsorted(begins, at).tolist()
            base |= {label} if at else set()
    found = detections(low)
    score = 1.0
    for best in {label: n for _, _, label, n in sorted(found, key=lambda x: x[3])}.values():
        score *= 1 - best / 101
    for _ in base - {label for _, _, label, _ in found}:
        score *= 0.5
    return {
        "n_words": len(begins), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {x[2] for x in found})), "score": 1 - score,
        "spans": [{"start": s, "end": e, "label": label, "priority": n} for s, e, label, n in found],
    }


RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
    ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))),
])


def scanner(wanted: tuple[tuple[str, str], ...]) -> Callable[[pa.Array], pa.Array]:
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([scan_text(x or b"", wanted) for x in texts.cast(pa.binary()).to_pylist()], RESULT)

    return of


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wanted: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per row; spans are in bytes of the UTF-8 text."""
    found = F.arrow_udf(
        scanner(wanted),
        "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<start:long,end:long,label:string,priority:int>>",
    )
    return docs.select(F.col(id_col).alias("id"), found(F.col(text_col)).alias("x")).select("id", "x.*")
