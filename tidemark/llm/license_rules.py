"""Signature rules of the licence scan, in order: ``label: regex`` over a text's words, joined by single spaces.

A rule's first word (or alternatives in brackets) is literal: it is where a match can start. The number of its words is bounded by
the rule itself. Tiers are priorities: an
earlier tier prevails over a later one that starts at the same word or overlaps it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases whose places are counted for themselves.
BASE = """
mit: under the mit license
apache-2: apache license version 2
cc-by-nc: cc by nc
"""

#: Identifiers and names with a version or variant: they say exactly which licence is meant.
EXACT = """
mit: under the mit license
apache-2: apache license version 2
cc-by-nc: cc by nc
mit: spdx license identifier mit
mit-0: spdx license identifier mit 0
apache-2: spdx license identifier apache 2( 0)?
apache-1.1: spdx license identifier apache 1 1
gpl-2: spdx license identifier gpl 2 0( only| or later)?
gpl-3: spdx license identifier gpl 3 0( only| or later)?
lgpl-2.1: spdx license identifier lgpl 2 1( only| or later)?
lgpl-3: spdx license identifier lgpl 3 0( only| or later)?
agpl-3: spdx license identifier agpl 3 0( only| or later)?
bsd-2: spdx license identifier bsd 2 clause( patent)?
bsd-3: spdx license identifier bsd 3 clause( clear)?
bsd-0: spdx license identifier 0bsd
isc: spdx license identifier isc
mpl-2: spdx license identifier mpl 2 0
mpl-1.1: spdx license identifier mpl 1 1
epl-1: spdx license identifier epl 1 0
epl-2: spdx license identifier epl 2 0
cddl-1: spdx license identifier cddl 1 [01]
eupl-1.2: spdx license identifier eupl 1 [012]
unlicense: spdx license identifier unlicense
zlib: spdx license identifier zlib
bsl-1: spdx license identifier bsl 1 0
cc0: spdx license identifier cc0 1 0
wtfpl: spdx license identifier wtfpl
artistic-2: spdx license identifier artistic 2 0
cc-by: spdx license identifier cc by [1234] [05]
cc-by-sa: spdx license identifier cc by sa [1234] [05]
gpl-1: gnu general public license( version)? 1
gpl-2: gnu general public license( as published by the free software foundation)?( either)? version 2
gpl-3: gnu general public license( as published by the free software foundation)?( either)? version 3
gpl-2: gnu general public license v2( 0)?
gpl-3: gnu general public license v3( 0)?
gpl-2: gnu gpl (v2|version 2|2 0|2)
gpl-3: gnu gpl (v3|version 3|3 0|3)
gpl-2: gpl (v2|version 2|2 0) (license|licence|or later|only)
gpl-3: gpl (v3|version 3|3 0) (license|licence|or later|only)
gpl-2: gplv2
gpl-3: gplv3
lgpl-2: gnu library general public license version 2
lgpl-2.1: gnu lesser general public license( as published by the free software foundation)?( either)? version 2 1
lgpl-3: gnu lesser general public license( as published by the free software foundation)?( either)? version 3
lgpl-2.1: gnu lgpl (v2 1|version 2 1|2 1)
lgpl-3: gnu lgpl (v3|version 3|3 0|3)
lgpl-2.1: lgplv2 1
lgpl-3: lgplv3
agpl-3: gnu affero general public license( as published by the free software foundation)?( either)? version 3
agpl-3: gnu agpl (v3|version 3|3 0|3)
agpl-3: agplv3
agpl-1: affero general public license version 1
fdl-1.2: gnu free documentation license version 1 2
fdl-1.3: gnu free documentation license version 1 3
apache-1: apache software license version 1 0
apache-1.1: apache software license version 1 1
apache-1: apache license version 1 0
apache-1.1: apache license version 1 1
apache-2: apache license (2 0|v2|v2 0)
apache-2: apache 2 0 (license|licence)
apache-2: apache 2 (license|licence)
apache-2: apache software license( version)? 2( 0)?
apache-2: apache org licenses license 2 0
mit-0: mit no attribution license
bsd-1: bsd 1 clause license
bsd-2: bsd 2 clause( simplified)? license
bsd-3: bsd 3 clause( new| revised)? license
bsd-4: bsd 4 clause( original)? license
bsd-0: bsd zero clause license
bsd-0: zero clause bsd license
bsd-2: simplified bsd license
bsd-2: freebsd license
bsd-2: two clause bsd license
bsd-3: three clause bsd license
bsd-3: new bsd license
bsd-3: revised bsd license
bsd-3: modified bsd license
bsd-4: four clause bsd license
bsd-4: original bsd license
mpl-1: mozilla public license version 1 0
mpl-1.1: mozilla public license( version| v)? 1 1
mpl-2: mozilla public license( version| v)? 2 0
mpl-2: mozilla org mpl 2 0
epl-1: eclipse public license( version| v)? 1 0
epl-2: eclipse public license( version| v)? 2 0
edl-1: eclipse distribution license( version| v)? 1 0
cpl-1: common public license( version)? 1 0
cpal-1: common public attribution license( version)? 1 0
cddl-1: common development and distribution license( version)? 1 0
cddl-1.1: common development and distribution license( version)? 1 1
eupl-1.1: european union public licence( version| v)? 1 1
eupl-1.2: european union public licence( version| v)? 1 2
osl-3: open software license( version| v)? 3 0
afl-3: academic free license( version| v)? 3 0
artistic-1: artistic license( version)? 1 0
artistic-2: artistic license( version)? 2 0
bsl-1: boost software license( version)? 1 0
ms-pl: microsoft public license ms pl
ms-rl: microsoft reciprocal license ms rl
ncsa: university of illinois ncsa open source license
python-2: python software foundation license version 2
php-3: php license version 3 0[01]
zpl-2: zope public license( zpl)? version 2 [01]
w3c: w3c software notice and license
ofl-1.1: sil open font license( version)? 1 1
lppl-1.3: latex project public license( version)? 1 3[abc]?
odbl-1: open database license( odbl)?( version| v)? 1 0
odc-by-1: open data commons attribution license( version| v)? 1 0
pddl-1: open data commons public domain dedication and license
cdla-permissive: community data license agreement permissive( version)?( [12] 0)?
cdla-sharing: community data license agreement sharing( version)?( 1 0)?
ogl-3: open government licence( version| v)? 3 0
etalab-2: licence ouverte( version)? 2 0
openrail-m: (creativeml|bigscience|bigcode) (open )?(open rail m|openrail m|rail|openrail)( license)?
llama: llama [234]( [123])? community license( agreement)?
busl-1.1: business source license( version)? 1 1
sspl-1: server side public license( version| v)? 1
elastic-2: elastic license( version)? 2 0
polyform-nc: polyform noncommercial license( 1 0 0)?
polyform-sb: polyform small business license( 1 0 0)?
commons-clause: commons clause license condition v1 0
cc-by-nc-nd: cc by nc nd
cc-by-nc-sa: cc by nc sa
cc-by-nd: cc by nd
cc-by-sa: cc by sa
cc-by: cc by [1234] [05]
cc0: cc0 1 0
cc0: cc zero
cc-by-nc-nd: creativecommons org licenses by nc nd
cc-by-nc-sa: creativecommons org licenses by nc sa
cc-by-nc: creativecommons org licenses by nc
cc-by-nd: creativecommons org licenses by nd
cc-by-sa: creativecommons org licenses by sa
cc-by: creativecommons org licenses by
cc0: creativecommons org publicdomain zero
public-domain: creativecommons org publicdomain mark
cc-by-nc-nd: creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?
cc-by-nc-sa: creative commons attribution non ?commercial share ?alike
cc-by-nc: creative commons attribution non ?commercial
cc-by-nd: creative commons attribution no ?deriv(ative)?s?( works)?
cc-by-sa: creative commons attribution share ?alike
cc-by: creative commons attribution( [1234] [05])?( international)? (license|licence)
cc0: creative commons (cc0|zero)
"""

#: Sentences of licence texts: they name no licence, but only one has them.
SENTENCES = """
mit: permission is hereby granted free of charge to any person obtaining a copy of this
mit: the above copyright notice and this permission notice shall be included in all copies
isc: permission to use copy modify and or distribute this software for any purpose
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd-3: neither the name of( [^ ]+){1,30} nor the names of its contributors
bsd-2: redistributions of source code must retain the above copyright notice
apache-2: you may not use this file except in compliance with the license
apache-2: unless required by applicable law or agreed to in writing software distributed under
gpl: this program is free software you can redistribute it and or modify it
gpl: you should have received a copy of the gnu general public license
lgpl: this library is free software you can redistribute it and or modify it
lgpl: you should have received a copy of the gnu lesser general public license
agpl: you should have received a copy of the gnu affero general public license
mpl-2: this source code form is subject to the terms of the mozilla public license
unlicense: this is free and unencumbered software released into the public domain
zlib: altered source versions must be plainly marked as such
zlib: this software is provided as is without any express or implied warranty in no event
wtfpl: do what the fuck you want to public license
wtfpl: everyone is permitted to copy and distribute verbatim or modified copies of this license document
bsl-1: permission is hereby granted free of charge to any person or organization obtaining a copy
ofl-1.1: this font software is licensed under the sil open font license
gfdl: permission is granted to copy distribute and or modify this document under the terms
epl: the accompanying materials are made available under the terms of the eclipse public license
cc: this work is licensed under a creative commons
public-domain: this work has been (dedicated|released) (to|into) the public domain
proprietary: unauthorized (copying|use|reproduction|distribution) of this (file|software|work|document|material)
proprietary: this (software|file|document|material) is (proprietary|confidential)( and (proprietary|confidential))?
proprietary: no part of this (publication|book|work|document) may be reproduced
"""

#: Names without a version.
NAMED = """
mit: mit (license|licence)
mit: mit licensed
mit: mit x11 license
x11: x11 license
expat: expat license
apache: apache (license|licence)
apache: apache software license
apache: apache licensed
gpl: gnu general public (license|licence)
gpl: gnu gpl
gpl: gpl (license|licence|licensed)
lgpl: gnu (lesser|library) general public (license|licence)
lgpl: gnu lgpl
lgpl: lgpl (license|licence|licensed)
agpl: gnu affero general public (license|licence)
agpl: affero general public license
agpl: agpl (license|licence|licensed)
gfdl: gnu free documentation license
gnu-all-permissive: gnu all permissive license
bsd: bsd (license|licence|licensed)
bsd: bsd style license
isc: isc (license|licence|licensed)
mpl: mozilla public (license|licence)
epl: eclipse public (license|licence)
cpl: common public license
cddl: common development and distribution license
eupl: european union public (licence|license)
osl: open software license
afl: academic free license
artistic: artistic license
bsl-1: boost software license
ms-pl: microsoft public license
ms-rl: microsoft reciprocal license
psf: python software foundation license
psf: psf license
php: php license
ruby: ruby license
perl: same terms as perl itself license
zpl: zope public license
zlib: zlib (license|licence)
zlib: zlib libpng license
libpng: libpng license
openssl: openssl license
curl: curl license
ntp: ntp license
vim: vim license
tcl: tcl tk license
postgresql: postgresql license
sleepycat: sleepycat license
unlicense: the unlicense
unlicense: unlicense org
wtfpl: wtfpl
beerware: (beer ware|beerware) license
json: json license
qpl: q public license
ipl: ibm public license
npl: netscape public license
nasa: nasa open source agreement license
ofl: (open font license|sil open font license)
lppl: latex project public license
odbl: open database license
odc-by: open data commons attribution license
ogl: open government licence
etalab: licence ouverte
dl-de: datenlizenz deutschland
cc0: cc0
cc: creative commons (license|licence|lizenz|licencia)
cc: (licence|licencia|lizenz) creative commons
cc: creativecommons org
gutenberg: project gutenberg license
openrail: (open rail|openrail) license
openrail: responsible ai license
llama: llama community license
gemma: gemma terms of use license
busl: business source license
sspl: server side public license
elastic: elastic license
polyform: polyform (shield|strict|perimeter|internal use) license
commons-clause: commons clause license
public-domain: public domain (dedication|license|licence|work)
"""

#: General statements: a licence, or a claim, of some kind.
GENERAL = """
licensed: (licensed|released|distributed|published|provided|available) under (the|a|an) ([a-z0-9]+ ){1,4}(license|licence)
licensed: (licensed|released|distributed|published) under (the )?terms of (the|a|an|this) ([a-z0-9]+ ){0,4}(license|licence|agreement)
licensed: (licensed|license|licence) cc
licensed: licensed to (you|the)
licensed: see (the )?(license|licence|copying) (file|txt|md)( for)?
licensed: subject to (the )?(license|licence) (terms|agreement)
licensed: end user (license|licence) agreement
licensed: software (license|licence) agreement
licensed: open source (license|licence|licensed)
licensed: dual licensed
licensed: (verbreitet|lizenziert|veröffentlicht) unter (der|den|einer)( [^ ]+){1,4} (license|lizenz)
licensed: (distribué|publié|diffusé|distribuée|publiée) sous (la )?(licence|license)
licensed: (distribuido|publicado|distribuida|publicada|licenciado) bajo (la )?(licencia|license)
copyright: copyright (c )?(19|20)[0-9]{2}
copyright: copyright c
copyright: copyright (by|holder|holders|owner|notice)
copyright: © (copyright )?(19|20)[0-9]{2}
copyright: all rights reserved copyright
copyright: (alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|all rights reserved)
permission: (used|reprinted|reproduced) (with|by) permission of the copyright
"""

TIERS = (BASE, EXACT, SENTENCES, NAMED, GENERAL)
#: Confidence that a detection of each tier gives.
CONFIDENCE = (1.0, 0.95, 0.9, 0.7, 0.4)
#: The keyword prefilter: every text that any rule can match has one of these (SEP stands for what parts two words).
GATES = """
licenc
licens
lizenz
copyright
©
spdx
gpl
creativecommons
creative SEP commons
cc SEP by
cc SEP zero
cc0
wtfpl
mozilla
openrail
open SEP rail
creativeml
bigscience
bigcode
public SEP domain
rights SEP reserved
rechte SEP vorbehalten
droits SEP réservés
derechos SEP reservados
permission
redistribution
neither SEP the SEP name
free SEP software
unencumbered
altered SEP source
implied SEP warranty
applicable SEP law
unauthorized
proprietary
confidential
no SEP part SEP of
"""


def gate_terms() -> tuple[list[str], list[tuple[str, str]]]:
    """The prefilter over ASCII-lower-cased text: keywords, and phrases as (longest word, regular expression)."""
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    terms = GATES.strip().splitlines()
    phrases = [(max(t.split(" SEP "), key=len), t.replace(" SEP ", sep)) for t in terms if " SEP " in t]
    return [t for t in terms if " SEP " not in t], phrases


@dataclass(frozen=True)
class Rule:
    number: int
    tier: int
    label: str
    regex: str
    leads: tuple[str, ...]
    #: Words that can follow a lead; empty if that isn't a fixed choice.
    seconds: tuple[str, ...]
    #: The most words that a match can have.
    words: int


def _leads(regex: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The words a match can begin with, and those that can come next after any of them."""
    choice = r"\(([^()]*)\)|([^ ()]+)"
    head = re.match(choice, regex)
    words = (head[1] or head[2]).split("|")
    if any(" " in w for w in words):  # several words in one choice: each has its own next word
        return tuple(dict.fromkeys(w.split(" ")[0] for w in words)), ()
    then = re.match(rf" (?:{choice})(?= |$|\( )", regex[head.end() :])
    options = (then[1] or then[2]).split("|") if then else []
    return tuple(words), tuple(options) if all(re.fullmatch(r"\w+", x) for x in options) else ()


def most_words(regex: str) -> int:
    """The most words of a match: one more than its spaces. Atoms are characters, classes and groups, with or without a quantifier."""

    def spaces(at: int) -> tuple[int, int]:
        best = here = 0
        while at < len(regex) and regex[at] != ")":
            if regex[at] == "|":
                best, here, at = max(best, here), 0, at + 1
                continue
            if regex[at] == "(":
                n, at = spaces(at + 1)
                at += 1
            else:
                end = regex.index("]", at) + 1 if regex[at] == "[" else at + 1
                n, at = int(regex[at:end] in (" ", ".")), end
            times = re.match(r"\{\d+,?(\d+)?\}|[?+*]", regex[at:])
            if times:
                at += times.end()
                if n and times[0] in "+*":
                    raise ValueError(f"no bound of words in {regex}")
                n *= int(times[1] or 1)
            here += n
        return max(best, here), at

    return spaces(0)[0] + 1


def rules() -> list[Rule]:
    out = []
    for tier, text in enumerate(TIERS):
        for line in text.strip().splitlines():
            label, _, regex = line.partition(": ")
            out.append(Rule(len(out), tier, label, regex, *_leads(regex), most_words(regex)))
    return out
