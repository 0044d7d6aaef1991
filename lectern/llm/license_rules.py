"""Signature rules for licences, hand-written, over normalised text.

Normalised text is lower case, with one blank between words and around them; punctuation is
gone, so ``GPL-3.0`` reads ``gpl 3 0``. A rule fires on whole words. Columns: priority (0 the
highest), confidence, label, keyword that the text must contain, regular expression.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    priority: int
    confidence: float
    label: str
    keyword: str
    pattern: str


#: a version number as it is left by the normalisation, and what may follow a licence's name
V = r"(?: version| v)? ?"
LATER = r"(?: or(?: \w+){0,4} later(?: version)?| or newer| plus)?"

_RULES = rf"""
0 | 0.99 | gpl-3.0 | gnu | gnu general public license(?: as published by(?: \w+){{1,6}} either)?{V}3(?: 0)?{LATER}
0 | 0.99 | gpl-2.0 | gnu | gnu general public license(?: as published by(?: \w+){{1,6}} either)?{V}2(?: 0)?{LATER}
0 | 0.99 | gpl-1.0 | gnu | gnu general public license(?: as published by(?: \w+){{1,6}} either)?{V}1(?: 0)?{LATER}
0 | 0.99 | lgpl-3.0 | gnu | gnu (?:lesser|library) general public license{V}3(?: 0)?{LATER}
0 | 0.99 | lgpl-2.1 | gnu | gnu (?:lesser|library) general public license{V}2 1{LATER}
0 | 0.99 | lgpl-2.0 | gnu | gnu (?:lesser|library) general public license{V}2(?: 0)?{LATER}
0 | 0.99 | agpl-3.0 | gnu | gnu affero general public license{V}3(?: 0)?{LATER}
0 | 0.99 | agpl-1.0 | affero | affero general public license{V}1(?: 0)?{LATER}
0 | 0.99 | gfdl-1.3 | gnu | gnu free documentation license{V}1 3{LATER}
0 | 0.99 | gfdl-1.2 | gnu | gnu free documentation license{V}1 2{LATER}
0 | 0.99 | gfdl-1.1 | gnu | gnu free documentation license{V}1 1{LATER}
1 | 0.9 | gpl | gnu | gnu general public licen[cs]e
1 | 0.9 | gpl | gnu | gnu gpl
1 | 0.9 | lgpl | gnu | gnu (?:lesser|library) general public licen[cs]e
1 | 0.9 | lgpl | gnu | gnu lgpl
1 | 0.9 | agpl | gnu | gnu affero general public licen[cs]e
1 | 0.9 | agpl | gnu | gnu agpl
1 | 0.9 | gfdl | gnu | gnu free documentation licen[cs]e
1 | 0.9 | gpl | free software foundation | free software foundation(?: \w+){{0,8}} general public licen[cs]e
0 | 0.95 | gpl-3.0 | gpl | gpl{V}3(?: 0)?(?: only)?{LATER}
0 | 0.95 | gpl-2.0 | gpl | gpl{V}2(?: 0)?(?: only)?{LATER}
0 | 0.95 | gpl-3.0 | gplv | gplv3(?: 0)?{LATER}
0 | 0.95 | gpl-2.0 | gplv | gplv2(?: 0)?{LATER}
0 | 0.95 | lgpl-3.0 | lgpl | lgpl{V}3(?: 0)?(?: only)?{LATER}
0 | 0.95 | lgpl-2.1 | lgpl | lgpl{V}2 1(?: only)?{LATER}
0 | 0.95 | lgpl-3.0 | lgplv | lgplv3{LATER}
0 | 0.95 | lgpl-2.1 | lgplv | lgplv2 1{LATER}
0 | 0.95 | agpl-3.0 | agpl | agpl{V}3(?: 0)?(?: only)?{LATER}
0 | 0.95 | agpl-3.0 | agplv | agplv3{LATER}
2 | 0.7 | gpl | gpl | (?:under|with) (?:the )?gpl
2 | 0.7 | gpl | gpl | gpl licen[cs]ed?
2 | 0.7 | lgpl | lgpl | (?:under|with) (?:the )?lgpl
2 | 0.7 | agpl | agpl | (?:under|with) (?:the )?agpl
2 | 0.6 | gpl | www gnu org licenses | www gnu org licenses(?: gpl)?(?: \d)*(?: html| txt)?
2 | 0.6 | copyleft | copyleft | copyleft(?: licen[cs]ed?)?
1 | 0.9 | gpl-exception | classpath exception | classpath exception
1 | 0.9 | gpl-exception | gcc runtime | gcc runtime library exception
1 | 0.9 | gpl-exception | font exception | font exception
0 | 0.99 | apache-2.0 | apache | apache (?:software )?licen[cs]e{V}2(?: 0)?
0 | 0.99 | apache-1.1 | apache | apache (?:software )?licen[cs]e{V}1 1
0 | 0.99 | apache-1.0 | apache | apache (?:software )?licen[cs]e{V}1(?: 0)?
0 | 0.95 | apache-2.0 | apache | apache 2(?: 0)?(?: licen[cs]ed?)?
1 | 0.95 | apache-2.0 | licenses license 2 0 | www apache org licenses license 2 0(?: html| txt)?
1 | 0.9 | apache | apache | apache (?:software )?licen[cs]e
2 | 0.6 | apache | apache | apache licensed
1 | 0.8 | apache | apache | licen[cs]ed to the apache software foundation
0 | 0.99 | mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?
0 | 0.9 | mit | without limitation the rights | without limitation the rights to use copy modify merge publish distribute sublicense and or sell(?: copies of the software)?
1 | 0.9 | mit | licen | mit licen[cs]e
1 | 0.9 | mit | licen | (?:x11|expat) licen[cs]e
1 | 0.8 | mit | licen | licen[cs]ed under(?: the)? mit
1 | 0.8 | mit | opensource org licenses mit | opensource org licenses mit(?: license)?(?: php| html)?
1 | 0.95 | mit-0 | licen | mit no attribution(?: licen[cs]e)?
0 | 0.95 | bsd-4-clause | all advertising materials | all advertising materials mentioning features or use of this software must display
0 | 0.95 | bsd-3-clause | endorse or promote products | may be used to endorse or promote products derived from this software without specific prior written permission
0 | 0.9 | bsd | redistribution and use in source | redistribution and use in source and binary forms with or without modification are permitted
0 | 0.95 | bsd-2-clause | bsd | bsd 2 clause(?: licen[cs]e)?
0 | 0.95 | bsd-3-clause | bsd | bsd 3 clause(?: licen[cs]e)?
0 | 0.95 | bsd-4-clause | bsd | bsd 4 clause(?: licen[cs]e)?
0 | 0.95 | 0bsd | 0bsd | 0bsd(?: licen[cs]e)?
0 | 0.95 | bsd-2-clause | bsd | (?:simplified|freebsd) bsd licen[cs]e
0 | 0.95 | bsd-2-clause | bsd | two clause bsd(?: licen[cs]e)?
0 | 0.95 | bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[cs]e
0 | 0.95 | bsd-3-clause | bsd | three clause bsd(?: licen[cs]e)?
1 | 0.85 | bsd | bsd | bsd(?: style)? licen[cs]e[ds]?
1 | 0.8 | bsd | berkeley | berkeley software distribution(?: licen[cs]e)?
0 | 0.99 | mpl-2.0 | mozilla | mozilla public licen[cs]e{V}2(?: 0)?
0 | 0.99 | mpl-1.1 | mozilla | mozilla public licen[cs]e{V}1 1
0 | 0.99 | mpl-1.0 | mozilla | mozilla public licen[cs]e{V}1(?: 0)?
1 | 0.9 | mpl | mozilla | mozilla public licen[cs]e
1 | 0.9 | mpl-2.0 | mpl | mpl{V}2(?: 0)?
2 | 0.7 | mpl | mpl | (?:under|with) (?:the )?mpl
2 | 0.7 | mpl | mozilla org mpl | mozilla org mpl
0 | 0.99 | epl-2.0 | eclipse | eclipse public licen[cs]e{V}2(?: 0)?
0 | 0.99 | epl-1.0 | eclipse | eclipse public licen[cs]e{V}1(?: 0)?
1 | 0.9 | epl | eclipse | eclipse public licen[cs]e
1 | 0.9 | edl-1.0 | eclipse | eclipse distribution licen[cs]e(?: version| v)?(?: 1 0)?
0 | 0.99 | cddl-1.1 | common development | common development and distribution licen[cs]e{V}1 1
0 | 0.99 | cddl-1.0 | common development | common development and distribution licen[cs]e{V}1(?: 0)?
1 | 0.9 | cddl | common development | common development and distribution licen[cs]e
1 | 0.9 | cpl-1.0 | common public | common public licen[cs]e(?: version| v)?(?: 1 0)?
1 | 0.9 | cpal-1.0 | common public | common public attribution licen[cs]e(?: version| v)?(?: 1 0)?
1 | 0.9 | ipl-1.0 | ibm | ibm public licen[cs]e(?: version| v)?(?: 1 0)?
0 | 0.99 | eupl-1.2 | european union | european union public licen[cs]e{V}1 2
0 | 0.99 | eupl-1.1 | european union | european union public licen[cs]e{V}1 1
1 | 0.9 | eupl | european union | european union public licen[cs]e
0 | 0.95 | eupl-1.2 | eupl | eupl{V}1 2
1 | 0.9 | isc | licen | isc licen[cs]e
1 | 0.9 | isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1 | 0.9 | ntp | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? with or without fee is hereby granted
1 | 0.9 | zlib | licen | zlib licen[cs]e
1 | 0.9 | zlib | licen | zlib libpng licen[cs]e
1 | 0.9 | libpng | licen | libpng licen[cs]e
0 | 0.9 | zlib | provided as is without | this software is provided as is without any express or implied warranty in no event will the authors be held liable
0 | 0.99 | bsl-1.0 | boost | boost software licen[cs]e(?: version| v)?(?: 1 0)?
0 | 0.95 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
1 | 0.9 | unlicense | unlicense | (?:the )?unlicense
1 | 0.9 | wtfpl | wtfpl | wtfpl
1 | 0.9 | wtfpl | public licen | do what the fuck you want to public licen[cs]e
1 | 0.9 | artistic-2.0 | artistic | artistic licen[cs]e{V}2(?: 0)?
1 | 0.85 | artistic | artistic | artistic licen[cs]e
1 | 0.85 | clarified-artistic | artistic | clarified artistic licen[cs]e
1 | 0.9 | perl | perl | same terms as perl(?: itself)?
1 | 0.9 | ruby | ruby | ruby licen[cs]e
1 | 0.9 | php-3.01 | php | php licen[cs]e{V}3 01
1 | 0.85 | php | php | php licen[cs]e
1 | 0.9 | psf-2.0 | python | python software foundation licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
1 | 0.85 | python | python | python licen[cs]e
1 | 0.9 | openssl | openssl | openssl licen[cs]e
1 | 0.9 | ssleay | ssleay | (?:original )?ssleay licen[cs]e
1 | 0.9 | ofl-1.1 | open font | sil open font licen[cs]e(?: version| v)?(?: 1 [01])?
1 | 0.85 | ofl | open font | open font licen[cs]e
1 | 0.9 | ms-pl | microsoft | microsoft public licen[cs]e
1 | 0.9 | ms-rl | microsoft | microsoft reciprocal licen[cs]e
1 | 0.9 | afl-3.0 | academic free | academic free licen[cs]e(?: version| v)?(?: \d \d)?
1 | 0.9 | osl-3.0 | open software | open software licen[cs]e(?: version| v)?(?: \d \d)?
1 | 0.9 | qpl-1.0 | licen | q public licen[cs]e(?: version| v)?(?: 1 0)?
1 | 0.9 | apsl-2.0 | apple public | apple public source licen[cs]e(?: version| v)?(?: 2 0)?
1 | 0.9 | npl-1.1 | netscape | netscape public licen[cs]e(?: version| v)?(?: 1 [01])?
1 | 0.9 | spl-1.0 | sun public | sun public licen[cs]e(?: version| v)?(?: 1 0)?
1 | 0.9 | sissl | sun industry | sun industry standards source licen[cs]e
1 | 0.9 | w3c | w3c | w3c (?:software(?: notice and)? )?licen[cs]e
1 | 0.9 | ncsa | university of illinois | university of illinois(?: ncsa)? open source licen[cs]e
1 | 0.9 | ncsa | ncsa | ncsa open source licen[cs]e
1 | 0.9 | postgresql | postgresql | postgresql licen[cs]e
1 | 0.9 | vim | licen | vim licen[cs]e
1 | 0.9 | beerware | beer | beer ?ware(?: licen[cs]e)?
1 | 0.9 | json | for good not evil | the software shall be used for good not evil
1 | 0.9 | ecl-2.0 | educational community | educational community licen[cs]e(?: version| v)?(?: 2 0)?
1 | 0.9 | upl-1.0 | universal permissive | universal permissive licen[cs]e(?: version| v)?(?: 1 0)?
1 | 0.9 | mulan-psl-2.0 | mulan | mulan permissive software licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
1 | 0.9 | blueoak-1.0.0 | blue oak | blue oak model licen[cs]e(?: 1 0 0)?
1 | 0.9 | cecill-2.1 | cecill | cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version| v)?(?: 2 [01])?
1 | 0.9 | busl-1.1 | business source | business source licen[cs]e(?: version| v)?(?: 1 1)?
1 | 0.9 | sspl-1.0 | server side public | server side public licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
1 | 0.9 | elastic-2.0 | elastic licen | elastic licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
1 | 0.9 | commons-clause | commons clause | commons clause(?: licen[cs]e condition)?(?: version| v)?(?: 1 0)?
1 | 0.9 | polyform | polyform | polyform \w+(?: \w+)? licen[cs]e(?: 1 0 0)?
1 | 0.9 | openrail | openrail | openrail(?: m)?(?: licen[cs]e)?
1 | 0.9 | llama | llama | llama(?: \d)* community licen[cs]e(?: agreement)?
1 | 0.9 | odbl-1.0 | open database | open database licen[cs]e(?: odbl)?(?: version| v)?(?: 1 0)?
1 | 0.9 | odbl-1.0 | open data commons | open data commons open database licen[cs]e(?: odbl)?(?: version| v)?(?: 1 0)?
1 | 0.9 | odbl-1.0 | odbl | odbl(?: 1 0)?
1 | 0.9 | odc-by-1.0 | open data commons | open data commons attribution licen[cs]e(?: version| v)?(?: 1 0)?
1 | 0.9 | pddl-1.0 | public domain dedication | public domain dedication and licen[cs]e(?: pddl)?(?: 1 0)?
1 | 0.9 | cdla-permissive | community data licen | community data licen[cs]e agreement permissive(?: version| v)?(?: [12] 0)?
1 | 0.9 | cdla-sharing | community data licen | community data licen[cs]e agreement sharing(?: version| v)?(?: 1 0)?
1 | 0.9 | ogl-uk | open government | open government licen[cs]e(?: version| v)?(?: ?[123](?: 0)?)?
1 | 0.9 | etalab | etalab | (?:etalab|licence ouverte)(?: open licen[cs]e)?(?: 2 0)?
0 | 0.95 | cc0-1.0 | cc0 | cc0(?: 1 0)?(?: universal)?
0 | 0.95 | cc0-1.0 | creative commons | creative commons (?:cc0|zero)(?: v?1 0)?(?: universal)?
0 | 0.95 | cc-pdm | public domain mark | public domain mark(?: 1 0)?
1 | 0.8 | cc-by | creative commons | creative commons attribution(?: licen[cs]e)?
1 | 0.8 | cc-by-sa | creative commons | creative commons attribution share ?alike(?: licen[cs]e)?
1 | 0.8 | cc-by-nc | creative commons | creative commons attribution non ?commercial(?: licen[cs]e)?
1 | 0.8 | cc-by-nd | creative commons | creative commons attribution no ?deriv(?:ative)?s(?: licen[cs]e)?
1 | 0.8 | cc-by-nc-sa | creative commons | creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?
1 | 0.8 | cc-by-nc-nd | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: licen[cs]e)?
2 | 0.6 | creative-commons | creative commons | creative commons(?: public)? licen[cs]e[ds]?
2 | 0.5 | creative-commons | creative commons | creative commons
1 | 0.8 | cc-by | creativecommons org licenses | creativecommons org licenses by(?: \d \d)?
1 | 0.8 | cc-by-sa | creativecommons org licenses | creativecommons org licenses by sa(?: \d \d)?
1 | 0.8 | cc-by-nc | creativecommons org licenses | creativecommons org licenses by nc(?: \d \d)?
1 | 0.8 | cc-by-nc-sa | creativecommons org licenses | creativecommons org licenses by nc sa(?: \d \d)?
1 | 0.8 | cc-by-nc-nd | creativecommons org licenses | creativecommons org licenses by nc nd(?: \d \d)?
1 | 0.8 | cc-by-nd | creativecommons org licenses | creativecommons org licenses by nd(?: \d \d)?
1 | 0.8 | cc0-1.0 | creativecommons org publicdomain | creativecommons org publicdomain zero(?: 1 0)?
2 | 0.7 | public-domain | public domain | (?:released|dedicated|placed) (?:in|into|to) the public domain
2 | 0.6 | public-domain | public domain | (?:is|are) (?:in|within) the public domain
2 | 0.8 | all-rights-reserved | all rights reserved | all rights reserved
2 | 0.7 | all-rights-reserved | copyright | copyright(?: c)? \d{{4}}(?: \d{{4}})?(?: \w+){{1,6}} all rights reserved
3 | 0.4 | copyright | copyright | copyright(?: c)? \d{{4}}(?: \d{{4}})?
2 | 0.7 | proprietary | proprietary | proprietary and confidential
2 | 0.7 | proprietary | proprietary | proprietary licen[cs]e
2 | 0.7 | proprietary | unauthorized copying | unauthorized copying of this (?:file|software|document)
2 | 0.7 | eula | end user licen | end user licen[cs]e agreement
2 | 0.6 | non-commercial | commercial | for (?:non ?commercial|personal) use only
2 | 0.6 | non-commercial | commercial | not for commercial use
2 | 0.6 | no-redistribution | redistribut | (?:may|must) not be redistributed
2 | 0.5 | source-available | source available | source available licen[cs]e
3 | 0.4 | open-source | licen | open source licen[cs]e
3 | 0.4 | free-software | licen | free software licen[cs]e
3 | 0.4 | dual-licence | licen | dual licen[cs]ed
3 | 0.4 | permissive | licen | permissive(?:ly)? licen[cs]ed?
3 | 0.3 | licence-reference | licen | see (?:the )?licen[cs]e(?: file| txt| md)?
3 | 0.3 | licence-reference | licen | (?:this \w+(?: \w+)? is )?licen[cs]ed under(?: the)?(?: terms of)?
3 | 0.3 | licence-reference | licen | (?:distributed|released|available|published) under (?:the|an?)(?: terms of)?(?: \w+){{1,3}} licen[cs]e
"""

#: licence identifiers that follow the words ``spdx license identifier``, normalised
_SPDX = """gpl 2 0 only, gpl 2 0 or later, gpl 3 0 only, gpl 3 0 or later, lgpl 2 1 only, lgpl 2 1 or later, lgpl 3 0 only,
lgpl 3 0 or later, agpl 3 0 only, agpl 3 0 or later, apache 2 0, mit, mit 0, bsd 2 clause, bsd 3 clause, isc, mpl 2 0, epl 2 0,
cddl 1 0, eupl 1 2, bsl 1 0, zlib, unlicense, 0bsd, cc0 1 0, cc by 4 0, cc by sa 4 0, cc by nc 4 0, ofl 1 1, artistic 2 0,
upl 1 0, ncsa, postgresql, wtfpl, psf 2 0"""

_CC_KINDS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
_CC_LONG = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s"}


def _hyphened(text: str) -> str:
    """``gpl 2 0 only`` as ``gpl-2.0-only``."""
    out = ""
    for word in text.split():
        joint = "." if word.isdigit() and out and out[-1].isdigit() else "-"
        out += (joint if out else "") + word
    return out


def rules() -> list[Rule]:
    """All rules in order of the table, then the families of identifiers and of versions."""
    out = []
    for line in _RULES.strip().splitlines():
        priority, confidence, label, keyword, pattern = (part.strip() for part in line.split(" | ", 4))
        out.append(Rule(int(priority), float(confidence), label, keyword, pattern))
    for ident in _SPDX.replace("\n", " ").split(","):
        words = " ".join(ident.split())
        out.append(Rule(0, 1.0, _hyphened(words), "spdx", f"spdx license identifier {words}"))
    for kind in _CC_KINDS:
        spelt = " ".join(_CC_LONG[part] for part in kind.split())
        label = "cc-" + kind.replace(" ", "-")
        out.append(Rule(1, 0.9, label, " cc ", f"cc {kind}"))
        for version in _CC_VERSIONS:
            own = f"{label}-{version.replace(' ', '.')}"
            out.append(Rule(0, 0.95, own, " cc ", f"cc {kind} {version}"))
            out.append(Rule(0, 0.99, own, "creative commons", f"creative commons {spelt}(?: licen[cs]e)? {version}(?: international| generic| unported)?"))
    return out
