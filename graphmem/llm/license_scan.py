"""License scans with DataFrame functions only.

Ordered signature rules run over the words of a text joined by single spaces.  A rule runs only where all words that one
of its spellings cannot do without are among the text's words (``needs``); they come from the pattern itself, so no match is lost.
Each word carries its number behind a tilde, which no word holds, so one pass of a rule's regex tells where its matches begin and
end, and nothing is added up.  Each match is an interval of words with a priority; one that lies inside an interval of at
least its priority is suppressed.  All of it is one narrow projection of a row: no join, no shuffle, and time in proportion to a text and its matches.
"""

from __future__ import annotations

import collections
import functools
import itertools
from collections.abc import Sequence
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmem.llm.plainwords import words

#: Phrases that are looked for word by word, and their labels.
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}

#: License and its name as a regular expression over words; ``alone`` marks a word that means nothing else.
NAMES = [(line + " | ").split(" | ")[:3] for line in r"""
apache-2.0 | apache(?: software)? license(?: version)? 2(?: 0)?|apache 2(?: 0)?
apache-1.1 | apache(?: software)? license(?: version)? 1 1|apache 1 1
apache-1.0 | apache(?: software)? license(?: version)? 1 0|apache 1 0
apache | apache(?: software)? license
mit | (?:the )?mit(?: x11)?(?: license)?|expat(?: license)?
mit-0 | mit no attribution|mit 0
x11 | x11(?: license)?
isc | isc(?: license)?
bsd | bsd(?: style| type)?(?: license)?
bsd-2-clause | (?:simplified |freebsd )bsd(?: license)?|bsd 2 clause(?: license)?|(?:2|two) clause bsd(?: license)?
bsd-3-clause | (?:new |modified |revised )bsd(?: license)?|bsd 3 clause(?: license)?|(?:3|three) clause bsd(?: license)?
bsd-4-clause | (?:original |old )bsd(?: license)?|bsd 4 clause(?: license)?|(?:4|four) clause bsd(?: license)?
bsd-0-clause | (?:zero|0) clause bsd(?: license)?
bsd-0-clause | 0bsd | alone
gpl | (?:gnu )?gpl
gpl-1.0 | (?:gnu )?gpl(?: version)? v?1(?: 0)?(?: only| or later)?
gpl-2.0 | (?:gnu )?gpl(?: version)? v?2(?: 0)?(?: only| or later)?
gpl-3.0 | (?:gnu )?gpl(?: version)? v?3(?: 0)?(?: only| or later)?
gpl-2.0 | gplv2(?: only| or later)? | alone
gpl-3.0 | gplv3(?: only| or later)? | alone
lgpl | (?:gnu )?lgpl
lgpl-2.0 | (?:gnu )?lgpl(?: version)? v?2(?: 0)?(?: only| or later)?
lgpl-2.1 | (?:gnu )?lgpl(?: version)? v?2 1(?: only| or later)?
lgpl-3.0 | (?:gnu )?lgpl(?: version)? v?3(?: 0)?(?: only| or later)?
lgpl-2.1 | lgplv2 1(?: only| or later)? | alone
lgpl-3.0 | lgplv3(?: only| or later)? | alone
agpl | (?:gnu )?agpl
agpl-3.0 | (?:gnu )?agpl(?: version)? v?3(?: 0)?(?: only| or later)?
agpl-3.0 | agplv3(?: only| or later)? | alone
gpl-2.0 | gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?
gpl-3.0 | gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?
lgpl-2.1 | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2 1
lgpl-3.0 | gnu lesser general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?
agpl-3.0 | gnu affero general public license(?: (?:version|v) ?3(?: 0)?)?
gfdl | gnu free documentation license(?: version 1 [123])?
gfdl | gfdl(?: 1 [123])?
mpl | mozilla public license|mpl license
mpl-1.1 | mozilla public license(?: version)? 1 1|mpl(?: version| v)? 1 1
mpl-2.0 | mozilla public license(?: version| v)? 2(?: 0)?|mpl(?: version| v)? 2(?: 0)?
npl-1.1 | netscape public license(?: version)? 1 1
epl-1.0 | eclipse public license(?: version| v)? 1(?: 0)?|epl 1 0
epl-2.0 | eclipse public license(?: version| v)? 2(?: 0)?|epl 2 0
edl-1.0 | eclipse distribution license(?: version| v)? 1(?: 0)?
cddl-1.0 | cddl(?: version| v)? 1(?: 0)?|common development and distribution license(?: version 1 0)?
cddl-1.1 | cddl(?: version| v)? 1 1
cpl-1.0 | common public license(?: version)? 1(?: 0)?
ipl-1.0 | ibm public license(?: version)? 1(?: 0)?
artistic-1.0 | artistic license(?: version)? 1(?: 0)?
artistic-2.0 | artistic license(?: version)? 2(?: 0)?
artistic | artistic license
bsl-1.0 | boost software license(?: version)? 1(?: 0)?|bsl 1 0
zlib | zlib(?: libpng)?(?: license)?
libpng | libpng license(?: version 2)?
unlicense | (?:the )?unlicense | alone
wtfpl | wtfpl(?: version 2)? | alone
cc0-1.0 | (?:creative commons )?cc0(?: 1 0)?(?: universal)? | alone
cc0-1.0 | creative commons zero(?: v?1 0)?(?: universal)?
cc-by-1.0 | (?:creative commons )?cc by 1 0
cc-by-2.0 | (?:creative commons )?cc by 2 0
cc-by-2.5 | (?:creative commons )?cc by 2 5
cc-by-3.0 | (?:creative commons )?cc by 3 0
cc-by-4.0 | (?:creative commons )?cc by 4 0
cc-by-sa-2.0 | cc by sa 2 0
cc-by-sa-2.5 | cc by sa 2 5
cc-by-sa-3.0 | cc by sa 3 0
cc-by-sa-4.0 | cc by sa 4 0
cc-by-nc-2.0 | cc by nc 2 0
cc-by-nc-3.0 | cc by nc 3 0
cc-by-nc-4.0 | cc by nc 4 0
cc-by-nd-3.0 | cc by nd 3 0
cc-by-nd-4.0 | cc by nd 4 0
cc-by-nc-sa-3.0 | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc by nc sa 4 0
cc-by-nc-nd-3.0 | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc by nc nd 4 0
cc-by | creative commons attribution(?: (?:license|[1-4] [05])){0,2}
cc-by-sa | creative commons attribution share ?alike(?: (?:license|[1-4] [05])){0,2}
cc-by-nc | creative commons attribution non ?commercial(?: (?:license|[1-4] [05])){0,2}
cc-by-nd | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: (?:license|[1-4] [05])){0,2}
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
odbl-1.0 | open database license(?: v1 0| 1 0)?|odbl(?: v1 0| 1 0)
odc-by-1.0 | odc by(?: 1 0)?|open data commons attribution license
pddl-1.0 | pddl(?: 1 0)?
pddl-1.0 | public domain dedication and license
cdla-permissive-2.0 | community data license agreement permissive(?: version)? 2 0|cdla permissive 2 0
cdla-sharing-1.0 | community data license agreement sharing(?: version)? 1 0|cdla sharing 1 0
ofl-1.1 | sil open font license(?: version)?(?: 1 1)?
ofl-1.1 | ofl(?: version)? 1 1
psf-2.0 | python software foundation license(?: version 2)?|psf license(?: version 2)?
php-3.01 | php license(?: version)? 3 01
ruby | ruby license
postgresql | postgresql license
openssl | openssl license
curl | curl license
ncsa | (?:university of illinois )?ncsa(?: open source)?(?: license)?
eupl-1.2 | eupl(?: version| v)? ?1 2|european union public licen[cs]e(?: version)? 1 2
eupl-1.1 | eupl(?: version| v)? ?1 1|european union public licen[cs]e(?: version)? 1 1
cecill-2.1 | cecill(?: free software license agreement)?(?: version| v)? ?2 1
osl-3.0 | osl(?: version| v)? ?3 0|open software license(?: version)? 3 0
afl-3.0 | afl(?: version| v)? ?3 0|academic free license(?: version)? 3 0
upl-1.0 | universal permissive license(?: version)?(?: 1 0)?
ms-pl | microsoft public license|ms pl
ms-rl | microsoft reciprocal license|ms rl
beerware | beer ?ware(?: license)?(?: revision 42)?
json | json license
vim | vim license
qpl-1.0 | q public license(?: version)?(?: 1 0)?
sleepycat | sleepycat(?: public)? license
w3c | w3c software(?: and document)?(?: notice and)? license
ecl-2.0 | educational community license(?: version)? 2(?: 0)?
ppl | peer production license
hippocratic | hippocratic license(?: version)?(?: [123] [01])?
blueoak-1.0.0 | blue oak model license(?: 1 0 0)?
mulan-psl-2.0 | mulan(?: permissive software license|psl| psl) ?(?:version |v)?2
sspl-1.0 | sspl(?: version| v)? ?1(?: 0)?|server side public license(?: version| v)?(?: ?1)?
busl-1.1 | business source license(?: version)? 1 1
elastic-2.0 | elastic license(?: version)? 2(?: 0)?
commons-clause | commons clause(?: license)?(?: condition)?(?: v?1 0)?
polyform | polyform (?:noncommercial|small business|strict|shield|perimeter) license(?: 1 0 0)?
bigscience-openrail-m | (?:bigscience |creativeml )open ?rail(?: m)?(?: license)?
bigscience-openrail-m | open ?rail(?: m)?(?: license)?
llama-community | llama [23](?: [123])? community license(?: agreement)?
""".strip().split("\n")]  # fmt: skip

#: What declares a license by name, and what may follow a name that stands on its own.
DECLARED = r"(?:spdx license identifier |(?:licensed|released|distributed|available|provided|covered) under (?:the )?(?:terms of (?:the )?)?|licen[cs]e )"
TITLE = "licen[cs]e"

#: Sentences of license texts and notices: label, pattern, priority, confidence.
TEXTS = [line.split(" | ") for line in r"""
mit | permission is hereby granted free of charge to any person obtaining a copy of this software | 3 | 0.98
mit | to deal in the software without restriction including without limitation the rights | 3 | 0.95
mit | to use copy modify merge publish distribute sublicense and or sell copies of the software | 3 | 0.95
mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions | 3 | 0.95
mit | in no event shall the authors or copyright holders be liable for any claim damages or other liability | 3 | 0.9
mit | arising from out of or in connection with the software or the use or other dealings in the software | 3 | 0.9
mit | fitness for a particular purpose and noninfringement | 2 | 0.6
isc | permission to use copy modify and or distribute this software for any purpose with or without fee | 3 | 0.97
isc | provided that the above copyright notice and this permission notice appear in all copies | 3 | 0.9
isc | the author disclaims all warranties with regard to this software | 3 | 0.85
x11 | shall not be used in advertising or otherwise to promote the sale use or other dealings in this software | 3 | 0.95
bsd | redistribution and use in source and binary forms with or without modification are permitted | 3 | 0.97
bsd | redistributions of source code must retain the above copyright notice | 3 | 0.95
bsd | redistributions in binary form must reproduce the above copyright notice | 3 | 0.95
bsd | this list of conditions and the following disclaimer(?: in the documentation)? | 2 | 0.8
bsd | this software is provided by the copyright holders and contributors as is | 3 | 0.9
bsd | any express or implied warranties including but not limited to the implied warranties of merchantability | 2 | 0.7
bsd-3-clause | may be used to endorse or promote products derived from this software | 3 | 0.9
bsd-3-clause | neither the name of (?:\S+ ){1,8}nor the names of its contributors | 3 | 0.95
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledgement | 3 | 0.95
bsd-2-clause-patent | subject to the terms and conditions of this license each copyright holder and contributor hereby grants | 3 | 0.9
apache-2.0 | you may not use this file except in compliance with the license | 3 | 0.9
apache-2.0 | apache license version 2 0 january 2004 | 3 | 0.99
apache-2.0 | www apache org licenses license 2 0 | 3 | 0.97
apache-2.0 | unless required by applicable law or agreed to in writing software distributed under the license | 3 | 0.95
apache-2.0 | see the license for the specific language governing permissions and limitations | 3 | 0.9
apache-2.0 | grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license | 3 | 0.9
apache-1.1 | this product includes software developed by the apache software foundation | 3 | 0.9
gpl | you can redistribute it and or modify it under the terms of the gnu(?: lesser| affero| library)? general public license | 3 | 0.97
gpl | without even the implied warranty of merchantability or fitness for a particular purpose | 2 | 0.7
gpl | you should have received a copy of the gnu(?: lesser| affero| library)? general public license | 3 | 0.95
gpl | gnu general public license | 2 | 0.9
gpl | either version [123] of the license or at your option any later version | 3 | 0.9
gpl | everyone is permitted to copy and distribute verbatim copies of this license document | 3 | 0.9
gpl | the licenses for most software are designed to take away your freedom to share and change it | 3 | 0.95
gpl | www gnu org (?:licenses|copyleft) gpl(?: html| txt)? | 3 | 0.95
gpl-3.0 | the gnu general public license is a free copyleft license for software and other kinds of works | 3 | 0.97
gpl-2.0 | write to the free software foundation inc 5(?:1|9) (?:franklin street|temple place) | 3 | 0.85
gpl-exception | as a special exception the copyright holders (?:of this library )?give you permission to link | 3 | 0.9
gpl-classpath | linking this library statically or dynamically with other modules is making a combined work | 3 | 0.95
lgpl | gnu lesser general public license | 3 | 0.9
lgpl | gnu library general public license | 3 | 0.9
lgpl | www gnu org licenses lgpl(?: 2 1| 3 0)?(?: html| txt)? | 3 | 0.95
agpl | affero general public license | 3 | 0.9
agpl | www gnu org licenses agpl(?: 3 0)?(?: html| txt)? | 3 | 0.95
agpl | designed specifically to ensure cooperation with the community in the case of network server software | 3 | 0.97
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license | 3 | 0.97
gfdl | with no invariant sections no front cover texts and no back cover texts | 3 | 0.95
mpl-2.0 | this source code form is subject to the terms of the mozilla public license | 3 | 0.97
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at | 3 | 0.97
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1 | 3 | 0.97
mpl-1.1 | software distributed under the license is distributed on an as is basis without warranty of any kind | 3 | 0.8
epl | eclipse public license | 2 | 0.85
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license(?: 2 0)? | 3 | 0.95
cddl | the contents of this file are subject to the terms of the common development and distribution license | 3 | 0.97
cddl | you can obtain a copy of the license at (?:\S+ ){0,6}cddl | 3 | 0.85
cpl | this program is made available under the terms of the common public license | 3 | 0.95
unlicense | this is free and unencumbered software released into the public domain | 3 | 0.98
unlicense | anyone is free to copy modify publish use compile sell or distribute this software | 3 | 0.97
unlicense | in jurisdictions that recognize copyright laws the author or authors of this software dedicate | 3 | 0.95
public-domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain | 2 | 0.85
public-domain | (?:is|are) in the public domain | 2 | 0.8
public-domain | no copyright is claimed | 2 | 0.75
public-domain | public domain | 1 | 0.5
wtfpl | do what the \S+ you want to public license | 3 | 0.97
wtfpl | you just do what the \S+ you want to | 3 | 0.9
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer | 3 | 0.97
zlib | altered source versions must be plainly marked as such and must not be misrepresented | 3 | 0.95
zlib | the origin of this software must not be misrepresented | 3 | 0.95
zlib | this notice may not be removed or altered from any source distribution | 3 | 0.95
zlib | in no event will the authors be held liable for any damages arising from the use of this software | 3 | 0.9
libpng | the png reference library is supplied as is | 3 | 0.95
bsl-1.0 | boost software license | 2 | 0.85
bsl-1.0 | www boost org license 1 0 txt | 3 | 0.97
bsl-1.0 | unless such copies or derivative works are solely in the form of machine executable object code | 3 | 0.95
ofl-1.1 | open font license | 2 | 0.85
ofl-1.1 | with reserved font name | 3 | 0.9
ofl-1.1 | the font software may be sold as part of a larger software package | 3 | 0.9
artistic | you may make and give away verbatim copies of the source form of the standard version of this package | 3 | 0.95
artistic | same terms as perl itself | 3 | 0.9
psf-2.0 | psf hereby grants licensee a nonexclusive royalty free world wide license | 3 | 0.95
openssl | this product includes software developed by the openssl project | 3 | 0.95
openssl | this product includes cryptographic software written by eric young | 3 | 0.95
ncsa | neither the names of (?:\S+ ){1,10}nor the names of its contributors may be used to endorse | 3 | 0.85
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee | 3 | 0.9
json | the software shall be used for good not evil | 3 | 0.98
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted | 3 | 0.9
vim | vim is charityware | 3 | 0.95
w3c | by obtaining using and or copying this work you the licensee agree | 3 | 0.9
sspl | service source code means the corresponding source for the program or the modified version | 3 | 0.95
busl | effective on the change date or the fourth anniversary of the first publicly available distribution | 3 | 0.97
elastic | you may not provide the software to third parties as a hosted or managed service | 3 | 0.97
commons-clause | the grant of rights under the license will not include and the license does not grant to you the right to sell | 3 | 0.97
cc-by | creative commons attribution | 2 | 0.8
cc-by-sa | cc by sa | 3 | 0.9
cc-by-nc | cc by nc | 3 | 0.9
cc-by-nd | cc by nd | 3 | 0.9
cc-by-nc-sa | cc by nc sa | 3 | 0.92
cc-by-nc-nd | cc by nc nd | 3 | 0.92
cc-by | creativecommons org licenses by(?: [1-4] [05])? | 3 | 0.95
cc-by-sa | creativecommons org licenses by sa(?: [1-4] [05])? | 3 | 0.97
cc-by-nc | creativecommons org licenses by nc(?: [1-4] [05])? | 3 | 0.97
cc-by-nd | creativecommons org licenses by nd(?: [1-4] [05])? | 3 | 0.97
cc-by-nc-sa | creativecommons org licenses by nc sa(?: [1-4] [05])? | 3 | 0.98
cc-by-nc-nd | creativecommons org licenses by nc nd(?: [1-4] [05])? | 3 | 0.98
cc0-1.0 | creativecommons org publicdomain zero 1 0 | 3 | 0.97
cc0-1.0 | waived all copyright and related or neighboring rights | 3 | 0.95
creative-commons | some rights reserved under (?:a |the )?creative commons | 3 | 0.85
creative-commons | creative commons(?: license)? | 1 | 0.6
proprietary | proprietary and confidential | 3 | 0.9
proprietary | confidential and proprietary | 3 | 0.9
proprietary | trade secrets? (?:and|or) confidential information | 2 | 0.7
proprietary | unauthorized (?:copying|use|reproduction|distribution|disclosure) (?:\S+ ){0,6}(?:is )?(?:strictly )?prohibited | 3 | 0.85
proprietary | without (?:the )?(?:prior )?(?:express )?written (?:permission|consent) | 2 | 0.6
proprietary | no part of this (?:publication|book|work|document|site) may be reproduced | 3 | 0.9
proprietary | may not be (?:reproduced|copied|republished|redistributed)(?: or (?:reproduced|copied|republished|redistributed))? | 2 | 0.65
proprietary | this material may not be published broadcast rewritten or redistributed | 3 | 0.95
proprietary | you may not (?:copy|reverse engineer|decompile|disassemble) | 2 | 0.65
proprietary | all other rights are reserved | 2 | 0.7
reserved | (?:all|some) rights reserved | 2 | 0.9
reserved | tous droits réservés | 2 | 0.85
reserved | alle rechte vorbehalten | 2 | 0.85
reserved | todos los derechos reservados | 2 | 0.85
no-rights-reserved | no rights reserved | 3 | 0.9
copyright | copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)* | 2 | 0.7
copyright | copyright(?: ©)? (?:by )?the (?:authors?|contributors?) | 2 | 0.6
copyright | copyright | 1 | 0.3
trademark | registered trademarks? of | 1 | 0.3
trademark | (?:is|are) (?:a )?trademarks? of | 1 | 0.3
patent | (?:patents? pending|covered by (?:one or more )?patents) | 1 | 0.3
commercial | commercial licen[cs]e | 1 | 0.5
noncommercial | for (?:personal and )?non ?commercial (?:use|purposes) only | 2 | 0.7
noncommercial | not for commercial (?:use|purposes) | 2 | 0.7
noncommercial | commercial use (?:is )?(?:not permitted|prohibited|forbidden) | 2 | 0.75
academic | for academic (?:and|or) research (?:use|purposes) only | 2 | 0.7
academic | for research (?:and educational )?(?:use|purposes) only | 2 | 0.7
evaluation | for evaluation purposes only | 2 | 0.7
personal | for (?:your )?personal use only | 2 | 0.65
government | restricted rights legend | 2 | 0.8
government | commercial computer software documentation | 2 | 0.6
license | (?:see|read) the licen[cs]e(?: file)? | 1 | 0.4
license | (?:is|are) licensed | 1 | 0.4
license | subject to the (?:following )?terms and conditions(?: of this license)? | 1 | 0.4
license | this license (?:does not grant|shall apply|governs) | 1 | 0.5
license | dual licensed | 1 | 0.5
eula | end user licen[cs]e agreement | 2 | 0.7
eula | by (?:installing|downloading|using) (?:\S+ ){0,4}you agree to (?:be bound by )?(?:the|these) terms | 2 | 0.65
no-warranty | provided as is without warranty of any kind | 2 | 0.6
no-warranty | the software is provided as is | 2 | 0.6
no-warranty | comes with absolutely no warranty | 2 | 0.7
robots | no (?:text and data mining|ai training) (?:is )?(?:permitted|allowed) | 2 | 0.7
""".strip().split("\n")]  # fmt: skip

Rule = tuple[str, str, int, float]


@functools.cache
def rules() -> tuple[Rule, ...]:
    """``label, pattern, priority, confidence``, in order: whole sentences, then each name where it is declared and where it stands on its own.

    A name that can be a single word counts on its own only with the word license behind it.
    """
    out = [(label, text, int(priority), float(sure)) for label, text, priority, sure in TEXTS]
    for label, name, alone in NAMES:
        plain = alone or all(" " in s for s in _spellings(parser.parse(name)))
        out += [(label, f"{DECLARED}(?:{name})", 3, 0.95), (label, f"(?:{name})(?: {TITLE})" + "?" * bool(plain), 2, 0.85)]
    return tuple(out)


#: Any characters, none or spaces included: what it touches is no known word.
_ANY = "\0"
#: Words too common to tell texts apart; numbers are left out with them.
_COMMON = set(
    "a all an and any are as at be been but by can could do each for from had has have he her his i if in into is it its may more most must no nor not of on one only or other our out over shall she should so some such than"
    " that the their them then there these they this those to under up use used using was we were what when where which who will with without would you your".split()
)


def _spellings(parsed: list, most: int = 20_000) -> set[str]:
    """All strings a parsed pattern matches, ``_ANY`` where they are not worth spelling out."""
    out = {""}
    for op, arg in parsed:
        if op is ops.LITERAL:
            part = {chr(arg)}
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in arg):
            part = {chr(c) for _, c in arg}
        elif op is ops.BRANCH:
            part = set().union(*(_spellings(x) for x in arg[1]))
        elif op is ops.SUBPATTERN and not arg[1] and not arg[2]:
            part = _spellings(arg[3])
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, each = arg[0], arg[1], _spellings(arg[2])
            counts = range(low, high + 1) if high <= 2 else [low]
            part = {"".join(x) for k in counts for x in itertools.product(each, repeat=k)} if len(each) ** counts[-1] <= most else {_ANY}
            part |= {x + _ANY for x in part} if high > 2 else set()
        else:
            part = {_ANY}
        out = {a + b for a in out for b in part} if len(out) * len(part) <= most else {a + _ANY for a in out}
    return out


@functools.cache
def needs(pattern: str) -> list[list[str]]:
    """Sets of words: every match of the pattern has all the words of one of them.  An empty set: a match may have any words."""
    each = {frozenset(w for w in s.split(" ") if w and _ANY not in w) for s in _spellings(parser.parse(pattern))}
    telling = {frozenset(w for w in s if w not in _COMMON and not w.isdecimal()) or s for s in each}
    least = [s for s in telling if not any(o < s for o in telling)]
    return sorted(sorted(s, key=lambda w: (-len(w), w)) for s in least)


def numbered(pattern: str) -> str:
    """A pattern over words that each have a tilde and a number behind them; a match ends with the number of its last word."""
    between = r"~\d++ "
    own = pattern.replace(r"\S", "[^ ~]").replace(" ?", "\0").replace(" ]", "\1").replace("[^ ~]", "\2").replace(" ", between)
    return rf"(?<= )(?:{own})~\d++".replace("\0", f"(?:{between})?").replace("\1", " ]").replace("\2", "[^ ~]")


def _quoted(x: object) -> str:
    if isinstance(x, list):
        return f"array({', '.join(map(_quoted, x))})" if x else "cast(array() as array<string>)"
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{x}D" if isinstance(x, float) else str(x)


def heads(sets: list[list[str]]) -> list[str]:
    """A few words of which every set has one, the most common among the sets first; none if a set is empty."""
    out, rest = [], [set(s) for s in sets]
    while rest and all(rest):
        count = collections.Counter(w for s in rest for w in s)
        out.append(min(count, key=lambda w: (-count[w], w)))
        rest = [s for s in rest if out[-1] not in s]
    return [] if rest else out


def _active(found: Sequence[Rule]) -> Column:
    """The rules that may match: those that a word of ``present`` leads to, and of which all words of a spelling are there."""
    named, by_word, always = ("label", "needs", "pattern", "priority", "sure"), {}, []
    structs = []
    for i, (label, pattern, priority, sure) in enumerate(found):
        values = (label, needs(pattern), numbered(pattern), priority, sure)
        structs.append("named_struct(" + ", ".join(f"'{k}', {_quoted(v)}" for k, v in zip(named, values, strict=True)) + ")")
        for w in heads(values[1]):
            by_word.setdefault(w, []).append(i)
        if not heads(values[1]):
            always.append(i)
    ints = lambda x: f"array({', '.join(map(str, x))})" if x else "cast(array() as array<int>)"
    index = f"map({', '.join(f'{_quoted(w)}, {ints(x)}' for w, x in sorted(by_word.items()))})" if by_word else "cast(map() as map<string, array<int>>)"
    led = f"array_sort(array_distinct(concat({ints(always)}, flatten(transform(present, k -> coalesce(try_element_at({index}, k), {ints([])}))))))"
    return F.expr(f"filter(transform({led}, i -> array({', '.join(structs)})[i]), r -> exists(r.needs, s -> forall(s, k -> array_contains(present, k))))")


_NONE = "cast(array() as array<struct<lo: int, hi: int, priority: int, label: string, sure: double>>)"
#: The intervals of all matches, in words, the last one included.
_MATCHES = r"""flatten(transform(active, r -> transform(regexp_extract_all(joined, r.pattern, 0), h ->
    named_struct('lo', int(regexp_extract(h, '~(\\d+)', 1)), 'hi', int(regexp_extract(h, '~(\\d+)$', 1)), 'priority', r.priority, 'label', r.label, 'sure', r.sure))))"""
#: In the order of starts, longer first, then higher priorities: one is suppressed if an interval kept so far, of its priority or a higher one, reaches its end.
_ORDER = "(a, b) -> case when a.lo <> b.lo then a.lo - b.lo when a.hi <> b.hi then b.hi - a.hi when a.priority <> b.priority then b.priority - a.priority when a.label < b.label then -1 when a.label > b.label then 1 else 0 end"
_KEPT = f"""aggregate(array_sort(found, {_ORDER}),
    named_struct('labels', cast(array() as array<string>), 'sure', 0D, 'e1', -1, 'e2', -1, 'e3', -1),
    (s, d) -> if(d.hi <= case d.priority when 1 then s.e1 when 2 then s.e2 else s.e3 end, s,
        named_struct('labels', array_union(s.labels, array(d.label)), 'sure', greatest(s.sure, d.sure), 'e1', greatest(s.e1, d.hi),
            'e2', if(d.priority >= 2, greatest(s.e2, d.hi), s.e2), 'e3', if(d.priority >= 3, greatest(s.e3, d.hi), s.e3))))"""


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: Sequence[Rule] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, rule_labels, detections, score`` of each row.

    ``n_base``: places where the words of a base phrase stand together, ``first_word`` and ``last_word`` the least and
    greatest of their first words, null if there is none; labels are sorted arrays; ``detections``: the matches of all rules before
    suppression, ``lo`` and ``hi`` their first and last words.  ``score``: the highest confidence of what is kept, 0.9 at least where there is a base phrase, 0 for nothing.

    A null or empty text has no words and nothing is found; an empty table gives none.  Ids may be null or repeat; other columns are not read.
    """
    table = rules() if found is None else found
    keys = sorted({k for r in table for s in needs(r[1]) for k in s} | {w for phrase in BASE for w in phrase})
    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w"))
    rows = rows.select("doc_id", "w", F.array_intersect("w", F.array(*map(F.lit, keys))).alias("present"))
    places = []
    for phrase, label in BASE.items():
        gate = " and ".join(f"array_contains(present, '{w}')" for w in phrase)
        same = " and ".join(f"w[i + {k}] = '{w}'" for k, w in enumerate(phrase))
        places.append(f"if({gate} and size(w) >= {len(phrase)}, transform(filter(sequence(0, greatest(size(w) - {len(phrase)}, 0)), i -> {same}), i -> named_struct('at', i, 'label', '{label}')), cast(array() as array<struct<at: int, label: string>>))")
    rows = rows.withColumn("base", F.expr(f"concat({', '.join(places)})"))
    free = any(not heads(needs(r[1])) for r in table)  # a rule that needs no word runs on every text
    ready = rows.withColumn("active", F.when(F.lit(free) | (F.size("present") > 0), _active(table)))
    # Spaces at both ends, so that every word of a match has one before it.
    joined = F.concat(F.lit(" "), F.array_join(F.transform("w", lambda x, i: F.concat(x, F.lit("~"), i.cast("string"))), " "), F.lit(" "))
    ready = ready.select("doc_id", F.size("w").cast("long").alias("n_words"), "base", "active", F.when(F.size("active") > 0, joined).alias("joined"))
    seen = ready.select("doc_id", "n_words", "base", F.expr(f"if(size(active) > 0, {_MATCHES}, {_NONE})").alias("found"))
    kept = seen.withColumn("kept", F.expr(_KEPT))
    return kept.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").cast("long").alias("first_word"),
        F.array_max("base.at").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("base.label")).alias("base_labels"),
        F.array_sort("kept.labels").alias("rule_labels"),
        F.col("found").alias("detections"),
        F.greatest(F.col("kept.sure"), F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"),
    )
