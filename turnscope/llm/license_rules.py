"""Signature rules of the license scan, in order.

Patterns run on text with A-Z lower-cased; a blank stands for any run of white space. Every rule has a literal
keyword that each of its matches contains once runs of white space are one blank, so a text without the keyword skips
the rule's regex.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: str


#: label | keyword | pattern of the license's name, most specific first within a family.
NAMES = r"""
agpl-3.0-or-later | affero | gnu affero general public licen[sc]e,? (?:as published .{0,80}?)?(?:either )?version 3(?:\.0)?(?: of the licen[sc]e)?,? or (?:\(at your option\) )?any later version
agpl-3.0 | affero | gnu affero general public licen[sc]e,? (?:version |v\.? ?)?3(?:\.0)?
agpl-1.0 | affero | affero general public licen[sc]e,? (?:version |v\.? ?)?1(?:\.0)?
agpl | affero | (?:gnu )?affero general public licen[sc]e
agpl | agpl | \bagpl(?:[ -]?v?[123](?:\.0)?)?\+?(?![a-z0-9])
lgpl-3.0 | lesser | (?:gnu )?lesser general public licen[sc]e,? (?:version |v\.? ?)?3(?:\.0)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public licen[sc]e,? (?:version |v\.? ?)?2\.1
lgpl-2.0 | library general | (?:gnu )?library general public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?
lgpl | lesser | (?:gnu )?lesser general public licen[sc]e
lgpl | library general | (?:gnu )?library general public licen[sc]e
lgpl-3.0 | lgpl | \blgpl[ -]?v?3(?:\.0)?\+?(?![a-z0-9])
lgpl-2.1 | lgpl | \blgpl[ -]?v?2\.1\+?(?![a-z0-9])
lgpl | lgpl | \blgpl(?![a-z0-9])
gpl-3.0-or-later | general public | (?:gnu )?general public licen[sc]e,? (?:either )?(?:version |v\.? ?)3(?:\.0)?(?: of the licen[sc]e)?,? or (?:\(at your option\) )?any later version
gpl-2.0-or-later | general public | (?:gnu )?general public licen[sc]e,? (?:either )?(?:version |v\.? ?)2(?:\.0)?(?: of the licen[sc]e)?,? or (?:\(at your option\) )?any later version
gpl-3.0 | general public | (?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)?3(?:\.0)?(?![0-9])
gpl-2.0 | general public | (?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?(?![0-9])
gpl-1.0 | general public | (?:gnu )?general public licen[sc]e,? (?:version |v\.? ?)?1(?:\.0)?(?![0-9])
gpl | general public | gnu general public licen[sc]e
gpl-3.0 | gpl | \bgpl[ -]?v?3(?:\.0)?\+?(?![a-z0-9])
gpl-2.0 | gpl | \bgpl[ -]?v?2(?:\.0)?\+?(?![a-z0-9])
gpl-classpath | classpath exception | gpl.{0,40}classpath exception
gfdl-1.3 | documentation licen | (?:gnu )?free documentation licen[sc]e,? (?:version |v\.? ?)?1\.3
gfdl-1.2 | documentation licen | (?:gnu )?free documentation licen[sc]e,? (?:version |v\.? ?)?1\.2
gfdl | documentation licen | (?:gnu )?free documentation licen[sc]e
apache-2.0 | apache | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?2(?:\.0)?(?![0-9])
apache-2.0 | apache | \bapache[ -]?(?:v\.? ?)?2\.0(?![0-9])
apache-1.1 | apache | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.1
apache-1.0 | apache | apache (?:software )?licen[sc]e,? (?:version |v\.? ?)?1\.0
apache | apache | apache (?:software )?licen[sc]e
mit-0 | mit no attribution | mit no attribution(?: licen[sc]e)?
mit | mit | \b(?:the )?mit(?:/expat)? licen[sc]e
mit | expat | \bexpat licen[sc]e
x11 | x11 | \b(?:the )?x11 licen[sc]e
bsd-4-clause | 4-clause | \b4-clause bsd(?: licen[sc]e)?
bsd-4-clause | bsd | \b(?:original|old) bsd licen[sc]e
bsd-3-clause | 3-clause | \b3-clause bsd(?: licen[sc]e)?
bsd-3-clause | bsd | \bbsd[ -]3[ -]clause(?: licen[sc]e)?
bsd-3-clause | bsd | \b(?:new|revised|modified) bsd licen[sc]e
bsd-2-clause | 2-clause | \b2-clause bsd(?: licen[sc]e)?
bsd-2-clause | bsd | \bbsd[ -]2[ -]clause(?: licen[sc]e)?
bsd-2-clause | bsd | \b(?:simplified|freebsd) bsd licen[sc]e
bsd-1-clause | bsd | \bbsd[ -]1[ -]clause(?: licen[sc]e)?
bsd-0-clause | bsd | \b(?:zero[ -]clause bsd|0bsd|bsd zero[ -]clause)(?: licen[sc]e)?
bsd | bsd | \bbsd(?:[ -]style)? licen[sc]e
isc | isc | \bisc licen[sc]e
mpl-2.0 | mozilla | mozilla public licen[sc]e,? (?:version |v\.? ?)?2\.0
mpl-1.1 | mozilla | mozilla public licen[sc]e,? (?:version |v\.? ?)?1\.1
mpl-1.0 | mozilla | mozilla public licen[sc]e,? (?:version |v\.? ?)?1\.0
mpl | mozilla | mozilla public licen[sc]e
mpl-2.0 | mpl | \bmpl[ -]?(?:v\.? ?)?2(?:\.0)?(?![a-z0-9])
epl-2.0 | eclipse | eclipse public licen[sc]e,? (?:- |version |v\.? ?)*2\.0
epl-1.0 | eclipse | eclipse public licen[sc]e,? (?:- |version |v\.? ?)*1\.0
epl | eclipse | eclipse public licen[sc]e
edl-1.0 | eclipse | eclipse distribution licen[sc]e
cddl-1.1 | common development | common development and distribution licen[sc]e,? (?:version |v\.? ?)?1\.1
cddl-1.0 | common development | common development and distribution licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?
cpl-1.0 | common public | common public licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?
cpal-1.0 | common public attribution | common public attribution licen[sc]e
ipl-1.0 | ibm public | ibm public licen[sc]e
eupl-1.2 | european union public | european union public licen[sc]e,? (?:version |v\.? ?)?1\.2
eupl-1.1 | european union public | european union public licen[sc]e,? (?:version |v\.? ?)?1\.1
eupl | european union public | european union public licen[sc]e
eupl | eupl | \beupl(?![a-z0-9])
cecill | cecill | \bcecill(?:-(?:b|c|2\.1))?(?![a-z0-9])
artistic-2.0 | artistic | artistic licen[sc]e,? (?:version |v\.? ?)?2\.0
artistic-1.0 | artistic | artistic licen[sc]e(?:,? (?:version |v\.? ?)?1\.0)?
zlib | zlib | \bzlib(?:/libpng)? licen[sc]e
libpng | libpng | \blibpng licen[sc]e
boost-1.0 | boost | boost software licen[sc]e(?:,? (?:- )?(?:version |v\.? ?)?1\.0)?
unlicense | unlicense | \b(?:the )?unlicense(?![a-z0-9])
wtfpl | what the fuck | do what the fuck you want to public licen[sc]e
wtfpl | wtfpl | \bwtfpl(?![a-z0-9])
beerware | beer | \bbeer-?ware licen[sc]e
psf-2.0 | python | python software foundation licen[sc]e(?: version 2)?
python-2.0 | python | python licen[sc]e,? (?:version |v\.? ?)?2\.0
php-3.01 | php | \bphp licen[sc]e,? (?:version |v\.? ?)?3\.01
php-3.0 | php | \bphp licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)?
ruby | ruby | \bruby licen[sc]e
postgresql | postgresql | postgresql licen[sc]e
openssl | openssl | openssl licen[sc]e
openldap | openldap | openldap public licen[sc]e
ofl-1.1 | open font | (?:sil )?open font licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)?
upl-1.0 | universal permissive | universal permissive licen[sc]e
ms-pl | microsoft public | microsoft public licen[sc]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e
afl-3.0 | academic free | academic free licen[sc]e(?:,? (?:version |v\.? ?)?3\.0)?
osl-3.0 | open software licen | open software licen[sc]e,? (?:version |v\.? ?)?3\.0
osl | open software licen | open software licen[sc]e
ecl-2.0 | educational community | educational community licen[sc]e
ncsa | ncsa | (?:university of illinois/)?ncsa open source licen[sc]e
w3c | w3c | \bw3c (?:software )?(?:notice and )?licen[sc]e
unicode-dfs | unicode | unicode,? inc\.? licen[sc]e agreement
unicode | unicode | unicode licen[sc]e
curl | curl | \bcurl licen[sc]e
ijg | independent jpeg | independent jpeg group
icu | icu | \bicu licen[sc]e
vim | vim | \bvim licen[sc]e
tcl | tcl | \btcl/tk licen[sc]e
qpl-1.0 | q public | \bq public licen[sc]e
sleepycat | sleepycat | sleepycat licen[sc]e
zpl-2.1 | zope | zope public licen[sc]e
lppl-1.3c | latex project | latex project public licen[sc]e
ncbi-pd | public domain notice | united states government work.{0,80}public domain notice
blueoak-1.0.0 | blue oak | blue oak model licen[sc]e
mulan-psl-2.0 | mulan | mulan permissive software licen[sc]e
sspl-1.0 | server side public | server side public licen[sc]e
busl-1.1 | business source | business source licen[sc]e(?:,? (?:version |v\.? ?)?1\.1)?
elastic-2.0 | elastic | elastic licen[sc]e,? (?:version |v\.? ?)?2\.0
polyform | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter) licen[sc]e
commons-clause | commons clause | commons clause(?: licen[sc]e condition)?
parity | parity | parity public licen[sc]e
hippocratic | hippocratic | hippocratic licen[sc]e
json | json | \bjson licen[sc]e
openrail | rail | \b(?:creativeml )?open ?rail(?:-[a-z]+)?(?: licen[sc]e)?
openrail | responsible ai | responsible ai licen[sc]e
llama-community | community licen | llama [0-9.]* ?community licen[sc]e
odbl-1.0 | open database | open (?:data commons )?open database licen[sc]e
odbl-1.0 | open database | open database licen[sc]e
odc-by-1.0 | open data commons | open data commons attribution licen[sc]e
pddl-1.0 | open data commons | open data commons public domain dedication
cdla-permissive | community data | community data licen[sc]e agreement ?[-–] ?permissive
cdla-sharing | community data | community data licen[sc]e agreement ?[-–] ?sharing
ogl-uk-3.0 | open government | open government licen[sc]e,? (?:version |v\.? ?)?3\.0
ogl | open government | open government licen[sc]e
cc0-1.0 | cc0 | \bcc0(?:[ -]1\.0)?(?: universal)?(?![a-z0-9])
cc-pdm | public domain mark | public domain mark(?: 1\.0)?
cc-by-nc-nd | creative commons | creative commons attribution[ -]non-?commercial[ -]no-?deriv(?:ative)?s(?:[ -][0-9.]+)?
cc-by-nc-sa | creative commons | creative commons attribution[ -]non-?commercial[ -]share-?alike(?:[ -][0-9.]+)?
cc-by-nc | creative commons | creative commons attribution[ -]non-?commercial(?:[ -][0-9.]+)?
cc-by-nd | creative commons | creative commons attribution[ -]no-?deriv(?:ative)?s(?:[ -][0-9.]+)?
cc-by-sa | creative commons | creative commons attribution[ -]share-?alike(?:[ -][0-9.]+)?
cc-by | creative commons | creative commons attribution(?: licen[sc]e)?(?:[ -][0-9.]+)?
creative-commons | creative commons | creative commons(?: licen[sc]e)?
cc-by-nc-nd | nc-nd | \bcc[ -]by-nc-nd(?:[ -][0-9.]+)?
cc-by-nc-sa | nc-sa | \bcc[ -]by-nc-sa(?:[ -][0-9.]+)?
cc-by-nc | by-nc | \bcc[ -]by-nc(?:[ -][0-9.]+)?(?![a-z-])
cc-by-nd | by-nd | \bcc[ -]by-nd(?:[ -][0-9.]+)?
cc-by-sa | by-sa | \bcc[ -]by-sa(?:[ -][0-9.]+)?
"""

#: label | keyword | signature of a license's own text or notice.
TEXTS = r"""
apache-2.0 | apache.org/licenses | https?://(?:www\.)?apache\.org/licenses/license-2\.0
apache-2.0 | limitations under the license | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | without warranties or conditions | without warranties or conditions of any kind,? either express or implied
mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit | portions of the software | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/mit(?:-license)?
isc | permission to use, copy | permission to use, copy, modify,? and/or distribute this software for any purpose with or without fee is hereby granted
bsd | redistribution and use | redistribution and use in source and binary forms,? with or without modification,? are permitted
bsd-3-clause | endorse or promote | neither the name of .{1,120}? may be used to endorse or promote products derived from this software
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
bsd-2-clause | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/bsd-2-clause
bsd-3-clause | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/bsd-3-clause
gpl | free software foundation | you can redistribute it and/or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation
lgpl | free software foundation | under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation
agpl | free software foundation | under the terms of the gnu affero general public licen[sc]e as published by the free software foundation
gpl | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/gpl(?:-[0-9.]+)?
lgpl | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/lgpl(?:-[0-9.]+)?
agpl | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/agpl(?:-[0-9.]+)?
gfdl | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/fdl(?:-[0-9.]+)?
gpl | gnu.org/copyleft | https?://(?:www\.)?gnu\.org/copyleft/gpl
mpl-2.0 | mozilla.org/mpl | https?://(?:www\.)?mozilla\.org/mpl/2\.0
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public licen[sc]e
epl-2.0 | eclipse.org/legal | https?://(?:www\.)?eclipse\.org/legal/epl-(?:2\.0|v20)
epl-1.0 | eclipse.org/legal | https?://(?:www\.)?eclipse\.org/legal/epl-v10
boost-1.0 | boost.org | https?://(?:www\.)?boost\.org/license_1_0
unlicense | unlicense.org | https?://(?:www\.)?unlicense\.org
unlicense | released into the public domain | this is free and unencumbered software released into the public domain
zlib | altered source versions | altered source versions must be plainly marked as such
wtfpl | wtfpl.net | https?://(?:www\.)?wtfpl\.net
ofl-1.1 | scripts.sil.org | https?://scripts\.sil\.org/ofl
cc0-1.0 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0
cc-pdm | creativecommons.org | https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0
cc-by-nc-nd | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/[0-9.]+
cc-by-nc-sa | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/[0-9.]+
cc-by-nc | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nc/[0-9.]+
cc-by-nd | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nd/[0-9.]+
cc-by-sa | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-sa/[0-9.]+
cc-by | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by/[0-9.]+
public-domain | public domain | (?:dedicated|released|placed|donated) (?:in)?to the public domain
public-domain | public domain | (?:is|are) in the public domain
proprietary | proprietary | (?:proprietary and confidential|confidential and proprietary)
proprietary | written permission | no part of this .{1,60}? may be reproduced .{0,120}?without .{0,40}?written permission
proprietary | unauthorized | unauthorized (?:copying|use|reproduction|distribution) .{0,60}?(?:is|are) (?:strictly )?prohibited
reserved | rights reserved | (?:all|some|no) rights reserved
copyright-notice | copyright | copyright (?:\(c\)|©)? ?(?:19|20)[0-9]{2}
copyright-notice | © | © ?(?:19|20)[0-9]{2}
"""

#: SPDX identifiers that a tag may name, as label | identifier pattern.
TAGS = r"""
0bsd | 0bsd
afl-3.0 | afl-3\.0
agpl-3.0 | agpl-3\.0(?:-only|-or-later|\+)?
apache-1.1 | apache-1\.1
apache-2.0 | apache-2\.0
artistic-2.0 | artistic-2\.0
blueoak-1.0.0 | blueoak-1\.0\.0
boost-1.0 | bsl-1\.0
bsd-2-clause | bsd-2-clause(?:-[a-z]+)?
bsd-3-clause | bsd-3-clause(?:-[a-z]+)?
bsd-4-clause | bsd-4-clause(?:-[a-z]+)?
busl-1.1 | busl-1\.1
cc-by | cc-by-[0-9.]+
cc-by-nc | cc-by-nc-[0-9.]+
cc-by-nc-nd | cc-by-nc-nd-[0-9.]+
cc-by-nc-sa | cc-by-nc-sa-[0-9.]+
cc-by-nd | cc-by-nd-[0-9.]+
cc-by-sa | cc-by-sa-[0-9.]+
cc0-1.0 | cc0-1\.0
cddl-1.0 | cddl-1\.0
cddl-1.1 | cddl-1\.1
cecill | cecill-[0-9.bc]+
cpl-1.0 | cpl-1\.0
ecl-2.0 | ecl-2\.0
elastic-2.0 | elastic-2\.0
epl-1.0 | epl-1\.0
epl-2.0 | epl-2\.0
eupl-1.2 | eupl-1\.2
gfdl-1.3 | gfdl-1\.3(?:-[a-z-]+)?
gpl-2.0 | gpl-2\.0(?:-only|-or-later|\+)?
gpl-3.0 | gpl-3\.0(?:-only|-or-later|\+)?
isc | isc
lgpl-2.1 | lgpl-2\.1(?:-only|-or-later|\+)?
lgpl-3.0 | lgpl-3\.0(?:-only|-or-later|\+)?
lppl-1.3c | lppl-1\.3c
mit | mit
mit-0 | mit-0
mpl-1.1 | mpl-1\.1
mpl-2.0 | mpl-2\.0
ms-pl | ms-pl
mulan-psl-2.0 | mulanpsl-2\.0
ncsa | ncsa
odbl-1.0 | odbl-1\.0
odc-by-1.0 | odc-by-1\.0
ofl-1.1 | ofl-1\.1(?:-[a-z-]+)?
osl-3.0 | osl-3\.0
pddl-1.0 | pddl-1\.0
postgresql | postgresql
psf-2.0 | psf-2\.0
python-2.0 | python-2\.0
sspl-1.0 | sspl-1\.0
unicode-dfs | unicode-dfs-20[0-9]{2}
unlicense | unlicense
upl-1.0 | upl-1\.0
vim | vim
w3c | w3c(?:-[0-9]+)?
wtfpl | wtfpl
x11 | x11
zlib | zlib
zpl-2.1 | zpl-2\.1
"""

_GRANT = r"\b(?:licen[sc]ed|released|distributed|available|published|offered|provided|used|redistributed)(?: to you)? under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?"


def _rows(table: str) -> list[list[str]]:
    return [line.split(" | ") for line in table.strip().splitlines()]


def build() -> list[Rule]:
    """All rules in order; a higher priority suppresses what it contains.

    4: tags, 3: a license's own text and grants that name it, 2: a mention of its name.
    """
    spaced = lambda p: p.replace(" ?", r"\s?").replace(" ", r"\s+")
    rules = [Rule(label, 4, 0.99, "spdx-license-identifier", spaced(rf"spdx-license-identifier: (?:\()?{tag}(?![a-z0-9.+-])")) for label, tag in _rows(TAGS)]
    for label, keyword, pattern in _rows(TEXTS):
        weak = label in ("reserved", "copyright-notice")
        rules.append(Rule(label, 3, 0.6 if weak else 0.95, keyword, spaced(pattern)))
    for label, keyword, pattern in _rows(NAMES):
        bare = pattern.removeprefix(r"\b").removeprefix("(?:the )?")
        rules.append(Rule(label, 3, 0.97, keyword, spaced(_GRANT + f"(?:{bare})")))
    for label, keyword, pattern in _rows(NAMES):
        rules.append(Rule(label, 2, 0.8, keyword, spaced(pattern)))
    return rules
