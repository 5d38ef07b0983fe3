"""Hand-written licence signatures over words joined by single blanks.

A line of the text is: label | priority | gate words | regex; every text the regex matches holds one
of the gate words (mostly there is one only) as a whole word. What all forms of "licence" and of "licensed under" hold is
added to the gates of the rules that need them. Higher priorities say more; they decide between detections of the
same words. Regexes match whole words: blanks stand around what they match."""

from __future__ import annotations

_V = r"(?: (?:version|v))?"
_LIC = "(?:license|licence)"
_UNDER = "(?:licensed|released|distributed|available|published|provided|covered|used) (?:under|by)(?: the)?(?: terms of)?(?: the)?"

_TEXT = rf"""
mit|60|mit|mit {_LIC}
mit|90|mit|{_UNDER} mit(?: {_LIC})?
mit|95|mit|spdx {_LIC} identifier mit
mit|50|mit|mit x11(?: {_LIC})?
mit|40|mit|expat mit|mit expat
mit|80|permission|permission is hereby granted free of charge to any person obtaining a copy
mit|70|permission|the above copyright notice and this permission notice shall be included in all copies
mit-0|97|mit|spdx {_LIC} identifier mit 0
mit-0|62|mit|mit no attribution
apache-2.0|90|apache|{_UNDER} apache {_LIC}(?: version)? 2(?: 0)?
apache-2.0|75|apache|apache {_LIC}(?: version)? 2(?: 0)?
apache-2.0|70|apache|apache(?: software)? {_LIC} v2(?: 0)?
apache-2.0|70|apache|apache 2(?: 0)?
apache-2.0|95|apache|spdx {_LIC} identifier apache 2 0
apache-2.0|80|apache|www apache org licenses {_LIC} 2 0
apache-2.0|60|apache|asl 2 0 apache
apache-1.1|75|apache|apache(?: software)? {_LIC}(?: version)? 1 1
apache-1.0|75|apache|apache(?: software)? {_LIC}(?: version)? 1 0
apache|40|apache|apache(?: software)? {_LIC}
apache|70|apache|{_UNDER} apache(?: software)? {_LIC}
gpl-2.0|90|gpl|spdx {_LIC} identifier gpl 2 0(?: only)?
gpl-2.0-or-later|92|gpl|spdx {_LIC} identifier gpl 2 0 or later
gpl-3.0|90|gpl|spdx {_LIC} identifier gpl 3 0(?: only)?
gpl-3.0-or-later|92|gpl|spdx {_LIC} identifier gpl 3 0 or later
gpl-3.0|80|general|gnu general public {_LIC}{_V} 3(?: 0)?
gpl-3.0|88|general|{_UNDER} gnu general public {_LIC}{_V} 3(?: 0)?
gpl-2.0|80|general|gnu general public {_LIC}{_V} 2(?: 0)?
gpl-2.0|88|general|{_UNDER} gnu general public {_LIC}{_V} 2(?: 0)?
gpl-1.0|80|general|gnu general public {_LIC}{_V} 1(?: 0)?
gpl-3.0-or-later|89|general|gnu general public {_LIC}{_V} 3(?: 0)? or(?: at your option any)? later(?: version)?
gpl-2.0-or-later|89|general|gnu general public {_LIC}{_V} 2(?: 0)? or(?: at your option any)? later(?: version)?
gpl-3.0-or-later|86|general|either version 3 of the {_LIC} or at your option any later version.{{0,80}}? general public {_LIC}
gpl|50|general|(?:gnu )?general public {_LIC}
gpl|70|general|{_UNDER} gnu general public {_LIC}
gpl-3.0|65|gpl|gpl(?: version)? (?:v ?)?3(?: 0)?
gpl-2.0|65|gpl|gpl(?: version)? (?:v ?)?2(?: 0)?
gpl-3.0|65|gplv3|gplv3
gpl-2.0|65|gplv2|gplv2
gpl-3.0-or-later|66|gplv3|gplv3 or later
gpl-2.0-or-later|66|gplv2|gplv2 or later
gpl|45|gpl|(?:gnu )?gpl
gpl|60|gpl|{_UNDER} (?:gnu )?gpl
lgpl-2.1|80|lesser|gnu lesser general public {_LIC}{_V} 2 1
lgpl-3.0|80|lesser|gnu lesser general public {_LIC}{_V} 3(?: 0)?
lgpl-2.0|80|library|gnu library general public {_LIC}{_V} 2(?: 0)?
lgpl|60|lesser|(?:gnu )?lesser general public {_LIC}
lgpl|60|library|(?:gnu )?library general public {_LIC}
lgpl-2.1|95|lgpl|spdx {_LIC} identifier lgpl 2 1(?: only| or later)?
lgpl-3.0|95|lgpl|spdx {_LIC} identifier lgpl 3 0(?: only| or later)?
lgpl-2.1|66|lgpl|lgpl(?: version)? (?:v ?)?2 1
lgpl-3.0|66|lgpl|lgpl(?: version)? (?:v ?)?3(?: 0)?
lgpl-3.0|66|lgplv3|lgplv3
lgpl-2.1|66|lgplv2|lgplv2(?: 1)?
lgpl|46|lgpl|(?:gnu )?lgpl
agpl-3.0|80|affero|gnu affero general public {_LIC}{_V} 3(?: 0)?
agpl|60|affero|(?:gnu )?affero general public {_LIC}
agpl-3.0|95|agpl|spdx {_LIC} identifier agpl 3 0(?: only| or later)?
agpl-3.0|66|agpl|agpl(?: version)? (?:v ?)?3(?: 0)?
agpl-3.0|66|agplv3|agplv3
agpl|46|agpl|(?:gnu )?agpl
gfdl|70|documentation|gnu free documentation {_LIC}
gfdl-1.3|80|documentation|gnu free documentation {_LIC}{_V} 1 3
gfdl-1.2|80|documentation|gnu free documentation {_LIC}{_V} 1 2
gfdl|50|gfdl|(?:gnu )?gfdl
bsd-3-clause|95|bsd|spdx {_LIC} identifier bsd 3 clause
bsd-2-clause|95|bsd|spdx {_LIC} identifier bsd 2 clause
bsd-3-clause|75|bsd|(?:new|revised|modified) bsd(?: {_LIC})?
bsd-3-clause|75|bsd|(?:3|three) clause bsd(?: {_LIC})?
bsd-3-clause|75|bsd|bsd (?:3|three) clause(?: {_LIC})?
bsd-2-clause|75|bsd|(?:2|two) clause bsd(?: {_LIC})?
bsd-2-clause|75|bsd|bsd (?:2|two) clause(?: {_LIC})?
bsd-2-clause|75|bsd|(?:simplified|freebsd) bsd(?: {_LIC})?
bsd-4-clause|75|bsd|(?:4|four) clause bsd(?: {_LIC})?
bsd-4-clause|75|bsd|(?:original|old) bsd(?: {_LIC})?
bsd-0-clause|76|bsd|(?:0|zero) clause bsd(?: {_LIC})?
bsd-0-clause|76|0bsd|0bsd
bsd|50|bsd|bsd {_LIC}
bsd|55|bsd|bsd style {_LIC}
bsd|70|bsd|{_UNDER} bsd(?: {_LIC})?
bsd|60|redistributions|redistributions of source code must retain the above copyright notice
bsd|60|redistributions|redistributions in binary form must reproduce the above copyright notice
bsd|58|redistribution|redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause|78|endorse|may be used to endorse or promote products derived from this software
bsd-4-clause|79|advertising|all advertising materials mentioning features or use of this software
cc-by-4.0|85|cc|cc by 4(?: 0)?
cc-by-3.0|85|cc|cc by 3(?: 0)?
cc-by-2.5|85|cc|cc by 2 5
cc-by-2.0|85|cc|cc by 2 0
cc-by-nc|70|cc|cc by nc
cc-by-nc-4.0|86|cc|cc by nc 4(?: 0)?
cc-by-nc-3.0|86|cc|cc by nc 3(?: 0)?
cc-by-nc-2.0|86|cc|cc by nc 2(?: 0)?
cc-by-sa|70|cc|cc by sa
cc-by-sa-4.0|86|cc|cc by sa 4(?: 0)?
cc-by-sa-3.0|86|cc|cc by sa 3(?: 0)?
cc-by-sa-2.5|86|cc|cc by sa 2 5
cc-by-nd|70|cc|cc by nd
cc-by-nd-4.0|86|cc|cc by nd 4(?: 0)?
cc-by-nd-3.0|86|cc|cc by nd 3(?: 0)?
cc-by-nc-sa|72|cc|cc by nc sa
cc-by-nc-sa-4.0|87|cc|cc by nc sa 4(?: 0)?
cc-by-nc-sa-3.0|87|cc|cc by nc sa 3(?: 0)?
cc-by-nc-nd|72|cc|cc by nc nd
cc-by-nc-nd-4.0|87|cc|cc by nc nd 4(?: 0)?
cc-by-nc-nd-3.0|87|cc|cc by nc nd 3(?: 0)?
cc0-1.0|86|cc0|cc0(?: 1(?: 0)?)?
cc0-1.0|86|cc|cc 0 1 0
cc0-1.0|90|cc0|{_UNDER} cc0(?: 1 0)?
cc-by|75|attribution|creative commons attribution(?: {_LIC})?
cc-by-4.0|87|attribution|creative commons attribution 4 0(?: international)?(?: {_LIC})?
cc-by-3.0|87|attribution|creative commons attribution 3 0(?: unported)?(?: {_LIC})?
cc-by-sa|77|attribution|creative commons attribution share ?alike(?: {_LIC})?
cc-by-sa-4.0|88|attribution|creative commons attribution share ?alike 4 0(?: international)?(?: {_LIC})?
cc-by-sa-3.0|88|attribution|creative commons attribution share ?alike 3 0(?: unported)?(?: {_LIC})?
cc-by-nc|77|attribution|creative commons attribution non ?commercial(?: {_LIC})?
cc-by-nc-4.0|88|attribution|creative commons attribution non ?commercial 4 0(?: international)?(?: {_LIC})?
cc-by-nc-sa|79|attribution|creative commons attribution non ?commercial share ?alike(?: {_LIC})?
cc-by-nc-nd|79|attribution|creative commons attribution non ?commercial no ?deriv(?:s|atives)?(?: {_LIC})?
cc-by-nd|77|attribution|creative commons attribution no ?deriv(?:s|atives)?(?: {_LIC})?
cc|45|creative|creative commons(?: {_LIC})?
cc|60|creative|{_UNDER} creative commons(?: {_LIC})?
cc0-1.0|80|creative|creative commons (?:zero|public domain dedication)
cc-by|82|creativecommons|creativecommons org licenses by
cc-by-sa|83|creativecommons|creativecommons org licenses by sa
cc-by-nc|83|creativecommons|creativecommons org licenses by nc
cc-by-nd|83|creativecommons|creativecommons org licenses by nd
cc-by-nc-sa|84|creativecommons|creativecommons org licenses by nc sa
cc-by-nc-nd|84|creativecommons|creativecommons org licenses by nc nd
cc0-1.0|84|creativecommons|creativecommons org publicdomain zero(?: 1 0)?
public-domain|55|domain|public domain
public-domain|75|domain|(?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain|74|domain|in the public domain
public-domain|76|domain|public domain dedication
public-domain|74|publicdomain|creativecommons org publicdomain mark
unlicense|85|unlicense|(?:the )?unlicense
unlicense|84|unencumbered|this is free and unencumbered software
unlicense|80|unlicense|unlicense org
mpl-2.0|80|mozilla|mozilla public {_LIC}{_V} 2(?: 0)?
mpl-1.1|80|mozilla|mozilla public {_LIC}{_V} 1 1
mpl-1.0|80|mozilla|mozilla public {_LIC}{_V} 1 0
mpl|60|mozilla|mozilla public {_LIC}
mpl-2.0|95|mpl|spdx {_LIC} identifier mpl 2 0
mpl-2.0|70|mpl|mpl(?: v)? 2(?: 0)?
mpl-1.1|70|mpl|mpl(?: v)? 1 1
mpl-2.0|82|mozilla|subject to the terms of the mozilla public {_LIC}
epl-2.0|80|eclipse|eclipse public {_LIC}{_V} 2(?: 0)?
epl-1.0|80|eclipse|eclipse public {_LIC}{_V} 1(?: 0)?
epl|60|eclipse|eclipse public {_LIC}
epl-2.0|70|epl|epl 2 0
epl-1.0|70|epl|epl 1 0
edl-1.0|75|eclipse|eclipse distribution {_LIC}
cddl-1.0|80|cddl|cddl(?: v)? 1 0
cddl-1.1|80|cddl|cddl(?: v)? 1 1
cddl|60|cddl|cddl
cddl|65|distribution|common development and distribution {_LIC}
cpl-1.0|70|common|common public {_LIC}
cpal-1.0|70|attribution|common public attribution {_LIC}
ipl-1.0|70|ibm|ibm public {_LIC}
isc|75|isc|isc {_LIC}
isc|90|isc|{_UNDER} isc(?: {_LIC})?
isc|95|isc|spdx {_LIC} identifier isc
isc|72|permission|permission to use copy modify and or distribute this software for any purpose
zlib|75|zlib|zlib {_LIC}
zlib|76|zlib|zlib libpng {_LIC}
zlib|95|zlib|spdx {_LIC} identifier zlib
zlib|70|misrepresented|the origin of this software must not be misrepresented
libpng|72|libpng|libpng {_LIC}
bsl-1.0|80|boost|boost software {_LIC}(?:{_V} 1(?: 0)?)?
bsl-1.0|95|bsl|spdx {_LIC} identifier bsl 1 0
busl-1.1|82|business|business source {_LIC}(?:{_V} 1 1)?
sspl-1.0|82|sspl sspl1|sspl(?: v)?(?: ?1)?
sspl-1.0|82|server|server side public {_LIC}
elastic-2.0|82|elastic|elastic {_LIC}(?: (?:v ?)?2(?: 0)?)?
artistic-2.0|80|artistic|artistic {_LIC}{_V} 2(?: 0)?
artistic-1.0|80|artistic|artistic {_LIC}{_V} 1(?: 0)?
artistic|60|artistic|artistic {_LIC}
artistic|61|perl|same terms as perl itself
wtfpl|85|wtfpl|wtfpl
wtfpl|84|fuck|do what the fuck you want to public {_LIC}
beerware|80|beerware|beerware(?: {_LIC})?
beerware|79|ware|beer ware(?: {_LIC})?
eupl-1.2|80|eupl|eupl(?: v)? 1 2
eupl-1.1|80|eupl|eupl(?: v)? 1 1
eupl|60|eupl|eupl
eupl|65|union|european union public {_LIC}
ofl-1.1|82|sil|sil open font {_LIC}(?:{_V} 1 1)?
ofl-1.1|70|ofl|ofl 1 1
ofl-1.1|60|font|open font {_LIC}
odbl-1.0|80|database|open database {_LIC}
odbl-1.0|75|odbl|odbl(?: 1 0)?
odc-by-1.0|75|odc|odc by(?: 1 0)?
odc-by-1.0|78|commons|open data commons attribution {_LIC}
pddl-1.0|75|pddl|pddl(?: 1 0)?
pddl-1.0|78|commons|open data commons public domain dedication
ogl-3.0|78|government|open government {_LIC}(?:{_V} 3(?: 0)?)?
cdla-permissive|75|cdla|cdla permissive(?: (?:1|2) 0)?
cdla-sharing|75|cdla|cdla sharing(?: 1 0)?
psf-2.0|78|python|python software foundation {_LIC}
psf-2.0|76|psf|psf {_LIC}
python-2.0|77|python|python 2 0 {_LIC}
ruby|70|ruby|ruby {_LIC}
php-3.01|75|php|php {_LIC}(?:{_V} 3(?: 01)?)?
openssl|75|openssl|openssl {_LIC}
ssleay|74|ssleay|ssleay {_LIC}
ncsa|75|ncsa|(?:university of illinois )?ncsa open source {_LIC}
ms-pl|78|microsoft|microsoft public {_LIC}
ms-rl|78|microsoft|microsoft reciprocal {_LIC}
ms-pl|76|pl|ms pl
upl-1.0|78|universal|universal permissive {_LIC}
afl-3.0|76|academic|academic free {_LIC}(?:{_V} 3(?: 0)?)?
osl-3.0|76|open|open software {_LIC}(?:{_V} 3(?: 0)?)?
ecl-2.0|76|educational|educational community {_LIC}(?:{_V} 2(?: 0)?)?
postgresql|76|postgresql|postgresql {_LIC}
vim|70|vim|vim {_LIC}
w3c|76|w3c|w3c software(?: notice and)? {_LIC}
curl|70|curl|curl {_LIC}
unicode|76|unicode|unicode(?: inc)? {_LIC}(?: agreement)?
x11|70|x11|x11 {_LIC}
icu|70|icu|icu {_LIC}
jquery|60|jquery|jquery {_LIC}
json|74|evil|the software shall be used for good not evil
openrail|76|openrail|(?:creativeml )?openrail(?: m)?
llama|76|llama|llama(?: (?:2|3))? community {_LIC}(?: agreement)?
gemma|70|gemma|gemma terms of use
proprietary|60|proprietary|proprietary(?: and confidential)?
proprietary|70|proprietary|proprietary {_LIC}
proprietary|72|confidential|(?:strictly )?confidential and proprietary
proprietary|71|unauthorized|unauthorized (?:copying|reproduction|distribution|use)(?: of this (?:file|material|document))?
proprietary|70|permission|(?:may not|must not|not to) be (?:reproduced|copied|distributed|used)(?: or (?:reproduced|copied|distributed|used))? without(?: the)?(?: prior)?(?: express)?(?: written)? permission
proprietary|69|reproduced|no part of this (?:publication|book|document|work) may be reproduced
reserved|50|reserved|all rights reserved
reserved|52|reserved|(?:alle rechte|todos los derechos|tous droits|tutti i diritti) (?:vorbehalten |reservados )?reserved
reserved|51|reserved|some rights reserved
reserved|50|vorbehalten|alle rechte vorbehalten
reserved|50|reservados|todos los derechos reservados
reserved|50|réservés|tous droits réservés
copyright|30|copyright|copyright(?: c)?(?: [12][0-9]{{3}})+
copyright|20|copyright copyrighted|copyrighted|copyright
free-use|40|freely|may be freely (?:used|copied|distributed|reproduced)
free-use|40|freely|freely (?:available|distributable|redistributable)
personal-use|55|personal private|for (?:personal|private)(?: and non ?commercial)? use only
non-commercial|55|commercial|(?:for )?non commercial (?:use|purposes)(?: only)?
non-commercial|54|noncommercial|(?:for )?noncommercial (?:use|purposes)(?: only)?
research-only|56|research academic|for (?:academic|research)(?: and educational)? (?:use|purposes) only
educational-use|55|educational|for educational (?:use|purposes)(?: only)?
editorial-use|55|editorial|for editorial use only
fair-use|50|fair|fair use(?: notice)?
royalty-free|50|royalty|royalty free
crown-copyright|60|crown|crown copyright
dual|58|dual|dual {_LIC}
dual|58|dual|dual licensed
no-derivatives|54|derivatives|no derivatives
share-alike|54|alike|share alike
no-warranty|35|warranty|(?:provided )?as is without warranty of any kind
no-warranty|34|warranty|without any warranty
trademark|30|trademark|(?:registered )?trademark of
patent|30|patent|patent pending
commercial-license|52|commercial|commercial {_LIC}
open-source|35|open|open source {_LIC}
open-source|40|osi|osi approved
see-license|25|license licence|see(?: the)? {_LIC}(?: file)?(?: for details)?
spdx|48|spdx|spdx {_LIC} identifier [^ ]+
terms|25|terms|terms (?:of use|of service|and conditions)
cc-by-nc|90|cc|{_UNDER} cc by nc
cc-by-nc-4.0|91|cc|{_UNDER} cc by nc 4(?: 0)?
cc-by|89|cc|{_UNDER} cc by
cc-by-4.0|92|cc|{_UNDER} cc by 4(?: 0)?
cc-by-sa|90|cc|{_UNDER} cc by sa
cc-by-sa-4.0|91|cc|{_UNDER} cc by sa 4(?: 0)?
cc-by-nc-sa-4.0|93|cc|{_UNDER} cc by nc sa 4(?: 0)?
cc-by-nc-nd-4.0|93|cc|{_UNDER} cc by nc nd 4(?: 0)?
mpl-2.0|90|mozilla|{_UNDER} mozilla public {_LIC}{_V} 2(?: 0)?
epl-2.0|90|eclipse|{_UNDER} eclipse public {_LIC}{_V} 2(?: 0)?
lgpl|72|lesser|{_UNDER} gnu lesser general public {_LIC}
agpl|72|affero|{_UNDER} gnu affero general public {_LIC}
"""


#: Words of which a text must hold one, for rules that need "licence", or "licensed under" and such.
_LIC_WORDS = ("license", "licence")
_UNDER_WORDS = ("licensed", "released", "distributed", "available", "published", "provided", "covered", "used")


def rules() -> list[tuple[str, int, tuple[tuple[str, ...], ...], str]]:
    """(label, priority, gates, regex) of each rule; of each gate a text must hold one word."""
    out = []
    for line in _TEXT.strip().splitlines():
        label, priority, gate, regex = line.split("|", 3)
        gates = [tuple(gate.split())]
        if _LIC in regex.replace(f"(?: {_LIC})?", ""):
            gates.append(_LIC_WORDS)
        if _UNDER in regex:
            gates.append(_UNDER_WORDS)
        out.append((label, int(priority), tuple(gates), f"(?:{regex})"))
    return out


RULES = rules()
